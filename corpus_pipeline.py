"""A corpus pipeline of five stages over the documents table.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the next one's documents. All but the last return the columns of documents, whatever these are:
they go through a stage under reserved names, so one that an operator uses too keeps its values.

Defined results, for every stage: an empty table gives an empty table; rows equal in id and text get
equal decisions, and one of them stays among near duplicates; null texts count as empty ones, and
null ids are kept; very long texts are worked on whole; ties go to the smaller id. A null or empty text
is judged by the classifier like any other, has no lines to lose, is a copy only of equally empty
ones, has no benchmark words, and has no tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gainflow.llm import bpe, decontam, linededup, minhash, quality
from gainflow.llm._common import shared_dir, table
from gainflow.llm.queries import vocabulary_path

#: SQL can't express the compression classifier, Order MinHash or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def apart(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` as they are, all else under names that no operator uses."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"__own{i}") for i, c in enumerate(docs.columns)])


def back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from what an operator made of :func:`apart`."""
    return out.select(*[F.col(f"`{c}`" if c in ("doc_id", "text") else f"__own{i}").alias(c) for i, c in enumerate(docs.columns)])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return back(quality.score(apart(docs), model).filter("predicted = 1"), docs)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier, within the edit bound; ``n_chars`` follows. A document that loses all its lines goes."""
    out = linededup.dedup_lines(apart(docs))
    out = back(out.filter((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\t\r\n", "   ")) != "")), docs)
    length = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns(length)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return back(minhash.deduplicate(apart(docs)), docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one in twenty words lie in benchmark windows."""
    return back(decontam.decontaminate(apart(docs), table(spark, sf_dir, "benchmark")), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: its number of tokens, its packed ids, and their hash; a document whose ids don't decode to its text fails."""
    out = bpe.round_trip(docs.select("doc_id", "text"), vocabulary_path())
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    ids = F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("ids do not decode to the text")).cast("binary"))
    return out.select("doc_id", "n_tokens", ids.alias("ids")).withColumn("ids_sha256", F.sha2("ids", 256))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("lines", distinct_lines),
    ("near_duplicates", distinct_documents),
    ("decontamination", uncontaminated),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
