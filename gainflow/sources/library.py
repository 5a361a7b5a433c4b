"""Evidence libraries and literature files as DataFrames.

Small YAML or JSON documents are read through Spark as whole text, so any store that Spark can open
serves, parsed on the driver, and flattened into typed rows. Graph and census JSON go through
Spark's own JSON reader and are exploded there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVIDENCE = "pos long, compound string, receptor string, param_type string, relation string, value_m double, n double, direction string, efficacy double, species string, source string, evidence_tier string"
#: Documents are read on the driver up to this many bytes.
LARGEST = 16 << 20


def document(spark: SparkSession, path: str) -> Any:
    """A YAML or JSON document."""
    row = spark.read.format("binaryFile").load(path).select("length").first()
    if row["length"] > LARGEST:
        raise ValueError(f"{path} has {row['length']} bytes; documents are read up to {LARGEST}")
    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def _number(x: Any) -> float | None:
    try:
        return None if x is None or isinstance(x, bool) else float(x)
    except (TypeError, ValueError):
        return None


def evidence_rows(library: dict) -> Iterator[tuple]:
    """One row per compound and receptor. An ``ec50_M`` alias wins over ``value_M``; missing types and relations follow from whether there is a value."""
    pos = 0
    for compound, own in library.get("compounds", {}).items():
        for receptor, spec in (own.get("receptors") or {}).items():
            value = _number(spec.get("ec50_M") if spec.get("ec50_M") is not None else spec.get("value_M"))
            known = value is not None
            yield (
                pos, compound, receptor, spec.get("param_type", "EC50" if known else "unknown"), spec.get("relation", "class_extrapolation" if known else "unsupported"), value,
                float(spec.get("n", 1.0)), spec.get("direction", "none"), _number(spec.get("efficacy")), spec.get("species"), spec.get("source"), spec.get("evidence_tier", "class_placeholder"))
            pos += 1


def evidence(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(list(evidence_rows(document(spark, path))), EVIDENCE)


def dimensions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``receptor``, ``pair`` and ``compound`` tables of a library."""
    d = document(spark, path)
    return {
        "receptor": spark.createDataFrame([(k, v.get("organism"), v.get("transmitter"), v.get("family"), v.get("note")) for k, v in d.get("receptors", {}).items()], "receptor string, organism string, transmitter string, family string, note string"),
        "pair": spark.createDataFrame([(k, v.get("insect"), v.get("vertebrate")) for k, v in d.get("selectivity_pairs", {}).items()], "pair string, insect string, vertebrate string"),
        "compound": spark.createDataFrame([(k, v.get("name"), v.get("class"), v.get("cas")) for k, v in sorted(d.get("compounds", {}).items())], "compound string, name string, class string, cas string"),
    }


def compound(table: DataFrame, name: str) -> DataFrame:
    """The rows of one compound, its name trimmed and lower-cased; an unknown one is an error that lists the known."""
    key = name.strip().lower()
    out = table.filter(F.lower(F.trim("compound")) == key)
    if not out.limit(1).count():
        known = [r[0] for r in table.select("compound").distinct().orderBy("compound").limit(200).collect()]
        raise KeyError(f"no compound {name!r}; known: {', '.join(known)}")
    return out


def _entries(spark: SparkSession, rows: list[Any]) -> DataFrame:
    """Nested entries of a document as rows ``pos, entry``, each its own JSON text, for Spark's JSON functions to open."""
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "pos long, entry string")


def shifts(spark: SparkSession, path: str) -> DataFrame:
    """Fold changes of alleles, in four written shapes: a map per variant, a map per compound, ``fold_<VARIANT>`` keys, or one number.

    A shape is taken only where none before it is there. The variant of a map per compound is the first run of capitals in
    the entry's compound, else the words before a bracket.
    """
    entries = [{"own": s, "allele": {k: v for k, v in a.items() if k != "shifts"}} for a in document(spark, path).get("alleles", []) for s in a.get("shifts") or []]
    fields = "compound string, fold string, allele_variant string, metric string, assay_type string, use_as_ec50_shift string, evidence_tier string, source string, id string, per_allele_fold map<string,string>, per_compound_fold map<string,string>"
    e = _entries(spark, entries).select("pos", F.from_json(F.get_json_object("entry", "$.own"), fields).alias("s"), F.from_json(F.get_json_object("entry", "$.allele"), fields).alias("a"), F.from_json(F.get_json_object("entry", "$.own"), "map<string,string>").alias("m"))
    named = F.map_filter("m", lambda k, _: k.rlike("^fold_.+") & (k != "fold_with_PBO"))
    e = e.withColumns({"variants": F.transform_keys(named, lambda k, _: F.regexp_extract(k, "^fold_(.+)$", 1)), "per_allele": F.col("s.per_allele_fold"), "per_compound": F.col("s.per_compound_fold")})
    words = F.regexp_replace(F.trim(F.substring_index(F.coalesce("s.compound", F.lit("variant")), "(", 1)), " ", "_")
    capitals = F.regexp_extract(F.coalesce("s.compound", F.lit("")), r"\b([A-Z]{2,})\b", 1)
    kind = F.when(F.col("per_allele").isNotNull(), 1).when(F.col("per_compound").isNotNull(), 2).when(F.size("variants") > 0, 3).otherwise(4)
    e = e.withColumn("kind", kind)
    rest = ["pos", "s", "a"]
    shapes = [
        e.filter("kind = 1").select(*rest, F.col("s.compound").alias("compound"), F.explode("per_allele").alias("variant", "fold")),
        e.filter("kind = 2").select(*rest, F.when(capitals != "", capitals).otherwise(words).alias("variant"), F.explode("per_compound").alias("compound", "fold")),
        e.filter("kind = 3").select(*rest, F.col("s.compound").alias("compound"), F.explode("variants").alias("variant", "fold")),
        e.filter("kind = 4").select(*rest, F.col("s.compound").alias("compound"), F.col("s.allele_variant").alias("variant"), F.col("s.fold").alias("fold")),
    ]
    rows = shapes[0]
    for shape in shapes[1:]:
        rows = rows.unionByName(shape)
    return rows.select(
        F.col("a.id").alias("allele"), "variant", F.concat_ws(":", "a.id", "variant").alias("genotype"), "compound", F.expr("try_cast(fold AS double)").alias("fold"), F.col("s.metric").alias("metric"),
        F.coalesce("s.assay_type", "a.assay_type").alias("assay_type"), F.expr("try_cast(coalesce(s.use_as_ec50_shift, a.use_as_ec50_shift) AS boolean)").alias("use_as_ec50_shift"), F.col("s.evidence_tier").alias("evidence_tier"), F.coalesce("s.source", "a.source").alias("source"))


def genotypes(shifts_: DataFrame) -> DataFrame:
    """One row per genotype of a table of shifts: its allele, variant, number of shifts, and how many may be used as shifts of a value."""
    return shifts_.groupBy("genotype", "allele", "variant").agg(F.count("*").alias("shifts"), F.count_if(F.col("use_as_ec50_shift") & F.col("fold").isNotNull()).alias("usable"))


EXPRESSION = "superclass string, gene string, level string, fraction double, evidence_tier string"


def expression(spark: SparkSession, path: str) -> DataFrame:
    """Written expression levels per superclass and gene; empty where the document is missing or has none."""
    try:
        blocks = document(spark, path).get("by_superclass") or []
    except Exception as e:  # Spark raises its own errors for a path that isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        blocks = []
    rows = [(b.get("superclass"), str(gene), str(x.get("level") or "unknown").strip().lower(), _number(x.get("fraction_cells_expressing")), x.get("evidence_tier")) for b in blocks for gene, x in (b.get("receptors") or {}).items() if isinstance(x, dict)]
    return spark.createDataFrame(rows, EXPRESSION)


def rank_orders(spark: SparkSession, path: str) -> DataFrame:
    """Published orders: one row per entry and compound, in the written order; values and ranks that were not published stay NULL."""
    item = "array<struct<compound:string,value:double,rank:double>>"
    e = _entries(spark, document(spark, path).get("entries") or [])
    e = e.select(F.from_json("entry", f"id string, species string, readout string, units string, source string, ordered_compounds {item}").alias("x")).select("x.*")
    return e.select(F.col("id").alias("entry"), "species", "readout", "units", "source", F.posexplode("ordered_compounds").alias("pos", "o")).select("entry", "species", "readout", "units", "pos", "o.compound", "o.value", "o.rank", "source")


def published_mixtures(spark: SparkSession, path: str) -> DataFrame:
    """Published mixture results: one row per entry and partner with its interaction class."""
    e = _entries(spark, document(spark, path).get("empirical") or [])
    e = e.select(F.from_json("entry", "id string, species string, source string, results array<struct<partner:string,classification:string,library_key:string>>").alias("x")).select("x.*")
    return e.select(F.col("id").alias("entry"), "species", "source", F.inline("results"))


def leaves(document_: Any) -> Iterator[tuple[str, float]]:
    """Numbers of a document of unknown shape in written order, each with its path."""
    open_: list[tuple[str, Any]] = [("", document_)]
    while open_:
        path, x = open_.pop()
        inside = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()
        open_.extend(reversed([(f"{path}/{k}" if path else str(k), v) for k, v in inside]))
        if type(x) in (int, float):
            yield path, float(x)


def baseline(spark: SparkSession, document_: Any, context: str = "per", default: float = 0.8) -> float:
    """The first number below a key that begins with ``context`` and whose path speaks of a proportion, percents as shares; else the default."""
    rows = spark.createDataFrame([(i, *leaf) for i, leaf in enumerate(leaves(document_))], "pos long, path string, x double")
    fits = F.lower("path").rlike(f"(^|/){context}") & F.lower("path").rlike("rate|prop|fraction") & (F.col("x") > 0) & (F.col("x") <= 100)
    share = F.when(F.col("x") > 1, F.col("x") / 100).otherwise(F.col("x"))
    return rows.filter(fits).agg(F.coalesce(F.min_by(share, "pos"), F.lit(default)).alias("x")).first()["x"]


def graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``nodes``, ``edges`` and ``seeds`` of graph JSON documents; a path without files is an error, never another graph."""
    schema = "nodes array<struct<bodyId:long,type:string,superclass:string,consensus_nt:string>>, edges array<struct<pre:long,post:long,weight:double>>, seeds map<string,array<long>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    node = doc.select(F.explode("nodes").alias("x")).select(F.col("x.bodyId").alias("body_id"), "x.type", "x.superclass", F.col("x.consensus_nt").alias("nt"))
    return {"nodes": node, "edges": doc.select(F.inline("edges")), "seeds": doc.select(F.explode("seeds").alias("type", "ids")).select("type", F.explode("ids").alias("body_id"))}


def census(spark: SparkSession, path: str) -> DataFrame:
    """Transmitter counts of a census JSON document, as ``nt, cells``."""
    doc = spark.read.schema("neurotransmitter_counts map<string,long>").json(path, multiLine=True)
    return doc.select(F.explode("neurotransmitter_counts").alias("nt", "cells"))


def seed_ids(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """Bodies of the requested types: exact matches, and for a type without any, those it is a prefix of."""
    exact = nodes.join(types, "type").select("type", "body_id")
    rest = types.join(exact.select("type").distinct(), "type", "left_anti").withColumnRenamed("type", "prefix")
    near = nodes.join(F.broadcast(rest), F.startswith(F.col("type"), F.col("prefix"))).select(F.col("prefix").alias("type"), "body_id")
    return exact.unionByName(near)


def expression_matrix(spark: SparkSession, path: str, genes_above: int = 0, umis_above: int = 0, umis_upto: int = 1 << 30, mito_upto: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """From a gene by cell count table (tab-separated, header GENE first): QC per cell and detection per gene among the cells kept.

    Lines are read as text and turned long by place, so the plan has the same size for any number of cells.
    """
    line = spark.read.text(path).select(F.split("value", "\t").alias("x"))
    at = line.select(F.get("x", F.lit(0)).alias("gene"), F.posexplode(F.slice("x", F.lit(2), F.size("x"))).alias("at", "n"))
    names = at.filter("gene = 'GENE'").select("at", F.col("n").alias("cell"))
    long = at.filter("gene <> 'GENE'").join(names, "at").select("gene", "cell", F.col("n").cast("long").alias("n"))
    cell = long.groupBy("cell").agg(F.sum("n").alias("umis"), F.count_if(F.col("n") > 0).alias("genes"), F.sum(F.when(F.startswith("gene", F.lit("mt:")), F.col("n")).otherwise(0)).alias("mito"))
    share = F.col("mito") / F.greatest("umis", F.lit(1))
    cell = cell.withColumn("kept", (F.col("genes") > genes_above) & (F.col("umis") > umis_above) & (F.col("umis") <= umis_upto) & (share <= mito_upto))
    kept = cell.filter("kept").select("cell")
    gene = long.join(kept, "cell", "left_semi").groupBy("gene").agg(F.count_if(F.col("n") > 0).alias("detected"), F.count("*").alias("cells"))
    return cell, gene.withColumn("fraction", F.col("detected") / F.col("cells"))
