"""Result tables, run manifests and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut


def write_rows(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """CSV in a fixed column order, NULL as the empty string, rows sorted over all files by ``order``."""
    df.select(*columns).orderBy(*order).write.mode("errorifexists").csv(path, header=True, nullValue="", emptyValue="")


def write_runs(df: DataFrame, path: str, by: list[str]) -> None:
    """JSON, one folder per cell of the design."""
    df.write.mode("errorifexists").partitionBy(*by).json(path)


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` below the folder, ``bytes`` and ``sha256`` of every file; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace("path", "^.*?" + folder.split("://")[-1].rstrip("/").replace(".", r"\.") + "/", "")
    return files.select(name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compare(then: DataFrame, now: DataFrame) -> DataFrame:
    """``path`` and whether it is same, changed, missing or extra."""
    both = then.select("path", F.col("sha256").alias("a")).join(now.select("path", F.col("sha256").alias("b")), "path", "full")
    return both.select("path", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("state"))


def digest(manifest: DataFrame) -> str:
    """One hash over the sorted lines ``path<TAB>sha256``: of block hashes of up to 4096 paths each, so no task holds them all."""
    from ..operators.stats import ordinal

    lines = ordinal(manifest, F.col("path")).withColumn("block", F.floor((F.col("ordinal") - 1) / 4096))
    line = F.struct("ordinal", F.concat_ws("\t", "path", "sha256").alias("line"))
    blocks = lines.groupBy("block").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n"), 256).alias("h"))
    # one row per 4096 files; a manifest of a billion files gives 250,000 hashes
    return blocks.orderBy("block").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), "\n"), 256)).first()[0]


#: Keys of an artifact that change from run to run and say nothing about its content.
VOLATILE = ("created_at", "elapsed_s", "generated_at", "hostname", "runtime_by_spec_s", "runtime_s", "started_at", "timestamp", "wall_s")


def stable_digests(artifacts: DataFrame, key: str, json: str, volatile: tuple[str, ...] = VOLATILE) -> DataFrame:
    """``key, digest``: SHA-256 of each artifact's JSON without its volatile keys, at whatever depth; runs that differ in those alone, or in the order of keys, agree.

    Texts become VARIANTs, whose objects and arrays are taken apart level by level into one line a value (its path and canonical text);
    an artifact's lines are sorted and hashed. A text that is no JSON is an error; NULL has no digest.
    """
    spark = artifacts.sparkSession
    rows = artifacts.filter(F.col(json).isNotNull()).select(F.col(key).alias("k"), F.lit("$").alias("path"), F.parse_json(json).alias("v"))
    lines = []
    while True:
        kind = F.regexp_extract(F.schema_of_variant("v"), "^(OBJECT|ARRAY)", 1)
        rows = rows.withColumn("kind", kind)
        own = F.when(F.col("kind") == "OBJECT", "{}").when(F.col("kind") == "ARRAY", "[]").otherwise(F.to_json("v"))
        lines.append(cut(rows.select("k", "kind", F.concat("path", F.lit("="), own).alias("line"))))
        if lines[-1].filter("kind <> ''").limit(1).count() == 0:
            break
        inner = rows.filter("kind <> ''")
        inner.createOrReplaceTempView("__artifact_level")
        each = spark.sql("SELECT k, path, e.pos, e.key, e.value FROM __artifact_level, LATERAL variant_explode(v) AS e")
        spark.catalog.dropTempView("__artifact_level")
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.to_json(F.struct("key"))))
        rows = each.filter(F.col("key").isNull() | ~F.col("key").isin(*volatile)).select("k", F.concat("path", step).alias("path"), F.col("value").alias("v"))
    every = lines[0]
    for more in lines[1:]:
        every = every.unionByName(more)
    return every.groupBy(F.col("k").alias(key)).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n").cast("binary"), 256).alias("digest"))
