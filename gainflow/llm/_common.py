"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Internal join key of a row: two independent 64-bit hashes of its id and text.
KEY = ("__k1", "__k2")


#: Rows of an Arrow batch that carries whole texts to a Python worker: Spark's own 10,000 may be gigabytes of long texts.
TEXT_ROWS = 500

#: Rows of some 40 bytes that are broadcast; beyond, joins shuffle.
SENT = 500_000


def text_batches(df: DataFrame) -> DataFrame:
    """Keep the session's Arrow batches small, for Python stages that get whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= TEXT_ROWS:
        df.sparkSession.conf.set(name, str(TEXT_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``.

    The setting is read from the session; where it is unset, a temporary folder is set as the
    checkpoint folder if all work is done on this machine, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="gainflow-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            root = os.path.dirname(known.get())
    return f"{root.rstrip('/')}/gainflow-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small intermediate by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate by a table in the shared folder; unlike a checkpoint, which counts rows first, its last stage runs once."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sent(df: DataFrame, most: int = SENT) -> DataFrame:
    """A stored table of small rows, broadcast where it is joined if these are at most ``most``."""
    return F.broadcast(df) if df.count() <= most else df


def with_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Add the internal key columns. Rows equal in id and text get one key, and so one result."""
    i, t = F.col(id_col), F.col(text_col)
    return df.withColumns({KEY[0]: F.xxhash64(i, t), KEY[1]: F.xxhash64(t, F.lit("second"), i)})


def replace_columns(df: DataFrame, outputs: list[str], keep: list[str]) -> DataFrame:
    """Drop input columns whose names (in any case) clash with output or internal columns, but for those in ``keep``."""
    taken = {c.lower() for c in [*outputs, *KEY]}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken or c in keep])


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row: a generator stands between them and what uses them.

    Spark may put an expression in place of a column; inside a lambda it would then run once per element.
    """
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("__fixed")
    return df.select("*", made).select(*[F.col(f"`{c}`") for c in df.columns], "__fixed.*")
