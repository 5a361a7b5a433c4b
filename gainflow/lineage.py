"""Cutting lineage for the library's own operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A table (compressed, unlike a checkpoint) in the folder that spark.checkpoint.dir names; where it is unset and all work is done on this machine, in a temporary one."""
    spark = df.sparkSession
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (os.path.dirname(known.get()) if known.isDefined() else None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gainflow-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/gainflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
