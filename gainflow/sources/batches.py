"""Sources that Spark has no reader for: edge matrices in Arrow files, a partition a record batch, and archives of count matrices, a partition a member.

Paths are read by every task, so they must be in a folder that the driver and all executors share. Filters that a source takes over
prune what a task reads or keeps; Spark applies all others. Switch them on with :func:`register`.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
import tarfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    found = sorted(glob.glob(os.path.join(path, "*"))) if os.path.isdir(path) else sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return [f for f in found if os.path.isfile(f) and not os.path.basename(f).startswith(("_", "."))]


@dataclass
class Part(InputPartition):
    """A record batch of a file, or the bytes of an archive's member."""

    path: str
    name: str = ""
    at: int = 0
    size: int = 0


class _Floors(DataSourceReader):
    """Takes over lower bounds of one numeric column, and an equality of a text column."""

    number, text = "weight", ""

    def __init__(self, options: dict[str, str]):
        self.path, self.least, self.above, self.only = options["path"], None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == (self.number,):
                self.least = f.value if self.least is None else max(self.least, f.value)
            elif isinstance(f, GreaterThan) and f.attribute == (self.number,):
                self.above = f.value if self.above is None else max(self.above, f.value)
            elif isinstance(f, EqualTo) and f.attribute == (self.text,) and self.only in (None, f.value):
                self.only = f.value
            else:
                yield f

    def keeps(self, x: float) -> bool:
        return (self.least is None or x >= self.least) and (self.above is None or x > self.above)


class _ArrowReader(_Floors):
    def partitions(self) -> list[InputPartition]:
        import pyarrow as pa

        out = []
        for f in _files(self.path):
            with pa.memory_map(f) as m:
                out += [Part(f, at=i) for i in range(pa.ipc.open_file(m).num_record_batches)]  # the file's footer alone
        return out

    def read(self, part: Part | None) -> Iterator:
        if part is None:  # Spark's own partition where a source has none
            return
        import pyarrow as pa
        import pyarrow.compute as pc

        with pa.memory_map(part.path) as m:
            batch = pa.ipc.open_file(m).get_batch(part.at)
        columns = {c: batch.column(next(n for n in names if n in batch.schema.names)) for c, names in ArrowEdges.NAMES.items()}
        made = pa.record_batch({c: x.cast(pa.float64() if c == "weight" else pa.int64()) for c, x in columns.items()})
        if self.least is not None:
            made = made.filter(pc.greater_equal(made.column("weight"), self.least))
        if self.above is not None:
            made = made.filter(pc.greater(made.column("weight"), self.above))
        yield made


class ArrowEdges(DataSource):
    """``pre, post, weight`` of Arrow (Feather) files; option ``path``: a file, a folder or a pattern. Takes over ``weight >=`` and ``weight >``."""

    NAMES = {"pre": ("pre", "body_pre"), "post": ("post", "body_post"), "weight": ("weight",)}

    @classmethod
    def name(cls) -> str:
        return "arrow_edges"

    def schema(self) -> str:
        return "pre long, post long, weight double"

    def reader(self, schema) -> DataSourceReader:
        return _ArrowReader(self.options)


class _ArchiveReader(_Floors):
    number, text = "n", "member"

    def partitions(self) -> list[InputPartition]:
        out = []
        for f in _files(self.path):
            with tarfile.open(f, "r:") as tar:  # the headers alone; a task goes to its member's bytes
                out += [Part(f, m.name, m.offset_data, m.size) for m in tar if m.isfile() and self.only in (None, m.name)]
        return out

    def read(self, part: Part | None) -> Iterator:
        if part is None:  # Spark's own partition where a source has none
            return
        import numpy as np
        import pyarrow as pa

        with open(part.path, "rb") as raw:
            raw.seek(part.at)
            own = io.BufferedReader(_Slice(raw, part.size))
            lines = gzip.open(own, "rt") if part.name.endswith(".gz") else io.TextIOWrapper(own)
            cells = np.array(next(lines, "").rstrip("\r\n").split("\t")[1:], dtype=object)
            for line in lines:
                gene, *counts = line.rstrip("\r\n").split("\t")
                if len(counts) != len(cells):
                    raise ValueError(f"{part.path}: {part.name}: row {gene!r} has {len(counts)} counts for {len(cells)} cells")
                n = np.array(counts, np.int64)
                keep = np.ones(len(n), bool)
                if self.least is not None:
                    keep &= n >= self.least
                if self.above is not None:
                    keep &= n > self.above
                k = int(keep.sum())
                if k:
                    yield pa.record_batch({"member": pa.array([part.name] * k), "gene": pa.array([gene] * k), "cell": pa.array(cells[keep]), "n": pa.array(n[keep])})


class _Slice(io.RawIOBase):
    """The next bytes of a file, so many."""

    def __init__(self, raw, size: int):
        self.raw, self.left = raw, size

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.raw.read(min(len(b), self.left))
        b[: len(data)] = data
        self.left -= len(data)
        return len(data)


class MatrixArchive(DataSource):
    """``member, gene, cell, n`` of the gene by cell tables (tab-separated, plain or gzip) in tar archives; option ``path``. Takes over ``n >=``, ``n >`` and ``member =``."""

    @classmethod
    def name(cls) -> str:
        return "matrix_archive"

    def schema(self) -> str:
        return "member string, gene string, cell string, n long"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``arrow_edges`` and ``matrix_archive`` formats of a session, with filters pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ArrowEdges, MatrixArchive):
        spark.dataSource.register(source)


def archive_quality(counts: DataFrame, genes_above: int = 0, umis_above: int = 0, umis_upto: int = 1 << 30, mito_upto: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Per member and cell: ``umis, genes, mito, kept``; per member and gene, among the cells kept: ``detected, cells, fraction``.

    ``counts`` may leave zeros out (``n > 0``, which the source takes over): a cell without counts isn't kept then, nor counted.
    """
    cell = counts.groupBy("member", "cell").agg(F.sum("n").alias("umis"), F.count_if(F.col("n") > 0).alias("genes"), F.sum(F.when(F.startswith("gene", F.lit("mt:")), F.col("n")).otherwise(0)).alias("mito"))
    share = F.col("mito") / F.greatest("umis", F.lit(1))
    cell = cell.withColumn("kept", (F.col("genes") > genes_above) & (F.col("umis") > umis_above) & (F.col("umis") <= umis_upto) & (share <= mito_upto))
    kept = cell.filter("kept")
    gene = counts.join(kept.select("member", "cell"), ["member", "cell"], "left_semi").groupBy("member", "gene").agg(F.count_if(F.col("n") > 0).alias("detected"))
    total = kept.groupBy("member").agg(F.count("*").alias("cells"))
    return cell, gene.join(F.broadcast(total), "member").withColumn("fraction", F.col("detected") / F.col("cells"))
