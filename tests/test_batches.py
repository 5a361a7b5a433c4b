import gzip
import io
import random
import tarfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gainflow.sources import batches as B


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    folder, pick, rows = tmp_path_factory.mktemp("edges"), random.Random(1), []
    for f in range(2):
        with pa.OSFile(str(folder / f"{f}.arrow"), "wb") as out:
            schema = pa.schema([("body_pre", pa.int32()), ("body_post", pa.int64()), ("weight", pa.int32())])
            with pa.ipc.new_file(out, schema) as w:
                for _ in range(3):
                    own = [(pick.randrange(9), pick.randrange(9), pick.randrange(20)) for _ in range(50)]
                    rows += own
                    w.write_batch(pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*own), schema)], schema=schema))
    return str(folder), rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_partition_a_record_batch_and_a_pushed_floor(spark, edges):
    B.register(spark)
    folder, rows = edges
    df = spark.read.format("arrow_edges").option("path", folder).load()
    assert df.rdd.getNumPartitions() == 6 and sorted(map(tuple, df.collect())) == sorted((a, b, float(w)) for a, b, w in rows)
    heavy = df.filter("weight >= 5 and weight > 7 and pre < 4")
    assert sorted(map(tuple, heavy.collect())) == sorted((a, b, float(w)) for a, b, w in rows if w > 7 and a < 4)
    text = plan(heavy)
    left = text.split("Filter", 1)[1].split("\n")[0]
    assert "pre#" in left and "weight#" not in left.replace("isnotnull(weight#", "")  # no comparison of weights is left to Spark
    assert df.groupBy("pre").agg(F.sum("weight")).count() == len({a for a, _, _ in rows})


MATRICES = {"a.tsv.gz": (["c1", "c2", "c3"], {"mt:x": [5, 0, 0], "g": [1, 2, 0], "h": [0, 7, 0]}), "b.tsv": (["c1"], {"g": [4]}), "empty.tsv": ([], {})}


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    path = tmp_path_factory.mktemp("archive") / "all.tar"
    with tarfile.open(path, "w") as tar:
        for name, (cells, genes) in MATRICES.items():
            text = "\n".join(["\t".join(["GENE", *cells]), *("\t".join([g, *map(str, n)]) for g, n in genes.items())]) + "\n"
            data = gzip.compress(text.encode()) if name.endswith("gz") else text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return str(path)


def test_a_partition_a_member(spark, archive):
    B.register(spark)
    df = spark.read.format("matrix_archive").option("path", archive).load()
    every = {(m, g, c, n) for m, (cells, genes) in MATRICES.items() for g, own in genes.items() for c, n in zip(cells, own)}
    assert df.rdd.getNumPartitions() == 3 and set(map(tuple, df.collect())) == every
    some = df.filter("n > 0 and member = 'a.tsv.gz'")
    assert some.rdd.getNumPartitions() == 1 and set(map(tuple, some.collect())) == {x for x in every if x[3] > 0 and x[0] == "a.tsv.gz"}
    assert df.filter("member = 'none'").count() == 0


def test_quality_of_every_member(spark, archive):
    B.register(spark)
    counts = spark.read.format("matrix_archive").option("path", archive).load().filter("n > 0")
    cell, gene = B.archive_quality(counts, genes_above=0, umis_above=1, mito_upto=0.5)
    assert {(r["member"], r["cell"]): (r["umis"], r["genes"], r["mito"], r["kept"]) for r in cell.collect()} == {("a.tsv.gz", "c1"): (6, 2, 5, False), ("a.tsv.gz", "c2"): (9, 2, 0, True), ("b.tsv", "c1"): (4, 1, 0, True)}
    assert {(r["member"], r["gene"]): (r["detected"], r["cells"], r["fraction"]) for r in gene.collect()} == {("a.tsv.gz", "g"): (1, 1, 1.0), ("a.tsv.gz", "h"): (1, 1, 1.0), ("b.tsv", "g"): (1, 1, 1.0)}


def test_a_row_of_wrong_length_fails(spark, tmp_path):
    B.register(spark)
    with tarfile.open(tmp_path / "bad.tar", "w") as tar:
        data = b"GENE\tc1\tc2\ng\t1\n"
        info = tarfile.TarInfo("bad.tsv")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    with pytest.raises(Exception, match="1 counts for 2 cells"):
        spark.read.format("matrix_archive").option("path", str(tmp_path / "bad.tar")).load().collect()
