import math
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from gainflow.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_rule(spark):
    rows = spark.range(200).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_accuracy_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    got = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter(quality.held_out(F.col("doc_id"))).toPandas()
    order = np.argsort(got.score.to_numpy(), kind="stable")
    rank = np.empty(len(got))
    rank[order] = np.arange(1, len(got) + 1)
    good = (got.quality == 1).to_numpy()
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.99 and (got.predicted == got.quality).mean() > 0.98


def test_score_against_its_definition(spark):
    """A score is the calibrated difference of the sizes that zstandard itself gives, whatever the text's length."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    good, bad = (zstandard.ZstdCompressor(level=12, write_content_size=False, write_checksum=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for d in (model.good, model.bad))
    known = {r.doc_id for r in labels.collect()}
    held = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(any(t and t.encode() in d for i, t in held.items() if i in known and zlib.crc32(str(i).encode()) % 4 != 2) for d in (model.good, model.bad))

    def definition(t):
        b = t.encode()
        x = (len(bad.compress(b)) - len(good.compress(b)) - model.neutral * len(b)) / (len(b) + quality.MORE)
        return 1 / (1 + math.exp(-model.intercept - model.slope * x))

    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(docs, model).collect()}
    want = {i: definition(t) for i, t in held.items()}
    assert all(abs(got[i][0] - x) < 1e-9 and got[i][1] == (x >= 0.7) for i, x in want.items())


def test_calibration_is_the_best_line():
    r = np.random.default_rng(1)
    x = r.normal(size=4000) * 0.01 + 0.02
    y = (r.random(4000) < 1 / (1 + np.exp(-(150 * x - 2)))).astype(float)
    a, b = quality.calibration(x, y, np.ones(4000))
    loss = lambda a, b: -np.mean(y * (a + b * x) - np.log1p(np.exp(a + b * x)))
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-6 for da in (-0.1, 0, 0.1) for db in (-5, 0, 5))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text here", 0.5), (2, "BAD!! BAD!!", 0.5), (3, None, 0.5), (4, "", 0.5), (None, "x" * 300_000, 0.5), (1, "good text here", 0.5)], "doc_id long, text string, Score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (9, 0), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if not r.text}) == 1
    assert quality.score(docs.limit(0), model).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.filter("quality = 1"))).collect()} == {1.0}
