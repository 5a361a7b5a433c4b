import numpy as np
from pyspark.sql import functions as F

from gainflow.llm import ann
from gainflow.llm.queries import op6_ann


def exact(rows, asks, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i in {i for i, _ in rows if asks(i)}:
        s = (x * x[ids == i][0]).sum(1)
        s[ids == i] = -np.inf
        order = np.lexsort((ids, -s))[:k]
        out[i] = [(int(ids[j]), s[j]) for j in order if s[j] > -np.inf]
    return out


def test_recall_of_the_query(spark):
    for sf in ("sf0.01", "sf0.1"):
        d = f"/root/testdata/{sf}"
        rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
        want = exact(rows, lambda i: i % 20 == 0, 20)
        got = {}
        for r in op6_ann(spark, d).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
            assert r["rank"] == len(got[r.query_id])
        assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
        hit = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
        assert hit >= 0.93, hit
        scores = {(q, i): s for q, v in want.items() for i, s in v}
        assert all(abs(s - scores[q, i]) < 1e-12 for q, v in got.items() for i, s in v if (q, i) in scores)


def test_ties_and_odd_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).tolist()) for i in range(60)] + [(i, [1.0] * 8) for i in range(100, 150)]
    rows += [(200, [5.0] * 8), (220, [-3.0] * 8)]
    odd = [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [1.0] * 3), (380, [None] + [1.0] * 7), (400, []), (None, [1.0] * 8), (420, [float("inf")] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("Score", F.lit(2))
    got = {}
    for x in ann.nearest(df, F.col("vec_id") % 20 == 0, 10).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    want = exact([(i, np.float32(v).tolist()) for i, v in rows], lambda i: i % 20 == 0, 10)
    assert set(got) == set(want)
    assert got[100] == [i for i, _ in want[100]] == [200, *range(101, 110)]
    assert np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / 10 for q in want]) > 0.9
    few = ann.nearest(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, 10).collect()
    assert [x["rank"] for x in few] == [1, 2]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    twice = ann.nearest(df.filter("vec_id in (0, 1, 2)").unionByName(df.filter("vec_id in (0, 1)")), F.col("vec_id") == 0, 10)
    assert sorted(x.vec_id for x in twice.collect()) == [1, 1, 2]
