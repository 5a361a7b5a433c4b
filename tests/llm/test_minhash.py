import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gainflow.llm import minhash as M
from gainflow.llm.components import components

SF = "/root/testdata/sf0.01"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prior = row[:]
        for j, y in enumerate(b):
            row[j + 1] = prior[j] + 1 if x == y else max(prior[j + 1], row[j])
    return row[-1]


def expected(texts):
    """Classes by comparing all pairs."""
    h = M.WordHashes()
    x = [M.shingles(M.word_hashes(t, h)) for t in texts]
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [set(s.tolist()) for s in x]
    for i in range(len(x)):
        for j in range(i):
            if x[i].size and x[j].size and M.SIMILAR <= min(len(x[i]), len(x[j])) / max(len(x[i]), len(x[j])):
                both = len(sets[i] & sets[j])
                if both / (len(x[i]) + len(x[j]) - both) >= M.SIMILAR and M.similarity(x[i], x[j])[1] >= M.SIMILAR:
                    root[max(find(i), find(j))] = min(find(i), find(j))
    same = {}
    return [find(i) if x[i].size else same.setdefault(texts[i] or "", i) for i in range(len(x))]


def test_alignment_is_the_longest_common_subsequence():
    r = random.Random(3)
    for _ in range(200):
        a = [r.randrange(60) for _ in range(r.randrange(1, 60))]
        b = a[:]
        for _ in range(r.randrange(3)):
            b[r.randrange(len(b))] = r.randrange(60)
        x, y = (M.shingles(np.array(s, np.uint64)) for s in (a, b))
        aligned = lcs(x.tolist(), y.tolist())
        true = aligned / (len(x) + len(y) - aligned)
        overlap, got = M.similarity(x, y)
        assert overlap >= true - 1e-12 and (abs(got - true) < 1e-12 if true >= M.SIMILAR else got < M.SIMILAR)


def test_corpus_against_all_pairs(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist())
    got = {r.id: r.class_id for r in M.classes(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    want = expected([t for _, t in rows])
    assert [got[i] for i, _ in rows] == [rows[k][0] for k in want]
    assert len(set(got.values())) < len(got) - 50


def test_chain_of_near_copies_and_common_passage(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    rows, w = [], base
    for i in range(12):  # a chain whose ends are unlike
        w = w[:]
        for _ in range(2):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    passage = [word() for _ in range(90)]
    rows += [(100 + i, " ".join(passage + [word() for _ in range(40)])) for i in range(120)]
    rows += [(300, rows[20][1]), (301, rows[20][1].upper()), (302, None), (303, ""), (304, " . "), (None, base and " ".join(base)), (305, "only four words here"), (306, "Only, four words here!"), (300, rows[20][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit(1)).withColumn("Node", F.lit(2)).repartition(5)
    got = {}
    for x in M.classes(df).collect():
        got.setdefault(x.id, set()).add(x.class_id)
    ids = [i for i, _ in rows]
    want = expected([t for _, t in rows])
    for i, k in zip(ids, want, strict=True):
        group = [a for a, b in zip(ids, want, strict=True) if b == k]
        assert got[i] == {min((g for g in group if g is not None), default=None)}, i
    kept = M.deduplicate(df)
    assert kept.columns == df.columns and kept.count() == len(set(want))
    assert M.classes(df.limit(0)).count() == 0


def test_large_bucket_is_finished(spark):
    """A family below the bound, all in one bucket, with near copies of single members: leaders link with nobody."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))

    def changed(w, n):
        w = w[:]
        for k in r.sample(range(len(w)), n):
            w[k] = word()
        return w

    base = [word() for _ in range(404)]
    family = [changed(base, 7) for _ in range(80)]
    texts = [" ".join(w) for w in family + [changed(w, 8) for w in family[:20]]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sig = M.signatures(df, "doc_id", "text").withColumn("bands", F.array(F.lit(1).cast("long"))).cache()
    name = {bytes(x.node): x.id for x in sig.collect()}
    found, root = M.links(df, sig, "doc_id", "text")
    want = expected(texts)
    assert len(set(want)) == 80
    assert {tuple(sorted((name[bytes(x.lead)], name[bytes(x.node)]))) for x in found.collect()} == {(k, i) for i, k in enumerate(want) if i != k}
    assert root.count() == 40


def test_pairs_in_one_large_bucket(spark):
    """Pairs just above the bound, all sharing a passage, so that they meet in buckets of hundreds of members; and a very long text."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage, texts = [word() for _ in range(260)], []
    for _ in range(100):
        w = passage + [word() for _ in range(140)]
        v = w[:]
        for k in (0, 3, 12, 24, 36, 48, 60, 72, 84):
            v[270 + k] = word()
        texts += [" ".join(w), " ".join(v)]
    want = expected(texts)
    assert want == [i - i % 2 for i in range(200)]
    h = M.WordHashes()
    a, b = (M.shingles(M.word_hashes(t, h)) for t in texts[:2])
    assert 0.8 <= M.similarity(a, b)[1] < 0.81
    long = " ".join(word() for _ in range(200_000))
    rows = [*enumerate(texts), (1000, long), (1001, long.replace(long[7000:7100], " x ")), (1002, long[:400_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {x.id: x.class_id for x in M.classes(df).collect()}
    assert got == dict(enumerate(want)) | {1000: 1000, 1001: 1000, 1002: 1002}
    sig = M.signatures(df, "doc_id", "text").cache()
    sizes = sig.filter("id < 1000").select(F.posexplode("bands").alias("band", "key")).groupBy("band", "key").count().filter("count > 64")
    assert sizes.count() > 0
    sig = sig.withColumn("bands", F.array(F.lit(1).cast("long")))  # even if all meet in one bucket only
    found, _ = M.links(df, sig, "doc_id", "text")
    assert found.count() == 101


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (102, 101), (101, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "x int, y int"), "x", "y").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    star = [(0, i) for i in range(1, 3000)] + [(i, i + 5000) for i in range(1, 3000, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(star, "x int, y int"), "x", "y").collect()}
    assert set(got.values()) == {0} and len(got) == len({n for p in star for n in p})


def test_sketches_bound_differences(spark, monkeypatch):
    """Pairs of a bucket that are surely unlike are not aligned, and no like pair is lost."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base, h = [word() for _ in range(200)], M.WordHashes()
    texts = [" ".join(base), " ".join(base[:199]), *[" ".join(base[:60] + [word() for _ in range(140)]) for _ in range(10)]]
    x = [M.shingles(M.word_hashes(t, h)) for t in texts]
    for a in x:
        for b in x:
            bits = sum(int(v).bit_count() for v in (M.parities(a) ^ M.parities(b)).view(np.uint64))
            assert bits <= len(np.setxor1d(a, b)) and (bits == 0) == (a is b)
    aligned, old = [], M._aligned

    def counted(pairs, texts):
        aligned.append(pairs.count())
        return old(pairs, texts)

    monkeypatch.setattr(M, "_aligned", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    sig = M.signatures(df, "doc_id", "text").withColumn("bands", F.array(F.lit(1).cast("long"))).cache()
    found, _ = M.links(df, sig, "doc_id", "text")
    assert sum(aligned) == found.count() == 1


def test_leaders_of_the_same_nodes_give_way(spark):
    rows = [("A", 9, n, n) for n in "pqrst"] + [("B", 5, n, n) for n in "rst"] + [("C", 4, n, n) for n in "uvw"]
    got = {(x.lead, x.node) for x in M._referred(spark.createDataFrame(rows, "lead string, lead_weight long, node string, root string")).collect()}
    assert got == {("A", n) for n in "pqrst"} | {("C", n) for n in "uvw"}


def test_common_differences_bring_no_pairs(spark):
    """Texts that have a passage in common which their leader has not, and are unlike but for two near copies, hardly meet by that passage."""
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))

    def changed(w, n):
        w = w[:]
        for k in r.sample([*range(0, 96, 6), *range(138, 400, 6)], n):
            w[k] = word()
        return w

    base = [word() for _ in range(400)]
    passage = base[:100] + [word() for _ in range(30)] + base[130:]
    family = [changed(passage, 10) for _ in range(60)]
    texts = [" ".join(w) for w in [base, *family, changed(family[0], 3), changed(family[1], 3)]]
    name = [b"%03d" % i for i in range(len(texts))]
    members = spark.createDataFrame([(name[0], n, n) for n in name[1:]], "lead binary, node binary, root binary")
    got = M._remaining(members, spark.createDataFrame([*zip(name, texts, strict=True)], "node binary, text string"))
    h = M.WordHashes()
    x = [M.shingles(M.word_hashes(t, h)) for t in texts]
    near = {(name[i], name[j]) for j in range(1, len(x)) for i in range(1, j) if 9 * len(np.setxor1d(x[i], x[j])) <= len(x[i]) + len(x[j])}
    assert near == {(name[1], name[61]), (name[2], name[62])}
    assert {(bytes(p.lead), bytes(p.node)) for p in got.collect()} == near
