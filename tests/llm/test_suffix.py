import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gainflow.llm import suffix as S
from gainflow.llm.queries import op4_suffix

from . import brute


def expected(docs):
    """By a set of all windows seen so far."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for j in range(len(b) - S.MATCH + 1):
            w = b[j : j + S.MATCH]
            if w in seen:
                gone[j] += 1
                gone[j + S.MATCH] -= 1
            seen.add(w)
        off = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.r_[0, off.astype(int)]) == 1).sum())
        out[doc_id] = (len(b), int(off.sum()), spans, brute.sha(bytes(np.frombuffer(b, np.uint8)[~off])))
    return out


def check(spark, docs, parts=4):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("KEPT", F.lit(1)).withColumn("s", F.lit("x")).withColumn("id", F.lit(1)).withColumn("k", F.lit(2)).repartition(parts)
    found = S.remove_repeats(df)
    assert found.columns == ["doc_id", "text", "s", "id", "k", "n_bytes", "spans", "kept"]
    got = {r.doc_id: (r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), brute.sha(bytes(r.kept))) for r in found.collect()}
    assert got == expected(docs)


def made(r):
    alphabet = "ab é"
    base = ["".join(r.choice(alphabet) for _ in range(r.randrange(50, 600))) for _ in range(6)]
    docs = []
    for i in range(120):
        t = ""
        for _ in range(r.randrange(1, 6)):
            b = r.choice(base)
            k = r.randrange(len(b))
            t += b[k : k + r.randrange(1, 400)] if r.random() < 0.8 else "".join(r.choice(alphabet) for _ in range(r.randrange(120)))
        docs.append((i, t))
    return docs + [(500, "a" * 1000), (501, "ab" * 300), (502, None), (503, ""), (504, "x" * 99), (505, "x" * 100), (506, "x" * 101), (507, docs[3][1]), (508, "\0" * 250), (509, "ÿ" * 130)]


def test_random_passages(spark):
    for seed in (1, 2):
        check(spark, made(random.Random(seed)))


def test_small_steps(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 10)
    monkeypatch.setattr(S, "SEGMENT", 150)
    check(spark, made(random.Random(3)), 3)


def some_strings(r):
    base = bytes(r.choice(b"abc\0\xff") for _ in range(400))
    strings = [b"", b"x" * 99]
    for _ in range(60):
        a = r.randrange(300)
        x = bytearray(base[a : a + r.randrange(90, 170)])
        x[r.randrange(len(x))] = r.randrange(256) if r.random() < 0.5 else x[0]
        strings.append(bytes(x))
    return strings


def matching_statistics(text, query):
    """Longest match of each suffix of ``query`` in any piece of ``text``."""
    return [max(next((k for k in range(len(query) - i, 0, -1) if any(query[i : i + k] in t for t in text)), 0), 0) for i in range(len(query))]


def test_statistics_through_samples():
    r = random.Random(8)
    strings = some_strings(r)
    data, size = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
    stop = np.cumsum(size)
    index = S.RunLengthIndex(*S.joined(data, (stop - size)[:40], stop[:40]))
    assert index.sample.shape == (2, len(index.starts)) and len(index.starts) < index.n / 2
    assert not [k for k, v in vars(index).items() if isinstance(v, np.ndarray) and v.shape[-1] > len(index.starts) and k != "packed"]
    text, ends = S.joined(data, (stop - size)[40:], stop[40:])
    begin, true = np.r_[0, ends[:-1] + 1], [matching_statistics(strings[:40], q) for q in strings[40:]]
    source, _ = S.joined(data, (stop - size)[:40], stop[:40])
    for least in (1, 7, 30, 100):
        at, place = index.matches(text, ends, least)
        want = sorted(begin[j] + i for j, own in enumerate(true) for i, k in enumerate(own) if k >= least)
        assert sorted(at.tolist()) == want
        assert all((text[a : a + least] == source[p : p + least]).all() for a, p in zip(at, place))
    index.sample = index.sample * 0  # without the samples nothing long is found
    assert len(index.matches(text, ends, 100)[0]) < len(want)


def test_windows_against_sets():
    for seed in range(5):
        r = random.Random(seed)
        strings, anchor, want = [], [], []
        for group in range(4):
            seen = set()
            for s in some_strings(r)[: r.randrange(1, 62)]:
                windows = [s[j : j + 100] for j in range(len(s) - 99)]
                if len(set(windows)) < len(windows):
                    continue
                want += [(len(strings), j) for j, w in enumerate(windows) if w in seen]
                seen.update(windows)
                strings.append(s)
                anchor.append(group)
        name, at = S.repeated_windows(np.array(anchor), strings)
        assert sorted(zip(name.tolist(), at.tolist())) == want
    assert not len(S.repeated_windows(np.zeros(0, np.int64), [])[0])


def test_crowded_anchors_and_a_long_text(spark, monkeypatch):
    r = random.Random(12)
    docs = made(r)
    monkeypatch.setattr(S, "CROWDED", 2)
    check(spark, docs)
    monkeypatch.undo()
    base = "".join(r.choice("abcdefghij klmno") for _ in range(300_000))
    check(spark, [(1, base * 8 + "the end"), (2, "x" + base[1000:90_000]), (3, "y" * 3000)], 2)


def test_very_frequent_anchors_are_dealt_by_content(spark, monkeypatch, tmp_path):
    """Every anchor that occurs twice counts as frequent, so contexts of one are in many tasks."""
    folders = []
    monkeypatch.setattr(S, "shared_dir", lambda _: folders.append(f"{tmp_path}/{len(folders)}") or folders[-1])
    monkeypatch.setattr(S, "HOT", 1)
    monkeypatch.setattr(S, "SAMPLED", 1)
    monkeypatch.setattr(S, "SALTS", 16)
    r = random.Random(21)
    passage = "".join(r.choice("abcdefgh ") for _ in range(120))
    around = [(1000 + i, "".join(r.choice("uvwxyz") for _ in range(60)) + passage + "".join(r.choice("uvwxyz") for _ in range(60))) for i in range(150)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else all these few rows go to one task
    for crowded in (4_000, 3):
        monkeypatch.setattr(S, "CROWDED", crowded)
        check(spark, made(random.Random(6)) + around)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for f in folders:
        seen = spark.read.parquet(f"{f}/contexts").filter("asks and dealt")
        most = seen.groupBy("a").count().orderBy("count", ascending=False).first()
        assert most["count"] > 50  # contexts of one anchor, from many tasks' files
        assert seen.filter(seen.a == most.a).selectExpr("input_file_name() as f").distinct().count() > 1


def test_corpus(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op4_suffix(spark, sf).collect()}
    assert got == expected(docs)


def test_repeats_and_empty(spark):
    r = random.Random(9)
    t = "".join(r.choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (None, t[50:200]), (2, t)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, len(r.kept)) for r in S.remove_repeats(df).collect()))
    assert got == [(0, 150), (1, 150), (1, 150), (2, 0)]
    assert S.remove_repeats(df.limit(0)).count() == 0
