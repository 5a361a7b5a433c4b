import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gainflow.llm import linededup as L

SF = "/root/testdata/sf0.001"


def words(line):
    return [x for x in line.replace("\t", " ").replace("\r", " ").split(" ") if x]


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = j = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    while j < min(len(a), len(b)) and a[-1 - j] == b[-1 - j]:
        j += 1
    return i + j >= max(len(a), len(b)) - 1


def within(a, b):
    """Whether two lines, as lists of words, are within the bound."""
    if len(a) >= 10 or len(b) >= 10:
        return len(a) >= 10 and len(b) >= 10 and near(a, b)
    a, b = " ".join(a), " ".join(b)
    return len(a) >= 10 and len(b) >= 10 and near(a, b)


def expected(docs):
    """By comparing each line with all earlier ones."""
    seen, out = [], {}
    for doc_id, text in sorted(docs, key=lambda r: r[0]):
        kept, n = [], 0
        for line in (text or "").split("\n") if text is not None else []:
            w = words(line)
            gone = bool(w) and any(w == s or within(w, s) for s in seen)
            if w and w not in seen:
                seen.append(w)
            n += gone
            kept += [] if gone else [line]
        out[doc_id] = ("\n".join(kept) if text is not None else None, n)
    return out


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("N_lines", F.lit("x")).withColumn("no", F.lit(1)).repartition(3)
    got = L.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "no", "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_removed) for r in got.collect()} == expected(docs)


def test_small_edits(spark):
    r = random.Random(2)
    pool, docs = [], []
    for i in range(60):
        lines = []
        for _ in range(r.randrange(1, 7)):
            w = list(r.choice(pool)) if pool and r.random() < 0.7 else [r.choice("abcdefghijklmnop") for _ in range(r.choice([1, 4, 9, 10, 11, 12, 30]))]
            for _ in range(r.choice([0, 1, 1, 1, 2])):
                w = w or ["x"]
                k = r.randrange(len(w))
                w[k : k + r.randrange(2)] = [r.choice("abcdef")] * r.randrange(2)
            w = w or ["x"]
            pool.append(w)
            lines.append(r.choice([" ", "  ", "\t"]).join(w))
        docs.append((i, "\n".join(lines) + r.choice(["", "\n", "\n\n", "\r\n"])))
    check(spark, docs)


def test_short_lines_by_letters(spark):
    r = random.Random(7)
    pool, docs = ["All rights reserved 2023", "ééé ààà ùùù 1", "abcdefghij", "😀 😀 😀 😀 😀 x"], []
    for i in range(80):
        lines = []
        for _ in range(r.randrange(1, 6)):
            t = list(r.choice(pool)) if r.random() < 0.7 else [r.choice("abc é") for _ in range(r.randrange(1, 40))]
            for _ in range(r.choice([0, 1, 1, 1, 2])):
                k = r.randrange(len(t) + 1)
                t[k : k + r.randrange(2)] = [r.choice("ab é😀")] * r.randrange(2)
            pool.append("".join(t) or "x")
            lines.append(pool[-1])
        docs.append((i, "\n".join(lines)))
    docs += [(100, "a b c d e f g h i j"), (101, "a b c d e f g h i"), (102, "abc def ghi"), (103, "abc def gh"), (104, "abc def g"), (105, "abc def")]
    check(spark, docs)
    hit = {i: n for i, (_, n) in expected(docs).items()}
    assert sum(hit.values()) > 60 and [hit[i] for i in range(100, 106)] == [0, 0, 0, 1, 0, 0]


def test_corpus(spark):
    check(spark, [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()])


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(30_000))
    check(spark, [(1, None), (2, ""), (3, "\n\n"), (4, long), (5, long + " more"), (6, long.replace(" 77 ", " x ", 1)), (7, " \t "), (8, "a"), (9, " a\r")])
    df = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (None, "b"), (2, "b\nc")], "doc_id long, text string")
    assert sorted(map(str, ((r.doc_id, r.text, r.n_removed) for r in L.dedup_lines(df).collect()))) == sorted(map(str, [(1, "a", 1), (1, "a", 1), (None, "b", 0), (2, "c", 1)]))
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_keys_are_made_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "shared_dir", lambda _: str(tmp_path / "x"))
    docs = [(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j z"), (3, "one line of its own")]
    check(spark, docs)
    assert spark.read.parquet(str(tmp_path / "x/keys")).count() > 0
