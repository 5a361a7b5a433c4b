import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gainflow.llm import decontam
from gainflow.llm.queries import op10_decontamination

from . import brute

SF = "/root/testdata/sf0.001"


def frame(spark, rows, names):
    return spark.createDataFrame(pd.DataFrame(rows, columns=names), f"{names[0]} long, {names[1]} string")


def check(spark, docs, items):
    found = decontam.contamination(frame(spark, docs, ["doc_id", "text"]), frame(spark, items, ["item_id", "text"]))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    got = sorted(tuple(r) for r in found.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join(ids, ","), 256), "contaminated").collect())
    assert got == sorted(brute.contamination(docs, items))


def test_hand_cases(spark):
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w[:20])), (2, "Short ITEM"), (3, None), (4, "..."), (5, " ".join(w[5:25])), (10, "é ü"), (11, " ".join(w[:20]))]
    docs = [(1, " ".join(w)), (2, "a short, item! " + "x " * 50), (3, ""), (4, None), (5, " ".join(["z"] * 1020 + w[:13] + ["z"] * 3000)), (6, "short item " * 700), (7, "É ü é Ü"), (8, " ".join(w[:12]))]
    check(spark, docs, items)


def test_corpus(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    check(spark, docs, items)
    assert op10_decontamination(spark, SF).columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_set_too_large_to_send(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_hand_cases(spark)
        test_modes_and_empty(spark)
        written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
        before, w = written(), [f"{i:x}{i * 7919 % 10007:x}" for i in range(4000)]
        check(spark, [(1, " ".join(w)), (2, " ".join(w[100:120]))], [(1, " ".join(w))])
        assert written() - before < 10 << 20  # a document's words don't go with each of its words
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_modes_and_empty(spark):
    docs = spark.createDataFrame([(1, "Keep. One two three! Rest", 9), (2, "nothing here", 8), (2, "nothing here", 8), (None, None, 7)], "doc_id long, text string, items int")
    bench = frame(spark, [(1, "one two three")], ["item_id", "text"])
    spans = decontam.decontaminate(docs, bench, "spans")
    assert sorted(map(str, (r.text for r in spans.collect()))) == ["Keep.   ! Rest", "None", "nothing here", "nothing here"]
    assert decontam.decontaminate(docs, bench).count() == 3
    assert decontam.decontaminate(docs, bench.limit(0)).count() == 4
    assert decontam.contamination(docs.limit(0), bench).count() == 0


def test_a_million_words_and_other_names(spark, monkeypatch):
    w = [f"{i * 7919 % 1_000_003:x}" for i in range(1_000_000)]
    docs = [(1, " ".join(w)), (2, " ".join(w[500:530])), (3, None)]
    items = spark.createDataFrame([("a", " ".join(w[1000:1020])), ("b", " ".join(w[999_980:])), ("c", " ".join(w[510:523]))], "name string, body string")
    for size in (decontam.BROADCAST_BYTES, 0):
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", size)
        found = decontam.contamination(frame(spark, docs, ["doc_id", "text"]), items, item_col="name", item_text_col="body")
        assert {r.doc_id: (r.n_words, r.n_hit, list(r.items), r.contaminated) for r in found.collect()} == {1: (1_000_000, 53, ["a", "b", "c"], False), 2: (30, 13, ["c"], True), 3: (0, 0, [], False)}
