import hashlib

from gainflow.llm import warc
from gainflow.llm._common import shared_dir
from gainflow.llm.queries import op1_warc

SF = "/root/testdata/sf0.01"


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = b in first and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = op1_warc(spark, SF)
    assert got.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == expected(rows)


def test_odd_rows_and_index(spark):
    a, b = "a" * 100, "ü\r\n\r\n" * 40
    rows = [(5, "http://x/é\r\n", a), (3, None, a), (9, "u", a), (3, "again", a), (1, "u", "a" * 99), (2, "u", "a" * 99), (7, "u", None), (8, "u", ""), (6, "u", b), (4, "u", b), (None, "u", b)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as Payload", "2 as first")
    folder = shared_dir(spark)
    idx = warc.write(warc.plan(df), folder)
    assert sorted(map(str, idx.collect())) == sorted(map(str, warc.index(spark, folder).withColumn("url", __import__("pyspark").sql.functions.expr("replace(replace(url, '%0D', '\r'), '%0A', '\n')")).collect()))
    got = {(r.record_id, r.url): r for r in warc.read(idx, folder).collect()}
    assert len(got) == len(rows) and bytes(got[4, "u"].payload) == b.encode() and got[6, "u"].refers_to == 4 and got[None, "u"].record_type == "revisit"
    assert got[5, "http://x/é%0D%0A"].refers_to == 3 and {got[3, None].record_type, got[3, "again"].record_type} == {"response"} and got[2, "u"].record_type == "response"
    only = warc.read(idx.filter("record_id = 4"), folder).collect()
    assert [bytes(r.payload) for r in only] == [b.encode()]
    empty = shared_dir(spark)
    assert warc.read(warc.write(warc.plan(df.limit(0)), empty), empty).count() == 0


def test_coalesced():
    g, s = warc.GAP, warc.SPAN
    got = warc.coalesced([("a", 0, 10), ("a", 10 + g, 5), ("a", 16 + 2 * g, 5), ("b", 0, s), ("b", s, 1)])
    assert [(x[0], x[1], x[2]) for x in got] == [("a", 0, 15 + g), ("a", 16 + 2 * g, 21 + 2 * g), ("b", 0, s), ("b", s, s + 1)]


def test_very_long_payload_and_many_digests(spark, monkeypatch):
    long = "".join(chr(97 + i * i % 26) for i in range(3_000_000))
    df = spark.createDataFrame([(2, "u", long), (1, "v", long), (3, "w", long[:-1]), (4, None, None)], "page_id long, url string, html string")
    for sent in (warc.SENT, 0):
        monkeypatch.setattr(warc, "SENT", sent)
        folder = shared_dir(spark)
        got = {r.record_id: r for r in warc.read(warc.write(warc.plan(df), folder), folder).collect()}
        assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None)}
        assert bytes(got[1].payload) == long.encode() and bytes(got[3].payload) == long[:-1].encode()
