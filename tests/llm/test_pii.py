import pandas as pd
import pyarrow.parquet as pq

from gainflow.llm import pii

from . import brute

SF = "/root/testdata/sf0.001"
HARD = [
    "x@y.com_z@w.com a.b+c@d-e.f.g.h, @no.one a@b", "1.2.3.4.5.6.7.8 0255.00.1.2 256.1.1.1 1.2.3 300.1.1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 " + "9" * 40, "+1 (415) 555-2671 +1234 +1.2.3 +44 20 7946 0958x +" + "1" * 30,
    "Größe 😀😀 mail bob@example.org 😀 10.0.0.1", "GB82 WEST 1234 5698 7654 32 DE89370400440532013000 GB82WEST12345698765433",
    "", None, "a" * 3000 + "@b.c " + "7" * 5000, "0 " * 4000, "q@w.e " * 300, "a@b.c@d.e..f@g.h.", "1-2 3--4 5  6",
]


def check(spark, rows):
    df = spark.createDataFrame(pd.DataFrame({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}
    assert len(got) == len({r[0] for r in rows})
    for doc_id, text in rows:
        counts, digest = brute.pii(text)
        r = got[doc_id]
        assert {k: r[f"n_{k}"] for k in counts} == counts, (doc_id, text and text[:80])
        assert r.base_sha256 == digest
    return got


def test_hard_cases(spark):
    got = check(spark, list(enumerate(HARD)))
    assert got[5].spans.count("iban") == 2


def test_corpus(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    check(spark, [(r["doc_id"], r["text"]) for r in t])


def test_repeats_nulls_clashes(spark):
    df = spark.createDataFrame([(1, "a@b.c", 5), (1, "a@b.c", 6), (None, "c@d.e", 7)], "doc_id long, text string, PII int")
    out = pii.find(df)
    assert out.columns == ["doc_id", "text", "pii"] and [len(r.pii) for r in out.collect()] == [1, 1, 1]
    assert pii.find(df.limit(0)).count() == 0


def test_random_strings(spark):
    import random

    r = random.Random(7)
    kinds = ["a@.-_%+b ", "0123.4 .5", "41 1-2+(3). 9", "+1 (2)-3.x", "a1@b.2 +3.4-5\n"]
    check(spark, [(i, "".join(r.choice(kinds[i % 5]) for _ in range(r.randrange(70)))) for i in range(3000)])


def test_a_very_long_text(spark):
    """Half a million characters in one row: spans at its start, its middle and its end are those of plain regular expressions."""
    text = "first@mail.example " + "some words, 12 and 3.4 more " * 9000 + "+44 20 7946 0958 4111 1111 1111 1111 10.0.0.1 " + "yet more of it " * 17_000 + "last@mail.example"
    assert len(text) > 500_000
    counts, base = brute.pii(text)
    out = pii.digest(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (out["n_email"], out["n_ip"], out["n_card"], out["n_phone"]) == tuple(counts[k] for k in ("email", "ip", "card", "phone")) and out["base_sha256"] == base and out["n_email"] == 2
