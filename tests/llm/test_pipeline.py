import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from gainflow.llm import quality

from . import brute
from .test_linededup import expected as deduplicated
from .test_minhash import expected as classes

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF).cache()
        if name == "quality":
            of = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).scorer()
            want = {i: t for i, t in rows.items() if of([t or ""])[0] >= quality.THRESHOLD}
            assert 0 < len(want) < len(rows)
        elif name == "lines":
            want = {i: t for i, (t, n) in deduplicated(sorted(rows.items())).items() if not n or t.strip()}
            assert want != rows
        elif name == "near_duplicates":
            ids = sorted(rows)
            group = classes([rows[i] for i in ids])
            want = {i: rows[i] for k, i in enumerate(ids) if group[k] == k}
        elif name == "decontamination":
            want = {r[0]: rows[r[0]] for r in brute.contamination(sorted(rows.items()), items) if not r[5]}
        else:
            got = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in out.collect()}
            ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in rows.items()}
            assert got == {i: (len(x), b"".join(t.to_bytes(4, "little") for t in x)) for i, x in ids.items()}
            continue
        assert out.columns == columns
        got = {r.doc_id: r.text for r in out.collect()}
        assert got == want, name
        assert out.filter("n_chars <> length(text)").count() == 0
        docs, rows = out, got


def test_run_and_odd_tables(spark, tmp_path):
    assert P.run(spark, SF).columns == ["doc_id", "n_tokens", "ids", "ids_sha256"]
    odd = spark.createDataFrame([(1, None, "en", None, None), (1, "", "en", "s", 0), (None, "good words here", None, "s", 15), (None, "good words here", None, "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, SF)
            assert docs.count() <= 4
    assert docs.agg(F.count("*").alias("n")).first().n == 0


def test_stages_keep_the_users_columns(spark):
    names = ["score", "predicted", "hits", "items", "n_hit", "n_lines", "n_removed", "class_id", "root", "id", "__id", "__text", "gone", "contaminated", "__k1", "node"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.select(*docs.columns[:1], *[F.concat(F.lit(n), "doc_id").alias(n) for n in names], *docs.columns[1:]).cache()
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.select("doc_id", *names).collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert P.STAGES[-1][1](spark, docs, SF).columns == ["doc_id", "n_tokens", "ids", "ids_sha256"]


def test_stages_take_a_very_long_text(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(1, 9))) for _ in range(5000)]
    lines = [" ".join(r.choice(words) for _ in range(12)) for _ in range(15_000)]
    long = "\n".join(lines)
    assert len(long) > 900_000
    docs = spark.createDataFrame([(1, long), (2, long + " and more"), (3, "\n".join(lines[:100]) + "\na line of its own stands at the end of this text, as the last one")], "doc_id long, text string")
    assert P.good_quality(spark, docs, SF).count() in (0, 3)
    kept = {x.doc_id: x.text for x in P.distinct_lines(spark, docs, SF).collect()}
    assert kept == {1: long, 2: lines[-1] + " and more", 3: "a line of its own stands at the end of this text, as the last one"}
    assert [x.doc_id for x in P.distinct_documents(spark, docs, SF).select("doc_id").orderBy("doc_id").collect()] == [1, 3]
    assert P.uncontaminated(spark, docs, SF).count() == 3
    ids = {x.doc_id: len(x.ids) // 4 for x in P.tokens(spark, docs, SF).collect()}
    assert ids[1] == len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(long).ids)
