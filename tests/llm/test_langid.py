import random
import zlib

import numpy as np
import pytest

from gainflow.llm import langid
from gainflow.llm.queries import op12_langid

ENDS = {"en": ["the", "ing", "tion", "wh", "sh"], "de": ["sch", "ung", "ich", "keit", "zu"], "fr": ["eau", "ment", "oi", "que", "é"], "ру": ["ов", "ск", "ение", "ть", "на"]}


def text(lang, n, seed):
    pick = random.Random(f"{lang}{seed}")
    return " ".join("".join(pick.choice(ENDS[lang]) for _ in range(pick.randint(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    return [(i, text(lang, 5 + i % 40, i), lang) for i in range(400) for lang in [list(ENDS)[i % 4]]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, LANG_PRED string, score double").repartition(3)


def named(df):
    return {r["doc_id"]: (r["lang_pred"], r["score"]) for r in df.collect()}


def test_held_out_rows(spark, rows):
    df = frame(spark, rows)
    found = named(langid.identify(df, langid.fit(df)))
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 50 and sum(found[i][0] == lang for i, _, lang in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for _, s in found.values())


def test_held_out_rows_teach_nothing(spark, rows):
    other = [(i, t, "en" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = (langid.fit(frame(spark, r)) for r in (rows, other))
    assert a.langs == b.langs and (a.masks == b.masks).all() and (a.own == b.own).all()


def test_odd_texts(spark, rows):
    model = langid.fit(frame(spark, rows))
    odd = [(1, None, None), (2, "", "en"), (3, "12 345 -- ́\U0001f600", "en"), (4, "ß", None), (None, text("de", 30, 1), None), (6, text("fr", 200_000, 2), "en"), (7, "中文", None), (8, text("ру", 9, 3), None), (8, text("ру", 9, 3), None)]
    df = frame(spark, odd)
    out = langid.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and out.count() == 9
    found = named(out)
    assert [found[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert found[None][0] == "de" and found[6][0] == "fr" and found[8][0] == "ру"
    assert found[7] == (max(model.langs, key=lambda x: (model.documents[model.langs.index(x)], [-ord(c) for c in x])), max(model.documents) / sum(model.documents))


def test_nothing_to_learn_from(spark):
    rows = [(1, "some words", None), (2, None, "en")]
    assert named(langid.identify(frame(spark, rows), langid.fit(frame(spark, rows)))) == {1: ("und", 0.0), 2: ("und", 0.0)}
    assert langid.identify(frame(spark, []), langid.fit(frame(spark, []))).count() == 0


def test_a_long_text_counts_all_its_n_grams(monkeypatch):
    letter, t = langid.is_letter(), text("en", 5000, 4) + " İx"
    whole = np.sort(np.concatenate(list(langid.grams(t, letter))))
    monkeypatch.setattr(langid, "STEP", 97)
    assert (np.sort(np.concatenate(list(langid.grams(t, letter)))) == whole).all()


def test_filter_of_more_languages_than_bits_of_a_word():
    """All languages that hold an n-gram are returned; others only by false positives, for which counts are corrected."""
    pick = np.random.default_rng(3)
    h = pick.integers(-(1 << 63), 1 << 63, 3000)
    langs = [f"l{i:03}" for i in range(150)]
    profile = [(langs[(i * 7 + j) % 150], int(x), 1) for i, x in enumerate(h) for j in range(0, 60, 20)]
    model = langid.build(langs, [1] * 150, profile, [60] * 150)
    assert model.masks.shape[1] == 3
    for i, x in list(enumerate(h))[:200]:
        hits = model.counts(np.array([x]).view(np.uint64))
        assert all(hits[(i * 7 + j) % 150] for j in range(0, 60, 20))
    n = 20_000
    stray = model.counts(pick.integers(0, 1 << 63, n).astype(np.uint64))
    assert abs(stray / n - model.wrong).max() < 0.01 and model.corrected(stray, n).max() < 0.01 * n


def test_query_on_labelled_documents(spark):
    d = "/root/testdata/sf0.001"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op12_langid(spark, d).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
