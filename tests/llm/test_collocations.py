import random
import re
from collections import Counter

from gainflow.llm import collocations

SCHEMA = "lang string, text string, phrase string, F long, score int"


def brute(rows, most, least, top):
    """What ``mine`` returns, by plain Python; rows are (lang, text)."""
    by = {}
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        by.setdefault("und" if lang is None else lang, []).extend(re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\n-\r]", low))
    out = []
    for lang, pieces in by.items():
        n = sum(map(len, pieces))
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, most + 1) for i in range(len(p) - k + 1))
        held = {p for p in f if len(p) > 1 and f[p] >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        scored = []
        for p in held:
            if any(len(q) > len(p) and inside(p, q) and f[q] >= f[p] for q in held):
                continue
            s, k = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -f[p], " ".join(p).encode(), f[p], f[p[:k]], f[p[k:]], n, s))
        for i, (_, _, p, a, l, r, n, s) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, p.decode(), a, l, r, n, s))
    return sorted(out)


def mined(spark, rows, most=5, least=4, top=50):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in collocations.mine(df, most=most, least=least, top=top).collect())


def corpus(seed, n=150):
    pick = random.Random(seed)
    words = ["a", "b", "c", "The", "the", "é", "É", "x\x00y", " ", "don't", "\U0001f600", "zz"]
    ends = [" ", "  ", "\t", ", ", ".", "\n", "\r", "\x0b", "!? ", " a b ", " zz zz zz "]
    text = lambda: "".join(pick.choice(words) + pick.choice(ends) for _ in range(pick.randint(0, 40)))
    return [(pick.choice(["en", "de", None, "und", ""]), pick.choice([text(), text(), None, ""])) for _ in range(n)]


def test_equals_brute_force(spark):
    rows = corpus(1)
    want = brute(rows, 5, 4, 50)
    assert len(want) > 100 and mined(spark, rows) == want


def test_several_automata_and_a_crowded_sketch(spark, monkeypatch):
    """Few bytes an automaton, and a sketch of so few cells that bounds are far too high, change nothing."""
    monkeypatch.setattr(collocations, "PATTERN_BYTES", 300)
    monkeypatch.setattr(collocations, "DEALT", 3)
    monkeypatch.setattr(collocations, "CELLS_LEAST", 1 << 8)
    monkeypatch.setattr(collocations, "CELLS_MOST", 1 << 8)
    monkeypatch.setattr(collocations, "SLICE", 1 << 7)
    monkeypatch.setattr(collocations, "PART", 16)
    rows = corpus(2, 60)
    assert mined(spark, rows, 3) == brute(rows, 3, 4, 50)


def test_bounds_are_never_too_low(spark):
    """Every phrase that is met often enough is a candidate, in long texts that are hashed in several parts as well."""
    rows = [("en", "w1 w2 w3. " * 70_000 + "only once"), ("en", None), (None, "w1 w2 w3")]
    got = mined(spark, rows, 3, 1000)
    assert got == [("en", 1, "w1 w2 w3", 70_000, 70_000, 70_000, 210_002, 3000)]


def test_exact_beyond_64_bits(spark):
    big = 3 * 10**12
    phrases = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 7), ("en", "b", 1, big + 9)], "lang string, phrase string, k int, f long")
    words = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    r = collocations.score(phrases, words).first()
    assert r["score"] == 1000 * big * 10**14 // ((big + 7) * (big + 9))


def test_empty_and_rare(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", "a b c"), ("en", ""), (None, None)]) == []
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_ties_and_the_first_of_a_language(spark):
    rows = [("en", "b c. a d. é f. z y.")] * 5
    want = brute(rows, 2, 5, 3)
    assert mined(spark, rows, 2, 5, 3) == want and [x[2] for x in want] == ["a d", "b c", "z y"]
