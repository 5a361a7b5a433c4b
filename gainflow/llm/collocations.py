"""Phrase collocations: candidates from sketch upper bounds, counted by Aho-Corasick automata.

A-Z are lower-cased; a text is cut into pieces at ``. , ; : ! ?`` and line ends (``\\x0A`` to ``\\x0D``), pieces into words at
blanks and tabs. Four passes, each of which reads every whole text:

1. every occurrence of a phrase of one or two words adds one to two cells of a sketch, with its language; then every longer one
   whose word pairs all may be frequent does so in a second sketch. A phrase's lesser cell is an upper bound of its count, so no
   phrase is missed;
2. phrases whose bound, and that of every phrase inside them, reaches the threshold are the candidates;
3. candidates become automata, each pattern guarded by a blank at either end, and each text is its words with one blank between any
   two and a line end where a piece ends. No pattern holds a line end, so a match is whole words of one piece. Overlapping
   matches are counted per language and summed; then the threshold is applied to the exact counts.

The sketch's size follows the text's (a cell for 16 characters, CELLS_MOST at most: beyond it more candidates turn out to be too
rare, none is lost). Tasks send their cells in compressed slices, which are added one by one; the driver gets one bit a cell (40 MB
at most). Candidates are dealt to automata of about PATTERN_BYTES bytes (each byte is a node at most); only one of them, so bounded,
is collected and broadcast at a time, and each takes a pass over the texts.

Defined results: a null text is empty; a null language counts as ``und``, together with rows that say so; repeated rows count each;
an empty table, or one without a candidate, gives no rows; ties go to the phrase first in UTF-8 byte order; texts, pieces and words
of any length are taken whole; other columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import shared_dir, text_batches
from .minhash import WordHashes, mix

MAX_WORDS, LEAST, TOP = 5, 100, 2000
#: Cells of the sketch, least and most, and characters a cell.
CELLS_LEAST, CELLS_MOST, CHARS = 1 << 20, 1 << 28, 16
#: Cells of a slice, buckets of candidates, and words of a phrase up to which the first sketch counts.
SLICE, DEALT, SHORT = 1 << 18, 1024, 2
#: Bytes of the phrases of one automaton.
PATTERN_BYTES = 8 << 20
#: Words that are hashed at once, cells that are added at once, and counters that travel together.
WORDS, PENDING, PART = 1 << 19, 1 << 22, 1 << 14
#: Parts into which a language's phrases are dealt before its first ones are taken.
SALTS = 64

_BREAKS = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[bytes]:
    """The words of a text, and a line end where a piece ends."""
    return list(filter(None, text.encode("utf-8", "replace").lower().translate(_BREAKS).replace(b"\n", b" \n ").split(b" ")))


class Hashes(WordHashes):
    """As WordHashes, but 0 where a piece ends, and for no word."""

    def __missing__(self, word: bytes) -> int:
        h = 0 if word == b"\n" else super().__missing__(word) or 1
        self[word] = h
        return h


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """Language, words and their hashes, of some texts at a time."""
    hashes = Hashes()
    for part in batches:
        for lang, texts in part.groupby("lang", sort=False)["text"]:
            held: list[bytes] = []
            for i, t in enumerate(texts):
                held += tokens(t)
                held.append(b"\n")
                if len(held) >= WORDS or i == len(texts) - 1:
                    yield lang, held, np.fromiter(map(hashes.__getitem__, held), np.uint64, len(held))
                    held = []


def levels(words: np.ndarray, most: int, passes: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``k``, places and hashes of the phrases of k words; only those that pass, and whose parts do."""
    at, h = np.flatnonzero(words), np.zeros(len(words), np.uint64)
    x = mix(words[at] * _ODD)
    for k in range(1, most + 1):
        if passes is not None:
            keep = passes(k, x)
            at, x = at[keep], x[keep]
        yield k, at, x
        h[at] = x
        found = np.zeros(len(words) + 1, bool)
        found[at] = True
        at = at[found[at + 1]]  # the phrase from the next word on is there as well
        x = mix(h[at] * _ODD + words[at + k])


def cells(x: np.ndarray, lang: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each phrase of a language."""
    import xxhash

    y = mix(x + np.uint64(xxhash.xxh64_intdigest(lang) | 1))
    return (y & np.uint64(size - 1)).astype(np.uint32), ((y >> np.uint64(32)) & np.uint64(size - 1)).astype(np.uint32)


def bounded(bits: list[np.ndarray], lang: str) -> Callable[[int, np.ndarray], np.ndarray]:
    """Whether phrases of k words may be met often enough: by the first sketch those of up to SHORT words, by the second, once there is one, longer ones."""
    def passes(k: int, x: np.ndarray) -> np.ndarray:
        if k > SHORT and len(bits) == 1:
            return np.ones(len(x), bool)
        own = bits[k > SHORT]
        a, b = cells(x, lang, 8 * len(own))
        test = lambda c: (own[c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & 1 > 0
        return test(a) & test(b)

    return passes


def _sketch(texts: DataFrame, size: int, most: int, least: int, known: list[np.ndarray]) -> np.ndarray:
    """A bit for each cell: it was met ``least`` times or more, by the phrases of up to SHORT words, or by the longer ones that ``known`` bounds let pass."""
    cap, sent = np.int64(min(least, 255)), texts.sparkSession.sparkContext.broadcast(known)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        table, pending, n, before = np.zeros(size, np.uint8), [], 0, sent.value

        def add() -> None:
            at, count = np.unique(np.concatenate(pending), return_counts=True)
            table[at] = np.minimum(table[at] + count, 255)

        for lang, _, words in blocks(batches):
            for k, _, x in levels(words, most if before else min(most, SHORT), bounded(before, lang) if before else None):
                if k > SHORT or not before:
                    pending += cells(x, lang, size)
                    n += 2 * len(x)
            if n >= PENDING:
                add()
                pending, n = [], 0
        if n:
            add()
        packer = zstandard.ZstdCompressor(level=1)
        for s in range(0, size, SLICE):
            if (own := table[s : s + SLICE]).any():
                yield pd.DataFrame({"slice": [s // SLICE], "cells": [packer.compress(own.tobytes())]})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        sums: dict[int, np.ndarray] = {}
        for part in batches:
            for s, packed in zip(part["slice"], part["cells"]):
                own = np.frombuffer(zstandard.decompress(packed), np.uint8)
                sums[s] = np.minimum(sums.get(s, np.uint16(0)) + own.astype(np.uint16), 1000)
        for s, x in sums.items():
            if (bits := x >= cap).any():
                yield pd.DataFrame({"slice": [s], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    parts = texts.mapInPandas(partial, "slice int, cells binary").repartition("slice")
    out = np.zeros(size // 8, np.uint8)
    for r in parts.mapInPandas(total, "slice int, bits binary").toLocalIterator():
        out[r["slice"] * (SLICE // 8) :][: len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def _candidates(texts: DataFrame, bits: list[np.ndarray], most: int) -> DataFrame:
    """``phrase``: every phrase whose bound, and that of all inside it, reaches the threshold in some language. Tasks send theirs in lists, one for each of DEALT buckets."""
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heavy, seen, out, n = sent.value, set(), {}, 0
        for lang, held, words in blocks(batches):
            for k, at, x in levels(words, most, bounded(heavy, lang)):
                u, first = np.unique(x, return_index=True)
                for v, i in zip(u.tolist(), at[first].tolist()):
                    if v not in seen:
                        seen.add(v)
                        n += 1
                        out.setdefault(v % DEALT, []).append(b" ".join(held[i : i + k]).decode("utf-8"))
            if n >= WORDS:
                yield pd.DataFrame({"bucket": list(out), "phrases": list(out.values())})
                out, n = {}, 0
        if out:
            yield pd.DataFrame({"bucket": list(out), "phrases": list(out.values())})

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for part in batches:
            new = {p for own in part["phrases"] for p in own} - seen
            seen |= new
            yield pd.DataFrame({"phrase": list(new)})

    return texts.mapInPandas(run, "bucket int, phrases array<string>").repartition("bucket").mapInPandas(once, "phrase string")


def automaton(patterns: list[str]) -> object:
    """Finds every pattern, a blank at either end of each."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        found.add_word(f" {p} ", i)
    found.make_automaton()
    return found


def _scan(texts: DataFrame, patterns: list[str], least: int) -> DataFrame:
    """``lang, phrase, f``: exact counts of at least ``least``, and with a null phrase the number of words."""
    sent = texts.sparkSession.sparkContext.broadcast(patterns)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from operator import itemgetter

        found = automaton(sent.value)
        size, counts = len(sent.value), {}
        for part in batches:
            for lang, own in part.groupby("lang", sort=False)["text"]:
                if lang not in counts:
                    counts[lang] = np.zeros(size + 1, np.int64)
                hits: list[int] = []
                for t in own:
                    words = tokens(t)
                    counts[lang][size] += len(words) - words.count(b"\n")
                    hits.extend(map(itemgetter(1), found.iter(f" {b' '.join(words).decode('utf-8')} ")))
                    if len(hits) >= WORDS:
                        counts[lang][:size] += np.bincount(hits, minlength=size)
                        hits = []
                counts[lang][:size] += np.bincount(np.array(hits, int), minlength=size)
        for lang, total in counts.items():
            for p in range(0, size + 1, PART):
                if (x := total[p : p + PART]).any():
                    yield pd.DataFrame({"lang": [lang], "part": [p], "counts": [x.tobytes()]})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for part in batches:
            for lang, p, x in zip(part["lang"], part["part"], part["counts"]):
                sums[lang, p] = sums.get((lang, p), 0) + np.frombuffer(x, np.int64)
        for (lang, p), x in sums.items():
            at = np.arange(p, p + len(x))
            keep = (x >= least) | (at == len(sent.value))
            if keep.any():
                yield pd.DataFrame({"lang": lang, "phrase": [sent.value[i] if i < len(sent.value) else None for i in at[keep].tolist()], "f": x[keep]})

    parts = texts.mapInPandas(partial, "lang string, part int, counts binary").repartition("lang", "part")
    return parts.mapInPandas(total, "lang string, phrase string, f long")


def counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = MAX_WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, k, f``: phrases of 1 to ``most`` words met ``least`` times or more in a language; and ``lang, n``, its words (no row where no phrase is a candidate)."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = text_batches(docs).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    size = min(CELLS_MOST, max(CELLS_LEAST, 1 << max(0, int(chars) // CHARS - 1).bit_length()))
    bits = [_sketch(texts, size, most, least, [])]
    if most > SHORT:
        bits.append(_sketch(texts, max(CELLS_LEAST, size // 4), most, least, bits))
    _candidates(texts, bits, most).write.parquet(f"{folder}/candidates")
    found = spark.read.parquet(f"{folder}/candidates")
    automata = -(-(found.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0) // PATTERN_BYTES)
    for i in range(automata):
        own = sorted(r["phrase"] for r in found.filter(F.pmod(F.xxhash64("phrase"), F.lit(automata)) == i).toLocalIterator())
        _scan(texts, own, least).withColumn("automaton", F.lit(i)).write.parquet(f"{folder}/counts/{i}")
    if not automata:
        none = spark.createDataFrame([], "lang string, phrase string, f long, automaton int")
    rows = spark.read.parquet(*[f"{folder}/counts/{i}" for i in range(automata)]) if automata else none
    phrases = rows.filter("phrase is not null").select("lang", "phrase", F.size(F.split("phrase", " ")).alias("k"), "f")
    return phrases, rows.filter("phrase is null and automaton = 0").select("lang", F.col("f").alias("n"))


def score(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the phrases of two words or more, by their lowest-scoring cut, without those that a phrase one word longer holds as often.

    A phrase that any longer one holds as often is held as often by one a word longer.
    """
    part = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    own = phrases.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    inner = own.filter("k > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase")).distinct()
    own = own.join(inner, ["lang", "phrase", "a"], "left_anti")
    cuts = own.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("i"))
    cuts = cuts.select("lang", "phrase", "a", "i", part(F.lit(1), F.col("i")).alias("first"), part(F.col("i") + 1, F.col("k") - F.col("i")).alias("rest"))
    of = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(F.broadcast(words), "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    exact = cuts.withColumn("up", F.lit(1000).cast("decimal(4,0)") * big("a") * big("n")).withColumn("down", big("l") * big("r"))
    exact = exact.withColumn("score", F.expr("up div down"))
    best = exact.groupBy("lang", "phrase").agg(F.min(F.struct("score", "i", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def first(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first rows of each language, with ``rank``: first those of each of SALTS parts of a language, then those of all."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    out = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = MAX_WORDS, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the collocations of each language, best first."""
    return first(score(*counts(docs, lang_col, text_col, most, least)), top)
