"""Language identification by n-gram filters that hold a bit for each language.

The letters of a text, in lower case, make words; runs of two to four letters of a word between its two ends are its n-grams. A
language's filter holds the n-grams that make up MIN_SHARE of its own text or more and at least NEAR of what they make up in the
language that has them most. All filters are one bit-sliced Bloom filter: at each place stands a mask of languages, and the masks at
an n-gram's HASHES places, and-ed, are all languages that contain it. Per text the bits are counted for each language. Of N n-grams
a filter that holds none of them still answers N times its false-positive rate, so the count is corrected by that rate, then set
against what the language's own text gives. The largest decides; the score sets it against the others in units of its spread.

Fitting takes a bounded sample: in each language, of the documents of 1 to TRAIN_CHARS characters that are not held out, those of
least hash, SAMPLE at most (rows equal in id and text count once). Their n-grams are counted on the cluster; the driver gets at most 3 / MIN_SHARE n-grams of a language.
The number of languages is not bounded (64 bits a word of a mask). Identifying reads every whole text, STEP letters at a time.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text where no language was learned;
a text with letters but no known n-gram gets the most frequent language of those learned from, ties to the lesser name; repeated
rows get equal results; a null id is not held out; null languages teach nothing; an empty table gives no rows; input columns named
like an output column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import replace_columns, text_batches
from .minhash import mix
from .quality import held_out

#: Lengths of n-grams in letters, a word's ends counting as one each.
SIZES = (2, 3, 4)
#: Documents of each language in the fitting sample, and the longest taken.
SAMPLE, TRAIN_CHARS = 1000, 20_000
#: Least share of a language's n-grams of that length, and least part of the largest share in any language.
MIN_SHARE, NEAR = 2e-5, 0.5
#: Places of an n-gram, and places of the filter for each n-gram of the language that has most.
HASHES, ROOM = 4, 16
#: Letters that are hashed at once.
STEP = 1 << 18

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def is_letter() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str, letter: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of a text's n-grams, some letters at a time; nothing where there is no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    code = np.where(letter[code], code, 0)
    code = np.r_[np.uint32(0), code, np.uint32(0)]
    code = code[np.r_[True, (code[1:] != 0) | (code[:-1] != 0)]].astype(np.uint64)  # one end between two words
    for i in range(0, len(code), STEP):
        x = code[i : i + STEP + max(SIZES) - 1]
        inside = x != 0
        for n in SIZES:
            if (m := min(STEP, len(x) - n + 1)) <= 0:
                continue
            whole = np.logical_and.reduce([inside[j : j + m] for j in range(1, n - 1)]) if n > 2 else inside[:m] | inside[1 : 1 + m]
            at = np.flatnonzero(whole)
            h = np.full(len(at), n, np.uint64)
            for j in range(n):
                h = (h * _MULTIPLY + x[at + j]) ^ (h >> np.uint64(29))
            yield mix(h)


def places(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The HASHES places of each n-gram, by double hashing."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class Model:
    langs: list[str]
    #: Documents learned from, of each language.
    documents: list[int]
    #: Masks by place and word; bit l % 64 of word l // 64 is language l.
    masks: np.ndarray
    #: Of each language: false positives of its filter, and what its own text gives after correction.
    wrong: np.ndarray
    own: np.ndarray

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Of so many n-grams, how many each language contains by its filter."""
        found = np.bitwise_and.reduce([self.masks[p] for p in places(h, len(self.masks))])
        return np.array([np.count_nonzero(found[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(self.langs))], np.int64)

    def corrected(self, hits: np.ndarray, n: int) -> np.ndarray:
        return np.maximum(0.0, (hits - n * self.wrong) / (1 - self.wrong))

    def identify(self, text: str | None, letter: np.ndarray) -> tuple[str, float]:
        hits, n = np.zeros(len(self.langs), np.int64), 0
        for h in grams(text or "", letter) if self.langs else ():
            hits += self.counts(h)
            n += len(h)
        if not n:
            return "und", 0.0
        each = self.corrected(hits, n) / self.own
        if not each.any():
            i = min(range(len(self.langs)), key=lambda i: (-self.documents[i], self.langs[i]))
            return self.langs[i], self.documents[i] / sum(self.documents)
        i = int(each.argmax())
        spread = np.sqrt(np.sort(each)[-2:].sum())  # of the difference between the two largest counts
        return self.langs[i], float(1 / np.exp((each - each[i]) / spread).sum())


def build(langs: list[str], documents: list[int], profile: list[tuple[str, int, int]], totals: list[int]) -> Model:
    """The filters from each language's n-grams: language, hash (as a signed number) and how often it was met; ``totals`` has all n-grams met."""
    by = {lang: i for i, lang in enumerate(langs)}
    which = np.array([by[p[0]] for p in profile], np.int64)
    h = np.array([p[1] for p in profile], np.int64).view(np.uint64)
    held = np.bincount(which, minlength=len(langs))
    size = 1 << int(max(64, ROOM * held.max(initial=0)) - 1).bit_length()
    masks = np.zeros((size, -(-len(langs) // 64)), np.uint64)
    for p in places(h, size):
        np.bitwise_or.at(masks, (p, which // 64), np.uint64(1) << (which % 64).astype(np.uint64))
    filled = np.array([np.count_nonzero(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(langs))]) / size
    met = np.bincount(which, weights=[p[2] for p in profile], minlength=len(langs))
    return Model(langs, documents, masks, filled**HASHES, np.maximum(met / np.maximum(totals, 1), 1e-6))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn the filters from documents that are not held out."""
    known = docs.filter(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)) & F.length(text_col).between(1, TRAIN_CHARS))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not sizes:
        return Model([], [], np.zeros((1, 1), np.uint64), np.zeros(0), np.zeros(0))
    spark = docs.sparkSession
    # twice the sample by hash, of which the first are taken; a language's whole rows never meet
    rate = spark.createDataFrame([(r["lang"], min(1.0, 2 * SAMPLE / r["n"])) for r in sizes], "lang string, rate double")
    few = text_batches(known).withColumn("place", F.pmod("h", F.lit(1 << 30))).join(F.broadcast(rate), "lang").filter(F.col("place") < F.col("rate") * (1 << 30))
    few = few.groupBy("lang", "place", "h").agg(F.min("text").alias("text"))
    sample = few.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("place", "h"))).filter(F.col("i") <= SAMPLE).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letter = is_letter()
        for part in batches:
            for lang, texts in part.groupby("lang", sort=False)["text"]:
                for i, n in enumerate(SIZES):
                    got = [h for t in texts for j, h in enumerate(grams(t, letter)) if j % len(SIZES) == i]
                    u, f = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    yield pd.DataFrame({"lang": lang, "n": n, "h": u.view(np.int64), "f": f})

    met = sample.mapInPandas(count, "lang string, n int, h long, f long").groupBy("lang", "n", "h").agg(F.sum("f").alias("f")).persist()
    totals = met.groupBy("lang", "n").agg(F.sum("f").alias("total"))
    share = met.join(F.broadcast(totals), ["lang", "n"]).withColumn("share", F.col("f") / F.col("total")).filter(F.col("share") >= MIN_SHARE)
    most = share.groupBy("h").agg(F.max("share").alias("most"))
    profile = share.join(most, "h").filter(F.col("share") >= NEAR * F.col("most")).select("lang", "h", "f").collect()
    total = {r["lang"]: r["t"] for r in totals.groupBy("lang").agg(F.sum("total").alias("t")).collect()}
    met.unpersist()
    langs = sorted(r["lang"] for r in sizes)
    n = {r["lang"]: r["n"] for r in sizes}
    return build(langs, [n[x] for x in langs], [tuple(r) for r in profile], [total.get(x, 0) for x in langs])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` plus ``lang_pred`` and ``score``."""
    docs = replace_columns(docs, ["lang_pred", "score"], [text_col])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.documents, model.masks, model.wrong, model.own))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letter, of = is_letter(), Model(*sent.value)
        for part in batches:
            found = [of.identify(t, letter) for t in part[text_col]]
            yield part.assign(lang_pred=[x[0] for x in found], score=[x[1] for x in found])

    return text_batches(docs).mapInPandas(run, schema)
