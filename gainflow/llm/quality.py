"""Quality by compression: zstandard dictionaries of good and of bad text, compared.

A dictionary is built from the text of either label. A text is compressed with each; the difference
of the two sizes, less that of a neutral text as long, over the text's own size is all that a score
rests on. A logistic calibration of that one number (Platt's) turns it into a score from 0 to 1. The
neutral rate is the one that speaks for neither label more than their shares do, so a text too short
to tell scores about as the share of good ones. Only the text is used.

Fitting takes a bounded sample: of each label the ``SAMPLE`` documents of least hash among those
labelled, not held out and at most ``TRAIN_CHARS`` long. They come to the driver: 4,000 texts of
20,000 characters at most, so 80 million characters (320 MB, were each of four bytes). Scoring covers
every whole text, however long.

Defined results: null and empty texts score as the empty text; a null id is not held out; an empty
table of documents gives no rows; repeated rows and ties get equal scores; repeated labels of a
document count as the lowest; rows without a label and null labels teach nothing; with one label
missing, every text gets the other's value (0 or 1), with none 0.5; input columns named like an
output column are replaced by it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import replace_columns, text_batches

#: Documents of each label in the fitting sample, and the longest taken.
SAMPLE, TRAIN_CHARS = 2000, 20_000
#: Bytes of a dictionary, for which at most half of a label's sample is used, and the level of compression.
DICTIONARY_BYTES, LEVEL = 512 << 10, 12
#: Bytes that are added to a text's size, so that a difference of some bytes in a short text says little.
MORE = 100
THRESHOLD = 0.7


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Difference:
    """The normalised difference of a text's compressed sizes, with the bad dictionary less with the good one, from ``neutral`` a byte."""

    def __init__(self, good: bytes, bad: bytes, neutral: float = 0.0):
        self.neutral = neutral
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        made = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (good, bad)]
        for d in made:
            d.precompute_compress(level=LEVEL)
        self.good, self.bad = (zstandard.ZstdCompressor(dict_data=d, **options) for d in made)

    def __call__(self, texts: list[str]) -> np.ndarray:
        each = (t.encode("utf-8", "replace") for t in texts)
        return np.array([(len(self.bad.compress(b)) - len(self.good.compress(b)) - self.neutral * len(b)) / (len(b) + MORE) for b in each], float)


def dictionary(texts: list[str]) -> tuple[bytes, int]:
    """Whole texts up to DICTIONARY_BYTES, at most half of them but one at least, and how many they are."""
    held, size = [], 0
    for t in texts[: max(1, len(texts) // 2)]:
        b = t.encode("utf-8", "replace")
        if held and size + len(b) > DICTIONARY_BYTES:
            break
        held.append(b)
        size += len(b) + 1
    return b"\n".join(held), len(held)


@dataclass
class Model:
    good: bytes
    bad: bytes
    neutral: float = 0.0
    intercept: float = 0.0
    slope: float = 0.0
    constant: float | None = None

    def scorer(self):
        if self.constant is not None:
            return lambda texts: np.full(len(texts), self.constant)
        difference = Difference(self.good, self.bad, self.neutral)
        return lambda texts: 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * difference(texts), -30, 30)))


def calibration(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """Intercept and slope of a ridge logistic regression of ``y`` on one number, by Newton steps."""
    middle, spread = x.mean(), x.std() or 1.0
    z = np.stack([np.ones(len(x)), (x - middle) / spread], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge * np.eye(2), z.T @ (weight * (y - p)) - ridge * w)
        w += step * min(1, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] - w[1] * middle / spread), float(w[1] / spread)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from labelled rows that are not held out; what comes to the driver is bounded by SAMPLE and TRAIN_CHARS."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("q")).filter(F.col("i").isNotNull() & F.col("q").isin(0, 1) & ~held_out(F.col("i")))
    known = known.groupBy("i").agg(F.min("q").alias("q"))
    counts = {r["q"]: r["n"] for r in known.groupBy("q").agg(F.count("*").alias("n")).collect()}
    # twice the sample of labelled ids, since some have no text or too long a one
    ids = [known.filter(F.col("q") == q).orderBy(F.xxhash64("i"), "i").limit(2 * SAMPLE) for q in (0, 1)]
    ids = ids[0].unionByName(ids[1])
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter(F.length("t").between(1, TRAIN_CHARS))
    texts = texts.join(F.broadcast(ids), "i").groupBy("i", "q").agg(F.min("t").alias("t"))
    chosen = [texts.filter(F.col("q") == q).orderBy(F.xxhash64("i"), "i").limit(SAMPLE) for q in (0, 1)]
    rows = chosen[0].unionByName(chosen[1]).collect()
    rows.sort(key=lambda r: (r["q"], zlib.crc32(str(r["i"]).encode()), r["i"]))
    by = {q: [r["t"] for r in rows if r["q"] == q] for q in (0, 1)}
    if not by[0] or not by[1]:
        return Model(b"", b"", constant=0.5 if not rows else float(bool(by[1])))
    (good, n_good), (bad, n_bad) = dictionary(by[1]), dictionary(by[0])
    rest = {1: by[1][n_good:] or by[1], 0: by[0][n_bad:] or by[0]}
    y = np.array([q for q in (0, 1) for _ in rest[q]], float)
    share = counts[1] / (counts[0] + counts[1])  # the calibration keeps the labels' true shares
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    intercept, slope = calibration(Difference(good, bad)(rest[0] + rest[1]), y, weight)
    neutral = float(np.log(share / (1 - share)) - intercept) / slope if slope > 0 else 0.0
    return Model(good, bad, neutral, *calibration(Difference(good, bad, neutral)(rest[0] + rest[1]), y, weight))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` plus ``score`` and ``predicted`` (1 at THRESHOLD or more)."""
    docs = replace_columns(docs, ["score", "predicted"], [text_col])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = model.scorer()
        for part in batches:
            yield part.assign(score=of(part[text_col].fillna("").tolist()))

    return text_batches(docs).mapInPandas(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
