"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a tree are the adjacent pairs of one pre-token, keyed by (merge rank, position), so
the root is the leftmost pair of the lowest rank. Merging it changes three leaves, each updated in
a logarithmic number of steps, until the root holds no mergeable pair. The trees of pre-tokens of
like length stand side by side in one array and take their steps together. The pre-tokens of a
task that were already encoded are kept in a bounded table.

``encode`` returns ``ids``, the token ids of the whole text as packed little-endian unsigned
32-bit integers; ``decode`` turns them back into text. Strings of special tokens inside a text
become their ids, as in the tokenizers library's default.

Defined results: null and empty texts encode to no ids and decode to the empty text; an empty table
gives no rows; repeated rows get equal results; equal ranks merge from the left; input columns named
like an output column are replaced. Texts of any length are encoded whole. A single pre-token is one
tree of some 60 bytes a byte of it, so a run of 10 MB without a blank, digit or mark takes a task 1 GB.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import text_batches

#: The byte-level pre-tokenizer's pattern, with Unicode white space spelt out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NONE = np.int64(1) << 62
#: Cells of the trees that are worked on together, encoded pre-tokens kept, and characters of text taken at a time.
CELLS, KEPT, STEP = 1 << 19, 300_000, 1_000_000


def byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary, read from a tokenizers JSON file on the driver; its size is that of the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        letters, vocab = byte_letters(), d["model"]["vocab"]
        self.bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in d["added_tokens"])]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in d["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where it can't be merged."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.order[at], -1)


def merge(v: Vocabulary, words: list[bytes], size: int) -> list[bytes]:
    """Packed ids of words shorter than ``size``, a power of two; one tree each, its last leaf stays empty."""
    n, end = len(words), size - 1
    lens = np.fromiter(map(len, words), np.int64, n)
    column = np.arange(size)
    alive = column < lens[:, None]
    sym = np.full((n, size), -1, np.int64)
    sym[alive] = v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    after = np.where(column + 1 < lens[:, None], column + 1, end).ravel()
    before = np.where(column > 0, column - 1, end) + np.zeros((n, 1), np.int64)
    before = before.ravel()
    tree = np.full((n, 2 * size), NONE, np.int64)
    rank = v.ranks(sym[:, :-1], sym[:, 1:])
    tree[:, size:-1] = np.where(rank >= 0, rank << 32 | column[:-1], NONE)
    k = size
    while k > 1:
        tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k //= 2
    sym, live, tree = sym.ravel(), alive.ravel(), tree.ravel()
    row = np.arange(n)
    while True:
        root = tree[row * 2 * size + 1]
        row = row[root < NONE]
        if not len(row):
            break
        root = root[root < NONE]
        pos, base = root & 0xFFFFFFFF, row * size
        right = after[base + pos]
        far = after[base + right]
        live[base + right] = False
        sym[base + pos] = v.merged[root >> 32]
        after[base + pos] = far
        before[base + far] = pos
        left = before[base + pos]
        own, prior = v.ranks(sym[base + pos], sym[base + far]), v.ranks(sym[base + left], sym[base + pos])
        top, at = np.tile(row * 2 * size, 3), np.concatenate([right, pos, left]) + size
        tree[top + at] = np.concatenate([np.full(len(row), NONE), np.where(own >= 0, own << 32 | pos, NONE), np.where(prior >= 0, prior << 32 | left, NONE)])
        for _ in range(size.bit_length() - 1):
            at >>= 1
            tree[top + at] = np.minimum(tree[top + 2 * at], tree[top + 2 * at + 1])
    live = live.reshape(n, size)
    packed, ends = sym.reshape(n, size)[live].astype("<u4").tobytes(), np.cumsum(live.sum(1)) * 4
    return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def encode_words(v: Vocabulary, words: list[str]) -> dict[str, bytes]:
    buckets: dict[int, list[str]] = {}
    raw = {w: w.encode("utf-8", "surrogatepass") for w in words}
    for w, b in raw.items():
        buckets.setdefault(1 << len(b).bit_length(), []).append(w)
    out = {}
    for size, own in buckets.items():
        step = max(1, CELLS // size)
        for i in range(0, len(own), step):
            part = own[i : i + step]
            out.update(zip(part, merge(v, [raw[w] for w in part], size), strict=True))
    return out


def encoder(v: Vocabulary):
    """A function that gives texts, about STEP characters at a time, their packed ids."""
    import regex

    pattern, special, kept = regex.compile(PATTERN), regex.compile("|".join(map(regex.escape, v.special)) or r"(?!)"), {}
    marks = {i: i.to_bytes(4, "little") for i in v.special.values()}

    def pieces(text: str) -> Iterator[str | int]:
        at = 0
        for m in special.finditer(text):
            yield from pattern.findall(text[at : m.start()])
            yield v.special[m[0]]
            at = m.end()
        yield from pattern.findall(text[at:] if at else text)

    def run(texts: list[str]) -> list[bytes]:
        rows = [[*pieces(t)] for t in texts]
        if len(kept) > KEPT:
            kept.clear()
        kept.update(marks)
        kept.update(encode_words(v, list({p for r in rows for p in r if p not in kept})))
        return [b"".join(map(kept.__getitem__, r)) for r in rows]

    return run


def decoder(v: Vocabulary):
    """A function that turns packed ids into text."""
    letters = v.bytes.__getitem__
    return lambda ids: b"".join(map(letters, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")


def steps(batches: Iterator[pd.DataFrame], text_col: str) -> Iterator[tuple[pd.DataFrame, list[str]]]:
    for whole in batches:
        texts = whole[text_col].fillna("")
        for _, own in whole.groupby((texts.str.len().cumsum() // STEP).to_numpy(), sort=False):
            yield own, texts.loc[own.index].tolist()


def _mapped(df: DataFrame, path: str, outputs: list[T.StructField], rows) -> DataFrame:
    """Apply ``rows(vocabulary)`` in each task; output columns replace those of their names."""
    taken = {f.name.lower() for f in outputs}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary(path))
    return text_batches(df).mapInPandas(lambda batches: rows(vocabulary.value, batches), T.StructType([*df.schema.fields, *outputs]))


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` plus ``ids``."""

    def rows(v: Vocabulary, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to_ids = encoder(v)
        for own, texts in steps(batches, text_col):
            yield own.assign(ids=to_ids(texts))

    return _mapped(docs, path, [T.StructField("ids", T.BinaryType())], rows)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Columns of ``encoded`` plus ``out_col``, the text of its packed ids (null ids: the empty text)."""

    def rows(v: Vocabulary, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to_text = decoder(v)
        for own in batches:
            yield own.assign(**{out_col: [to_text(i) for i in own[ids_col]]})

    return _mapped(encoded, path, [T.StructField(out_col, T.StringType())], rows)


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` plus ``ids``, ``n_tokens`` and ``decoded``: encoding and then decoding the ids, in one pass."""

    def rows(v: Vocabulary, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to_ids, to_text = encoder(v), decoder(v)
        for own, texts in steps(batches, text_col):
            ids = to_ids(texts)
            yield own.assign(ids=ids, n_tokens=[len(i) // 4 for i in ids], decoded=[to_text(i) for i in ids])

    return _mapped(docs, path, [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())], rows)
