"""Removal of long repeated byte strings through run-length BWT indexes of content shards.

A byte goes if a string of MATCH bytes that covers it also starts earlier: in a document of smaller
id, or before it in the same document. This is judged on the input; matches end at documents.

One index of all text can't be held or built in one task, so text is dealt out by content. Of the
GRAM-byte grams inside every window of MATCH bytes, that of least hash is its anchor; equal windows
have equal anchors. Runs of windows with one anchor make a context. Contexts are shuffled by their
anchors' hashes only, without their bytes:

* a context equal to an earlier one (by 128 bits of hash, beside the anchor's 64) goes as a whole;
* where an anchor has several different contexts, the first of each is fetched and sent to the
  anchor's shard. There run-length Burrows-Wheeler indexes with samples at the ends of runs are built
  over earlier contexts, and the matching statistics of later contexts are streamed through them;
  matches of MATCH bytes or more go. Lengths come from comparing bytes at the sampled places;
* contexts of an anchor that occurs nowhere else are unique.

Earlier and later: the contexts of an anchor are numbered by place. From the highest bit of these
numbers down, contexts with bit 0 are indexed and those with bit 1 streamed, and what matches is
taken out of both before the next bit. Contexts that differ in a higher bit then have no window in
common any more, so one index serves all anchors of a shard at once, and after the last bit exactly
the first of each window is left.

Equal contexts are first reduced to one inside each task. Grams that occur very often are listed
beforehand and serve as anchors only of windows that hold no other gram, so the surroundings of a
very common passage are dealt by what differs in them. An anchor that has more than CROWDED different
contexts nevertheless is decided window by window, by an aggregate over 128-bit hashes of the windows
that combines before its shuffle: no index exceeds a fixed size. Contexts of anchors that
are frequent nevertheless (as one document in SAMPLED shows) are shuffled by anchor and content, so that
they fill no task, and counted by an aggregate; where they are shuffled doesn't change the result.

Defined results: null text has no bytes; an empty table gives no rows; repeated rows (equal id and
text) get equal results and don't remove one another's bytes; ids are integers, and a null id comes
first; equal ids with different texts are told apart, and ordered, by a hash of the text; very long
texts are worked on SEGMENT windows at a time and never cut; input columns named like an output
column are replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import replace_columns, shared_dir, text_batches

#: Bytes of a match, of an anchor, and positions among which an anchor is the least.
MATCH, GRAM = 100, 32
SPREAD = MATCH - GRAM + 1
#: Windows of a document that are worked on at once, contexts of a task that are reduced at once, and bytes of a shard.
SEGMENT, REDUCED, SHARD = 1 << 20, 2_000_000, 1 << 20
#: Occurrences from which a gram counts as very frequent, and entries (8 bytes each) of the list of such grams, which is broadcast.
HOT, MOST_HOT = 4_000, 1_000_000
#: Different contexts (of at most 2 MATCH bytes) of one anchor up to which they are indexed together.
CROWDED = 4_000
#: Of one document in SAMPLED the anchors that contexts get are counted; contexts of those that make up HOT or more of all are dealt to SALTS
#: tasks by content. That decides where contexts go, not what becomes of them.
SAMPLED, SALTS = 16, 1 << 10
#: What stands for a null id.
NO_ID = -(1 << 63)

_R = np.random.default_rng(4)
_BYTE = _R.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER, _THIRD = (_R.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_STEP = _R.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the rolling base and of its inverse, as many as were asked for so far."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                x = np.full(max(n, 1 << 16), base, np.uint64)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))
        return cls.up[:n], cls.down[:n]


def grams(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on: of blocks of 1, 2, 4, ... bytes, those that make up GRAM."""
    h, n, done, at, count = _BYTE[b], 1, None, 0, len(b) - GRAM + 1
    while True:
        if GRAM & n:
            part = h[at : at + count]
            done = part if done is None else done * _STEP[7] + part
            at += n
        if 2 * n > GRAM:
            return mix(done)
        h = h[:-n] * _STEP[n.bit_length() % 7] + h[n:]
        n *= 2


def least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        key = np.minimum(key[:-n], key[n:])
        n *= 2
    return np.minimum(key[: len(key) - (width - n)], key[width - n :]) if width > n else key


def anchor_runs(b: np.ndarray, hot: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Where each SEGMENT windows start, their grams' hashes, and the anchor's place and the first window of each run of windows with one anchor.

    Grams in the sorted list ``hot`` are anchors only of windows that have no others.
    """
    for s in range(0, len(b) - MATCH + 1, SEGMENT):
        h = grams(b[s : s + SEGMENT + MATCH - 1])
        order = h >> np.uint64(33)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
            order |= (hot[at] == h).astype(np.uint64) << np.uint64(31)
        pos = (least(order << np.uint64(32) | np.arange(len(h), dtype=np.uint64), SPREAD) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        yield s, h, pos, np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])


def anchors(b: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, two context hashes, first window, and number of windows, for each run of :func:`anchor_runs`."""
    out = []
    for s, h, pos, first in anchor_runs(b, hot):
        part = b[s : s + SEGMENT + MATCH - 1]
        count = np.diff(np.r_[first, len(pos)])
        up, down = Powers.to(len(part))
        shape = (pos[first] - first).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + count.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        both = []
        for code in (_OTHER, _THIRD):
            pre = np.r_[np.uint64(0), np.cumsum(code[part] * up, dtype=np.uint64)]
            both.append(mix(mix((pre[first + count + MATCH - 1] - pre[first]) * down[first]) + shape))
        out.append((h[pos[first]], *both, first + s, count))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else tuple(np.zeros(0, t) for t in (*[np.uint64] * 3, *[np.int64] * 2))


def joined(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``data`` one after the other as symbols from 1 on, each followed by a 0, and where the zeros stand."""
    size = stop - start + 1
    ends = np.cumsum(size) - 1
    at = np.arange(size.sum()) + np.repeat(start - (ends - size + 1), size)
    text = data[np.minimum(at, max(0, len(data) - 1))].astype(np.int64) + 1 if len(data) else np.zeros(len(at), np.int64)
    text[ends] = 0
    return text, ends


#: Symbols of 9 bits that are packed into one number, and its least values with their first, second, ... last symbol above 0.
PACKED = 7
_LEAST = np.int64(1) << np.arange(0, 9 * PACKED, 9)


def packed(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """From each place on PACKED symbols, zeros beyond the end of its piece."""
    left = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(len(text))
    wide, out = np.r_[text, np.zeros(PACKED, np.int64)], np.zeros(len(text), np.int64)
    for i in range(PACKED):
        out = out << 9 | np.where(left > i, wide[i : i + len(text)], 0)
    return out


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of :func:`joined` pieces, with samples of the suffix array at the ends of runs.

    Kept are the text, and for each run its symbol, its first row, the row to which that steps back,
    and the places of its first and last suffix. Suffixes end with their piece; equal ones follow the
    order of the pieces. The plain transform and the suffix array are dropped.
    """

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        self.packed = packed(text, ends)
        sa = self._sorted(self.packed, ends)
        bwt = np.where(sa > 0, text[sa - 1], 0)
        self.n, self.first = len(text), int(sa[0])
        self.starts = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        self.symbol = bwt[self.starts]
        length = np.diff(np.r_[self.starts, self.n])
        self.last = self.starts + length - 1
        self.sample = np.stack([sa[self.starts], sa[self.last]])
        self.by_symbol = np.argsort(self.symbol, kind="stable")
        self.target = np.empty(len(length), np.int64)
        self.target[self.by_symbol] = np.cumsum(length[self.by_symbol]) - length[self.by_symbol]
        self.key = self.symbol[self.by_symbol] * len(length) + self.by_symbol

    @staticmethod
    def _sorted(key: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The suffix array, by prefix doubling."""
        n, at = len(key), np.arange(len(key))
        left = np.repeat(ends, np.diff(np.r_[-1, ends])) - at
        depth, most = PACKED, int(left.max()) + 1
        while True:
            sa = np.argsort(key)
            key, rank = key[sa], np.empty(n, np.int64)
            rank[sa] = np.r_[0, np.cumsum(key[1:] != key[:-1])]
            if rank[sa[-1]] == n - 1:
                return sa
            if depth >= most:
                return np.argsort(rank * np.int64(n) + at)
            key = rank * np.int64(n + 1) + np.where(left >= depth, rank[np.minimum(at + depth, n - 1)] + 1, 0)
            depth *= 2

    def agree(self, place: np.ndarray, query: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols, up to ``most``, in which the text from ``place`` and the packed query from ``at`` agree."""
        n, on = np.zeros(len(place), np.int64), np.flatnonzero(most > 0)
        while len(on):
            differ = np.searchsorted(_LEAST, self.packed[place[on] + n[on]] ^ query[at[on] + n[on]], side="right")
            n[on] += PACKED - differ
            on = on[(differ == 0) & (n[on] < most[on])]
        return np.minimum(n, most)

    def matches(self, text: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Stream other pieces backwards through the index, all at once: the places from which at least ``least`` symbols match, and where.

        Each piece keeps a row, its place in the text, and the length of the match there. Where the
        row's symbol is the next one, all three step back. Else the nearest runs of that symbol above
        and below hold the best continuations; their samples give the places at which to compare.
        """
        query, begin = packed(text, ends), np.r_[0, ends[:-1] + 1]
        at, row, place, length, found = ends.copy(), np.zeros(len(ends), np.int64), np.full(len(ends), self.first), np.zeros(len(ends), np.int64), []
        while len(at):
            on = (at > begin) & (length + at - begin >= least)  # a match grows by one a step, so others can't get long enough
            at, begin, row, place, length = (x[on] for x in (at, begin, row, place, length))
            c = text[at - 1]
            run = np.searchsorted(self.starts, row, side="right") - 1
            row, place = self.target[run] + row - self.starts[run], place - 1
            j = np.flatnonzero(self.symbol[run] != c)
            if len(j):
                k = np.searchsorted(self.key, c[j] * len(self.starts) + run[j])
                best, new, row[j], place[j] = np.full(len(j), -1), np.full(len(j), -1), 0, self.first
                for side, near in ((1, k - 1), (0, k)):
                    other = self.by_symbol[np.minimum(np.maximum(near, 0), len(self.key) - 1)]
                    ok = (near >= 0) & (near < len(self.key)) & (self.symbol[other] == c[j])
                    same = np.where(ok, self.agree(self.sample[side, other], query, at[j], np.where(ok, length[j], 0)), -1)
                    better = same > new
                    new, best = np.where(better, same, new), np.where(better, 2 * other + side, best)
                hit = best >= 0
                other, side = best[hit] // 2, best[hit] % 2
                row[j[hit]] = self.target[other] + np.where(side == 1, self.last[other] - self.starts[other], 0)
                place[j[hit]] = self.sample[side, other] - 1
                length[j] = new
            length, at = length + 1, at - 1
            long = length >= least
            found.append((at[long], place[long]))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 2


def repeated_windows(anchor: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of each window of MATCH bytes that also begins in an earlier string of the same anchor.

    Strings of one anchor stand together; no window occurs twice in a string, nor under two anchors.
    """
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    begin = np.cumsum(size) - size
    first = np.r_[True, anchor[1:] != anchor[:-1]] if len(anchor) else np.zeros(0, bool)
    rank = np.arange(len(size)) - np.maximum.accumulate(np.where(first, np.arange(len(size)), 0))
    members = np.diff(np.r_[np.flatnonzero(first), len(size)])[np.cumsum(first) - 1]
    window = np.ones(len(data), bool)
    short = np.minimum(size, MATCH - 1)
    window[np.arange(short.sum()) + np.repeat(begin + size - np.cumsum(short), short)] = False
    alive = window.copy()
    for bit in range(int(members.max() - 1).bit_length() - 1 if len(size) else -1, -1, -1):
        edge = np.flatnonzero(np.diff(np.r_[False, alive, False].astype(np.int8)))
        start, stop = edge[::2], edge[1::2] + MATCH - 1
        of = np.searchsorted(begin, start, side="right") - 1
        both = (rank[of] >> (bit + 1) << (bit + 1)) + (1 << bit) < members[of]
        later = rank[of] >> bit & 1 == 1
        early, late = np.flatnonzero(both & ~later), np.flatnonzero(later)
        if not len(early) or not len(late):
            continue
        text, ends = joined(data, start[late], stop[late])
        at, _ = RunLengthIndex(*joined(data, start[early], stop[early])).matches(text, ends, MATCH)
        piece = np.searchsorted(ends, at)
        alive[at - np.r_[0, ends[:-1] + 1][piece] + start[late][piece]] = False
    gone = np.flatnonzero(window & ~alive)
    name = np.searchsorted(begin, gone, side="right") - 1
    return name, gone - begin[name]


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges sorted by document and start, with those that meet joined."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    place = doc * np.int64(1 << 33)
    reach = np.maximum.accumulate(place + end)
    first = np.r_[True, place[1:] + start[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(first)[1:] - 1, len(doc) - 1]
    return doc[first], start[first], reach[last] - place[first]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` (a null becomes the least long), ``k`` (16 bits of a hash of the text), the text, and other columns."""
    i = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    return docs.select(i.alias("__id"), F.hash(text_col).bitwiseAND(0xFFFF).alias("__k"), F.col(text_col).alias("__text"), *rest)


def _frequent(docs: DataFrame, least: int, avoided: np.ndarray | None = None) -> np.ndarray:
    """Sorted hashes of grams that are anchors ``least`` times or more, where those ``avoided`` are anchors only of windows that have no others; at most MOST_HOT, the most frequent."""
    known = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64) if avoided is None else avoided)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = [], 0

        def often() -> pd.DataFrame:
            a, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"a": a.view(np.int64), "n": n})[n > 1]  # what is single in every task has at most one in REDUCED of all

        for part in batches:
            for t in part["__text"]:
                found = [h[pos[first]] for _, h, pos, first in anchor_runs(_bytes(t), known.value)]
                held += found
                total += sum(map(len, found))
                if total > REDUCED:
                    yield often()
                    held, total = [], 0
        if held:
            yield often()

    counts = docs.select("__text").mapInPandas(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = counts.orderBy(F.desc("n"), "a").limit(MOST_HOT).collect()
    return np.sort(np.array([r["a"] for r in rows], np.int64).view(np.uint64))


def _contexts(docs: DataFrame, hot: np.ndarray, dealt: np.ndarray) -> DataFrame:
    """Contexts, one of each content per task, and ranges that go for another context of the task, packed for the shuffle.

    ``a``: hash of the anchor; ``c, d``: hashes of the context; ``id``; ``p``: 16 bits of the text's
    hash, start and number of windows, and above them whether the anchor is one of ``dealt``. For a range ``p`` is below 0 and
    holds the 16 bits, ``c`` its start, ``d`` its length.
    """
    hot, dealt = (docs.sparkSession.sparkContext.broadcast(x) for x in (hot, dealt))

    def reduced(held: list[tuple]) -> pd.DataFrame:
        names = [(x[5][0], x[6][0]) for x in held]
        held = [held[j] for j in sorted(range(len(held)), key=names.__getitem__)]
        a, c, d, s, n, i, k = (np.concatenate([x[j] for x in held]) for j in range(7))
        # places stand in order already but for repeated rows; contexts whose mixed hashes clash are only reduced later
        order = np.argsort(mix(a ^ mix(c ^ mix(d))), kind="stable") if len(set(names)) == len(names) else np.lexsort((s, k, i, d, c, a))
        a, c, d, s, n, i, k = (x[order] for x in (a, c, d, s, n, i, k))
        first = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])]
        same = np.r_[False, (s[1:] == s[:-1]) & (i[1:] == i[:-1]) & (k[1:] == k[:-1])]
        gone = ~first & ~same
        names, doc = np.unique(np.stack([i, k], 1)[gone], axis=0, return_inverse=True)
        doc, start, end = merged(doc.ravel().astype(np.int64), s[gone], s[gone] + n[gone] + MATCH - 1)
        spread = mix((doc + start * 1_000_003).astype(np.uint64))  # ranges have no anchor; they go anywhere
        whole = lambda x, y: np.r_[x[first].view(np.int64), y.view(np.int64)]
        listed = dealt.value
        often = (listed[np.minimum(np.searchsorted(listed, a), len(listed) - 1)] == a).astype(np.int64) if len(listed) else np.zeros(len(a), np.int64)
        return pd.DataFrame({"a": whole(a, spread), "c": whole(c, start), "d": whole(d, end - start), "id": whole(i, names[doc, 0]), "p": whole(often << 56 | k << 40 | s << 8 | n, -1 - names[doc, 1])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = [], 0
        for part in batches:
            for i, k, t in part.itertuples(index=False):
                found = anchors(_bytes(t), hot.value)
                held.append((*found, np.full(len(found[0]), i, np.int64), np.full(len(found[0]), k, np.int64)))
                total += len(found[0])
                if total > REDUCED:
                    yield reduced(held)
                    held, total = [], 0
        if total:
            yield reduced(held)

    return docs.select("__id", "__k", "__text").mapInPandas(run, "a long, c long, d long, id long, p long")


def _shards(contexts: DataFrame) -> DataFrame:
    """``id, k, s, e``: what goes of the contexts ``a, id, k, s, bytes``, by one index for each SHARD bytes of whole anchors."""

    def marked(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["a", "id", "k", "s"])
        name, at = repeated_windows(rows["a"].to_numpy(), rows["bytes"].tolist())
        n, start, end = merged(name, at, at + MATCH)
        own = rows.iloc[n]
        return pd.DataFrame({"id": own["id"].to_numpy(), "k": own["k"].to_numpy(), "s": own["s"].to_numpy() + start, "e": own["s"].to_numpy() + end})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in batches:
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            while held["bytes"].str.len().sum() >= SHARD:
                size, a = held["bytes"].str.len().cumsum().to_numpy(), held["a"].to_numpy()
                ends = np.flatnonzero(np.r_[a[1:] != a[:-1], False])  # the last anchor may go on
                enough = ends[size[ends] >= SHARD]
                if not len(enough):
                    break
                yield marked(held.iloc[: enough[0] + 1])
                held = held.iloc[enough[0] + 1 :].reset_index(drop=True)
        if held is not None and len(held):
            yield marked(held)

    ordered = contexts.repartition("a").sortWithinPartitions("a", "id", "k", "s")
    return ordered.mapInPandas(run, "id long, k int, s int, e int")


def _by_windows(contexts: DataFrame) -> DataFrame:
    """``id, k, s, e``: what goes of contexts ``id, k, s, bytes`` of crowded anchors, by the first place of each window's 128-bit hash."""
    offsets = F.sequence(F.lit(0), F.octet_length("bytes") - MATCH)
    each = contexts.select("id", "k", F.explode(F.transform(offsets, lambda i: F.struct((F.col("s") + i).alias("s"), F.md5(F.substring("bytes", i + 1, F.lit(MATCH))).alias("h")))).alias("x"))
    each = each.select("x.h", F.struct("id", "k", "x.s").alias("at"))
    first = each.groupBy("h").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last").select("h", "first")
    later = each.join(first, "h").filter("at > first")
    return later.select("at.id", "at.k", "at.s", (F.col("at.s") + MATCH).alias("e"))


def ranges(keyed: DataFrame) -> DataFrame:
    """``id, k, s, e``: byte ranges of the documents of :func:`_documents` that go, several of which may overlap."""
    spark, folder = keyed.sparkSession, shared_dir(keyed.sparkSession)
    large = keyed.filter(F.octet_length("__text") >= MATCH)
    often = F.shiftright("p", 56) == 1
    hot = _frequent(large, HOT)
    part = large.filter(F.pmod(F.xxhash64("__id", "__k"), F.lit(SAMPLED)) == 0)
    packed = _contexts(large, hot, _frequent(part, max(1, HOT // SAMPLED), hot)).withColumn("salt", F.when(often, F.pmod("c", F.lit(SALTS)) + 1).otherwise(0).cast("int")).repartition("a", "salt")  # unpacked after the shuffle
    cut, p = F.col("p") < 0, F.col("p")
    rows = packed.select(
        "a", "salt", F.when(~cut, F.col("c")).alias("c"), F.when(~cut, F.col("d")).alias("d"), "id", F.when(cut, -1 - p).otherwise(F.shiftright(p, 40).bitwiseAND(0xFFFF)).cast("int").alias("k"),
        F.when(cut, F.col("c")).otherwise(F.shiftright(p, 8).bitwiseAND((1 << 32) - 1)).cast("int").alias("s"), F.when(cut, F.col("d")).otherwise(p.bitwiseAND(255) + MATCH - 1).cast("int").alias("n"))
    order, whole = Window.partitionBy("a", "salt").orderBy("c", "d", "id", "k", "s"), Window.partitionBy("a", "salt")
    before, content = F.lag(F.struct("c", "d", "id", "k", "s")).over(order), F.when(F.col("c").isNotNull(), F.struct("c", "d"))
    seen = rows.withColumns({"b": before, "low": F.min(content).over(whole), "high": F.max(content).over(whole)})
    again = F.coalesce((F.col("c") == F.col("b.c")) & (F.col("d") == F.col("b.d")), F.lit(False))
    same = again & (F.col("id") == F.col("b.id")) & (F.col("k") == F.col("b.k")) & (F.col("s") == F.col("b.s"))
    dealt = F.col("salt") > 0  # its other contexts may be elsewhere
    asks = F.col("c").isNotNull() & ~again & (dealt | (F.col("low") != F.col("high")))
    seen = seen.withColumn("asks", asks).withColumn("crowded", F.col("asks") & ~dealt & (F.count_if("asks").over(whole) > CROWDED))
    seen = seen.filter((F.col("c").isNull() | again | F.col("asks")) & ~same)
    seen.select("a", "id", "k", "s", (F.col("s") + F.col("n")).alias("e"), "asks", "crowded", dealt.alias("dealt")).write.parquet(f"{folder}/contexts")
    seen = spark.read.parquet(f"{folder}/contexts")
    # dealt anchors: at most MOST_HOT, their different contexts counted by an aggregate that combines before its shuffle
    counts = seen.filter("asks and dealt").groupBy("a").agg(F.count("*").alias("contents")).filter("contents > 1")
    counted = seen.filter("asks and dealt").join(counts, "a")
    place = ["a", "id", "k", "s", "e"]
    few = seen.filter("asks and not crowded and not dealt").select(*place).unionByName(counted.filter(F.col("contents") <= CROWDED).select(*place))
    many = seen.filter("crowded").select(*place).unionByName(counted.filter(F.col("contents") > CROWDED).select(*place))

    def fetched(contexts: DataFrame) -> DataFrame:
        wanted = contexts.groupBy("id", "k").agg(F.collect_list(F.struct("a", "s", "e")).alias("at"))
        text = keyed.join(wanted, (F.col("__id") == F.col("id")) & (F.col("__k") == F.col("k"))).select("id", "k", F.col("__text").cast("binary").alias("b"), F.explode("at").alias("x"))
        return text.select("x.a", "id", "k", "x.s", F.substring("b", F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("bytes"))

    out = seen.filter("not asks").select("id", "k", "s", "e").unionByName(_shards(fetched(few)))
    if many.limit(1).count():
        out = out.unionByName(_by_windows(fetched(many)))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` plus ``n_bytes``, ``spans`` (removed byte ranges, joined where they meet) and ``kept`` (bytes that stay).

    Fetching contexts and cutting the texts use the same columns by the same keys, so that Spark shuffles the texts once for both.
    """
    docs = replace_columns(text_batches(docs), ["n_bytes", "spans", "kept", "__id", "__k", "__text"], [id_col, text_col])
    keyed = _documents(docs, id_col, text_col)
    gone = ranges(keyed.select("__id", "__k", "__text")).groupBy(F.col("id").alias("__i"), F.col("k").alias("__h")).agg(F.collect_list(F.struct("s", "e")).alias("__gone"))
    out = keyed.join(gone, (F.col("__id") == F.col("__i")) & (F.col("__k") == F.col("__h")), "left")

    def keep(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for t, g in zip(text, gone, strict=True):
            b = _bytes(t)
            s, e = (np.array([x[j] for x in g], np.int64) for j in ("s", "e")) if g is not None and len(g) else (np.zeros(0, np.int64),) * 2
            _, s, e = merged(np.zeros(len(s), np.int64), s, e)
            edge = np.zeros(len(b) + 1, np.int32)
            edge[s] += 1
            edge[e] -= 1
            stay = np.cumsum(edge)[:-1] == 0
            rows.append(([{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)], b[stay].tobytes()))
        return pd.DataFrame({"spans": [r[0] for r in rows], "kept": [r[1] for r in rows]})

    made = F.pandas_udf(keep, "spans array<struct<start:int,end:int>>, kept binary")
    out = out.withColumn("__made", made(F.col("__text"), F.col("__gone")))
    back = {id_col: F.when(F.col("__id") != NO_ID, F.col("__id")).cast(docs.schema[id_col].dataType), text_col: F.col("__text")}
    return out.select(*[back.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns], F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long").alias("n_bytes"), "__made.spans", "__made.kept")
