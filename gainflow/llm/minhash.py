"""Near-duplicate documents by Order MinHash, verified by banded alignment.

The k-mers are shingles of five words, each labelled with its occurrence in the text. For every
hash function the three smallest k-mers are kept in text order, so equal sketches speak for equal
order too; two sketches make one band. Texts that meet in a band are candidates. Their similarity
is that of an alignment of the two shingle sequences: aligned / (all of both - aligned), found by
chaining the common shingles inside the diagonal band that a similarity of 0.8 allows.

Equal word sequences are one node, so copies never meet in a bucket. A bucket's leader is the member
that meets most others over all bands, which in a group of copies is their source; first, every
member is aligned with its buckets' leaders. Only buckets that then still hold several components
go on, and only pairs across components: in buckets of up to SMALL members all of them, in larger
ones first those of the next LEADERS leaders, round by round until a round finds no link. Large
buckets that are open even then are finished exactly, by what their members differ in from their
leader: two texts of similarity 0.8 differ in at most a ninth of their shingles, so texts that are
further than that from their leader must share much of what sets them apart from it. All pairs across
components that may are aligned; the others can't reach 0.8.

Chance of missing a pair: 32 bands of six minima miss one of similarity 0.8 with probability about
(1 - 0.8**6)**32 = 6e-5.

Defined results: texts without words are copies only of equal texts, null counting as empty; an empty
table gives no rows; repeated rows and ties share a class; a class is named by its smallest id (null
ids count only where no other is); texts of any length are hashed and aligned whole, STEP shingles at
a time; other columns of the input, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import KEY, sent, shared_dir, stored, text_batches, with_key
from .components import components, look_up

SHINGLE, SIMILAR = 5, 0.8
#: Of a text's shingles, the part that it and any text of similarity SIMILAR may differ in.
SPARE = (1 - SIMILAR) / SIMILAR
#: Bands, sketches in a band, minima in a sketch.
BANDS, SKETCHES, MINIMA = 32, 2, 3
#: Members up to which all pairs across components are aligned, and leaders that larger buckets take in a later round.
SMALL, LEADERS = 64, 4
#: Longs of a text's sketch (see :func:`parities`), and nodes (some 150 bytes each) whose sketches are broadcast to pairs; beyond, the join shuffles.
LONGS, SKETCHED = 16, 200_000
#: Shingles that are hashed at once.
STEP = 1 << 14

_R = np.random.default_rng(20)
_MULTIPLY = _R.integers(1, 1 << 63, BANDS * SKETCHES, dtype=np.uint64) | np.uint64(1)
_WEIGH = _R.integers(1, 1 << 63, SHINGLE + MINIMA + SKETCHES, dtype=np.uint64) | np.uint64(1)
_WORD = re.compile(r"\w+")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """Shingles in text order, each mixed with its occurrence; a text of fewer than five words is one shingle."""
    if not len(words):
        return words
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    x = mix(sum(words[i : i + n] * _WEIGH[i] for i in range(k)))
    order = np.argsort(x, kind="stable")
    first = np.r_[True, x[order][1:] != x[order][:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    seen = np.empty(n, np.uint64)
    seen[order] = np.arange(n) - start
    return mix(x + seen * np.uint64(0x9E3779B97F4A7C15))


def bands(x: np.ndarray) -> np.ndarray:
    """The band keys of a text's labelled shingles."""
    low, where = [], []
    for i in range(0, len(x), STEP):
        part = x[i : i + STEP]
        h = (part[None, :] * _MULTIPLY[:, None]) >> np.uint64(32)
        h = h.astype(np.uint32)
        rows = np.arange(len(h))
        for _ in range(min(MINIMA, len(part))):
            at = h.argmin(1)
            low.append(h[rows, at].copy())
            where.append(at + i)
            h[rows, at] = 0xFFFFFFFF
    low, where = np.array(low).T, np.array(where).T
    if low.shape[1] > MINIMA:
        best = np.argsort(low, axis=1, kind="stable")[:, :MINIMA]
        where = np.take_along_axis(where, best, 1)
    kept = x[np.sort(where, axis=1)]
    sketch = mix((kept * _WEIGH[SHINGLE : SHINGLE + kept.shape[1]]).sum(1, dtype=np.uint64))
    return mix((sketch.reshape(BANDS, SKETCHES) * _WEIGH[-SKETCHES:]).sum(1, dtype=np.uint64)).astype(np.int64)


def parities(x: np.ndarray) -> np.ndarray:
    """Bits, as longs: whether an odd number of shingles falls to each. Two texts differ in as many shingles as bits, or more."""
    odd = np.bincount((x >> np.uint64(32)).astype(np.int64) % (64 * LONGS), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def chain(at: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    if len(at) < 2 or (np.diff(at) > 0).all():
        return len(at)
    tails: list[int] = []
    for j in at.tolist():
        k = bisect_left(tails, j)
        tails[k : k + 1] = [j]
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Of two labelled shingle sequences: overlap of the sets, and similarity of the banded alignment (0 where the overlap is below SIMILAR)."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    total = len(a) + len(b)
    overlap = len(common) / max(1, total - len(common))
    if overlap < SIMILAR:
        return overlap, 0.0
    band = int(total * (1 - SIMILAR) / (1 + SIMILAR)) + 1
    order = np.argsort(i)
    i, j = i[order], j[order]
    aligned = chain(j[np.abs(i - j) <= band])
    return overlap, aligned / (total - aligned)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: its key, id, ``node`` (hash of the word sequence, or of a text without words); ``bands``, ``size`` in shingles and ``sketch`` (null without words)."""
    keyed = with_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    schema = f"{KEY[0]} long, {KEY[1]} long, id {docs.schema[id_col].dataType.simpleString()}, node binary, bands array<long>, size int, sketch array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashes = WordHashes()
        for part in batches:
            nodes, keys, size, sketch = [], [], [], []
            for t in part["text"]:
                w = word_hashes(t, hashes)
                nodes.append(xxhash.xxh128_digest(w.tobytes() if len(w) else b"-" + (t or "").encode("utf-8", "replace")))
                x = shingles(w)
                keys.append(bands(x) if len(w) else None)
                size.append(len(x))
                sketch.append(parities(x) if len(w) else None)
            yield part.drop(columns="text").assign(node=nodes, bands=keys, size=size, sketch=sketch)

    return text_batches(keyed).select(*KEY, "id", "text").mapInPandas(run, schema)


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The ``pairs`` of nodes (``lead, node``) whose sketches (``node, size, sketch``) let them reach SIMILAR; no other pair can."""
    named = lambda n: sketches.select(F.col("node").alias(n), F.col("size").alias(f"{n}_size"), F.col("sketch").alias(f"{n}_sketch"))
    apart = F.aggregate(F.zip_with("lead_sketch", "node_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    both = pairs.join(named("node"), "node").join(named("lead"), "lead")
    return both.filter(apart <= (F.col("lead_size") + F.col("node_size")) * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-6).select("lead", "node")


def _aligned(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``lead, node, overlap, similar`` for pairs of nodes."""
    named = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"{n}_text"))
    both = pairs.join(named("node"), "node").join(named("lead"), "lead")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, name, lead = WordHashes(), None, np.zeros(0, np.uint64)
        for part in batches:
            out = []
            for r in part.itertuples(index=False):
                if r.lead != name:
                    name, lead = r.lead, shingles(word_hashes(r.lead_text, hashes))
                out.append(similarity(lead, shingles(word_hashes(r.node_text, hashes))))
            yield part[["lead", "node"]].assign(overlap=[x[0] for x in out], similar=[x[1] for x in out])

    return both.select("lead", "node", "lead_text", "node_text").mapInPandas(run, "lead binary, node binary, overlap double, similar double")


def _differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``lead, node, root, size, n, mark, e``: the ``n`` shingles in which a node differs from its leader, those that only the leader has inverted.

    A node that differs in so few that it may be like another without sharing one of them has a row besides that is a mark.
    """
    named = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"{n}_text"))
    both = pairs.join(named("node"), "node").join(named("lead"), "lead").select("lead", "node", "root", "lead_text", "node_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, name, lead = WordHashes(), None, np.zeros(0, np.uint64)
        for part in batches:
            size, n, e = [], [], []
            for r in part.itertuples(index=False):
                if r.lead != name:
                    name, lead = r.lead, shingles(word_hashes(r.lead_text, hashes))
                own = shingles(word_hashes(r.node_text, hashes))
                more, less = np.setdiff1d(own, lead, assume_unique=True), np.setdiff1d(lead, own, assume_unique=True)
                size.append(len(own))
                n.append(len(more) + len(less))
                e.append(np.r_[more, ~less].view(np.int64))
            yield part[["lead", "node", "root"]].assign(size=size, n=n, e=e)

    made = both.mapInPandas(run, "lead binary, node binary, root binary, size int, n int, e array<long>")
    mark = F.when(F.col("n") <= F.col("size") * SPARE + 1e-9, F.array(F.struct(F.lit(True).alias("mark"), F.lit(0).cast("long").alias("e")))).otherwise(F.array().cast("array<struct<mark:boolean,e:bigint>>"))
    each = F.concat(F.transform("e", lambda x: F.struct(F.lit(False).alias("mark"), x.alias("e"))), mark)
    return made.select("lead", "node", "root", "size", "n", F.explode(each).alias("x")).select("lead", "node", "root", "size", "n", "x.*")


def _remaining(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``lead, node``: all pairs of nodes that share a leader in ``members`` (``lead, node, root``), have different roots and may reach SIMILAR, the lesser node first.

    Texts a and b that differ from the leader in A and B differ from each other in what is in one of both only. Of the shingles
    of both together, at most (1 - SIMILAR) / (1 + SIMILAR) may be such; so A and B must share the more, the more there is
    in them. A leader's differences are put in one order, the rarest first; those that nodes of one root only have stand before
    all others and need no rows. At the first shingle that A and B share, no more can be common than what follows in either,
    and what very many nodes have comes so late that hardly any of them meet by it.
    """
    rows = stored(_differences(members, texts))
    # of each difference only nodes outside its largest component meet all others, so that component isn't joined with itself
    most = rows.groupBy("lead", "e", "root").agg(F.count("*").alias("k")).groupBy("lead", "e").agg(F.max_by("root", "k").alias("most"), F.sum("k").alias("k"), F.count("*").alias("roots")).filter("roots > 1")
    follow = F.row_number().over(Window.partitionBy("lead", "node").orderBy("mark", F.desc("k"), F.desc("e")))
    rows = rows.join(most.drop("roots"), ["lead", "e"]).withColumn("at", F.when(F.col("mark"), -1).otherwise(F.col("n") - follow)).filter(F.col("at") <= F.col("size") * SPARE + 1e-9)
    rows = stored(rows.select("lead", "e", "node", "root", "size", "n", "at", (F.col("root") != F.col("most")).alias("minor")))
    a = rows.filter(F.col("at") <= F.col("size") * (SPARE / 2) + 1e-9).select("lead", "e", *[F.col(c).alias(f"a_{c}") for c in ("node", "size", "n", "at", "root", "minor")])
    need = f"(a_n + n - {(1 - SIMILAR) / (1 + SIMILAR)} * (a_size + size)) / 2 - 1e-6"
    fits = f"a_root <> root and a_n <= n and least(a_size, size) >= {SIMILAR} * greatest(a_size, size) - 1e-9 and case when at < 0 or a_at < 0 then {need} <= 0 else least(a_n - a_at, n - at) >= {need} end"
    on = ["lead", "e"]
    pairs = a.filter("a_minor").join(rows, on).filter(fits).unionByName(a.filter("not a_minor").join(rows.filter("minor"), on).filter(fits))
    return pairs.select(F.least("a_node", "node").alias("lead"), F.greatest("a_node", "node").alias("node")).distinct()


def _referred(members: DataFrame) -> DataFrame:
    """``lead, node, root`` for ``lead, lead_weight, node, root``: leaders of much the same nodes give way to one of them.

    What :func:`_remaining` tells from the differences holds for any text that two nodes are held against, so nodes need not be
    held against each of their leaders. A leader gives way to the weightiest leader that most of its nodes have, or stays.
    """
    top = F.max(F.struct("lead_weight", "lead")).over(Window.partitionBy("node"))["lead"]
    votes = members.select("lead", top.alias("top")).groupBy("lead", "top").agg(F.count("*").alias("k"))
    refer = stored(votes.groupBy("lead").agg(F.max(F.struct("k", "top"))["top"].alias("by")))
    return members.join(sent(refer), "lead").select(F.col("by").alias("lead"), "node", "root").distinct()


def links(docs: DataFrame, sig: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``lead, node``: verified links between different word sequences; and the components they make, as ``node, root``."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    nodes = kept(sig.filter("bands is not null").groupBy("node").agg(F.min(F.struct(*KEY, "bands", "size", "sketch")).alias("r")).select("node", "r.*"), "nodes")
    member = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = member.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    member = kept(member.join(shared, ["band", "key"]), "members")
    weight = member.groupBy("node").agg(F.sum("n").alias("weight"))
    member = kept(member.join(weight, "node"), "weighted")
    involved = kept(weight.join(nodes.select("node", *KEY, "size", "sketch"), "node").select("node", *KEY, "size", "sketch"), "involved")
    sketches = sent(involved.select("node", "size", "sketch"), SKETCHED)
    texts = with_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    texts = texts.join(sent(involved.select("node", *KEY)), list(KEY))
    texts = kept(texts.groupBy("node").agg(F.min("text").alias("text")), "texts")
    lead = kept(member.groupBy("band", "key").agg(F.max(F.struct("weight", "node")).alias("h")).select("band", "key", F.col("h.weight").alias("lead_weight"), F.col("h.node").alias("lead")), "leads")
    tested = kept(_aligned(_possible(member.join(lead, ["band", "key"]).filter("lead <> node").select("lead", "node").distinct(), sketches), texts), "tested/0")
    found, open_, i = tested.filter(F.col("similar") >= SIMILAR).select("lead", "node"), member, 0
    while True:
        root = components(found, "lead", "node")
        i += 1
        of = open_.select("band", "key", "node", "n", "weight").join(sent(root), "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = of.groupBy("band", "key").agg((F.min("root") != F.max("root")).alias("several")).filter("several").drop("several")
        open_ = kept(of.join(several, ["band", "key"]).select("band", "key", "node", "root", "n", "weight"), f"open/{i}")
        large = open_.filter(F.col("n") > SMALL)
        rank = F.row_number().over(Window.partitionBy("band", "key").orderBy(F.desc("weight"), "node"))
        upto = large.withColumn("rank", rank).filter(F.col("rank") <= LEADERS * i + 1).filter(F.col("rank") > (LEADERS * (i - 1) + 1 if i > 1 else 0))
        heads = upto.drop("rank") if i > 1 else upto.drop("rank").unionByName(open_.filter(F.col("n") <= SMALL))
        pairs = open_.join(heads.select("band", "key", F.col("node").alias("lead"), F.col("root").alias("lead_root")), ["band", "key"]).filter(f"root <> lead_root and (n > {SMALL} or lead < node)")
        pairs = pairs.select(F.least("lead", "node").alias("lead"), F.greatest("lead", "node").alias("node")).distinct()
        done = tested.select(F.least("lead", "node").alias("lead"), F.greatest("lead", "node").alias("node"))
        new = kept(_aligned(_possible(pairs, sketches).join(done, ["lead", "node"], "left_anti"), texts), f"tested/{i}")
        tested = spark.read.parquet(*[f"{folder}/tested/{k}" for k in range(i + 1)])
        if new.filter(F.col("similar") >= SIMILAR).limit(1).count() == 0:
            break
        found = tested.filter(F.col("similar") >= SIMILAR).select("lead", "node")
    rest = stored(large.join(lead, ["band", "key"]).filter("lead <> node").select("lead", "lead_weight", "node", "root").distinct())
    if rest.limit(1).count() == 0:
        return found, root
    done = tested.select(F.least("lead", "node").alias("lead"), F.greatest("lead", "node").alias("node"))
    last = kept(_aligned(_possible(_remaining(_referred(rest), texts), sketches).join(done, ["lead", "node"], "left_anti"), texts), "last")
    if last.filter(F.col("similar") >= SIMILAR).limit(1).count() == 0:
        return found, root
    found = tested.unionByName(last).filter(F.col("similar") >= SIMILAR).select("lead", "node")
    return found, components(found, "lead", "node")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its key columns, ``id``, ``root`` (the class's smallest node) and ``class_id``."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    signatures(docs, id_col, text_col).write.parquet(f"{folder}/signatures")
    sig = spark.read.parquet(f"{folder}/signatures")
    _, root = links(docs, sig, id_col, text_col)
    least = sig.groupBy("node").agg(F.min("id").alias("least"))
    named = stored(least.join(sent(root), "node", "left").withColumn("root", F.coalesce("root", "node")))
    ids = named.groupBy("root").agg(F.min("least").alias("class_id"))
    return look_up(sig.drop("bands"), look_up(named, ids, "root", "node").select("node", "root", "class_id"), "node", KEY[0]).select(*KEY, "id", "root", "class_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of its smallest id, then smallest key."""
    found = stored(classes(docs, id_col, text_col))
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", *KEY)).alias("s")).select("s.*")
    repeated = found.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1").select(*KEY)
    kept = with_key(docs, id_col, text_col).join(stay.select(*KEY), list(KEY), "left_semi")
    if repeated.limit(1).count():
        kept = kept.join(repeated, list(KEY), "left_anti").unionByName(kept.join(repeated, list(KEY), "left_semi").dropDuplicates(list(KEY)))
    return kept.drop(*KEY)
