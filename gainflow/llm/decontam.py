"""Benchmark decontamination by a broadcast hash set of normalised n-grams (native).

A-Z are lower-cased and words are runs of digits, letters and non-ASCII characters. Every
window of ``n`` consecutive benchmark words (a shorter item: all its words) goes into a hash
set of the n-grams themselves, so that a hit in the broadcast join is at once verified by
equality of all its words. The set's windows each have an anchor, their longest word; a second
hash set of anchors with their offsets tells which windows of a document can be in the set at
all, and only those are put together and looked up. No window that could hit is left out. A set too
large to be sent is joined by 64-bit hashes of windows, one row for each window of a document, and
only windows whose hash is in the set are put together and compared word by word.

Defined results: a null or empty text has no words and no hits; a null id is kept; repeated rows
get equal results; equal windows of several items count for each; an empty benchmark or document
table gives no hits or no rows; texts of any length are searched whole, and no row between the scan
and a hit holds more than one text; input columns named like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import KEY, ascii_lower, fixed, replace_columns, with_key

#: The ASCII characters that are no part of a word. They are listed one by one: Java's regular
#: expressions look such a class up in a table, ranges by one comparison after the other.
GAPS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
#: Words of a text, of whatever case.
WORD = f"[^{GAPS}]+"
WINDOW = 13
#: Bytes of distinct windows up to which they are broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """Distinct windows: ``gram`` (words joined by a space), ``width`` and the sorted ``items`` it comes from."""
    w = benchmark.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("width", F.least(F.size("w"), F.lit(n)))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1), lambda i: F.array_join(F.slice("w", i, F.col("width")), " "))
    return w.select("item", "width", F.explode(grams).alias("gram")).groupBy("gram", "width").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _anchors(windows: DataFrame) -> DataFrame:
    """Distinct ``word, offset, width``: where in a window of the set its longest word stands."""
    w = windows.select("width", F.split("gram", " ").alias("w"))
    longest = F.array_max(F.transform("w", lambda x, i: F.struct(F.length(x).alias("n"), x.alias("word"), (-i).alias("before"))))
    return w.select("width", longest.alias("a")).select(F.col("a.word").alias("anchor"), (-F.col("a.before")).alias("offset"), "width").distinct()


def _hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Key, position and width of each window of a document that is in the set, with its items; the set is broadcast."""
    each = docs.select(*KEY, words(F.col("__text")).alias("w")).select(*KEY, "w", F.posexplode("w").alias("i", "anchor"))
    at = F.col("i") - F.col("offset")
    fits = (at >= 0) & (at + F.col("width") <= F.size("w"))
    near = each.join(F.broadcast(_anchors(windows)), "anchor")
    grams = near.select(*KEY, at.alias("pos"), F.when(fits, F.array_join(F.slice("w", at + 1, F.col("width")), " ")).alias("gram"))
    return grams.join(F.broadcast(windows), "gram")


def _shuffled_hits(docs: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    """What :func:`_hits` returns, for a set of any size: rows before the filter hold a key, a place and a hash, no words."""
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    known = windows.select("width", F.xxhash64(hashes(F.split("gram", " "))).alias("h")).distinct()
    own = fixed(docs.select(*KEY, "__text"), __h=hashes(words(F.col("__text")))).select(*KEY, "__h")

    def places(width: int) -> Column:
        first = F.when(F.size("__h") >= width, F.sequence(F.lit(0), F.size("__h") - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(first, lambda i: F.struct(i.alias("pos"), F.lit(width).alias("width"), F.xxhash64(F.slice("__h", i + 1, width)).alias("h")))

    each = own.select(*KEY, F.explode(F.concat(*map(places, widths))).alias("x")).select(*KEY, "x.*")
    near = each.join(known, ["width", "h"]).groupBy(*KEY).agg(F.collect_set(F.struct("pos", "width")).alias("__at"))
    text = fixed(docs.select(*KEY, "__text").join(near, list(KEY)), __w=words(F.col("__text")))
    gram = F.transform("__at", lambda p: F.struct(p["pos"].alias("pos"), F.array_join(F.slice("__w", p["pos"] + 1, p["width"]), " ").alias("gram")))
    return text.select(*KEY, F.explode(gram).alias("x")).select(*KEY, "x.*").join(windows, "gram")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` plus ``n_words``, ``n_hit``, ``hits`` (positions of hit words, sorted), ``items`` and ``contaminated``.

    A word inside any occurrence of a benchmark window is hit; a document is contaminated if at
    least one in twenty of its words is.
    """
    outputs = ["n_words", "n_hit", "hits", "items", "contaminated"]
    docs = with_key(replace_columns(docs, outputs, [id_col, text_col]), id_col, text_col)
    windows = benchmark_windows(benchmark, item_col, item_text_col, n)
    sizes = windows.groupBy("width").agg(F.sum(F.length("gram") + 16 * F.size("items") + 64).alias("bytes")).collect()  # at most n rows
    text = docs.withColumn("__text", F.col(text_col))
    n_words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    none = F.array().cast("array<int>")
    item_type = f"array<{benchmark.schema[item_col].dataType.simpleString()}>"
    if not sizes:
        return docs.drop(*KEY).select("*", n_words.alias("n_words"), F.lit(0).cast("long").alias("n_hit"), none.alias("hits"), F.array().cast(item_type).alias("items"), F.lit(False).alias("contaminated"))
    small = sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES
    found = _hits(text, windows) if small else _shuffled_hits(text, windows, [r["width"] for r in sizes])
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda h: F.sequence(h["pos"], h["pos"] + h["width"] - 1)))))
    hits = found.groupBy(*KEY).agg(F.collect_set(F.struct("pos", "width")).alias("at"), F.collect_set("items").alias("sets")).select(
        *KEY, covered.alias("__hits"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("__items"))
    out = docs.withColumn("n_words", n_words).join(hits, list(KEY), "left")
    hit = F.coalesce("__hits", none)
    out = out.withColumns({"n_hit": F.size(hit).cast("long"), "hits": hit, "items": F.coalesce("__items", F.array().cast(item_type))})
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return out.drop(*KEY, "__hits", "__items")


def remove_hits(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Take the hit words out of the texts that :func:`contamination` returned; all else stays as it is."""
    found = fixed(found, __gaps=F.split(text_col, WORD, -1), __own=F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)))
    found = fixed(found, __keep=F.array_except(F.sequence(F.lit(0), F.size("__own")), F.col("hits")))
    # the pieces that stay, each with its place: every gap, and the words that are not hit
    gaps = F.transform("__gaps", lambda g, i: F.struct((2 * i).alias("at"), g.alias("piece")))
    own = F.transform(F.filter("__keep", lambda i: i < F.size("__own")), lambda i: F.struct((2 * i + 1).alias("at"), F.get("__own", i).alias("piece")))
    kept = F.array_join(F.transform(F.array_sort(F.concat(gaps, own)), lambda p: p["piece"]), "")
    return found.withColumn(text_col, F.when(F.col("n_hit") > 0, kept).otherwise(F.col(text_col))).drop("__gaps", "__own", "__keep")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents (``mode="documents"``) or without their hit words (``mode="spans"``)."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    found, columns = contamination(docs, benchmark, id_col, text_col), docs.columns
    if mode == "spans":
        return remove_hits(found, text_col).select(*[c for c in columns if c in found.columns])
    return found.filter(~F.col("contaminated")).select(*[c for c in columns if c in found.columns])
