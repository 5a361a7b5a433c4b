"""Line dedup within an edit bound of one unit in ten, by a deletion-neighbourhood join (native).

A line is its words, parted by blanks, tabs and carriage returns. Its units are these words, if there
are at least UNITS of them; else the letters of the words joined by single blanks. A line goes if an
equal line, or (for lines of at least UNITS units) one of the same kind of units that differs by one
unit put in, left out or replaced, stands earlier: in a document of smaller id, or in the same
document above. So one word may differ in ten words or more, one letter in a shorter line of ten
letters or more, and nothing in a line shorter than that. This is judged on the input. Blank lines stay.

Lines within the bound agree before and after one place, so each line emits, for a place, the hash
of the units before and of those after a deleted unit, and likewise for a unit it may lack. Lines
that share such a key and place are all within the bound of each other: the earliest of a key
stands for all of them, nothing is paired within it, and what it removes is verified unit by unit.
To keep the keys few, only lines whose first or last half occurs in another line emit them, at the
places in the other half. Hashes of all beginnings and all ends are chained in blocks, so very
long lines cost little more than their length.

Counting is by aggregates that combine before their shuffles; rows of a very frequent line or
key meet only in joins with one row per key, which AQE splits.

Defined results: null text has no lines; an empty table gives no rows; repeated rows (equal id and
text) get equal results and don't remove one another's lines; null ids come first; other lines at
equal places stay if they are equal, else the one of smaller hash stays; very long lines and texts
are worked on whole; input columns named like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import KEY, fixed, replace_columns, shared_dir, with_key

#: Units of which one may differ.
UNITS = 10
#: Documents and lines (some 40 bytes each) whose places are broadcast to fetch their words; beyond, the join shuffles.
SENT = 500_000
#: Units of a block, within which beginnings are hashed one by one.
BLOCK = 64


def _plain(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r", "  "))


def _odd(line: Column) -> Column:
    """Whether a plain split at blanks would not give a line's words."""
    found = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for gap in ("\t", "\r", "  "):
        found = found | F.contains(line, F.lit(gap))
    return found


def line_words(line: Column) -> Column:
    return F.when(_odd(line), F.split(_plain(line), " +")).otherwise(F.split(line, " "))


def _lines(docs: DataFrame) -> DataFrame:
    """Key, id, number, words and hashes of every line that is not blank."""
    line = F.col("line")
    each = docs.select(*KEY, "__id", F.posexplode(F.split("__text", "\n", -1)).alias("no", "line"))
    each = each.filter((line != "") & (~_odd(line) | (_plain(line) != ""))).select(*KEY, "__id", "no", line_words(line).alias("w"))
    return each.select(*KEY, "__id", "no", F.xxhash64("w").alias("l1"), F.hash("w").alias("l2"), *_halves())


def by_words(w: Column) -> Column:
    return F.size(w) >= UNITS


def units(w: Column) -> Column:
    """A line's words, or its letters if the words are few."""
    return F.when(by_words(w), w).otherwise(F.split(F.array_join(w, " "), ""))


def _halves() -> list[Column]:
    """Hashes of a line's first and last half, for partners of as many units or fewer and for those of one more."""
    w, letters, out = F.col("w"), F.array_join("w", " "), []
    for less in (1, 0):
        for n, part, kind in ((F.size(w), lambda at, q: F.slice(w, at, q), "words"), (F.length(letters), lambda at, q: F.substring(letters, at, q), "letters")):
            x = n - less
            q = ((x - 1) / 2).cast("int")
            out.append([F.when(n >= UNITS, F.xxhash64(F.lit(f"{end} {kind}"), x, part(at, q))) for end, at in (("first", F.lit(1)), ("last", n - q + 1))])
    pairs = zip(out[0::2], out[1::2], strict=True)
    return [F.when(by_words(w), a).otherwise(b).alias(f"h{2 * i + j}") for i, (own, few) in enumerate(pairs) for j, (a, b) in enumerate(zip(own, few, strict=True))]


def _chained(df: DataFrame, w: Column, name: str) -> DataFrame:
    """Add the hashes of the first 0, 1, ... units of ``w``, as many as there are units."""
    df = fixed(df, __blocks=F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(BLOCK)), lambda s: F.slice(w, s + 1, F.lit(BLOCK))))
    df = fixed(df, __hashes=F.transform("__blocks", lambda b: F.xxhash64(b)))
    df = fixed(df, __seeds=F.transform("__blocks", lambda b, i: F.xxhash64(F.slice("__hashes", F.lit(1), i))))
    inner = lambda b, i: F.transform(b, lambda w, r: F.xxhash64(F.get("__seeds", i), F.slice(b, F.lit(1), r)))
    return fixed(df, **{name: F.flatten(F.transform("__blocks", inner))}).drop("__blocks", "__hashes", "__seeds")


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """``key`` and the line's place (id, no, l1), for each place in the halves that may differ."""
    lines = fixed(lines.withColumn("by_words", by_words(F.col("w"))), u=units(F.col("w")))
    n = F.size("u")
    # b[i]: the first i units, e[i]: the units from the i-th on; one more unit makes room for the whole line
    marked = _chained(fixed(lines, __w=F.concat("u", F.array(F.lit("")))), F.col("__w"), "b")
    marked = _chained(fixed(marked, __r=F.concat(F.reverse("u"), F.array(F.lit("")))), F.col("__r"), "r")
    marked = fixed(marked, e=F.reverse("r"))
    q = ((n - 2) / 2).cast("int")
    places = F.filter(F.sequence(F.lit(0), n), lambda i: (F.col("after") & (i >= q)) | (F.col("before") & (i <= n - q)))
    gone = F.transform(F.filter(places, lambda i: i < n), lambda i: F.xxhash64("by_words", i, F.get("b", i), F.get("e", i + 1)))
    lacks = F.transform(places, lambda i: F.xxhash64("by_words", i, F.get("b", i), F.get("e", i)))
    return marked.select("l1", "__id", "no", F.explode(F.concat(gone, lacks)).alias("key"))


def near(a: Column, b: Column) -> Column:
    """Whether two lists of units differ by one unit put in, left out or replaced, or not at all."""
    alike = lambda x, y: F.concat(F.zip_with(x, y, lambda v, w: F.coalesce(v == w, F.lit(False))), F.array(F.lit(False)))
    same = lambda x, y: F.array_position(alike(x, y), F.lit(False)) - 1
    return same(a, b) + same(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def decide(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document key: ``gone``, the numbers of the lines that go."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    docs = docs.select(*KEY, F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    hashes = [f"h{i}" for i in range(4)]
    _lines(docs).write.parquet(f"{folder}/lines")
    lines = spark.read.parquet(f"{folder}/lines")
    first = F.min(F.struct("__id", "no", *KEY)).alias("f")
    lines.groupBy("l1", "l2").agg(first, F.count("*").alias("copies")).select("l1", "l2", "f.*", "copies").write.parquet(f"{folder}/distinct")
    each = spark.read.parquet(f"{folder}/distinct")

    half = lines.filter("h0 is not null").select("l1", F.posexplode(F.array(*hashes)).alias("which", "half"))
    shared = half.groupBy("half").agg(F.min("l1").alias("low"), F.max("l1").alias("high")).filter("low < high").select("half")
    wanted = half.join(shared, "half").groupBy("l1").agg(F.max(F.col("which") % 2 == 0).alias("after"), F.max(F.col("which") % 2 == 1).alias("before"))
    wanted = each.join(wanted, "l1").groupBy(*KEY).agg(F.collect_list(F.struct("no", "l1", "before", "after")).alias("at"))
    wanted.write.parquet(f"{folder}/asked")
    wanted = spark.read.parquet(f"{folder}/asked")
    few = wanted.agg(F.count("*").alias("n"), F.sum(F.size("at")).alias("lines")).first()
    few = few["n"] + (few["lines"] or 0) <= SENT
    text = docs.join(F.broadcast(wanted) if few else wanted, list(KEY)).select("__id", F.split("__text", "\n", -1).alias("all"), "at")
    text = text.select("__id", "all", F.explode("at").alias("a")).select("__id", "a.*", line_words(F.get("all", F.col("a.no"))).alias("w"))
    text.dropDuplicates(["l1"]).write.parquet(f"{folder}/wanted")
    wanted = spark.read.parquet(f"{folder}/wanted")

    # the keys are hashed once, though both their heads and the lines that these remove are found from them
    _neighbourhood(wanted).write.parquet(f"{folder}/keys")
    keys, place = spark.read.parquet(f"{folder}/keys"), F.struct("__id", "no", "l1")
    heads = keys.groupBy("key").agg(F.min(place).alias("head"), F.count("*").alias("n")).filter("n > 1").select("key", "head")
    found = keys.join(heads, "key").filter(F.col("head") < place).groupBy("l1").agg(F.min("head").alias("head")).select("l1", F.col("head.l1").alias("by"))
    found = found.join(wanted.select("l1", "w"), "l1").join(wanted.select(F.col("l1").alias("by"), F.col("w").alias("by_w")), "by")
    found = fixed(found, __u=units(F.col("w")), __by=units(F.col("by_w")))
    found.filter(near(F.col("__u"), F.col("__by")) & (by_words(F.col("w")) == by_words(F.col("by_w")))).select("l1", F.hash("w").alias("l2")).write.parquet(f"{folder}/near")
    found = spark.read.parquet(f"{folder}/near")

    # lines that stand more than once keep their first place, near ones none
    twice = each.filter("copies > 1").join(found, ["l1", "l2"], "left_anti").select("l1", "l2", F.col("__id").alias("id0"), F.col("no").alias("no0"), F.lit(False).alias("near"))
    none = F.lit(None)
    flags = twice.unionByName(found.select("l1", "l2", none.cast(docs.schema["__id"].dataType).alias("id0"), none.cast("int").alias("no0"), F.lit(True).alias("near")))
    at = lines.select(*KEY, "__id", "no", "l1", "l2").join(flags, ["l1", "l2"])
    later = ~(F.col("__id").eqNullSafe(F.col("id0")) & F.col("no").eqNullSafe(F.col("no0")))
    return at.filter(F.col("near") | later).groupBy(*KEY).agg(F.collect_set("no").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns of ``docs``, the text without the lines that go, plus ``n_lines`` and ``n_removed``."""
    docs = with_key(replace_columns(docs, ["n_lines", "n_removed"], [id_col, text_col]), id_col, text_col)
    out = docs.join(decide(docs, id_col, text_col).select(*KEY, F.col("gone").alias("__gone")), list(KEY), "left")
    out = fixed(out, __all=F.split(text_col, "\n", -1))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__all") - 1), F.col("__gone")), lambda i: F.get(F.col("__all"), i))
    out = out.withColumns({"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__all")).cast("long"), "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")})
    return out.withColumn(text_col, F.when(F.col("__gone").isNotNull(), F.array_join(stay, "\n")).otherwise(F.col(text_col))).drop("__all", "__gone", *KEY)
