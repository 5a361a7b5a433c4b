"""Conversation structure repair by a fold with higher-order functions (native).

The rows of a conversation are taken by turn (nulls first), then role, then text. A row's first fault counts: blank (nothing but
blanks, tabs and line ends), duplicate (role and text stand earlier), truncated (its last character that is none of these is no
``. ! ?``). The cheapest edits then give role initials ``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (2), Delete (3, required
for blank and duplicate rows), Insert an empty user or assistant anywhere (2); a truncated row that stays adds 1. Ties go to the
ASCII-least string of the edits' initials.

``aggregate()`` carries four structs (cost, audit), one for each state: nothing yet, after s, after u, after a; ``least`` picks. Since
the state and the initial tell what a Rerole or an Insert makes, an audit alone fixes the repaired conversation.

No conversation need fit in a task: the sorted order of all rows is cut into blocks of BLOCK rows. Windows flag what neighbours tell
inside a block; first occurrences come from an aggregate that combines before its shuffle. A block's fold starts from each of
the four states, and a second fold runs over a conversation's blocks, so that only some bytes a row meet there, never texts.

Defined results: null roles and texts count as one blank (a null text is blank, a role of a blank fits nowhere); null conversation
ids are one conversation; null turns come first and count in no gap; repeated rows are duplicates, whatever their turns; a role counts by its
first character, as it is written; an empty table gives no rows; texts of any length are judged and kept whole; other columns
of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import shared_dir

#: Rows of a block.
BLOCK = 512
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Characters of a text by which rows of one turn and role are dealt to sorted ranges.
HEAD = 32

_BLANKS = "\t\n\x0b\x0c\r"
_CELL = "struct<cost:bigint,audit:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _add(cell: Column, cost: Column | int, letter: Column | str) -> Column:
    """A cell after an edit; null stays null, for a state that can't be reached."""
    cost, letter = (x if isinstance(x, Column) else F.lit(x) for x in (cost, letter))
    return F.when(cell.isNotNull(), F.struct((cell["cost"] + cost).cast("bigint").alias("cost"), F.concat(cell["audit"], letter).alias("audit")))


def _state(*cells: Column) -> Column:
    return F.struct(*[c.cast(_CELL).alias(f"s{i}") for i, c in enumerate(cells)])


def _start(at: Column) -> Column:
    """Cost 0 in one state."""
    none, zero = F.lit(None).cast(_CELL), F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit"))
    return _state(*[F.when(at == i, zero).otherwise(none) for i in range(4)])


def _inserted(s: Column) -> Column:
    """States after the inserts that may be worth it: none, one or two."""
    one = lambda c: _add(c, INSERT, "I")
    two = lambda c: _add(c, 2 * INSERT, "II")
    return _state(s["s0"], s["s1"], F.least(s["s2"], one(s["s0"]), one(s["s1"]), one(s["s3"])), F.least(s["s3"], one(s["s2"]), two(s["s0"]), two(s["s1"])))


def _row(s: Column, r: Column) -> Column:
    """States after one more row."""
    more = F.when(r["truncated"], TRUNCATED).otherwise(0)

    def kept(cell: Column, initial: str) -> Column:
        own = r["initial"] == initial
        return F.when(~r["gone"], _add(cell, more + F.when(own, 0).otherwise(REROLE), F.when(own, "K").otherwise("R")))

    def edited(i: Column) -> Column:
        gone = [_add(i[f"s{j}"], DELETE, "D") for j in range(4)]
        system = F.when(~r["gone"] & (r["initial"] == "s"), _add(i["s0"], more, "K"))
        user = _let(F.least(i["s0"], i["s1"], i["s3"]), lambda c: kept(c, "u"))
        return _state(gone[0], F.least(gone[1], system), F.least(gone[2], user), F.least(gone[3], kept(i["s2"], "a")))

    return _let(_inserted(s), edited)


def _block(s: Column, b: Column) -> Column:
    """States after one more block, of which ``b.m[i]`` has the states reached from state i."""
    def after(j: int) -> Column:
        cells = [(s[f"s{i}"], F.get(b["m"], F.lit(i))[f"s{j}"]) for i in range(4)]
        return F.least(*[F.when(m.isNotNull(), _add(c, m["cost"], m["audit"])) for c, m in cells])

    return _state(*[after(j) for j in range(4)])


def faults(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``k`` (the conversation's key), ``conv_id, turn, role, text``, place ``id`` in the order of all rows, its ``block``, and ``blank, duplicate, truncated``; stored."""
    spark, folder = rows.sparkSession, shared_dir(rows.sparkSession)
    conv = F.col(f"`{conv_col}`")
    key = F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))
    own = rows.select(key.alias("k"), conv.alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), *[F.coalesce(F.col(f"`{c}`"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    own = own.repartitionByRange("k", "turn", "role", F.left("text", F.lit(HEAD))).sortWithinPartitions("k", "turn", "role", "text")
    own = own.withColumn("id", F.monotonically_increasing_id()).withColumn("block", F.expr(f"id div {BLOCK}"))
    tail = F.rtrim(F.translate("text", _BLANKS, " " * len(_BLANKS)))
    own = own.withColumn("blank", tail == "").withColumn("open", ~F.substring(tail, -1, 1).isin(".", "!", "?"))
    own = own.withColumn("same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    own.write.parquet(f"{folder}/rows")
    own = spark.read.parquet(f"{folder}/rows")
    first = own.groupBy("k", "same").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    flags = own.select("k", "block", "id", "same", "blank", "open").join(first, ["k", "same"], "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    flags = flags.select("k", "block", "id", duplicate.alias("duplicate"), (F.col("open") & ~F.col("blank") & ~duplicate).alias("truncated"))
    flags.write.parquet(f"{folder}/flags")
    return own.drop("open", "same").join(spark.read.parquet(f"{folder}/flags"), ["k", "block", "id"])


def solve(flagged: DataFrame) -> DataFrame:
    """Per conversation: ``k, conv_id``, the numbers of faults, ``illegal``, ``cost, audit``, and ``blocks`` (block, its first place and rows, in order)."""
    compact = flagged.select("k", "conv_id", "block", "id", "blank", "duplicate", "truncated", F.left("role", F.lit(1)).alias("initial"))
    fits = lambda a, b: F.concat(a, b).isin("su", "ua", "au")
    before = F.lag("initial").over(Window.partitionBy("k", "block").orderBy("id"))
    compact = compact.withColumn("illegal", before.isNotNull() & ~fits(before, F.col("initial")))
    total = [F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    row = F.struct("id", "initial", (F.col("blank") | F.col("duplicate")).alias("gone"), "truncated")
    made = compact.groupBy("k", "block").agg(
        F.first("conv_id").alias("conv_id"), F.min("id").alias("start"), F.count("*").alias("n"), *total,
        F.min_by("initial", "id").alias("head"), F.max_by("initial", "id").alias("tail"), F.array_sort(F.collect_list(row)).alias("rows"))
    fold = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.aggregate("rows", _start(i), _row))
    made = made.withColumn("m", fold).drop("rows")
    each = F.array_sort(F.collect_list(F.struct("block", "start", "n", "head", "tail", "m")))
    whole = made.groupBy("k").agg(F.first("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], each.alias("b"))
    between = F.filter(F.zip_with(F.slice("b", 2, F.size("b")), F.slice("b", 1, F.size("b") - 1), lambda y, x: F.when(y.isNotNull() & x.isNotNull(), ~fits(x["tail"], y["head"]))), lambda bad: F.coalesce(bad, F.lit(False)))
    best = _let(F.aggregate("b", _start(F.lit(0)), _block), lambda s: _let(_inserted(s), lambda i: F.least(i["s0"], i["s3"])))
    whole = whole.withColumn("illegal", F.col("illegal") + F.size(between)).withColumn("best", best)
    return whole.select("k", "conv_id", "blank", "duplicate", "truncated", "illegal", "best.*", F.transform("b", lambda x: F.struct(x["block"].alias("block"), x["start"].alias("start"), x["n"].alias("n"))).alias("blocks"))


def repaired(flagged: DataFrame, solved: DataFrame) -> DataFrame:
    """``k, conv_id, id, part, role, text, edit``: the rows that the edits leave, in the order of ``id, part``; ``edit`` is keep, rerole or insert."""
    # one token a row: the inserts before it and its own edit; the last has those at the end as well
    tokens = F.regexp_extract_all("audit", F.lit("I*[DKR](?:I+$)?"), F.lit(0))
    at = solved.select("k", "audit", tokens.alias("tokens"), F.posexplode("blocks").alias("i", "b"), "blocks")
    skipped = F.aggregate(F.slice("blocks", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda n, b: n + b["n"]).cast("int")
    made = lambda s: F.length(F.translate(s, "D", ""))
    at = at.select("k", F.col("b.block").alias("block"), F.col("b.start").alias("start"), F.slice("tokens", skipped + 1, F.col("b.n").cast("int")).alias("own"), (made(F.array_join(F.slice("tokens", F.lit(1), skipped), "")) - made("audit") % 2).alias("before"))
    place = (F.col("id") - F.col("start")).cast("int")
    rows = flagged.join(at, ["k", "block"]).withColumn("token", F.get("own", place))
    rows = rows.withColumn("before", F.col("before") + made(F.array_join(F.slice("own", F.lit(1), place), ""))).withColumn("letters", F.split(F.translate("token", "D", ""), ""))
    rows = rows.filter("length(translate(token, 'D', '')) > 0").select("k", "conv_id", "id", "role", "text", "before", F.posexplode("letters").alias("part", "letter"))
    role = F.when(F.col("letter") == "K", F.col("role")).when((F.col("before") + F.col("part")) % 2 == 0, "user").otherwise("assistant")
    return rows.select("k", "conv_id", "id", "part", role.alias("role"), F.when(F.col("letter") == "I", "").otherwise(F.col("text")).alias("text"), F.when(F.col("letter") == "K", "keep").when(F.col("letter") == "R", "rerole").otherwise("insert").alias("edit"))


def gaps(flagged: DataFrame) -> DataFrame:
    """``k, gaps``: turns that are missing between a conversation's first and last, nulls aside."""
    turns = flagged.filter("turn is not null").groupBy("k")
    return turns.agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"))


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of ``conv_id:turn``: one row in twenty each is dropped, emptied, loses its sentence ends, is repeated, gets the role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(text("role")).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"), times.alias("times"))
    return out.withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("__n", "times")
