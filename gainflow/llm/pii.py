"""Personal data: regular expressions propose, checksums confirm, context words score (native).

Base kinds are email, ip, card and phone; ``iban`` is an added kind, confirmed by mod-97. Each
kind's matches are leftmost and do not overlap within the kind; a match that fails its check is
dropped and not tried again. Positions are code points, the end exclusive. They come from the
lengths of the pieces between matches, summed by a window over one document's matches, so the
cost stays linear for texts with very many matches and no text is shuffled.

Where a pattern begins with a long run, it may only begin at the run's start or at the end of
the previous match (``\\G``); any other start inside the run has the same continuation, so the
matches are those of the plain pattern without its quadratic retries.

Defined results: null and empty texts have no spans; an empty table gives no rows; repeated rows get
equal results; ties don't arise, for kinds are found apart; a null id is kept; texts of any length are
searched whole; an input column named like the output column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import KEY, replace_columns, with_key

#: Kinds in the order in which spans are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: What a text must hold for the pattern to match at all.
NEEDS = {"email": r"[A-Za-z0-9]@[A-Za-z0-9-]|[._%+-]@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}"}
#: Words near a match that speak for the kind.
CONTEXT = {
    "email": r"(?i)e-?mail|mail|contact|write|@",
    "ip": r"(?i)\bip\b|host|server|address|login|from",
    "card": r"(?i)card|visa|master|amex|credit|debit|pay",
    "phone": r"(?i)phone|tel|call|mobile|fax|contact",
    "iban": r"(?i)iban|bank|account|konto|transfer|bic",
}
#: Characters on either side in which context words are looked for.
REACH = 48


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 modulo 97, its first four characters moved to the end."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _confirmed(kind: Column, value: Column) -> Column:
    n = F.length(digits(value))
    part = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)
    plain = F.replace(value, F.lit(" "), F.lit(""))
    return (
        F.when(kind == "ip", F.forall(F.split(value, r"\."), part))
        .when(kind == "card", F.when(n.between(16, 19), luhn(digits(value))).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .when(kind == "iban", F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False))
        .otherwise(True)
    )


def _spans(docs: DataFrame) -> DataFrame:
    """One row per confirmed span: key, kind, rank, start, end, value, score."""
    text = F.col("__text")

    def proposals(kind: str) -> Column:
        gaps, own = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        zipped = F.arrays_zip(gaps, own, F.slice(gaps, F.lit(2), F.size(gaps))).cast("array<struct<gap:string,own:string,next:string>>")
        around = lambda p: F.concat(F.right(p["gap"], F.lit(REACH)), F.lit(" "), F.left(F.coalesce(p["next"], F.lit("")), F.lit(REACH)))
        one = lambda p, i: F.struct(F.lit(KINDS.index(kind)).alias("rank"), i.alias("i"), F.length(p["gap"]).alias("gap"), p["own"].alias("value"), around(p).alias("around"))
        found = F.transform(F.filter(zipped, lambda p: p["own"].isNotNull()), one)
        return F.when(text.rlike(NEEDS[kind]), found).otherwise(F.array().cast("array<struct<rank:int,i:int,gap:int,value:string,around:string>>"))

    rows = docs.select(*KEY, F.explode(F.concat(*map(proposals, KINDS))).alias("m")).select(*KEY, "m.*").distinct()
    upto = Window.partitionBy(*KEY, "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(upto))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    rows = rows.withColumn("kind", kind).filter(_confirmed(F.col("kind"), F.col("value")))
    near = F.lit(False)
    for k in KINDS:
        near = F.when(F.col("kind") == k, F.col("around").rlike(CONTEXT[k])).otherwise(near)
    checked = F.when(F.col("kind").isin("card", "iban"), 0.3).when(F.col("kind") == "phone", 0.0).otherwise(0.1)
    return rows.select(*KEY, "rank", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value", (F.lit(0.5) + checked + F.when(near, 0.2).otherwise(0.0)).alias("score"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` plus ``pii``: its spans (rank, start, end, kind, value, score), sorted by kind as in KINDS, then start."""
    docs = with_key(replace_columns(docs, ["pii"], [id_col, text_col]), id_col, text_col)
    spans = _spans(docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))))
    each = spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "start", "end", "kind", "value", "score"))).alias("pii"))
    kind = "array<struct<rank:int,start:bigint,end:bigint,kind:string,value:string,score:double>>"
    return docs.join(each, list(KEY), "left").withColumn("pii", F.coalesce("pii", F.array().cast(kind))).drop(*KEY)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    return found.select(
        F.col(id_col).alias("doc_id"), *map(count, BASE),
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", name), ",").alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)), 6).alias("top_score"))
