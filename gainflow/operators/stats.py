"""Ranks, permutation statistics, verdicts, correlations and sensitivity indices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pharm
from ..lineage import cut


def ordinal(df: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """Number all rows in an order, from 1, without one task seeing them all: ranges of the order are numbered each, then moved by the counts of those before."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = ranged.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__own", own).join(F.broadcast(before.drop("n")), "__part").withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__part", "__own", "__before")


def numbered(df: DataFrame, by: list[str], *order: Column | str, name: str) -> DataFrame:
    """Number the rows of each group in an order, from 1, without one task seeing a whole group: :func:`ordinal` less the group's first."""
    if not by:
        return ordinal(df, *order, name=name)
    rows = cut(ordinal(df, *by, *order, name=name))
    first = rows.groupBy(*by).agg(F.min(name).alias("__first"))
    return rows.join(first, by).withColumn(name, F.col(name) - F.col("__first") + 1).drop("__first")


def prefix_sums(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` up to and with each row, in each group's order; ties share it. Ranges of the order are summed each, then moved by the sums of those before."""
    ranged = cut(df.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()))
    own = F.sum(value).over(Window.partitionBy("__part", *by).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    parts = ranged.groupBy(*by, "__part").agg(F.sum(value).alias("__n"))  # a row for each task that holds a part of a group
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__own", own).join(parts.select(*by, "__part", before.alias("__before")), [*by, "__part"]).withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def average_rank(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Average ranks with ties, NULL values unranked: ordinals of distinct values with their counts, then a join back."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ranged = cut(counts.repartitionByRange("__v").withColumn("__part", F.spark_partition_id()))
    upto = Window.partitionBy("__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    parts = ranged.groupBy("__part").agg(F.sum("__n").alias("n"))
    before = parts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranks = ranged.withColumn("__up", F.sum("__n").over(upto)).join(F.broadcast(before), "__part")
    ranks = ranks.select("__v", (F.col("__before") + F.col("__up") - (F.col("__n") - 1) / 2).alias(name))
    return df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group, between neighbours by their distance; NULL values are left out and no group's rows meet in one task."""
    rows = numbered(df.filter(F.col(value).isNotNull()).select(*by, value), by, value, name="__k")
    n = rows.groupBy(*by).agg(F.max("__k").alias("__n"))
    place = lambda q: (F.col("__n") - 1) * F.lit(q) + 1
    some = rows.join(n, by)
    pick = lambda k: F.max(F.when(F.col("__k") == k, F.col(value)))

    def between(q: float) -> Column:
        low, high = pick(F.floor(place(q))), pick(F.ceil(place(q)))
        return low + (high - low) * F.max(place(q) - F.floor(place(q)))

    return some.groupBy(*by).agg(*[between(q).alias(name) for name, q in at.items()])


def correlation(x: str, y: str) -> Column:
    """Pearson's coefficient as an aggregate; NULL, not an error, where a column has no variance."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson and Spearman over rows where both are finite; NULL below three rows or without variance."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = df.filter(finite(a) & finite(b)).select(F.col(a).alias("x"), F.col(b).alias("y"))
    rows = average_rank(average_rank(rows, "x", "rx"), "y", "ry")
    enough = lambda x, y: F.when(F.count("*") >= 3, correlation(x, y))
    return rows.agg(F.count("*").alias("n"), enough("x", "y").alias("pearson"), enough("rx", "ry").alias("spearman"))


def kendall(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Kendall's tau-b per group, without pairs.

    Places of the second value are split by their bits: two different places differ first in one bit, below equal higher
    ones. For each bit, a row with a 1 there meets the rows with a 0 and the same higher bits through running sums over the first value.
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(by, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    place = numbered(cells.select(by, "y").distinct(), [by], "y", name="k")
    cells = cut(cells.join(place, [by, "y"]))
    bits = max(1, int(cells.agg(F.max("k")).first()[0] or 1).bit_length())
    each = cells.select(by, "x", "n", "k", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    one = F.expr("shiftright(k, bit) & 1") == 1
    each = each.groupBy(by, "bit", F.expr("shiftright(k, bit + 1)").alias("block"), "x").agg(F.sum(F.when(one, 0).otherwise(F.col("n"))).alias("zeros"), F.sum(F.when(one, F.col("n")).otherwise(0)).alias("ones"))
    on = [by, "bit", "block"]
    upto = prefix_sums(each, on, "x", "zeros", "upto").join(each.groupBy(*on).agg(F.sum("zeros").alias("all")), on)
    s = upto.groupBy(by).agg(F.sum(F.col("ones") * (2 * F.col("upto") - F.col("zeros") - F.col("all"))).alias("s"))

    def untied(*own: str) -> DataFrame:
        """Pairs of rows that differ in some columns."""
        count = cells.groupBy(by, *own).agg(F.sum("n").alias("n")).groupBy(by).agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("tied"))
        return count.select(by, (F.col("rows") * (F.col("rows") - 1) / 2 - F.col("tied")).alias(f"u{own[0]}"))

    out = s.join(untied("x"), by).join(untied("y"), by)
    return out.select(by, F.when((F.col("ux") > 0) & (F.col("uy") > 0), F.col("s") / F.sqrt(F.col("ux") * F.col("uy"))).alias("tau"))


def permutation(draws: DataFrame, by: str = "cell", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per cell: two-sided permutation p = (k + 1) / (n + 1) around the null mean, null median, 95 % interval and resolution; and columns ``keep``, which a cell's rows share.

    Quantiles are exact, but no cell's draws meet: they are numbered over ranges of the order, and the few at a quantile's place are picked.
    """
    centre = draws.groupBy(by).agg(F.avg("effect").alias("centre"))
    rows = draws.join(centre, by)
    beyond = F.abs(F.round(F.col("effect") - F.col("centre"), 9)) >= F.abs(F.round(F.col("real") - F.col("centre"), 9))
    out = rows.groupBy(by).agg(
        F.max("real").alias("real"), F.count("*").alias("n"), F.max("centre").alias("null_mean"), *[F.first(c).alias(c) for c in keep],
        ((F.count_if(beyond) + 1) / (F.count("*") + 1)).alias("p"), (F.lit(1.0) / (F.count("*") + 1)).alias("resolution"))
    return out.join(quantiles(draws, [by], "effect", {"null_median": 0.5, "ci_low": 0.025, "ci_high": 0.975}), by)


def benjamini_hochberg(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Step-up false-discovery control over all tests: ``q``, ``rejected``, ``m``; NULL p is left out of m.

    Ranks come from :func:`ordinal`; the running minimum from the largest p on is that of the rows
    above in the same range of ranks, joined with the least of the ranges after it.
    """
    known = ordinal(tests.filter(F.col(p).isNotNull()), F.col(p), name="__k")
    m = known.agg(F.count("*").alias("m"))
    raw = known.crossJoin(F.broadcast(m)).withColumn("__raw", F.col(p) * F.col("m") / F.col("__k")).withColumn("__b", F.floor(F.col("__k") / 100_000))
    block = raw.groupBy("__b").agg(F.min("__raw").alias("low"))
    after = block.select("__b", F.min("low").over(Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)).alias("__after"))
    inside = F.min("__raw").over(Window.partitionBy("__b").orderBy(F.desc("__k")).rowsBetween(Window.unboundedPreceding, 0))
    out = raw.withColumn("__inside", inside).join(F.broadcast(after), "__b").withColumn("q", F.least("__inside", F.coalesce("__after", F.lit(1.0)), F.lit(1.0)))
    done = out.withColumn("rejected", F.col("q") <= alpha).drop("__k", "__raw", "__b", "__inside", "__after")
    rest = tests.filter(F.col(p).isNull()).crossJoin(F.broadcast(m)).withColumns({"q": F.lit(None).cast("double"), "rejected": F.lit(False)})
    return done.select(*tests.columns, "m", "q", "rejected").unionByName(rest.select(*tests.columns, "m", "q", "rejected"))


def verdict(real: Column, median: Column, p: Column, delta: Column, alpha: float = 0.05) -> Column:
    """distinguishable (the test rejects), else equivalent (the gap is below delta), else indeterminate."""
    return F.when(F.coalesce(p <= alpha, F.lit(False)), "distinguishable").when(F.coalesce(F.abs(real - median) < delta, F.lit(False)), "equivalent_within_tolerance").otherwise("indeterminate")


def classify(modes: DataFrame, floor: float, structural: tuple[str, ...], by: str = "cell") -> DataFrame:
    """Class of each cell from its modes' verdicts: undefined, no-effect, topology-dependent, mixed or composition-dominated."""
    hit = F.col("verdict") == "distinguishable"
    a = modes.groupBy(by).agg(F.max("real").alias("real"), F.bool_or(hit & F.col("mode").isin(*structural)).alias("s"), F.bool_or(hit & (F.col("mode") == "sign_permute")).alias("g"), F.count_if(F.col("verdict") == "indeterminate").alias("n_indeterminate"))
    label = F.when(F.col("real").isNull(), "undefined").when(F.abs("real") <= floor, "no-effect").when(F.col("s"), "topology-dependent").when(F.col("g"), "mixed").otherwise("composition-dominated")
    return a.select(by, label.alias("class"), "n_indeterminate")


def convergence(draws: DataFrame, fractions: tuple[float, ...] = (0.25, 0.5, 1.0), tolerance: float = 0.02) -> DataFrame:
    """Mean effect on prefixes of each cell's draws (a range condition on the draw's place), and the earliest prefix from which it stays within tolerance of the last."""
    checks = draws.sparkSession.createDataFrame([(f,) for f in fractions], "fraction double")
    n = draws.groupBy("cell").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("k1", "k2"))
    rows = draws.withColumn("i", place).join(n, "cell").crossJoin(F.broadcast(checks)).filter(F.col("i") <= F.ceil(F.col("n") * F.col("fraction")))
    at = rows.groupBy("cell", "fraction").agg(F.avg("effect").alias("mean"))
    last = F.last("mean").over(Window.partitionBy("cell").orderBy("fraction").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = at.withColumn("off", F.abs(F.round(F.col("mean") - last, 9)) > tolerance * F.abs(last))
    late = F.max(F.when(F.col("off"), F.col("fraction"))).over(Window.partitionBy("cell"))
    return at.groupBy("cell").agg(F.max_by("mean", "fraction").alias("mean"), F.count_if("off").alias("n_off")).join(
        at.withColumn("late", late).filter("late is null or fraction > late").groupBy("cell").agg(F.min("fraction").alias("settled")), "cell")


def threshold_crossing(curve: DataFrame, by: str, x: str, y: str, at: float) -> DataFrame:
    """First dose at which a curve reaches a level, by interpolation in log10 dose with the point before; the first dose itself where it is reached there."""
    order = Window.partitionBy(by).orderBy(x)
    rows = curve.withColumns({"px": F.lag(x).over(order), "py": F.lag(y).over(order)}).filter(F.col(y) >= at)
    first = rows.withColumn("k", F.row_number().over(order)).filter("k = 1")
    share = (at - F.col("py")) / (F.col(y) - F.col("py"))
    between = F.pow(F.lit(10.0), F.log10("px") + share * (F.log10(x) - F.log10("px")))
    return first.select(by, F.when(F.col("px").isNull(), F.col(x)).otherwise(between).alias("crossing"), F.col("px").isNull().alias("at_first"))


def islands(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Changes of a verdict along an order and the length of its last unchanged run."""
    w = Window.partitionBy(by).orderBy(order)
    change = F.when(F.lag(value).over(w) != F.col(value), 1).otherwise(0)
    rows = df.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max("run").over(Window.partitionBy(by))
    return rows.withColumn("last", last).groupBy(by).agg(F.sum("change").alias("changes"), F.count_if(F.col("run") == F.col("last")).alias("agreeing"), F.max_by(value, order).alias("final"))


def jansen(rows: DataFrame, by: str) -> DataFrame:
    """First and total Sobol indices per factor from aligned outputs a, b and ab (Jansen); variance with ddof 1 over a and b."""
    v = rows.select(by, F.explode(F.array("a", "b")).alias("y")).groupBy(by).agg(F.var_samp("y").alias("v"))
    s = rows.groupBy(by).agg((F.sum(F.pow(F.col("b") - F.col("ab"), 2)) / (2 * F.count("*"))).alias("db"), (F.sum(F.pow(F.col("a") - F.col("ab"), 2)) / (2 * F.count("*"))).alias("da"))
    return s.join(v, by).select(by, F.when(F.col("v") > 0, 1 - F.col("db") / F.col("v")).alias("first"), F.when(F.col("v") > 0, F.col("da") / F.col("v")).alias("total"))


def hashed(*key: str | Column) -> Column:
    """A number above 0 and up to 1 that depends on the key only."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)


def resampled(rows: DataFrame, draws: int, *key: str, seed: int = 0) -> DataFrame:
    """Rows once per draw with a Poisson weight ``w`` of mean 1, a hash of seed, draw and ``key``; rows of weight 0 are left out.

    That is a bootstrap in which a resample is a weighted aggregate: nothing is numbered, joined or shuffled for it. A row's key is
    put together once for all draws, and generators stand between a draw's hash and what uses it, which would else hash again for each use.
    """
    known = F.coalesce(*[F.col(k).cast("string") for k in key]).isNotNull()
    many = rows.withColumn("__key", F.explode(F.array(F.when(known, F.concat_ws(":", *key))))).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u, upto, p, w = F.col("__u"), 0.0, math.exp(-1), F.lit(0)
    for k in range(16):
        upto, p = upto + p, p / (k + 1)
        w = w + F.when(u > upto, 1).otherwise(0)
    return many.withColumn("__u", F.explode(F.array(hashed(F.lit(seed), "draw", "__key")))).withColumn("w", w).filter("w > 0").drop("__u", "__key")


def jansen_bootstrap(rows: DataFrame, by: str, key: tuple[str, ...], draws: int = 100, seed: int = 0, null: str | None = None) -> DataFrame:
    """``by, first, total, first_low, first_high, total_low, total_high, state``: Sobol indices (:func:`jansen`), their 95 % bootstrap intervals, and what the sample can tell of each factor.

    resolved: the interval of the first-order index leaves 0 out; null control: the factor ``null``, and those not resolved whose index is
    no larger than its or than the most negative one, which is error for sure; else unresolved. ``key`` names a row, and so its weights.
    """
    own = rows.select(
        by, *key, F.col("a") + F.col("b"), F.col("a") * F.col("a") + F.col("b") * F.col("b"), F.pow(F.col("b") - F.col("ab"), 2), F.pow(F.col("a") - F.col("ab"), 2)).toDF(by, *key, "s", "q", "db", "da")
    own = own.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, by, *key)  # each row is hashed once per draw, so few rows are much work
    many = resampled(own, draws, by, *key, seed=seed).groupBy(by, "draw").agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("s", "q", "db", "da")])
    v = (F.col("q") - F.col("s") * F.col("s") / (2 * F.col("n"))) / (2 * F.col("n") - 1)
    each = cut(many.withColumn("v", v).filter("v > 0").select(by, (1 - F.col("db") / (2 * F.col("n") * F.col("v"))).alias("first"), (F.col("da") / (2 * F.col("n") * F.col("v"))).alias("total")))
    out = jansen(rows, by)
    for c in ("first", "total"):
        out = out.join(quantiles(each, [by], c, {f"{c}_low": 0.025, f"{c}_high": 0.975}), by, "left")
    own = F.lit(0.0) if null is None else F.coalesce(F.max(F.when(F.col(by).cast("string") == null, F.abs("first"))), F.lit(0.0))
    floor = out.agg(F.greatest(own, F.coalesce(F.max(F.when(F.col("first") < 0, -F.col("first"))), F.lit(0.0))).alias("floor"))
    resolved = F.coalesce((F.col("first_low") > 0) | (F.col("first_high") < 0), F.lit(False))
    is_null = F.lit(False) if null is None else F.col(by).cast("string") == null
    state = F.when(is_null, "null control").when(resolved, "resolved").when(F.abs("first") <= F.col("floor"), "null control").otherwise("unresolved")
    return out.crossJoin(F.broadcast(floor)).select(by, "first", "total", "first_low", "first_high", "total_low", "total_high", state.alias("state"))


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, and sample standard deviation (0 for one value) over finite values."""
    return rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def p_convergence(draws: DataFrame, fractions: tuple[float, ...] = (0.25, 0.5, 1.0), tolerance: float = 0.02, alpha: float = 0.05, by: str = "cell") -> DataFrame:
    """Has the permutation p stopped moving? p and verdict on prefixes of each cell's draws, held against all of them.

    ``stabilised``: no prefix is off by more than the tolerance, nor of another verdict; ``n_stabilised``: the smallest
    prefix, never all draws, from which that holds; ``resolution_limited``: p is at its floor 1 / (n + 1).
    """
    checks = draws.sparkSession.createDataFrame([(f,) for f in fractions], "fraction double")
    n = draws.groupBy(by).agg(F.count("*").alias("total"))
    placed = numbered(draws, [by], "k1", "k2", name="i").join(n, by).crossJoin(F.broadcast(checks)).withColumn("upto", F.bround(F.col("fraction") * F.col("total")).cast("long"))
    rows = cut(placed.filter("i <= upto").select(by, "upto", "effect", "real"))
    centre = rows.groupBy(by, "upto").agg(F.avg("effect").alias("centre"))
    beyond = F.abs(F.round(F.col("effect") - F.col("centre"), 9)) >= F.abs(F.round(F.col("real") - F.col("centre"), 9))
    at = rows.join(centre, [by, "upto"]).groupBy(by, "upto").agg(((F.count_if(beyond) + 1) / (F.count("*") + 1)).alias("p"))
    last = at.groupBy(by).agg(F.max("upto").alias("n"), F.max_by("p", "upto").alias("last"))
    at = at.join(last, by).withColumns({"shift": F.abs(F.col("p") - F.col("last")), "same": (F.col("p") <= alpha) == (F.col("last") <= alpha)})
    off = (F.round("shift", 9) > tolerance) | ~F.col("same")
    at = at.join(at.groupBy(by).agg(F.coalesce(F.max(F.when(off, F.col("upto"))), F.lit(0)).alias("late")), by)
    earlier = F.when((F.col("upto") > F.col("late")) & (F.col("upto") < F.col("n")), F.col("upto"))
    out = at.groupBy(by).agg(F.max("n").alias("n"), F.max("last").alias("p"), F.coalesce(F.max(F.when(F.col("upto") < F.col("n"), F.col("shift"))), F.lit(0.0)).alias("p_max_shift"), F.bool_and("same").alias("verdict_stable"), F.bool_and(~off).alias("stabilised"), F.min(earlier).alias("n_stabilised"))
    return out.withColumn("resolution_limited", F.col("p") <= 1 / (F.col("n") + 1) + 1e-12)


def fdr_diagnostics(tests: DataFrame, p: str = "p", resolution: str = "resolution", alpha: float = 0.05) -> DataFrame:
    """One row: whether false-discovery control can reject anything at the tests' resolution (the coarsest).

    ``min_rejections``: tests that must sit at the floor before any is rejected; ``single_rejection``: whether one alone can be.
    """
    done = benjamini_hochberg(tests, p, alpha).filter(F.col(p).isNotNull())
    a = done.agg(F.count("*").alias("m"), F.count_if("rejected").alias("n_rejected"), F.max(resolution).alias("resolution"))
    least = F.when(F.col("m") > 0, F.ceil(F.round(F.col("m") * F.col("resolution") / alpha, 9)))
    return a.withColumn("min_rejections", least).withColumns({"can_reject": F.coalesce(F.col("min_rejections") <= F.col("m"), F.lit(True)), "single_rejection": F.when(F.col("m") > 0, F.col("resolution") <= alpha / F.col("m"))})


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided tail of k successes in n fair trials, NULL without trials: outcomes no likelier than k.

    The tail is summed from its largest term down, each from the one before. Terms fall as fast as a normal tail does, so those more
    than 10 * sqrt(n) + 60 places on add less than 1e-40 of the sum; a row holds the square root of n numbers, not n.
    """
    least = F.least(k, n - k).cast("long")
    first = F.exp(pharm.log_gamma(n + 1.0) - pharm.log_gamma(least + 1.0) - pharm.log_gamma(n - least + 1.0) - n * F.ln(F.lit(2.0)))
    step = lambda a, i: F.struct((a["term"] * i / (n - i + 1)).alias("term"), (a["sum"] + a["term"] * i / (n - i + 1)).alias("sum"))
    last = F.greatest(F.lit(1).cast("long"), least - (10 * F.sqrt(n.cast("double")) + 60).cast("long"))
    down = F.when(least > 0, F.sequence(least, last, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(down, F.struct(first.alias("term"), first.alias("sum")), step)["sum"]
    return F.when(n > 0, F.when(2 * least == n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail)))


def rank_agreement(orders: DataFrame, scores: DataFrame) -> DataFrame:
    """Per published entry: pairs of its compounds that have ranks and scores, how many a score (larger: more potent) orders alike, and the sign test's p.

    ``orders``: entry, compound, rank (1 is the most potent); ``scores``: compound, score. Only pairs of one entry meet, and an entry is one published table.
    """
    known = orders.filter("rank is not null").join(scores.filter("score is not null"), "compound").select("entry", "compound", "rank", "score")
    a, b = known.alias("a"), known.alias("b")
    pair = a.join(b, F.col("a.entry") == F.col("b.entry")).filter("a.rank < b.rank").select("a.entry", (F.col("a.score") - F.col("b.score")).alias("d"))
    out = pair.groupBy("entry").agg(F.count("*").alias("pairs"), F.count_if(F.col("d") > 0).alias("concordant"), F.count_if(F.col("d") < 0).alias("discordant"))
    out = out.withColumn("p", binomial_two_sided(F.col("concordant"), F.col("concordant") + F.col("discordant")))
    return orders.select("entry").distinct().join(out, "entry", "left")
