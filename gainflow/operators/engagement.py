"""From typed evidence and doses to engagement, gains, selectivity, mixtures and shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims, pharm


def engage(evidence: DataFrame, doses: DataFrame) -> DataFrame:
    """Evidence times doses with its ``distance``, ``model`` and ``engagement``; not modelled stays NULL, never 0."""
    models = dims.models(evidence.sparkSession)
    rows = evidence.join(F.broadcast(models), ["param_type", "relation"]).crossJoin(F.broadcast(doses))
    value = F.when(F.col("model") != "not_modelled", F.col("value_m"))
    return rows.withColumn("engagement", pharm.hill(F.col("conc_m"), value, F.col("n")))


def gains(engaged: DataFrame) -> DataFrame:
    """Six gains per compound and dose. The last row of a receptor decides; AChE takes its largest engagement and scales g_ach too."""
    key = ["compound", "conc_m"]
    rules = dims.rules(engaged.sparkSession).withColumnRenamed("receptor", "of")
    t = F.least(F.greatest(F.col("engagement"), F.lit(0.0)), F.lit(1.0))
    rows = engaged.filter("engagement is not null").withColumns({"t": t, "act": F.col("direction").isin(*dims.ACTIVATING)})
    ruled = rows.join(F.broadcast(rules), (F.col("receptor") == F.col("of")) & (F.col("act") == F.col("activating")))
    g = F.greatest(F.lit(pharm.FLOOR), 1 + F.col("slope") * F.col("t") - F.col("curve") * F.col("t") * F.col("t"))
    last = lambda k: F.coalesce(F.max_by(F.when(F.col("gain") == k, g), F.when(F.col("gain") == k, F.col("pos"))), F.lit(1.0)).alias(k)
    direct = ruled.groupBy(*key).agg(*map(last, dims.GAINS[:5]))
    ache = rows.filter("receptor = 'insect_AChE' and not act").groupBy(*key).agg(F.max("t").alias("ache"))
    out = engaged.select(*key).distinct().join(direct, key, "left").join(ache, key, "left").fillna(1.0, list(dims.GAINS[:5]))
    tone = F.when(F.col("ache") > 0, 1 + 2 * F.col("ache")).otherwise(1.0)
    toned = F.when(F.col("ache") > 0, F.greatest(F.lit(pharm.FLOOR), F.col("g_ach") * tone * pharm.biphasic(F.col("ache")))).otherwise(F.col("g_ach"))
    return out.withColumns({"ach_tone": tone, "g_ach": toned}).select(*key, *dims.GAINS)


def spec_gains(engaged: DataFrame, specs: DataFrame) -> DataFrame:
    """The acetylcholine gain of nicotinic agonists under every specification: the alternatives are rows, not patches."""
    rows = engaged.filter("receptor = 'insect_nAChR' and direction = 'agonist' and engagement is not null")
    last = rows.groupBy("compound", "conc_m").agg(F.max_by("engagement", "pos").alias("t"))
    g = pharm.shaped(F.col("shape"), F.col("t"), F.lit(1.0), F.lit(0.4), F.lit(1.6), F.col("coef"))
    return last.crossJoin(F.broadcast(specs)).withColumn("g_ach", g)


def drive_sign(gains_: DataFrame) -> DataFrame:
    """Sign of the summed gain changes, weighted by the transmitters' signs."""
    s = dims.SIGN
    net = sum((F.col(g) - 1) * s[nt] for nt, g in dims.GAIN_OF.items()) + F.col("g_nav") - 1
    return gains_.withColumn("direction", F.signum(F.round(net, 9)).cast("int"))


def _rows_of(engaged: DataFrame, organism: str) -> DataFrame:
    """The last row of each receptor of an organism, its columns prefixed."""
    own = engaged.filter(F.startswith("receptor", F.lit(f"{organism}_"))).withColumn("target", F.substring_index("receptor", "_", -1))
    row = F.max_by(F.struct("value_m", "param_type", "engagement"), "pos").alias("r")
    out = own.groupBy("compound", "conc_m", "target").agg(row)
    return out.select("compound", "conc_m", "target", *[F.col(f"r.{c}").alias(f"{organism}_{c}") for c in ("value_m", "param_type", "engagement")])


def selectivity(engaged: DataFrame) -> DataFrame:
    """Insect against vertebrate per target: ratio of values (above 1: the insect side is the more potent); NULL if either side is not modelled."""
    both = _rows_of(engaged, "insect").join(_rows_of(engaged, "vertebrate"), ["compound", "conc_m", "target"], "full")
    known = F.col("insect_engagement").isNotNull() & F.col("vertebrate_engagement").isNotNull()
    ratio = F.when(known, F.col("vertebrate_value_m") / F.col("insect_value_m"))
    same = F.coalesce(F.col("insect_param_type") == F.col("vertebrate_param_type"), F.lit(False))
    return both.withColumns({
        "ratio": ratio, "log_ratio": F.log10(ratio), "difference": F.when(known, F.col("insect_engagement") - F.col("vertebrate_engagement")),
        "comparable": known & same, "reason": F.when(~known, "placeholder").when(~same, "mixed_param_types")})


def best_pairs(pairs: DataFrame) -> DataFrame:
    """The three rules for a compound's best pair: largest ratio, comparable ones first, comparable ones only."""
    by = Window.partitionBy("compound", "conc_m")
    key = [F.desc("log_ratio"), F.asc("target")]
    known = pairs.filter("ratio is not null")
    rank = {"largest": key, "comparable_first": [F.desc("comparable"), *key]}
    known = known.withColumns({k: F.row_number().over(by.orderBy(*order)) for k, order in rank.items()})
    only = F.min_by("target", F.when(F.col("comparable"), F.col("comparable_first")))
    return known.groupBy("compound", "conc_m").agg(F.min_by("target", "largest").alias("largest"), F.min_by("target", "comparable_first").alias("comparable_first"), only.alias("comparable_only"))


def mixture(components: DataFrame) -> DataFrame:
    """Competition for a receptor: each component's share, its rivals being all others there (a window sum less its own term)."""
    x = F.col("dose") / F.col("value_m")
    at = Window.partitionBy("mixture", "receptor")
    all_ = F.sum(x).over(at)
    return components.filter("value_m is not null").withColumns({"share": x / (1 + all_), "rivals": all_ - x, "total": all_ / (1 + all_)})


def loewe(components: DataFrame, effect: Column, tolerance: float = 0.25) -> DataFrame:
    """Combination index sum(dose / dose alone at the effect) and its verdict per mixture."""
    alone = pharm.inverse_hill(effect, F.col("value_m"), F.col("n"))
    out = components.filter("value_m is not null and dose > 0").groupBy("mixture").agg(F.sum(F.col("dose") / alone).alias("ci"))
    verdict = F.when(F.col("ci") <= 0, "inconclusive").when(F.col("ci") < 1 / (1 + tolerance), "synergistic").when(F.col("ci") > 1 + tolerance, "antagonistic").otherwise("additive")
    return out.withColumn("verdict", verdict)


def preferred(shifts: DataFrame) -> DataFrame:
    """One shift row per compound: the best grade, then the first; ``alternatives`` counts the others."""
    first = Window.partitionBy("compound").orderBy(F.desc("grade"), "pos")
    all_ = Window.partitionBy("compound")
    return shifts.withColumns({"k": F.row_number().over(first), "alternatives": F.count("*").over(all_) - 1}).filter("k = 1").drop("k")


def apply_shifts(evidence: DataFrame, shifts: DataFrame) -> DataFrame:
    """Evidence with a genotype's fold changes: value times fold where there is one; ``state`` tells shifted, unshifted and not modelled apart."""
    s = shifts.select("compound", F.col("receptor").alias("on"), "fold")
    out = evidence.join(s, (evidence.compound == s.compound) & (evidence.receptor == s["on"]), "left").drop(s.compound)
    state = F.when(F.col("value_m").isNull(), "not_modelled").when(F.col("fold").isNull(), "unshifted").otherwise("shifted")
    return out.withColumns({"shifted_m": F.col("value_m") * F.coalesce("fold", F.lit(1.0)), "state": state}).drop("on")


def exposure(subjects: DataFrame, hours: float = 24.0, step: float = 0.5) -> DataFrame:
    """AUC (trapezoid), peak and first time of the peak of each subject's concentration curve."""
    n = int(round(hours / step))
    t = F.explode(F.sequence(F.lit(0), F.lit(n)))
    rows = subjects.select("*", t.alias("i")).withColumn("t_h", F.col("i") * step)
    rows = rows.withColumn("c", pharm.bateman(F.col("t_h"), F.col("c0"), F.col("ka"), F.col("ke")))
    ends = F.when((F.col("i") == 0) | (F.col("i") == n), 0.5).otherwise(1.0)
    return rows.groupBy("subject").agg(F.sum(F.col("c") * ends * step).alias("auc"), F.max("c").alias("cmax"), F.min_by("t_h", F.struct(-F.round("c", 12), F.col("t_h"))).alias("tmax"))


#: Directions and evidence tiers that a library may use.
DIRECTIONS = (*dims.ACTIVATING, *dims.BLOCKING, "none")
TIERS = ("literature_order", "class_placeholder", "measured_fit")


def problems(evidence: DataFrame, receptors: list[str], tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """Rows of ``evidence`` (with ``model``, NULL where type or relation is unknown) once per ``problem`` they have."""
    value, known = F.col("value_m").isNotNull(), F.col("model").isNotNull()
    checks = {
        "receptor_not_declared": ~F.col("receptor").isin(*receptors), "unknown_type_or_relation": ~known, "bad_direction": known & ~F.coalesce(F.col("direction").isin(*DIRECTIONS), F.lit(False)),
        "bad_tier": known & ~F.coalesce(F.col("evidence_tier").isin(*tiers), F.lit(False)), "no_source": known & (F.trim(F.coalesce("source", F.lit(""))) == ""),
        "value_not_modellable": known & (F.col("model") == "not_modelled") & value, "value_of_unknown_type": known & (F.col("param_type") == "unknown") & value, "value_not_positive": known & (F.col("value_m") <= 0),
        "no_value_but_tier": known & ~value & (F.col("evidence_tier") != "class_placeholder"), "placeholder_with_value": known & value & (F.col("evidence_tier") == "class_placeholder"),
    }
    flags = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return evidence.withColumn("problem", F.explode(flags))


def _hashed(*key: str | Column) -> Column:
    """A number above 0 and up to 1 that depends on the key only."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)


def credible(evidence: DataFrame, draws: int = 500, sd_log10: float = 0.3, seed: int = 0, fixed: Column | None = None) -> DataFrame:
    """Engagement with its mean and 95 % interval over log-normal jitter of each value; NULL stays NULL, ``fixed`` rows don't move.

    A draw is a normal number from two hashes of seed, row and draw, so it doesn't depend on partitions.
    """
    moves = F.col("value_m").isNotNull() & (F.col("direction") != "none") & (~fixed if fixed is not None else F.lit(True))
    rows = evidence.withColumns({"perturbed": moves & (F.lit(sd_log10) > 0), "draw": F.explode(F.sequence(F.lit(1), F.lit(draws)))})
    z = F.sqrt(-2 * F.ln(_hashed(F.lit(seed), F.lit("a"), "pos", "draw"))) * F.cos(6.283185307179586 * _hashed(F.lit(seed), F.lit("b"), "pos", "draw"))
    jitter = F.when(F.col("perturbed"), F.pow(F.lit(10.0), sd_log10 * z)).otherwise(F.lit(1.0))
    value = F.when(F.col("model") != "not_modelled", F.col("value_m"))
    y, point = pharm.hill(F.col("conc_m"), value * jitter, F.col("n")), pharm.hill(F.col("conc_m"), value, F.col("n"))
    rows = rows.withColumns({"y": y, "point": point})
    return rows.groupBy("pos").agg(F.max("point").alias("point"), F.avg("y").alias("mean"), F.percentile("y", F.lit(0.025)).alias("low"), F.percentile("y", F.lit(0.975)).alias("high"), F.bool_or("perturbed").alias("perturbed"))


def isobole(pairs: DataFrame, effect: float, points: int, rounds: int = 60) -> DataFrame:
    """Rows of ``va, na`` and ``vb, nb`` at ``points`` shares of the first compound: the doses that reach the effect together, and their combination index.

    Along each share both doses are scaled by one factor, found by geometric bisection of the competitive occupancy, to which
    each compound adds (dose / value) ^ n; so the index is 1 only where both slopes are.
    """
    alone_a, alone_b = (pharm.inverse_hill(F.lit(effect), F.col(v), F.col(n)) for v, n in (("va", "na"), ("vb", "nb")))
    rows = pairs.withColumns({"alone_a": alone_a, "alone_b": alone_b, "fraction": F.explode(F.array(*[F.lit(i / (points - 1)) for i in range(points)]))})

    def occupancy(scale: Column) -> Column:
        x = F.pow(F.col("fraction") * F.col("alone_a") * scale / F.col("va"), F.col("na")) + F.pow((1 - F.col("fraction")) * F.col("alone_b") * scale / F.col("vb"), F.col("nb"))
        return x / (1 + x)

    def halve(at: Column, _: Column) -> Column:
        middle = (at["low"] + at["high"]) / 2
        below = occupancy(F.pow(F.lit(10.0), middle)) < effect
        return F.struct(F.when(below, middle).otherwise(at["low"]).alias("low"), F.when(below, at["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(-8.0).alias("low"), F.lit(8.0).alias("high")), halve)
    rows = rows.withColumn("scale", F.pow(F.lit(10.0), (found["low"] + found["high"]) / 2))
    rows = rows.withColumns({"dose_a": F.col("fraction") * F.col("alone_a") * F.col("scale"), "dose_b": (1 - F.col("fraction")) * F.col("alone_b") * F.col("scale")})
    return rows.withColumn("ci", F.col("dose_a") / F.col("alone_a") + F.col("dose_b") / F.col("alone_b"))
