"""Predictions from hypotheses: all of them, all replicates and their vehicles are arms of one run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, pharm
from ..lineage import cut
from . import designs as D
from . import engagement as E
from . import graph as G
from . import networks as N

#: What a hypothesis compares: treated with vehicle, two read-outs of one arm, or insect with vertebrate engagement.
VEHICLE, WITHIN, GAP = "treated_minus_vehicle", "within", "occupancy_gap"
HYPOTHESIS = "h string, compound string, conc_m double, contrast string, readout string, minus string, direction string, endpoint string"
#: Bounds of a relative effect that a group size is planned for, and the two-sided 95 % point of the normal curve.
LEAST_DROP, MOST_DROP, Z95 = 0.05, 0.5, 1.959963985


def drive_factor(draw: Column, jitter: float, seed: int) -> Column:
    """A replicate's drive as a multiple of the nominal one; it depends on the replicate only, so all arms of a replicate share it."""
    return 1 + jitter * (2 * E._hashed(F.lit(seed), F.lit("drive"), draw.cast("string")) - 1)


def _replicated(evidence: DataFrame, asked: DataFrame, draws: int, sd_log10: float, seed: int) -> DataFrame:
    """Engaged rows of every asked compound, dose and replicate (from 1 on); the compound's name carries its replicate."""
    rows = N.jittered(evidence, draws, sd_log10, seed).filter("draw > 0").join(asked.select("compound", "conc_m").distinct(), "compound")
    return rows.withColumns({"engagement": pharm.hill(F.col("conc_m"), F.col("value_m"), F.col("n")), "compound": F.concat_ws("|", "compound", "draw")})


def _gaps(hypotheses: DataFrame, evidence: DataFrame, draws: int, sd_log10: float, seed: int) -> DataFrame:
    """Insect less vertebrate engagement at the compound's best pair of receptors."""
    asked = hypotheses.filter(F.col("contrast") == GAP)
    typed = evidence if "param_type" in evidence.columns else evidence.withColumn("param_type", F.lit(None).cast("string"))
    pairs = cut(E.selectivity(_replicated(typed, asked, draws, sd_log10, seed)))
    best = E.best_pairs(pairs).select("compound", "conc_m", F.col("comparable_first").alias("target"))
    at = pairs.join(best, ["compound", "conc_m", "target"]).select(F.substring_index("compound", "|", 1).alias("compound"), F.substring_index("compound", "|", -1).cast("int").alias("draw"), "conc_m", "difference")
    none = F.lit(None).cast("double")
    return asked.join(at, ["compound", "conc_m"]).select("h", "draw", F.col("difference").alias("treated"), none.alias("other"), F.col("difference").alias("effect"))


def effects(edges: DataFrame, nodes: DataFrame, evidence: DataFrame, hypotheses: DataFrame, driven: DataFrame, sets: DataFrame, draws: int = 8, sd_log10: float = 0.3, jitter: float = 0.1, hz: float = 40.0, seed: int = 0, steps: int = 80) -> DataFrame:
    """``h, draw, treated, other, effect``: each hypothesis's effect in each replicate, ``other`` being the vehicle or the other read-out.

    A replicate jitters the evidence and the drive; its vehicle has the same drive, so differences are paired. Without a compound an
    arm is the vehicle's; a compound without evidence and a read-out without nodes give no effect. ``sets``: ``readout, body_id``;
    ``mean_hz`` comes besides.
    """
    spark = edges.sparkSession
    asked = hypotheses.filter(F.col("contrast") != GAP)
    gains = E.gains(_replicated(evidence, asked.filter("compound is not null"), draws, sd_log10, seed)).withColumn("arm", F.concat_ws("|", "compound", F.col("conc_m").cast("string")))
    vehicles = spark.range(1, draws + 1).select(F.concat_ws("|", F.lit("vehicle"), "id", F.lit("0")).alias("arm"), *[F.lit(1.0).alias(g) for g in dims.GAINS])
    arms = cut(gains.select("arm", *dims.GAINS).unionByName(vehicles))
    draw = F.element_at(F.split("arm", r"\|"), -2)
    drive = arms.select("arm", (hz * drive_factor(draw, jitter, seed)).alias("hz")).crossJoin(F.broadcast(driven.select("body_id")))
    values = cut(G.readouts(edges, nodes, drive, arms, sets, "mean_hz", steps=steps).select("arm", "readout", F.col("hz").alias("value")))
    each = asked.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    vehicle = F.concat_ws("|", F.lit("vehicle"), "draw", F.lit("0"))
    each = each.withColumn("arm", F.when(F.col("compound").isNull(), vehicle).otherwise(F.concat_ws("|", "compound", "draw", F.col("conc_m").cast("string"))))
    within = F.col("contrast") == WITHIN
    each = each.withColumns({"arm2": F.when(within, F.col("arm")).otherwise(vehicle), "readout2": F.when(within, F.col("minus")).otherwise(F.col("readout"))})
    own, other = values.withColumnRenamed("value", "treated"), values.select(F.col("arm").alias("arm2"), F.col("readout").alias("readout2"), F.col("value").alias("other"))
    paired = each.join(own, ["arm", "readout"]).join(other, ["arm2", "readout2"]).select("h", "draw", "treated", "other", (F.col("treated") - F.col("other")).alias("effect"))
    return paired.unionByName(_gaps(hypotheses, evidence, draws, sd_log10, seed))


def predict(hypotheses: DataFrame, found: DataFrame, baseline: float = 0.8) -> DataFrame:
    """Every hypothesis with ``n, effect, sd, low, high, d, treated, other, relative, observed, matches, per_group`` over its replicates of :func:`effects`.

    ``d`` (mean by spread) is stability inside the model; NULL where all replicates agree. ``observed``: increase, decrease or none.
    ``per_group``: a group size to plan with, for the endpoint ``per`` from the relative drop of a response proportion (within bounds),
    else from ``d``. Hypotheses without an effect stay, with n = 0, NULLs, and no match.
    """
    known = found.filter(F.col("effect").isNotNull() & ~F.isnan("effect"))
    by = known.groupBy("h").agg(F.count("*").alias("n"), F.avg("effect").alias("effect"), F.coalesce(F.stddev_samp("effect"), F.lit(0.0)).alias("sd"), F.avg("treated").alias("treated"), F.avg("other").alias("other"))
    half = Z95 * F.col("sd") / F.sqrt("n")
    sure = F.round(F.col("sd"), 12) > 0
    out = hypotheses.join(by, "h", "left").withColumns({
        "n": F.coalesce("n", F.lit(0).cast("long")), "low": F.col("effect") - half, "high": F.col("effect") + half, "d": F.when(sure, F.col("effect") / F.col("sd")),
        "relative": F.when(F.abs("other") > 1e-12, F.abs(F.col("effect") / F.col("other"))),
        "observed": F.when(F.col("effect") > 1e-9, "increase").when(F.col("effect") < -1e-9, "decrease").when(F.col("effect").isNotNull(), "none")})
    drop = F.least(F.greatest(F.col("relative"), F.lit(LEAST_DROP)), F.lit(MOST_DROP))
    size = F.when((F.col("endpoint") == "per") & (F.col("relative") > 0), D.two_proportions(F.lit(baseline), baseline * (1 - drop))).otherwise(D.two_means(F.col("d")))
    return out.withColumns({"matches": F.coalesce(F.col("observed") == F.col("direction"), F.lit(False)), "per_group": size})
