"""Published orders against the model: ranks as published, the receptor an entry speaks of, scores, and agreement per entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from . import networks as N
from . import stats as S

#: Words that name a preparation's organism, receptors by what an assay's description says, read-outs whose larger value is the more potent.
VERTEBRATE_WORDS = ("rattus", "rat ", "human", "homo", "mouse", "mus ", "mammal", "vertebrate", "chicken")
INSECT_WORDS = ("drosophila", "musca", "myzus", "insect", "nilaparvata", "apis", "plutella", "house fly")
HINTS = {
    "alpha7": "vertebrate_nAChR_a7", "alpha 7": "vertebrate_nAChR_a7", "a7 ": "vertebrate_nAChR_a7", "alpha4beta2": "vertebrate_nAChR_a4b2",
    "glucl": "insect_GluCl", "rdl": "insect_RDL", "glycine": "vertebrate_GlyR", "sodium channel": "insect_Nav"}
DESCENDING = ("resistance", "selectivity", "potentiation")
INACTIVE = ("no agonist", "no effect", "inactive")


def says(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for w in words:
        found = found | F.contains(low, F.lit(w))
    return found


def organism(text: Column) -> Column:
    """insect or vertebrate if a description speaks of one and not the other, else NULL."""
    insect, vertebrate = says(text, INSECT_WORDS), says(text, VERTEBRATE_WORDS)
    return F.when(insect & ~vertebrate, "insect").when(vertebrate & ~insect, "vertebrate")


def published(items: DataFrame) -> DataFrame:
    """``items`` (``entry, pos, rank, value, readout, efficacy, direction``; ``pos`` is unique in its entry) with ``published`` ranks (1 is the most potent) and their ``order_source``.

    published_rank: all ranks are given; published_value: values are, and those that lack are said to be without effect and come last;
    direction_selectivity: only directions are given, insect-selective before vertebrate-selective; tied, few, none: no order is claimed.
    """
    inactive = says(F.concat_ws(" ", "efficacy", "direction"), INACTIVE)
    vertebrate = F.contains(F.lower("direction"), F.lit("vertebrate"))
    by = items.groupBy("entry").agg(
        F.count("*").alias("n"), F.count("rank").alias("ranks"), F.min("rank").alias("r0"), F.max("rank").alias("r1"), F.count("value").alias("values"), F.min("value").alias("v0"), F.max("value").alias("v1"),
        F.bool_and(F.col("value").isNotNull() | inactive).alias("told"), F.max(says(F.col("readout"), DESCENDING)).alias("descending"),
        F.bool_and(F.coalesce(F.col("direction") != "", F.lit(False))).alias("directed"), F.count_if(vertebrate).alias("vertebrates"))
    ranked, valued = F.col("ranks") == F.col("n"), (F.col("values") >= 2) & F.col("told")
    source = (
        F.when(F.col("n") < 2, "few").when(ranked & (F.col("r0") == F.col("r1")), "tied").when(ranked, "published_rank").when(valued, "published_value")
        .when(F.col("directed") & (F.col("vertebrates") > 0) & (F.col("vertebrates") < F.col("n")), "direction_selectivity").otherwise("none"))
    rows = items.join(by.select("entry", "descending", "v0", "v1", "n", source.alias("order_source")), "entry")
    worst = F.when(F.col("descending"), -F.col("v0") / 10).otherwise(F.col("v1") * 10)
    key = F.when(F.col("order_source") == "published_value", F.coalesce(F.when(F.col("descending"), -F.col("value")).otherwise(F.col("value")), worst))
    rows = cut(rows.withColumn("__key", key))
    place = N.ranks_within(rows.filter("__key is not null").select("entry", "pos", "__key"), ["entry"], "__key", "__by_value").select("entry", "pos", "__by_value")
    rows = rows.join(place, ["entry", "pos"], "left")
    given = F.when(F.col("order_source") == "published_rank", F.col("rank")).when(F.col("order_source") == "direction_selectivity", F.when(vertebrate, 2.0).otherwise(1.0)).otherwise(F.col("__by_value"))
    return rows.withColumn("published", given.cast("double")).drop("__key", "__by_value", "v0", "v1", "descending")


def receptors(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """``entry, receptor``: the receptor each entry speaks of, NULL if none is active.

    First one that the description names, if two compounds of the entry have evidence there; else, among receptors of the organism
    that it speaks of, that with the most compounds of known value, then of least mean log value, then by name.
    """
    text = F.concat_ws(" ", *[F.max(F.coalesce(F.col(c), F.lit(""))) for c in ("assay", "species", "readout")])
    names = F.concat_ws(" ", *[F.max(F.coalesce(F.col(c), F.lit(""))) for c in ("species", "assay")])
    entry = items.groupBy("entry").agg(text.alias("text"), names.alias("names"))
    hint = entry.sparkSession.createDataFrame([(i, k, v) for i, (k, v) in enumerate(HINTS.items())], "i int, word string, receptor string")
    rows = items.select("entry", "compound").distinct().join(evidence.select("compound", "receptor", "direction", "value_m"), "compound")
    of = cut(rows.groupBy("entry", "receptor").agg(
        F.count_distinct("compound").alias("compounds"), F.count_distinct(F.when((F.col("direction") != "none") & F.col("value_m").isNotNull(), F.col("compound"))).alias("active"),
        F.avg(F.log10(F.when(F.col("direction") != "none", F.col("value_m")))).alias("level")))
    hinted = entry.crossJoin(F.broadcast(hint)).filter(F.contains(F.lower("text"), F.col("word"))).join(of.filter("compounds >= 2"), ["entry", "receptor"])
    hinted = hinted.groupBy("entry").agg(F.min_by("receptor", "i").alias("hinted"))
    own = of.filter("active > 0").join(entry.select("entry", organism(F.col("names")).alias("organism")), "entry")
    own = own.filter(F.col("organism").isNull() | F.startswith("receptor", F.concat("organism", F.lit("_"))))
    best = own.groupBy("entry").agg(F.min(F.struct((-F.col("active")).alias("a"), F.round("level", 9).alias("level"), "receptor"))["receptor"].alias("inferred"))
    return entry.select("entry").join(hinted, "entry", "left").join(best, "entry", "left").select("entry", F.coalesce("hinted", "inferred").alias("receptor"))


def occupancy_scores(items: DataFrame, evidence: DataFrame, engaged: DataFrame) -> DataFrame:
    """``items`` with ``receptor`` (an item's own ``target``, else its entry's) and its ``score``, the compound's engagement there (``compound, receptor, engagement``)."""
    rows = items.join(receptors(items, evidence).withColumnRenamed("receptor", "__of"), "entry").withColumn("receptor", F.coalesce("target", "__of")).drop("__of")
    last = engaged.groupBy("compound", "receptor").agg(F.max_by("engagement", "pos").alias("score"))
    return rows.join(last, ["compound", "receptor"], "left")


def validate(items: DataFrame, by: str = "entry") -> DataFrame:
    """``entry, n, order_source, skipped, rho, exact, tau`` of items with ``published`` ranks and a ``score`` (larger: more potent).

    ``skipped`` says why an entry has no figures: no order is claimed, a compound has no score, or all scores are the same.
    """
    rows = cut(items.withColumn("score", F.when(~F.isnan("score"), F.round("score", 12))))
    of = rows.groupBy(by).agg(F.count("*").alias("n"), F.max("order_source").alias("order_source"), F.count("published").alias("placed"), F.count("score").alias("scored"), (F.min("score") == F.max("score")).alias("level"))
    why = F.when(F.col("placed") < F.col("n"), "no_order").when(F.col("scored") < F.col("n"), "no_score").when(F.col("level"), "same_scores")
    of = cut(of.select(by, "n", "order_source", why.alias("skipped")))
    good = rows.join(of.filter("skipped is null").select(by), by).select(by, "pos", "published", (-F.col("score")).alias("__s"))
    good = cut(N.ranks_within(good, [by], "__s", "model"))
    flat = good.groupBy(by).agg(S.correlation("published", "model").alias("rho"), F.bool_and(F.round("published", 6) == F.round("model", 6)).alias("exact"))
    tau = S.kendall(good, by, "published", "model")
    return of.join(flat, by, "left").join(tau, by, "left")


def summary(validated: DataFrame) -> DataFrame:
    """One row per assay: entries, how many were evaluated or skipped, exact matches, and the mean correlation of those evaluated."""
    return validated.groupBy("assay").agg(F.count("*").alias("entries"), F.count_if(F.col("skipped").isNull()).alias("evaluated"), F.count("skipped").alias("skipped"), F.count_if("exact").alias("exact"), F.avg("rho").alias("mean_rho"))
