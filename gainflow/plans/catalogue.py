"""The library's queries over the driver tables; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dims, pharm
from ..lineage import cut
from ..operators import engagement as E
from ..operators import graph as G
from ..operators import kernels as K
from ..operators import stats as S
from ..sources import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Gains of the worked example: a nicotinic agonist at a high dose with some inhibitor.
TREATED = {"g_ach": 0.4, "g_gaba": 0.7, "ach_tone": 1.2}
STRUCTURAL = ("rewire", "weight_permute")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r(c, digits: int = 6):
    return F.round(c, digits)


def engaged(spark: SparkSession, d: str, *doses: float) -> DataFrame:
    return E.engage(X.evidence(spark, d), X.doses(spark, *(doses or (1e-6,))))


@query
def engagement_at_dose(spark, d):
    return engaged(spark, d).select("pos", "compound", "receptor", "distance", "model", r("engagement", 9).alias("engagement"))


@query
def engagement_curve(spark, d):
    e = engaged(spark, d, 0.0, 1e-7, 1e-6, 1e-5, 1e-4)
    return e.groupBy("compound", "conc_m").agg(r(F.max("engagement"), 9).alias("top"), F.max_by("receptor", F.struct(r("engagement", 9), "pos")).alias("receptor"), F.count("engagement").alias("modelled"))


@query
def evidence_rule_table(spark, d):
    return dims.models(spark)


@query
def library_census(spark, d):
    e = X.evidence(spark, d).join(F.broadcast(dims.models(spark)), ["param_type", "relation"])
    e.createOrReplaceTempView("census_evidence")
    return spark.sql("""SELECT param_type, relation, distance, model, receptor, count(*) AS n, count(value_m) AS n_valued FROM census_evidence
        GROUP BY GROUPING SETS ((param_type), (relation), (distance), (model), (receptor), (distance, model), ())""")


@query
def library_violations(spark, d):
    e = X.evidence(spark, d)
    checks = {"no_value": "value_m IS NULL", "value_not_positive": "value_m <= 0", "type_without_value": "param_type <> 'unknown' AND value_m IS NULL", "value_without_type": "param_type = 'unknown' AND value_m IS NOT NULL", "unsupported_with_value": "relation = 'unsupported' AND value_m IS NOT NULL"}
    flags = F.filter(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return e.select("compound", F.explode(flags).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"), F.count_distinct("compound").alias("compounds"))


@query
def inverse_hill_threshold(spark, d):
    e = engaged(spark, d).filter("engagement is not null and startswith(receptor, 'vertebrate_')")
    t = pharm.inverse_hill(F.lit(0.2), F.col("value_m"), F.col("n")) * 1e9
    return e.groupBy("compound").agg(r(F.min(t)).alias("threshold_nm"), F.count("*").alias("n"))


@query
def binding_models(spark, d):
    e = X.evidence(spark, d).filter("value_m is not null")
    c, v, n = F.lit(1e-6), F.col("value_m"), F.col("n")
    return e.select("pos", r(pharm.competitive(c, v, F.lit(2e-6), F.lit(1e-6), n), 9).alias("competitive"), r(pharm.schild_shift(F.lit(2e-6), v), 6).alias("dose_ratio"), r(pharm.operational(c, v, F.lit(3.0), n), 9).alias("response"), r(pharm.hill4(c, F.lit(100.0), F.lit(5.0), v, -n), 6).alias("logistic"))


@query
def gains_pivot(spark, d):
    g = E.gains(engaged(spark, d, 1e-7, 1e-6))
    return g.select("compound", "conc_m", *[r(k, 9).alias(k) for k in dims.GAINS])


@query
def spec_family_gains(spark, d):
    specs = spark.createDataFrame([(s, c) for s in pharm.SHAPES for c in pharm.COEFFICIENTS], "shape string, coef double")
    return E.spec_gains(engaged(spark, d), specs).select("compound", "shape", "coef", r("g_ach", 9).alias("g_ach"))


@query
def net_drive_sign(spark, d):
    return E.drive_sign(E.gains(engaged(spark, d))).groupBy("direction").agg(F.count("*").alias("n"))


def _pairs(spark, d):
    return E.selectivity(engaged(spark, d))


@query
def pair_selectivity(spark, d):
    return _pairs(spark, d).select("compound", "target", r("ratio", 9).alias("ratio"), r("log_ratio", 9).alias("log_ratio"), r("difference", 9).alias("difference"), "comparable", "reason")


@query
def best_pair_rules(spark, d):
    return E.best_pairs(_pairs(spark, d).withColumn("log_ratio", r("log_ratio", 9))).drop("conc_m")


def _mixture(spark, d):
    return X.evidence(spark, d).select(F.floor(F.col("compound") / 3).cast("long").alias("mixture"), "receptor", "pos", "value_m", "n", (F.lit(1e-7) * (1 + F.col("pos") % 5)).alias("dose"))


@query
def mixture_competition(spark, d):
    return E.mixture(_mixture(spark, d)).select("mixture", "receptor", "pos", r("share", 9).alias("share"), r("total", 9).alias("total"))


@query
def bliss_expected(spark, d):
    e = engaged(spark, d).filter("engagement is not null").groupBy("compound").agg(F.sort_array(F.collect_list("engagement")).alias("e"))
    return e.select("compound", r(pharm.bliss(F.col("e")), 9).alias("expected"), F.size("e").cast("long").alias("n"))


@query
def loewe_index(spark, d):
    return E.loewe(_mixture(spark, d), F.lit(0.5)).select("mixture", r("ci", 6).alias("ci"), "verdict")


def _shifts(spark, d):
    n = X.table(spark, d, "nation")
    return n.select((F.col("n_nationkey") * 5).cast("long").alias("compound"), X.pick([f"insect_{x}" for x in dims.RECEPTORS], F.col("n_nationkey")).alias("receptor"), (F.lit(2.0) + F.col("n_nationkey") * 0.5).alias("fold"), (F.col("n_nationkey") % 3).cast("int").alias("grade"), F.col("n_nationkey").cast("long").alias("pos"))


@query
def genotype_shift(spark, d):
    out = E.apply_shifts(X.evidence(spark, d), _shifts(spark, d))
    before, after = (pharm.hill(F.lit(1e-6), F.col(c), F.col("n")) for c in ("value_m", "shifted_m"))
    return out.select("pos", "state", r(F.col("shifted_m") * 1e9).alias("shifted_nm"), r(after - before, 9).alias("delta"))


@query
def unshifted_anti(spark, d):
    e, s = X.evidence(spark, d), _shifts(spark, d)
    return s.join(e, ["compound", "receptor"], "left_anti").select("compound", "receptor", "fold")


@query
def preferred_row(spark, d):
    s = X.evidence(spark, d).filter("value_m is not null").select("compound", "pos", (F.col("pos") % 3).cast("int").alias("grade"))
    return E.preferred(s).select("compound", "pos", "grade", "alternatives")


@query
def exposure_profile(spark, d):
    s = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("subject"), (1e-6 * (1 + F.col("s_suppkey") % 7)).alias("c0"), (0.2 + F.col("s_suppkey") % 5 * 0.2).alias("ka"), (0.1 + F.col("s_suppkey") % 4 * 0.1).alias("ke"))
    return E.exposure(s).select("subject", r(F.col("auc") * 1e6).alias("auc_um_h"), r(F.col("cmax") * 1e6).alias("cmax_um"), "tmax")


def graph(spark, d):
    return X.edges(spark, d), X.nodes(spark, d)


def seeds(nodes):
    return nodes.filter("superclass = 'AFRICA'").select("body_id")


@query
def edge_effective_weight(spark, d):
    return G.impact(*graph(spark, d), TREATED).select("pre", "post", "nt", *[r(c).alias(c) for c in ("weight", "before", "after", "delta")])


@query
def totals_by_transmitter(spark, d):
    return G.by_transmitter(G.impact(*graph(spark, d), TREATED)).select("nt", "n_edges", *[r(c).alias(c) for c in ("synapses", "before", "after", "ratio")])


@query
def composition_shares(spark, d):
    return G.shares(*graph(spark, d)).select("nt", "cells", r("cell_share").alias("cell_share"), r("out_weight").alias("out_weight"), r("weight_share", 9).alias("weight_share"))


@query
def weighted_degree(spark, d):
    return G.degrees(X.big_edges(spark, d)).select("body_id", "in_degree", "out_degree", r("in_weight").alias("in_weight"), r("out_weight").alias("out_weight"))


@query
def graph_census(spark, d):
    e, n = graph(spark, d)
    return G.census(e, n, seeds(n)).select("n_nodes", "n_edges", r("synapses").alias("synapses"), r("density", 9).alias("density"), r("seed_share", 9).alias("seed_share"), r("input_share", 9).alias("input_share"), "largest_degree")


@query
def induced_subgraph(spark, d):
    e, n = graph(spark, d)
    return G.induced(e, n.filter("body_id % 2 = 0")).select("pre", "post", r("weight").alias("weight"))


@query
def touching_edges(spark, d):
    e, n = graph(spark, d)
    return G.touching(e, seeds(n), 1000.0).select("pre", "post", r("weight").alias("weight"))


@query
def khop_frontier(spark, d):
    e = X.big_edges(spark, d)
    return G.khop(e, spark.createDataFrame([(1,)], "body_id long"), 2, 45.0)


@query
def ranked_rings(spark, d):
    e = X.big_edges(spark, d).filter("weight >= 45")
    return G.ranked_rings(e, spark.createDataFrame([(1,)], "body_id long"), 2).select("body_id", "ring", r("pull").alias("pull"), F.row_number().over(Window.partitionBy("ring").orderBy(F.desc(r("pull")), "body_id")).cast("long").alias("place"))


@query
def top_changed(spark, d):
    """The nodes whose rates change most; the report's size is its limit."""
    return treated_minus_vehicle(spark, d).orderBy(F.desc(F.abs("delta")), "body_id").limit(15)


def _paths(spark, d, length):
    e, n = graph(spark, d)
    e = e.withColumn("weight", F.col("weight") / 1000)
    return G.paths(e, seeds(n), length, 10).select("source", F.col("rank").cast("long").alias("rank"), r("strength").alias("strength"), "path")


@query
def two_hop_paths(spark, d):
    return _paths(spark, d, 2)


@query
def three_hop_paths(spark, d):
    return _paths(spark, d, 3)


ARMS = {"vehicle": {}, "treated": TREATED}


def _rates(spark, d, arms=None, normalise="row_abs", steps=80, of=None):
    e, n = of or graph(spark, d)
    return G.rates(e, n, seeds(n).withColumn("hz", F.lit(40.0)), arms, normalise, steps)


def arm(name):
    return F.max(F.when(F.col("arm") == name, F.col("hz"))).alias(name)


def _rate_query(normalise):
    def run(spark, d):
        return _rates(spark, d, normalise=normalise, steps=10).select("body_id", r("hz").alias("hz"))
    run.__name__ = f"rate_{normalise}_k10"
    return query(run)


for _n in ("row_abs", "none", "degree"):
    _rate_query(_n)


@query
def rate_by_superclass(spark, d):
    _, n = graph(spark, d)
    return _rates(spark, d).join(n, "body_id").groupBy(F.coalesce("superclass", F.lit("unknown")).alias("superclass")).agg(r(F.avg("hz")).alias("mean_hz"), r(F.max("hz")).alias("max_hz"))


@query
def treated_minus_vehicle(spark, d):
    both = _rates(spark, d, ARMS).groupBy("body_id").agg(arm("vehicle"), arm("treated"))
    return both.select("body_id", r("vehicle").alias("vehicle"), r("treated").alias("treated"), r(F.col("treated") - F.col("vehicle")).alias("delta"))


@query
def census_index(spark, d):
    c = X.nodes(spark, d).groupBy("nt").agg(F.count("*").alias("cells"))
    rows = [G.settle(c, g, x, y).select(F.lit(name).alias("arm"), F.lit(conv).alias("convention"), *[r(k, 9).alias(k) for k in ("excitation", "inhibition", "ratio")]) for name, g in (("vehicle", {}), ("treated", TREATED)) for conv, x, y in (("wholens", 0.3, 0.7), ("rate_engine", -0.4, 0.4))]
    return G.union_all(rows)


@query
def average_ranks(spark, d):
    return S.average_rank(X.table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", "rank")


@query
def rank_correlations(spark, d):
    o = X.table(spark, d, "part").select(F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return S.correlations(o, "a", "b").select("n", r("pearson").alias("pearson"), r("spearman").alias("spearman"))


@query
def kendall_tau_b(spark, d):
    o = X.table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    return S.kendall(o, "l_returnflag", "a", "b").select("l_returnflag", r("tau").alias("tau"))


def _permuted(spark, d):
    return S.permutation(X.draws(spark, d))


@query
def permutation_p(spark, d):
    return _permuted(spark, d).select("cell", "real", "n", *[r(c).alias(c) for c in ("null_mean", "null_median", "ci_low", "ci_high")], r("p", 9).alias("p"), r("resolution", 9).alias("resolution"))


@query
def bh_fdr(spark, d):
    tests = _permuted(spark, d).select("cell", F.when(F.col("cell") % 10 != 0, r("p", 9)).alias("p"))
    return S.benjamini_hochberg(tests, alpha=0.5).select("cell", "p", "m", r("q", 9).alias("q"), "rejected")


def _modes(spark, d):
    p = _permuted(spark, d).select(F.floor(F.col("cell") / 4).cast("long").alias("of"), X.pick(["rewire", "weight_permute", "sign_permute", "erdos_renyi"], F.col("cell")).alias("mode"), (F.col("real") - 60_000).alias("real"), (r("null_median") - 60_000).alias("median"), r("p", 9).alias("p"))
    return p.select(F.col("of").alias("cell"), "mode", "real", S.verdict(F.col("real"), F.col("median"), F.col("p"), F.lit(25_000.0), 0.5).alias("verdict"))


@query
def mode_verdicts(spark, d):
    return _modes(spark, d).groupBy("mode", "verdict").agg(F.count("*").alias("n"))


@query
def classify_cells(spark, d):
    return S.classify(_modes(spark, d), 3500.0, STRUCTURAL)


@query
def necessary_level(spark, d):
    order = {"erdos_renyi": 0, "weight_permute": 1, "rewire": 2, "sign_permute": 3}
    level = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("mode")]
    m = _modes(spark, d).withColumn("level", level)
    return m.groupBy("cell").agg(F.min_by("mode", F.when(F.col("verdict") != "distinguishable", F.col("level"))).alias("sufficient"), F.count_if(F.col("verdict") == "distinguishable").alias("n_distinguishable"))


@query
def prefix_convergence(spark, d):
    return S.convergence(X.draws(spark, d)).select("cell", r("mean").alias("mean"), "n_off", "settled")


@query
def threshold_crossing(spark, d):
    o = X.table(spark, d, "orders")
    c = o.select(F.floor(F.col("o_orderkey") / 8).cast("long").alias("curve"), F.pow(F.lit(10.0), (F.col("o_orderkey") % 8).cast("double")).alias("dose"), (F.col("o_totalprice") / 200_000).alias("y"))
    return S.threshold_crossing(c, "curve", "dose", "y", 1.0).select("curve", r(F.log10("crossing")).alias("log_crossing"), "at_first")


@query
def verdict_islands(spark, d):
    o = X.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return S.islands(o, "o_custkey", "o_orderkey", "o_orderstatus")


@query
def psth_bins(spark, d):
    e = X.table(spark, d, "events")
    return e.groupBy(F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("bin")).agg(F.count("*").alias("spikes"), F.count_distinct("user_id").alias("cells"))


@query
def raster_budget(spark, d):
    e = X.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("spikes"))
    place = S.ordinal(e, F.desc("spikes"), "user_id")
    per = e.select(F.least("spikes", F.lit(8)).alias("k"))
    return place.filter("ordinal <= 50").withColumn("kept", F.least("spikes", F.lit(8)).cast("long")).crossJoin(F.broadcast(per.agg(F.sum("k").alias("all_kept")))).select("user_id", "spikes", "kept", F.col("all_kept").cast("long").alias("all_kept"), "ordinal")


@query
def experiment_summary(spark, d):
    o = X.table(spark, d, "orders").select(F.col("o_orderpriority").alias("compound"), F.col("o_orderstatus").alias("arm"), "o_totalprice")
    return S.summary(o, ["compound", "arm"], "o_totalprice").select("compound", "arm", "n", r("mean").alias("mean"), r("sd", 4).alias("sd"))


@query
def stability_matrix(spark, d):
    o = X.table(spark, d, "orders")
    holds = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") > 150_000)
    m = o.select(F.col("o_orderpriority").alias("conclusion"), (F.col("o_orderkey") % 25).alias("spec"), holds.alias("holds")).groupBy("conclusion", "spec").agg(F.bool_and("holds").alias("all_hold"), F.avg(F.col("holds").cast("int")).alias("share"))
    v = m.withColumn("retained", F.when(F.col("share").isNotNull(), F.col("share") > 0.5))
    return v.groupBy("conclusion").agg(F.count("*").alias("n"), F.count_if("retained").alias("retained"), F.count_if(F.col("retained").isNull()).alias("undecidable"), r(F.avg("share")).alias("share"))


@query
def threshold_grid(spark, d):
    grid = spark.createDataFrame([(float(f), float(v)) for f in (0.25, 0.4, 0.5) for v in (0.1, 0.2, 0.3)], "frac double, vert_limit double")
    p = _pairs(spark, d).filter("ratio is not null").select("compound", "insect_engagement", "vertebrate_engagement").crossJoin(F.broadcast(grid))
    amp = (F.col("insect_engagement") >= F.col("frac")) & (F.col("vertebrate_engagement") < F.col("vert_limit"))
    return p.groupBy("frac", "vert_limit").agg(F.count("*").alias("n"), F.count_if(amp).alias("amplified"))


@query
def jansen_indices(spark, d):
    li = X.table(spark, d, "lineitem")
    rows = li.select(F.col("l_linenumber").cast("int").alias("factor"), F.col("l_extendedprice").alias("a"), (1500 * F.col("l_quantity")).alias("b"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("ab"))
    return S.jansen(rows, "factor").select("factor", r("first").alias("first"), r("total").alias("total"))


@query
def ishigami(spark, d):
    x = [F.col("l_quantity") / 25 - 1, F.col("l_discount") * 20 - 1, F.col("l_tax") * 25 - 1]
    a, b, c = (v * 3.141592653589793 for v in x)
    y = F.sin(a) + 7 * F.pow(F.sin(b), 2) + 0.1 * F.pow(c, 4) * F.sin(a)
    return X.table(spark, d, "lineitem").groupBy("l_returnflag").agg(r(F.avg(y), 5).alias("mean"), r(F.var_samp(y), 4).alias("variance"))


@query
def sign_permute_nulls(spark, d):
    e, n = graph(spark, d)
    nulls = G.sign_nulls(n, 20)
    w = e.join(nulls.withColumnRenamed("body_id", "pre"), "pre").withColumn("w", F.col("weight") * G.sign_of(F.col("nt")))
    return w.groupBy("draw").agg(r(F.sum("w")).alias("net"), r(F.sum(F.abs("w"))).alias("absolute"))


@query
def sha_digest(spark, d):
    t = X.table(spark, d, "documents")
    lines = F.concat_ws("\t", F.col("doc_id").cast("string"), F.sha2("text", 256))
    # a digest per source and block of ids: the list of a whole source would be one group of unbounded size
    per = t.withColumn("block", F.floor(F.col("doc_id") / 256).cast("long")).groupBy("source", "block").agg(F.sort_array(F.collect_list(F.sha2(lines, 256))).alias("l"))
    return per.select("source", "block", F.sha2(F.array_join("l", "\n"), 256).alias("digest"), F.size("l").cast("long").alias("n"))


@query
def json_fields(spark, d):
    e = X.table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))


@query
def cited_numbers(spark, d):
    t = X.table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0))).alias("x"))
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("x").alias("different"))


@query
def degree_preserving_rewire(spark, d):
    """Ten swaps per edge on the graph of orders: per source what the null keeps, and how many of its targets it still shares with the real graph."""
    e = cut(X.order_edges(spark, d))
    null, swaps = G.rewire(e)
    real = e.select("pre", "post", F.lit(1).alias("real"))
    return null.join(real, ["pre", "post"], "left").groupBy("pre").agg(F.count("*").alias("out_degree"), r(F.sum("weight")).alias("out_weight"), F.count("real").alias("targets_kept")).withColumn("enough_swaps", F.lit(swaps) >= 10 * F.lit(e.count()))


@query
def weight_permute_nulls(spark, d):
    e, _ = graph(spark, d)
    return G.weight_nulls(e, 5).groupBy("draw", "pre").agg(F.count("*").alias("out_degree"), r(F.sum("weight")).alias("out_weight"))


@query
def hill_fit(spark, d):
    o = X.table(spark, d, "orders")
    curve = o.select(F.col("o_orderpriority").alias("curve"), (F.col("o_orderkey") % 8 - 7).cast("double").alias("log_dose"), (F.col("o_totalprice") / 300_000).alias("y"))
    mean = curve.groupBy("curve", "log_dose").agg(F.avg("y").alias("noise"))
    planted = 5 + 95 / (1 + F.pow(F.lit(10.0), -(F.col("log_dose") + 3.5) * 1.2))
    return K.fit_hill(mean.select("curve", "log_dose", (planted + F.col("noise")).alias("y")), bootstraps=20)


@query
def sensitivity_tornado(spark, d):
    """Engagement at half and twice each value and slope, one parameter at a time: span per compound and parameter."""
    e = engaged(spark, d).filter("engagement is not null")
    move = spark.createDataFrame([(p, f) for p in ("value_m", "n") for f in (0.5, 2.0)], "parameter string, factor double")
    v = F.col("value_m") * F.when(F.col("parameter") == "value_m", F.col("factor")).otherwise(1.0)
    n = F.col("n") * F.when(F.col("parameter") == "n", F.col("factor")).otherwise(1.0)
    rows = e.crossJoin(F.broadcast(move)).withColumn("moved", pharm.hill(F.col("conc_m"), v, n))
    return rows.groupBy("pos", "parameter").agg(r(F.min("moved"), 9).alias("low"), r(F.max("moved"), 9).alias("high"), r(F.max("moved") - F.min("moved"), 9).alias("span"))


@query
def circuit_disruption(spark, d):
    t = treated_minus_vehicle(spark, d)
    return t.agg(r(F.try_divide(F.avg(F.abs("delta")), F.avg("vehicle"))).alias("disruption"), F.count("*").alias("n"))


@query
def normalisation_signs(spark, d):
    e, n = graph(spark, d)
    parts, of = [], (cut(e), n)
    for how in ("row_abs", "none", "degree"):
        mean = lambda name: F.avg(F.when(F.col("arm") == name, F.col("hz")))
        parts.append(_rates(spark, d, ARMS, how, of=of).agg(r(mean("treated") - mean("vehicle")).alias("effect")).select(F.lit(how).alias("normalise"), "effect"))
    return G.union_all(parts).withColumn("sign", F.signum("effect").cast("int"))


@query
def first_seen_edges(spark, d):
    li = X.table(spark, d, "lineitem")
    k = F.row_number().over(Window.partitionBy("l_suppkey", "l_partkey").orderBy("l_orderkey", "l_linenumber"))
    return li.withColumn("k", k).filter("k = 1").select(F.col("l_suppkey").alias("pre"), F.col("l_partkey").alias("post"), "l_orderkey", r("l_quantity").alias("weight"))


@query
def mixture_coverage(spark, d):
    m = _mixture(spark, d)
    receptors, mixtures = m.select("receptor").distinct(), m.select("mixture").distinct()
    return mixtures.crossJoin(F.broadcast(receptors)).join(m.filter("value_m is not null"), ["mixture", "receptor"], "left_anti").groupBy("mixture").agg(F.count("*").alias("missing"))


@query
def viewer_edges(spark, d):
    e = X.big_edges(spark, d).filter("weight >= 10").select("pre", "post", r("weight").alias("weight"))
    n = e.agg(F.count("*").alias("n"))
    return e.orderBy(F.desc("weight"), "pre", "post").limit(500).crossJoin(F.broadcast(n)).select("pre", "post", "weight", (F.col("n") > 500).alias("truncated"))


@query
def response_sample_sizes(spark, d):
    """Group sizes for the drop in a response proportion that each compound's largest insect engagement predicts."""
    from ..operators import designs as D

    e = engaged(spark, d).filter("startswith(receptor, 'insect_') and engagement is not null").groupBy("compound").agg(F.least(F.max("engagement"), F.lit(0.5)).alias("drop"))
    size = D.two_proportions(F.lit(0.8), 0.8 * (1 - F.col("drop")))
    return e.filter("drop is not null").select("compound", r("drop", 9).alias("drop"), size.alias("per_group"))


@query
def pairwise_concordance(spark, d):
    """Share of pairs of sizes that a model orders as published, per brand, and the average ranks' largest difference."""
    p = X.table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("price"))
    a, b = p.select("p_brand", F.col("p_size").alias("s1"), F.col("price").alias("y1")), p.select("p_brand", F.col("p_size").alias("s2"), F.col("price").alias("y2"))
    pair = a.join(b, "p_brand").filter("s1 < s2")
    return pair.groupBy("p_brand").agg(F.count("*").alias("pairs"), F.count_if(F.col("y1") < F.col("y2")).alias("agree"), r(F.count_if(F.col("y1") < F.col("y2")) / F.count("*"), 9).alias("share"))


@query
def structure_separation(spark, d):
    """For each statistic, whether classes of nodes are apart: the next class's least value lies above this one's largest."""
    deg, n = G.degrees(X.edges(spark, d)), X.nodes(spark, d)
    long = deg.join(n, "body_id").select("superclass", F.expr("stack(3, 'in_weight', in_weight, 'out_weight', out_weight, 'out_degree', double(out_degree)) as (statistic, value)"))
    span = long.groupBy("statistic", "superclass").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    after = F.lead("low").over(Window.partitionBy("statistic").orderBy("low", "superclass"))
    return span.select("statistic", "superclass", r("low").alias("low"), r("high").alias("high"), (after > F.col("high")).alias("apart"))


@query
def balance_report(spark, d):
    """Outgoing weight per transmitter under permuted signs against the real graph: mean, spread, extremes and the largest deviation."""
    e, n = graph(spark, d)
    real = G.shares(e, n).select("nt", F.col("out_weight").alias("real"))
    w = e.join(G.sign_nulls(n, 20).withColumnRenamed("body_id", "pre"), "pre").groupBy("draw", "nt").agg(F.sum("weight").alias("w"))
    return w.join(real, "nt").groupBy("nt").agg(r(F.max("real")).alias("real"), r(F.avg("w")).alias("mean"), r(F.coalesce(F.stddev_samp("w"), F.lit(0.0)), 4).alias("sd"), r(F.min("w")).alias("low"), r(F.max("w")).alias("high"), r(F.max(F.abs(F.col("w") - F.col("real")))).alias("most_off"))


@query
def source_overlap(spark, d):
    """Numbers that texts of two languages both cite."""
    t = X.table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0))).alias("x")).distinct()
    a, b = t.withColumnRenamed("lang", "a"), t.withColumnRenamed("lang", "b")
    return a.join(b, "x").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


@query
def genotype_panel(spark, d):
    """Engagement of the wild type and of each fold change, and the difference from the wild type."""
    folds = spark.createDataFrame([("wild_type", 1.0), ("low", 2.0), ("high", 20.0)], "genotype string, fold double")
    e = X.evidence(spark, d).filter("value_m is not null").crossJoin(F.broadcast(folds))
    rows = e.withColumn("engagement", pharm.hill(F.lit(1e-6), F.col("value_m") * F.col("fold"), F.col("n")))
    wild = F.max(F.when(F.col("genotype") == "wild_type", F.col("engagement"))).over(Window.partitionBy("pos"))
    return rows.select("pos", "genotype", r("engagement", 9).alias("engagement"), r(F.col("engagement") - wild, 9).alias("delta"))


@query
def exposure_occupancy(spark, d):
    """Mean and largest occupancy over a day's concentration curve."""
    s = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("subject"), (1e-6 * (1 + F.col("s_suppkey") % 7)).alias("c0"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("h"))
    c = pharm.bateman(F.col("h").cast("double"), F.col("c0"), F.lit(0.5), F.lit(0.5))
    return s.withColumn("o", pharm.hill(c, F.lit(5e-7), F.lit(1.0))).groupBy("subject").agg(r(F.avg("o"), 9).alias("mean"), r(F.max("o"), 9).alias("top"))


@query
def equivalence_margins(spark, d):
    """Margin (5 % of the vehicle) and effect floor (1 %, at least 1e-6) of each node, and whether the effect passes them."""
    t = treated_minus_vehicle(spark, d)
    margin, floor = 0.05 * F.abs("vehicle"), F.greatest(F.lit(1e-6), 0.01 * F.abs("vehicle"))
    return t.select("body_id", r(margin).alias("margin"), r(floor, 8).alias("floor"), (F.abs("delta") < margin).alias("within"), (F.abs("delta") <= floor).alias("no_effect"))


@query
def sobol_budget(spark, d):
    from ..operators import designs as D

    x = F.col("x")
    y = F.sin((2 * x["a"] - 1) * 3.141592653589793) + 7 * F.pow(F.sin((2 * x["b"] - 1) * 3.141592653589793), 2) + 0.1 * F.pow((2 * x["c"] - 1) * 3.141592653589793, 4) * F.sin((2 * x["a"] - 1) * 3.141592653589793)
    return D.sobol(D.saltelli(spark, 512, ["a", "b", "c"]), y).select("factor", r("first", 9).alias("first"), r("total", 9).alias("total"))


@query
def design_runs(spark, d):
    """Gains over a design's grid of compounds, doses and replicates, summarised per compound and dose."""
    from ..operators import designs as D

    e = X.evidence(spark, d).withColumn("compound", F.concat(F.lit("c"), F.col("compound").cast("string")))
    out = D.run(D.Design(("c1", "c2", "c3", "c10"), (1e-7, 1e-6), replicates=3, seed=5), e)
    return S.summary(out, ["condition", "compound", "conc_m"], "g_ach").select("condition", "compound", "conc_m", "n", r("mean", 9).alias("mean"), r("sd", 9).alias("sd"))
