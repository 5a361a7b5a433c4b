"""Queries of whole analyses: null models and dependence on structure, baselines, uncertainty, mixtures, paths and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims, pharm
from ..lineage import cut
from ..operators import engagement as E
from ..operators import graph as G
from ..operators import stats as S
from ..sources import fixtures as X
from .catalogue import QUERIES, STRUCTURAL, TREATED, graph, query, r, seeds

__all__ = ["QUERIES"]

DRAWS, ALPHA = 20, 0.1
#: Null models whose draws SQL can make too.
MODES = ("sign_permute", "weight_matched", "weight_permute", "erdos_renyi")


@query
def erdos_renyi_nulls(spark, d):
    null = G.erdos_renyi(X.order_edges(spark, d), X.order_nodes(spark, d), 3)
    return null.groupBy("draw", "pre").agg(F.count("*").alias("out_degree"), r(F.sum("weight")).alias("out_weight"), F.sum("post").alias("targets"))


@query
def weight_matched_nulls(spark, d):
    e = X.order_edges(spark, d)
    null = G.weight_matched_nulls(e, X.order_nodes(spark, d), 3)
    out = e.groupBy(F.col("pre").alias("body_id")).agg(F.sum("weight").alias("out"))
    return null.join(out, "body_id", "left").groupBy("draw", "nt").agg(F.count("*").alias("cells"), r(F.coalesce(F.sum("out"), F.lit(0.0))).alias("out_weight"), F.max("block").alias("block"))


@query
def weight_shuffle_nulls(spark, d):
    return G.weight_nulls(X.order_edges(spark, d), 3, within=()).groupBy("draw", "post").agg(F.count("*").alias("in_degree"), r(F.sum("weight")).alias("in_weight"))


def heavy_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """The graph of nations, its edges those above the mean weight and no loops."""
    e, n = graph(spark, d)
    e = cut(e.filter("pre <> post"))
    return cut(e.crossJoin(F.broadcast(e.agg(F.avg("weight").alias("mean")))).filter("round(weight - mean, 6) > 0").drop("mean")), cut(n)


def typical(spark, d, *doses: float) -> DataFrame:
    """Engagement of three typical compounds, one per direction: at each receptor the geometric mean of all values of that direction."""
    e = X.evidence(spark, d).filter("value_m is not null").groupBy("direction", "receptor").agg(F.exp(F.avg(F.ln("value_m"))).alias("value_m"), F.avg("n").alias("n"))
    rows = e.crossJoin(F.broadcast(X.doses(spark, *doses))).select(F.col("direction").alias("compound"), "conc_m", "receptor", "direction", F.lit(0).alias("pos"), "value_m", "n", F.lit("EC50").alias("param_type"))
    return rows.withColumn("engagement", pharm.hill(F.col("conc_m"), F.col("value_m"), F.col("n")))


def cells(spark, d, *doses: float) -> DataFrame:
    """An arm per typical compound and dose, with its gains."""
    g = E.gains(typical(spark, d, *doses))
    return cut(g.select(F.concat_ws("@", "compound", (F.col("conc_m") * 1e9).cast("long").cast("string")).alias("arm"), *dims.GAINS))


def effects(edges, nodes, arms, drive, motor, by=(), steps=80) -> DataFrame:
    """Mean rate of the read-out nodes per arm, less the vehicle's: ``*by, arm, effect, vehicle``."""
    sets = motor.select(F.lit("motor").alias("readout"), "body_id")
    out = G.readouts(edges, nodes, drive, arms, sets, by=tuple(by), steps=steps)
    return out.select(*by, "arm", (F.col("hz") - F.col("vehicle")).alias("effect"), "vehicle")


def null_graphs(edges: DataFrame, nodes: DataFrame, modes: tuple[str, ...], draws: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of every draw of every null model, told apart by ``mode`` and ``draw``."""
    e, n = G.drawn(edges, draws), G.drawn(nodes.select("body_id", "nt"), draws)
    made = {
        "sign_permute": lambda: (e, G.sign_nulls(nodes, draws, seed)),
        "weight_matched": lambda: (e, G.weight_matched_nulls(edges, nodes, draws, seed).drop("block")),
        "weight_permute": lambda: (G.weight_nulls(edges, draws, seed, within=()), n),
        "erdos_renyi": lambda: (G.erdos_renyi(edges, nodes, draws, seed), n),
        "rewire": lambda: (G.rewire(e, seed=seed, by=("draw",))[0], n),
    }
    parts = [[x.withColumn("mode", F.lit(m)) for x in made[m]()] for m in modes]
    return cut(G.union_all([p[0] for p in parts])), cut(G.union_all([p[1] for p in parts]))


def landscape(edges: DataFrame, nodes: DataFrame, arms: DataFrame, drive: DataFrame, motor: DataFrame, modes: tuple[str, ...], draws: int, alpha: float, structural: tuple[str, ...] = STRUCTURAL) -> DataFrame:
    """Per cell (arm) and null model: effect, permutation p, q over the structural tests of all cells, verdict, and the cell's class.

    All draws of all models run at once as graphs of one table, so every cell meets the same nulls.
    """
    real = effects(edges, nodes, arms, drive, motor)
    null = effects(*null_graphs(edges, nodes, modes, draws), arms, drive, motor, by=("mode", "draw"))
    rows = null.drop("vehicle").join(F.broadcast(real.select("arm", F.col("effect").alias("real"), "vehicle")), "arm")
    test = cut(S.permutation(rows.select(F.concat_ws("|", "arm", "mode").alias("cell"), "effect", "real")).withColumn("p", r("p", 9)))
    test = test.select(F.substring_index("cell", "|", 1).alias("arm"), F.substring_index("cell", "|", -1).alias("mode"), "real", "null_median", "p")
    own = S.benjamini_hochberg(test.filter(F.col("mode").isin(*structural)), alpha=alpha).select("arm", "mode", "q")
    rows = test.join(own, ["arm", "mode"], "left").join(real.select("arm", "vehicle"), "arm").withColumn("decides", F.coalesce("q", "p"))
    floor, margin = F.greatest(F.lit(1e-6), 0.01 * F.abs("vehicle")), 0.05 * F.abs("vehicle")
    rows = rows.withColumns({"floor": floor, "verdict": S.verdict(F.col("real"), F.col("null_median"), F.col("decides"), margin, alpha)})
    hit = F.col("verdict") == "distinguishable"
    of = rows.groupBy("arm").agg(F.max(F.abs("real") <= F.col("floor")).alias("none"), F.bool_or(hit & F.col("mode").isin(*structural)).alias("s"), F.bool_or(hit & (F.col("mode") == "sign_permute")).alias("g"))
    label = F.when(F.col("none"), "no-effect").when(F.col("s"), "topology-dependent").when(F.col("g"), "mixed").otherwise("composition-dominated")
    return rows.join(of.select("arm", label.alias("class")), "arm").select("arm", "mode", "real", "null_median", "p", "q", "verdict", "class")


def motor(nodes):
    return nodes.filter("superclass = 'ASIA'").select("body_id")


@query
def dependence_landscape(spark, d):
    e, n = heavy_graph(spark, d)
    out = landscape(e, n, cells(spark, d, 1e-7, 1e-6), seeds(n).withColumn("hz", F.lit(40.0)), motor(n), MODES, DRAWS, ALPHA, ("weight_permute", "erdos_renyi"))
    return out.select("arm", "mode", r("real").alias("real"), r("null_median", 5).alias("null_median"), "p", r("q", 9).alias("q"), "verdict", "class")


@query
def baseline_ladder(spark, d):
    """Effect of each cell by what a model knows: its strongest insect receptor, the graph's composition, its topology, all; and rank correlations with the last."""
    doses = (1e-8, 1e-7, 1e-6, 1e-5)
    e, n = heavy_graph(spark, d)
    arms, drive = cells(spark, d, *doses), seeds(n).withColumn("hz", F.lit(40.0))
    known = typical(spark, d, *doses).filter(F.startswith("receptor", F.lit("insect_"))).groupBy("compound", "conc_m").agg(F.max("engagement").alias("theta"))
    theta = known.select(F.concat_ws("@", "compound", (F.col("conc_m") * 1e9).cast("long").cast("string")).alias("arm"), "theta")
    arms = cut(E.drive_sign(arms).join(theta, "arm"))
    up = F.when(F.col("direction") > 0, 1 + F.col("theta")).otherwise(F.greatest(F.lit(pharm.FLOOR), 1 - F.col("theta")))
    plain = arms.select("arm", *[(up if k != "ach_tone" and k != "g_nav" else F.lit(1.0)).alias(k) for k in dims.GAINS])
    full = effects(e, n, arms.select("arm", *dims.GAINS), drive, motor(n)).select("arm", F.col("effect").alias("full"))
    topology = effects(e, n, plain, drive, motor(n)).select("arm", F.col("effect").alias("topology"))
    share = n.groupBy("nt").agg(F.count("*").alias("cells")).crossJoin(F.broadcast(n.agg(F.count("*").alias("all"))))
    weighed = arms.crossJoin(F.broadcast(share)).groupBy("arm").agg(F.sum(G.sign_of(F.col("nt")) * (G.gain_column(F.col("nt")) - 1) * F.col("cells") / F.col("all")).alias("composition"))
    receptor = arms.select("arm", F.when(F.col("direction") > 0, F.col("theta")).otherwise(-F.col("theta")).alias("receptor"))
    rows = cut(full.join(topology, "arm").join(weighed, "arm").join(receptor, "arm"))
    parts = [S.correlations(rows.select(r(level).alias("a"), r("full").alias("b")), "a", "b").select(F.lit(level).alias("level"), "n", r("spearman").alias("spearman")) for level in ("receptor", "composition", "topology", "full")]
    return G.union_all(parts)


@query
def p_convergence(spark, d):
    out = S.p_convergence(X.draws(spark, d), alpha=0.5)
    return out.select("cell", "n", r("p", 9).alias("p"), r("p_max_shift", 9).alias("p_max_shift"), "verdict_stable", "stabilised", "n_stabilised", "resolution_limited")


@query
def fdr_diagnostics(spark, d):
    tests = S.permutation(X.draws(spark, d)).select("cell", r("p", 9).alias("p"), "resolution")
    return S.fdr_diagnostics(tests, alpha=0.5).select("m", "n_rejected", r("resolution", 9).alias("resolution"), "min_rejections", "can_reject", "single_rejection")


@query
def library_checks(spark, d):
    """All checks of a library's rows: problems with their rows and compounds."""
    p = F.col("pos")
    e = X.evidence(spark, d).join(F.broadcast(dims.models(spark)), ["param_type", "relation"], "left")
    e = e.withColumns({"evidence_tier": X.pick(["primary", "secondary", "class_placeholder", "guess"], p), "source": F.when(p % 11 != 0, F.concat(F.lit("paper "), p.cast("string"))).otherwise(" ")})
    e = e.withColumn("receptor", F.when(p % 97 == 0, "insect_unheard_of").otherwise(F.col("receptor"))).withColumn("direction", F.when(p % 89 == 0, "sideways").otherwise(F.col("direction")))
    declared = [f"{o}_{x}" for o in ("insect", "vertebrate") for x in dims.RECEPTORS]
    return E.problems(e, declared).groupBy("problem").agg(F.count("*").alias("n"), F.count_distinct("compound").alias("compounds"))


@query
def path_impact(spark, d):
    """The 50 strongest paths of one or two edges into motor nodes under gains; the report's size is its limit."""
    e, n = X.order_edges(spark, d), X.order_nodes(spark, d)
    out = G.backward_paths(e, n, n.filter("superclass = 'motor'").select("body_id"), TREATED, 2)
    top = out.withColumn("size", r(F.abs("after"))).orderBy(F.desc("size"), "path").limit(50)
    return top.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "length", r("min_weight").alias("min_weight"), r("before").alias("before"), r("after").alias("after"), r(F.col("after") - F.col("before")).alias("delta"))


@query
def edge_scan(spark, d):
    """Raw edges of some weight whose ends are both traced; the weight floor reaches the scan."""
    raw = X.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pre"), F.col("l_partkey").alias("post"), F.col("l_quantity").alias("weight"))
    pre, post = X.table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("body_id")), X.table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("body_id"))
    return G.scan(raw, 30.0, pre, post).groupBy("pre").agg(F.count("*").alias("n"), r(F.sum("weight")).alias("weight"))


@query
def node_records(spark, d):
    """Wanted bodies with their annotation and transmitter, each the first of its key; bodies without either stay."""
    ev = X.table(spark, d, "events")
    wanted = X.table(spark, d, "orders").select(F.col("o_custkey").alias("body_id")).distinct()
    annotation = X.table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("body_id"), F.col("c_mktsegment").alias("superclass"), F.col("c_custkey").alias("order"))
    transmitter = ev.select(F.col("user_id").alias("body_id"), F.col("event_type").alias("nt"), F.col("event_id").alias("order"))
    return G.node_records(wanted, annotation, transmitter).select("body_id", "superclass", "nt")


@query
def credible_intervals(spark, d):
    e = X.evidence(spark, d).join(F.broadcast(dims.models(spark)), ["param_type", "relation"]).withColumn("conc_m", F.lit(1e-6))
    return E.credible(e, draws=100, sd_log10=0.3).select("pos", r("point").alias("point"), r("mean").alias("mean"), r("low").alias("low"), r("high").alias("high"), "perturbed")


@query
def isobologram(spark, d):
    """Dose pairs of two compounds at a shared receptor that reach half occupancy together, and their combination index."""
    e = X.evidence(spark, d).filter("value_m is not null").groupBy("compound", "receptor").agg(F.min(F.struct("value_m", "n")).alias("x")).select("compound", "receptor", F.col("x.value_m").alias("v"), F.col("x.n").alias("n")).withColumn("pair", F.floor(F.col("compound") / 2).cast("long"))
    a, b = e.filter("compound % 2 = 0").select("pair", "receptor", F.col("v").alias("va"), F.col("n").alias("na")), e.filter("compound % 2 = 1").select("pair", "receptor", F.col("v").alias("vb"), F.col("n").alias("nb"))
    return E.isobole(a.join(b, ["pair", "receptor"]), 0.5, 7).select("pair", "receptor", r("fraction").alias("fraction"), r(F.col("dose_a") * 1e9).alias("dose_a_nm"), r(F.col("dose_b") * 1e9).alias("dose_b_nm"), r("ci").alias("ci"))


@query
def two_sided_signs(spark, d):
    """Exact two-sided sign test per brand: how often its parts cost more than the mean of all."""
    p = X.table(spark, d, "part")
    rows = p.crossJoin(F.broadcast(p.agg(F.avg("p_retailprice").alias("mean")))).groupBy("p_brand").agg(F.count_if(F.col("p_retailprice") > F.col("mean")).alias("k"), F.count("*").alias("n"))
    return rows.select("p_brand", "k", "n", r(S.binomial_two_sided(F.col("k"), F.col("n")), 9).alias("p"))


@query
def evidence_coercion(spark, d):
    """Types and relations written in any case and with blanks, read back, and rows that claim a stronger model than their type supports."""
    e = X.evidence(spark, d)
    messy = e.select(F.when(F.col("pos") % 13 != 0, F.concat(F.lit(" "), F.upper("param_type"))).alias("t"), F.when(F.col("pos") % 17 != 0, F.concat(F.initcap("relation"), F.lit("  "))).alias("s"), X.pick(["binding_occupancy", "functional_engagement", "not_modelled"], F.col("pos")).alias("claimed"))
    rows = messy.select(dims.param_type(F.col("t")).alias("param_type"), dims.relation(F.col("s")).alias("relation"), dims.distance(F.col("s")).alias("distance"), "claimed")
    return rows.withColumn("exceeds", dims.exceeds(F.col("claimed"), F.col("param_type"))).groupBy("param_type", "relation", "distance").agg(F.count("*").alias("n"), F.count_if("exceeds").alias("too_strong"))


@query
def generic_multipliers(spark, d):
    e = E.engage(X.evidence(spark, d), X.doses(spark, 1e-6))
    theta = e.filter(F.startswith("receptor", F.lit("insect_"))).groupBy("compound").agg(F.max("engagement").alias("theta"))
    g = E.drive_sign(E.gains(e)).select("compound", "direction").join(theta, "compound", "left")
    return g.select("compound", r(pharm.generic_multiplier(F.col("theta"), F.col("direction")), 9).alias("directed"), r(pharm.generic_multiplier(F.col("theta"), F.col("direction"), False), 9).alias("depressant"))


@query
def scaled_cut(spark, d):
    """The first 60 nodes in growth order and the weights among them; the budget is the operator's."""
    e = X.big_edges(spark, d).filter("weight >= 45")
    nodes, inside = G.scaled_cut(e, spark.createDataFrame([(1,)], "body_id long"), 2, 60)
    out = inside.groupBy(F.col("pre").alias("body_id")).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))
    return nodes.join(out, "body_id", "left").select("body_id", "ring", "place", F.coalesce("edges", F.lit(0)).alias("edges"), r(F.coalesce("weight", F.lit(0.0))).alias("weight"))
