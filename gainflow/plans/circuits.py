"""Queries of analyses on networks: planted graphs, ensembles, mixtures, expression, composition and scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims, pharm
from ..lineage import cut
from ..operators import conclusions as C
from ..operators import engagement as E
from ..operators import graph as G
from ..operators import networks as N
from ..operators import planted as P
from ..operators import predictions as H
from ..operators import stats as S
from ..operators import validation as V
from ..sources import fixtures as X
from ..sources import sinks as K
from .analyses import QUERIES, cells, effects
from .catalogue import TREATED, engaged, query, r

__all__ = ["QUERIES"]

#: The grid of planted loops: strengths, replicates, nodes of a loop (of which so many are driven), draws and steps.
STRENGTHS, REPLICATES, LOOP, DRIVEN, PLANTED_DRAWS, PLANTED_STEPS, PLANTED_ALPHA = (0.0, 1.0, 4.0), 3, 5, 2, 9, 20, 0.1


#: Pairs of typical compounds, and the doses at which they are mixed.
PAIRS = (("agonist", "antagonist"), ("agonist", "inhibitor"), ("antagonist", "inhibitor"))
MIXED_DOSES = (("100", 1e-7), ("1000", 1e-6))


def planted_cells(spark, d, modes: tuple[str, ...] = ("weight_permute",)):
    """Detections of loops planted in random graphs with the order graph's census and weights."""
    edges, nodes, ring = P.planted(X.order_edges(spark, d), X.order_nodes(spark, d), STRENGTHS, REPLICATES, LOOP)
    drive = ring.filter(F.col("place") < DRIVEN).select("replicate", "body_id", F.lit(40.0).alias("hz"))
    return P.detection(edges, nodes, drive, {"g_ach": 0.05}, modes, (5, PLANTED_DRAWS), PLANTED_ALPHA, steps=PLANTED_STEPS)


@query
def planted_detection(spark, d):
    """Effect and permutation p of every planted graph, on the first five and on all draws."""
    return planted_cells(spark, d).select("strength", "replicate", "n", "mode", r("real").alias("real"), r("p", 9).alias("p"), "detected")


@query
def planted_power(spark, d):
    """Share of graphs in which a loop is found, by its strength and the number of draws; strength 0 gives the false alarms. With whether the null models find what was planted and nothing else."""
    powers = cut(P.power(planted_cells(spark, d)))
    whole = P.recovery(powers).select("n", "smallest", "false_positive_rate", "recovered")
    return powers.join(whole, "n").select("strength", "n", "replicates", "n_detected", "rate", "is_control", "smallest", "false_positive_rate", "recovered")


def order_graph(spark, d):
    """The order graph, stored once, and the drive of its sensory nodes."""
    edges, nodes = cut(X.order_edges(spark, d)), cut(X.order_nodes(spark, d))
    return edges, nodes, nodes.filter("superclass = 'sensory'").select("body_id", F.lit(40.0).alias("hz"))


def typical_evidence(spark, d):
    """Evidence of three typical compounds, one per direction: at each receptor the geometric mean of all values of that direction."""
    e = X.evidence(spark, d).filter("value_m is not null").groupBy("direction", "receptor").agg(F.exp(F.avg(F.ln("value_m"))).alias("value_m"), F.avg("n").alias("n"))
    return cut(e.select(F.col("direction").alias("compound"), "receptor", "direction", F.lit(0).alias("pos"), "value_m", "n"))


@query
def ensemble_intervals(spark, d):
    """Read-outs of typical compounds on the order graph, with intervals over jittered evidence and drive."""
    edges, nodes, drive = order_graph(spark, d)
    sets = nodes.filter("superclass in ('motor', 'visual')").select(F.concat("superclass", F.lit("_hz")).alias("readout"), "body_id")
    out = N.ensemble(edges, nodes, typical_evidence(spark, d), X.doses(spark, 1e-7, 1e-6), drive, sets, draws=12, steps=10)
    return out.select("compound", r(F.col("conc_m") * 1e9).alias("conc_nm"), "readout", *[r(c).alias(c) for c in ("nominal", "mean", "sd", "low", "high")], "n")


@query
def mixture_assays(spark, d):
    """Pairs of typical compounds at one share of doses each, through the order graph, against Bliss independence."""
    edges, nodes, drive = order_graph(spark, d)
    e = typical_evidence(spark, d)
    grid = spark.createDataFrame([(f"{a}+{b}@{x}", c, v) for a, b in PAIRS for x, v in MIXED_DOSES for c in (a, b)], "mixture string, compound string, conc_m double")
    out = N.mixture_assay(edges, nodes, drive, e.join(F.broadcast(grid), "compound"), steps=10)
    single = lambda i: r(F.col("singles")[i]["effect"]).alias(f"effect_{i + 1}")
    return out.select("mixture", single(0), single(1), r("observed").alias("observed"), r("expected").alias("expected"), r("delta").alias("delta"), "shared_receptors", "verdict")


@query
def network_isoboles(spark, d):
    """Doses of two typical compounds that displace a tenth of the order graph's activity together, and their index against each alone."""
    edges, nodes, drive = order_graph(spark, d)
    pairs = spark.createDataFrame(list(PAIRS), "a string, b string")
    out = N.network_isobole(edges, nodes, drive, typical_evidence(spark, d), pairs, 0.1, steps=10)
    return out.select("a", "b", "fraction", r(F.col("dose_a") * 1e9).alias("dose_a_nm"), r(F.col("dose_b") * 1e9).alias("dose_b_nm"), r("index").alias("index"))


@query
def expression_rates(spark, d):
    """Rates of every node of the order graph where gains act in full, and where they act as far as the target's class has the receptor."""
    edges, nodes, drive = order_graph(spark, d)
    out = N.expression_assay(edges, nodes, drive, X.expression_levels(spark, d), {**TREATED, "g_glu": 1.5, "g_oct": 1.3}, steps=10)
    return out.select("body_id", *[r(c).alias(c) for c in ("vehicle", "uniform", "weighted", "delta")])


@query
def expression_coverage(spark, d):
    edges, nodes, _ = order_graph(spark, d)
    return N.expression_coverage(edges, nodes, X.expression_levels(spark, d)).select("receptor", "nodes", "known", r("node_share").alias("node_share"), r("weight_share").alias("weight_share"))


@query
def composition_reference(spark, d):
    """Is the census's agreement with the network special to the library? Rank correlations over drawn gain vectors, and where the library's own stands among them."""
    edges, nodes, drive = order_graph(spark, d)
    motor = nodes.filter("superclass = 'motor'").select("body_id")
    out = N.composition_reference(edges, nodes, drive, motor, cells(spark, d, 1e-8, 1e-7, 1e-6, 1e-5), 5, steps=10)
    return out.select("kind", "draw", "n", r("rho").alias("rho"), r("percentile").alias("percentile"))


#: Predicates over the read-outs of one specification, and the compound whose test each topology conclusion rests on.
CONCLUSIONS = {
    "agonist_lowers": "effect_agonist < 0",
    "antagonist_lowers": "effect_antagonist < 0",
    "agonist_beats_antagonist": "abs(effect_agonist) > abs(effect_antagonist)",
    "agonist_needs_wiring": "p_agonist <= 0.1",
    "inhibitor_within_nulls": "p_inhibitor > 0.1 and abs(effect_inhibitor - median_inhibitor) < 0.05 * vehicle",
    "agonist_desensitises": "falling_agonist > 0",
}
RESTS_ON = {"agonist_needs_wiring": "agonist", "inhibitor_within_nulls": "inhibitor"}


def spec_readouts(spark, d):
    """One row a specification: effects of typical compounds on motor nodes, their permutation p against dealt weights, and null medians; long and wide."""
    edges, nodes, drive = order_graph(spark, d)
    engaged = typical_evidence(spark, d).withColumn("conc_m", F.lit(1e-6)).withColumn("engagement", pharm.hill(F.col("conc_m"), F.col("value_m"), F.col("n")))
    specs = spark.createDataFrame([(f"{s}@{c:g}", s, c) for s in pharm.SHAPES for c in pharm.COEFFICIENTS], "spec string, shape string, coef double")
    own = E.spec_gains(engaged, specs).select("compound", "spec", F.col("g_ach").alias("own"))
    arms = E.gains(engaged).crossJoin(F.broadcast(specs.select("spec"))).join(own, ["compound", "spec"], "left").withColumn("g_ach", F.coalesce("own", "g_ach"))
    arms = cut(arms.select(F.concat_ws("|", "spec", "compound").alias("arm"), *dims.GAINS))
    motor = nodes.filter("superclass = 'motor'").select("body_id")
    real = cut(effects(edges, nodes, arms, drive, motor, steps=10))
    null = effects(G.weight_nulls(edges, 9, within=()), G.drawn(nodes.select("body_id", "nt"), 9), arms, drive, motor, by=("draw",), steps=10)
    tested = S.permutation(null.select(F.col("arm").alias("cell"), "effect").join(real.select(F.col("arm").alias("cell"), F.col("effect").alias("real")), "cell"))
    rows = tested.join(real.select(F.col("arm").alias("cell"), "vehicle"), "cell").join(arms.select(F.col("arm").alias("cell"), "g_ach"), "cell")
    long = cut(rows.select(F.substring_index("cell", "|", 1).alias("spec"), F.substring_index("cell", "|", -1).alias("compound"), "real", "p", "null_median", "vehicle", "g_ach"))
    of = lambda column, compound: F.max(F.when(F.col("compound") == compound, F.col(column)))
    wide = long.groupBy("spec").agg(F.max("vehicle").alias("vehicle"), *[of(c, k).alias(f"{n}_{k}") for k in ("agonist", "antagonist", "inhibitor") for n, c in (("effect", "real"), ("p", "p"), ("median", "null_median"))], F.when(of("g_ach", "agonist") > 0.05, 1 - of("g_ach", "agonist")).alias("falling_agonist"))
    return long, wide


@query
def conclusion_stability(spark, d):
    """Every conclusion under all 25 specifications: how many retain it, lose it or can't tell, and which lose it."""
    _, wide = spec_readouts(spark, d)
    out = C.stability(C.decide(wide, CONCLUSIONS))
    return out.select("conclusion", "n", "retained", "lost", "undecidable", r("share").alias("share"), r("share_decidable").alias("share_decidable"), F.array_join("failing", ",").alias("failing"), "fragile")


@query
def conclusion_breakdown(spark, d):
    """Verdicts of the tests behind the conclusions about wiring, and how many specifications of each verdict retain them."""
    long, wide = spec_readouts(spark, d)
    on = spark.createDataFrame(list(RESTS_ON.items()), "conclusion string, compound string")
    label = S.verdict(F.col("real"), F.col("null_median"), F.col("p"), 0.05 * F.abs("vehicle"), 0.1)
    labels = long.join(F.broadcast(on), "compound").select("conclusion", "spec", label.alias("label"))
    return C.breakdown(C.decide(wide, CONCLUSIONS), labels)


@query
def index_intervals(spark, d):
    """Sobol indices of seven factors over line items, with bootstrap intervals and what the sample resolves; factor 7 is the control."""
    li = X.table(spark, d, "lineitem")
    rows = li.select(F.col("l_linenumber").cast("int").alias("factor"), "l_orderkey", "l_partkey", F.col("l_extendedprice").alias("a"), (1500 * F.col("l_quantity")).alias("b"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("ab"))
    out = S.jansen_bootstrap(rows, "factor", ("l_orderkey", "l_partkey"), 20, null="7")
    return out.select("factor", *[r(c).alias(c) for c in ("first", "total", "first_low", "first_high", "total_low", "total_high")], "state")


#: Cuts of the ladder, and the seconds that its draws may take.
BUDGETS, LADDER_S = (60, 120, 240), 0.5


def order_ladder(spark, d):
    """The order graph's ladder, grown from its three nodes of most outgoing weight."""
    edges, nodes, _ = order_graph(spark, d)
    hubs = cut(edges.groupBy(F.col("pre").alias("body_id")).agg(F.sum("weight").alias("w")).join(nodes.select("body_id"), "body_id", "left_semi").orderBy(F.desc(r("w")), "body_id").limit(3))
    return N.ladder(edges, hubs.select("body_id"), 3, BUDGETS), nodes, hubs.select("body_id", F.lit(40.0).alias("hz"))


@query
def ladder_rungs(spark, d):
    """Nodes and edges that each rung adds, and the weight between them."""
    (nodes, edges), _, _ = order_ladder(spark, d)
    e = edges.groupBy("rung").agg(F.count("*").alias("edges"), r(F.sum("weight")).alias("weight"))
    return nodes.groupBy("rung").agg(F.count("*").alias("nodes"), F.max("ring").alias("ring"), F.sum("body_id").alias("ids")).join(e, "rung", "left")


@query
def profile_over_scale(spark, d):
    """Effect, draws and permutation p of each cut of the ladder."""
    cuts, nodes, drive = order_ladder(spark, d)
    out = N.profile_over_scale(cuts, nodes, drive, {"g_ach": 0.4, "g_gaba": 0.7}, BUDGETS, LADDER_S, most=15, steps=10)
    return out.select("budget", "n_nodes", "n_edges", r("weight").alias("weight"), "draws", r("real").alias("real"), r("vehicle").alias("vehicle"), r("null_median").alias("null_median"), r("p", 9).alias("p"))


@query
def stable_digests(spark, d):
    """Digests of every customer's artifact, written twice with other run times and another order of keys; the two agree."""
    c = X.table(spark, d, "customer")
    first = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_acctbal").alias("runtime_s"), F.lit("a").alias("state")).alias("run"), F.array("c_mktsegment", F.lit("x")).alias("tags")))
    again = F.to_json(F.struct(F.array("c_mktsegment", F.lit("x")).alias("tags"), F.struct(F.lit("a").alias("state"), F.lit(0.5).alias("runtime_s")).alias("run"), F.lit("2020-01-01").alias("created_at"), F.col("c_custkey").alias("id")))
    both = c.select("c_custkey", F.explode(F.array(F.struct(F.lit(0).alias("run"), first.alias("json")), F.struct(F.lit(1).alias("run"), again.alias("json")))).alias("x"))
    out = K.stable_digests(both.select(F.concat_ws("|", "c_custkey", "x.run").alias("of"), "x.json"), "of", "json")
    by = out.groupBy(F.substring_index("of", "|", 1).cast("long").alias("c_custkey"))
    return by.agg(F.min("digest").alias("digest"), (F.min("digest") == F.max("digest")).alias("agree"))


@query
def order_rates(spark, d):
    """Mean and largest rate of each class of the order graph, at vehicle and under treatment, after 80 steps."""
    edges, nodes, drive = order_graph(spark, d)
    hz = G.rates(edges, nodes, drive, {"vehicle": {}, "treated": TREATED}).join(nodes.select("body_id", "superclass"), "body_id")
    return hz.groupBy("superclass", "arm").agg(F.count("*").alias("n"), r(F.avg("hz")).alias("mean_hz"), r(F.max("hz")).alias("max_hz"))


#: Hypotheses on typical compounds: name, compound, dose, contrast, read-out, the read-out taken off, predicted direction and endpoint.
HYPOTHESES = (
    ("h1", "antagonist", 1e-6, H.GAP, "engagement", None, "increase", "continuous"),
    ("h2", "agonist", 1e-6, H.VEHICLE, "mean_hz", None, "decrease", "per"),
    ("h3", "antagonist", 1e-6, H.VEHICLE, "mean_hz", None, "increase", "continuous"),
    ("h4", "inhibitor", 1e-6, H.VEHICLE, "visual_hz", None, "none", "per"),
    ("h5", None, 0.0, H.WITHIN, "motor_hz", "visual_hz", "decrease", "per"),
    ("h6", "agonist", 1e-6, H.WITHIN, "motor_hz", "visual_hz", "increase", "continuous"),
    ("h7", "unlisted", 1e-6, H.VEHICLE, "mean_hz", None, "decrease", "per"),
)


@query
def predictions(spark, d):
    """Hypotheses on typical compounds over six paired replicates on the order graph: effect, interval, direction held against the predicted one, and a group size to plan with."""
    edges, nodes, drive = order_graph(spark, d)
    hypotheses = spark.createDataFrame(list(HYPOTHESES), H.HYPOTHESIS)
    sets = nodes.filter("superclass in ('motor', 'visual')").select(F.concat("superclass", F.lit("_hz")).alias("readout"), "body_id")
    out = H.predict(hypotheses, H.effects(edges, nodes, typical_evidence(spark, d), hypotheses, drive, sets, draws=6, steps=10))
    numbers = [r(c).alias(c) for c in ("effect", "sd", "low", "high", "treated", "other", "relative")]
    return out.select("h", "n", *numbers, r("d", 4).alias("d"), "observed", "matches", "per_group")


def order_claims(spark, d):
    """Published orders of up to six parts: ranks, values or directions, with what else an entry says."""
    price = X.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.avg("l_extendedprice"), 2).alias("price"))
    p = X.evidence(spark, d).join(X.table(spark, d, "part").select("p_partkey", "p_size"), F.col("pos") == F.col("p_partkey")).join(price, F.col("pos") == F.col("l_partkey"), "left")
    entry, even = F.floor(F.col("pos") / 6).cast("long"), F.col("p_size") % 2 == 0
    directed = entry % 7 == 0
    return cut(p.select(
        entry.alias("entry"), "pos", "compound", F.when(entry % 5 != 0, F.col("receptor")).alias("target"), F.when((entry % 4 == 1) & ~directed, F.col("p_size") % 3 + 1).cast("double").alias("rank"),
        F.when((F.col("p_size") % 11 != 0) & ~directed, F.col("price")).alias("value"), F.when(even, "no effect").otherwise("full").alias("efficacy"),
        F.when(directed, F.when(even, "insect-selective").otherwise("Vertebrate-selective")).otherwise("").alias("direction"), F.when(entry % 3 == 0, "resistance ratio").otherwise("EC50").alias("readout"),
        F.when(entry % 2 == 0, "Drosophila melanogaster").otherwise("Rattus norvegicus").alias("species"), F.when(entry % 10 == 0, "RDL currents").otherwise("currents").alias("assay")))


def validated_claims(spark, d):
    claims = order_claims(spark, d)
    return V.validate(V.occupancy_scores(V.published(claims), X.evidence(spark, d), engaged(spark, d)))


@query
def published_orders(spark, d):
    """Every published order against engagement at its receptor: where the order comes from, why it is skipped, and agreement."""
    return validated_claims(spark, d).select("entry", "n", "order_source", "skipped", r("rho").alias("rho"), r("tau").alias("tau"), "exact")


@query
def claimed_receptors(spark, d):
    """The receptor that each published order speaks of."""
    return V.receptors(order_claims(spark, d), X.evidence(spark, d))


@query
def validation_summary(spark, d):
    out = V.summary(validated_claims(spark, d).withColumn("assay", F.lit("occupancy")))
    return out.select("assay", "entries", "evaluated", "skipped", "exact", r("mean_rho").alias("mean_rho"))
