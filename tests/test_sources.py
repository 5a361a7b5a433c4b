import json

import pytest
from pyspark.sql import functions as F

from gainflow.functions import dims, pharm
from gainflow.operators import designs as D
from gainflow.operators import engagement as E
from gainflow.operators import graph as G
from gainflow.operators import stats as S
from gainflow.sources import library as L
from gainflow.sources import sinks

LIBRARY = """
receptors: {insect_nAChR: {organism: insect, transmitter: acetylcholine, family: ion channel, note: x}}
selectivity_pairs: {nAChR: {insect: insect_nAChR, vertebrate: vertebrate_nAChR}}
compounds:
  one:
    name: One
    class: c
    cas: 1-1
    receptors:
      insect_nAChR: {param_type: EC50, value_M: 2.0e-8, n: 1.2, direction: agonist, relation: exact_compound_related_receptor}
      insect_RDL: {value_M: null}
      vertebrate_nAChR: {value_M: 5.0e-6, ec50_M: 1.0e-6, direction: agonist}
"""
ALLELES = """
alleles:
  - {id: a, assay_type: r, use_as_ec50_shift: true, source: s, shifts: [{compound: one, fold: 3}, {compound: one, per_allele_fold: {X: 2, Y: bad}}, {compound: both of them, per_compound_fold: {one: 4, two: 5}}, {compound: "combination allele VAYA (both)", per_compound_fold: {one: 7}}, {compound: one, fold_Z: 6, fold_with_PBO: 9}]}
  - {id: b}
"""


def test_library(spark, tmp_path):
    (tmp_path / "l.yaml").write_text(LIBRARY)
    e = L.evidence(spark, f"file://{tmp_path}/l.yaml")
    rows = {r.receptor: r for r in e.collect()}
    assert rows["vertebrate_nAChR"].value_m == 1e-6 and rows["vertebrate_nAChR"].param_type == "EC50" and rows["vertebrate_nAChR"].relation == "class_extrapolation"
    assert rows["insect_RDL"].value_m is None and rows["insect_RDL"].param_type == "unknown" and rows["insect_RDL"].relation == "unsupported"
    en = {r.receptor: r for r in E.engage(e, spark.createDataFrame([(1e-6,)], "conc_m double")).collect()}
    assert en["insect_RDL"].engagement is None and abs(en["insect_nAChR"].engagement - 0.9909367919777582) < 1e-12 and en["insect_nAChR"].model == "functional_engagement_proxy"
    g = E.gains(E.engage(e, spark.createDataFrame([(0.0,), (1e-6,)], "conc_m double"))).orderBy("conc_m").collect()
    assert g[0].g_ach == 1.0 and g[1].g_ach == pharm.FLOOR and g[1].g_gaba == 1.0
    assert L.compound(e, " ONE ").count() == 3 and {k: v.count() for k, v in L.dimensions(spark, f"{tmp_path}/l.yaml").items()} == {"receptor": 1, "pair": 1, "compound": 1}
    with pytest.raises(KeyError):
        L.compound(e, "two")


def test_gain_golden(spark):
    g = spark.range(1).select(pharm.biphasic(F.lit(0.8545051332184401)).alias("g")).first().g
    assert abs(g - 0.17351561697271345) < 1e-12


def test_alleles_and_baseline(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(ALLELES)
    rows = {(r.variant, r.compound): r for r in L.shifts(spark, f"{tmp_path}/a.yaml").collect()}
    assert {k: r.fold for k, r in rows.items()} == {(None, "one"): 3, ("X", "one"): 2, ("Y", "one"): None, ("both_of_them", "one"): 4, ("both_of_them", "two"): 5, ("VAYA", "one"): 7, ("Z", "one"): 6}
    assert rows["X", "one"].genotype == "a:X" and rows[None, "one"].genotype == "a" and rows["Z", "one"].assay_type == "r"
    assert rows["X", "one"].use_as_ec50_shift and {r.genotype: (r.shifts, r.usable) for r in L.genotypes(L.shifts(spark, f"{tmp_path}/a.yaml")).collect()}["a:Y"] == (1, 0)
    assert L.baseline(spark, {"per": [{"n": 5, "response_rate": 75}, {"rate": 0.5}]}) == 0.75 and L.baseline(spark, {"other": {"rate": 0.3}}) == 0.8 and L.baseline(spark, {}) == 0.8


def test_graph_and_census(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"map": "m", "seeds": {"t": [1]}, "nodes": [{"bodyId": 1, "type": "tA", "superclass": None, "consensus_nt": "gaba"}, {"bodyId": 2, "type": "tB", "superclass": "s", "consensus_nt": "acetylcholine"}], "edges": [{"pre": 1, "post": 2, "weight": 3.0}, {"pre": 9, "post": 2, "weight": 1.0}]}))
    g = L.graph(spark, f"{tmp_path}/g.json")
    assert G.labelled(g["edges"], g["nodes"]).count() == 1 and g["seeds"].collect() == [("t", 1)]
    types = spark.createDataFrame([("tA",), ("t",)], "type string")
    assert sorted(map(tuple, L.seed_ids(g["nodes"], types).collect())) == [("t", 1), ("t", 2), ("tA", 1)]
    (tmp_path / "c.json").write_text(json.dumps({"neurotransmitter_counts": {"acetylcholine": 60, "gaba": 20, "glutamate": 20}}))
    r = G.settle(L.census(spark, f"{tmp_path}/c.json"), {}, 0.3, 0.7).first()
    assert abs(r.excitation - (24 + 0.3 * 8 - 1.1 * 8)) < 1e-9 and abs(r.inhibition - (8 + 0.7 * 8)) < 1e-9
    assert G.settle(spark.createDataFrame([("acetylcholine", 5)], "nt string, cells long"), {}, 0.3, 0.7).first().ratio is None


def test_two_node_fixed_point(spark):
    nodes = spark.createDataFrame([(1, "acetylcholine"), (2, "gaba")], "body_id long, nt string")
    edges = spark.createDataFrame([(1, 2, 2.0), (1, 2, 2.0), (7, 2, 9.0)], "pre long, post long, weight double")  # parallel edges add up, a dangling one goes
    r = {x.body_id: x.hz for x in G.rates(edges, nodes, spark.createDataFrame([(1, 10.0)], "body_id long, hz double"), {"treated": {"g_ach": 0.5}}, steps=40).collect()}
    assert abs(r[1] - 10) < 1e-4 and abs(r[2] - 5) < 1e-3


def test_matrix(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("GENE\tc1\tc2\tc3\nnA\t1\t0\t5\nmt:x\t0\t9\t1\nB\t2\t1\t0\n")
    cell, gene = L.expression_matrix(spark, f"{tmp_path}/m.tsv", genes_above=1, mito_upto=0.5)
    assert {r.cell: (r.umis, r.genes, r.mito, r.kept) for r in cell.collect()} == {"c1": (3, 2, 0, True), "c2": (10, 2, 9, False), "c3": (6, 2, 1, True)}
    assert {r.gene: r.fraction for r in gene.collect()} == {"nA": 1.0, "mt:x": 0.5, "B": 0.5}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", None, 2.0), ("a", 1, None)], "k string, n int, x double")
    out = f"file://{tmp_path}/run"
    sinks.write_rows(df, f"{out}/rows", ["k", "x", "n"], ["k"])
    sinks.write_runs(df, f"{out}/json", ["k"])
    a = sinks.artifacts(spark, out).filter("path not like '%crc'").cache()
    assert a.count() >= 3 and len(sinks.digest(a)) == 64
    changed = a.withColumn("sha256", F.when(F.col("path").startswith("rows/part"), "x").otherwise(F.col("sha256")))
    assert {r.state for r in sinks.compare(a, changed).collect()} == {"same", "changed"} and sinks.digest(a) != sinks.digest(changed)


def test_designs(spark):
    d = D.Design.of({"design": {"compound": ["one", "one"], "doses": [1e-6, 1e-5], "replicates": 2, "jitter_log10": 0.1}})
    g = d.grid(spark)
    assert g.count() == 6 and d.compounds == ("one",) and len(d.fingerprint()) == 64
    assert sorted(map(tuple, g.collect())) == sorted(map(tuple, g.repartition(5).collect()))
    for bad in ({"compounds": [], "concentrations": [1]}, {"compounds": "a", "concentrations": [-1]}, {"compounds": "a", "concentrations": [1], "wrong": 1}):
        with pytest.raises(ValueError):
            D.Design.of(bad)
    e = spark.createDataFrame([(0, "one", "insect_nAChR", "EC50", "class_extrapolation", 1e-6, 1.0, "antagonist")], "pos long, compound string, receptor string, param_type string, relation string, value_m double, n double, direction string")
    out = D.run(D.Design(("one", "none"), (1e-6,)), e).orderBy("compound", "conc_m").collect()
    assert [r.g_ach for r in out] == [None, None, 1.0, 0.5]


def test_sobol_and_samples(spark):
    s = D.saltelli(spark, 600, ["a", "b", "c"])
    x = F.col("x")
    got = {r.factor: r for r in D.sobol(s, 4 * x["a"] + 2 * x["b"]).collect()}
    assert abs(got["a"].first - 0.8) < 0.08 and abs(got["b"].total - 0.2) < 0.05 and abs(got["c"].total) < 1e-9
    v = D.information_value(D.sobol(s, 4 * x["a"] + 2 * x["b"]), 2.0).orderBy("rank").collect()
    assert [r.factor for r in v] == ["a", "b", "c"]
    n = spark.range(1).select(*[D.two_proportions(F.lit(0.8), F.lit(p)).alias(f"p{i}") for i, p in enumerate((0.8, 0.4))], *[D.two_means(F.lit(d)).alias(f"d{i}") for i, d in enumerate((0.0, 5.0))]).first()
    assert tuple(n) == (None, 23, None, 16)


def test_expression(spark):
    nodes = spark.createDataFrame([(1, "s"), (2, "t"), (3, None)], "body_id long, superclass string")
    levels = spark.createDataFrame([("s", "nAChRa1", "high"), ("s", "nachrb", "low"), ("s", "Rdl", "absent"), ("t", "nAChRa1", "unknown")], "superclass string, gene string, level string")
    got = {r.body_id: r.weight for r in D.expression_weights(nodes, levels, "nAChR").collect()}
    assert got == {1: 0.625, 2: 1.0, 3: 1.0}


def test_bh_ties_nulls_and_ranks(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.02), (4, None), (5, 0.9)], "i long, p double")
    got = {r.i: (r.q, r.rejected, r.m) for r in S.benjamini_hochberg(df).collect()}
    assert abs(got[1][0] - 0.02666666) < 1e-6 and abs(got[3][0] - 0.02666666) < 1e-6 and got[4] == (None, False, 4) and got[5][0] == 0.9
    ranks = {r.i: r["rank"] for r in S.average_rank(df, "p").collect()}
    assert ranks == {1: 1.0, 2: 2.5, 3: 2.5, 4: None, 5: 4.0}
    assert S.benjamini_hochberg(df.limit(0)).count() == 0


def test_published_tables(spark, tmp_path):
    (tmp_path / "e.yaml").write_text("by_superclass:\n  - {superclass: s, receptors: {Rdl: {level: High, fraction_cells_expressing: 0.5}, Ace: {level: null}}}\n")
    assert sorted(map(str, L.expression(spark, f"{tmp_path}/e.yaml").select("gene", "level", "fraction").collect())) == sorted(["Row(gene='Rdl', level='high', fraction=0.5)", "Row(gene='Ace', level='unknown', fraction=None)"])
    assert L.expression(spark, f"{tmp_path}/none.yaml").count() == 0
    (tmp_path / "r.yaml").write_text("entries:\n  - {id: a, units: ppm, ordered_compounds: [{compound: x, value: 0.1, rank: 1}, {compound: y, value: 2, rank: 2}, {compound: z, value: null, rank: 3}, {compound: w, rank: null}]}\n  - {id: b, ordered_compounds: [{compound: q, rank: 1}]}\n")
    orders = L.rank_orders(spark, f"{tmp_path}/r.yaml")
    assert [tuple(r) for r in orders.filter("entry = 'a'").orderBy("pos").select("compound", "value", "rank").collect()] == [("x", 0.1, 1.0), ("y", 2.0, 2.0), ("z", None, 3.0), ("w", None, None)]
    scores = spark.createDataFrame([("x", 3.0), ("y", 1.0), ("z", 2.0), ("w", 9.0)], "compound string, score double")
    got = {r.entry: tuple(r)[1:] for r in S.rank_agreement(orders, scores).collect()}
    assert got == {"a": (3, 2, 1, 1.0), "b": (None, None, None, None)}
    (tmp_path / "m.yaml").write_text("empirical:\n  - {id: h, species: bee, results: [{partner: p, classification: additive}]}\n")
    assert [tuple(r) for r in L.published_mixtures(spark, f"{tmp_path}/m.yaml").select("entry", "partner", "classification").collect()] == [("h", "p", "additive")]


def test_weight_floor_reaches_the_scan(spark):
    from gainflow.plans.analyses import QUERIES

    plan = QUERIES["edge_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_quantity,30.0)" in plan.split("PushedFilters", 1)[1]


def test_landscape_with_rewired_graphs(spark):
    from gainflow.plans import analyses as A

    sf = "/root/testdata/sf0.001"
    e, n = A.heavy_graph(spark, sf)
    arms = G.arm_table(spark, {"none": {}, "block": {"g_ach": 0.3}})
    rows = A.landscape(e, n, arms, A.seeds(n).withColumn("hz", F.lit(40.0)), A.motor(n), ("rewire", "sign_permute"), 4, 0.3).collect()
    assert {(r.arm, r["mode"]) for r in rows} == {(a, m) for a in ("none", "block") for m in ("rewire", "sign_permute")}
    assert {r["class"] for r in rows if r.arm == "none"} == {"no-effect"} and all(r.real != 0 for r in rows if r.arm == "block")
    assert all((r.q is None) == (r["mode"] == "sign_permute") for r in rows)


def test_dense_blocks_of_nulls(spark):
    e = spark.createDataFrame([(i, (i * 7 + k) % 40, float(1 + (i + k) % 9)) for i in range(40) for k in range(1, 4) if (i * 7 + k) % 40 != i], "pre long, post long, weight double")
    n = spark.createDataFrame([(i, ["gaba", "acetylcholine", None][i % 3]) for i in range(40)], "body_id long, nt string")
    er = G.erdos_renyi(e, n, 2).collect()
    for k in (0, 1):
        own = [(r.pre, r.post) for r in er if r.draw == k]
        assert len(own) == len(set(own)) == e.count() and all(a != b for a, b in own)
    wm = G.weight_matched_nulls(e, n, 2, tolerance=0.05)
    out = {r.pre: r.w for r in e.groupBy("pre").agg(F.sum("weight").alias("w")).collect()}
    total = sum(out.values())
    real = {}
    for r in n.collect():
        real[r.nt] = real.get(r.nt, 0) + out.get(r.body_id, 0)
    for k in (0, 1):
        own = [r for r in wm.collect() if r.draw == k]
        assert sorted(str(r.nt) for r in own) == sorted(str(r.nt) for r in n.collect())
        assert all(abs(sum(out.get(r.body_id, 0) for r in own if r.nt == t) - real[t]) <= 0.05 * total + 1e-9 for t in real)


def test_rule_table():
    assert dims.model_of("Kd", "E0") == "binding_occupancy" and dims.model_of("Ki", "E3") == "functional_engagement_proxy" and dims.model_of("IC50", "E4") == "not_modelled" and dims.model_of("unknown", "E0") == "not_modelled"


def test_names_in_any_case(spark):
    rows = spark.createDataFrame([(" kd ", "E2"), (None, None), ("Relative_Potency", " Class_Extrapolation")], "t string, d string")
    got = [tuple(r) for r in rows.select(dims.param_type(F.col("t")), dims.distance(F.col("d"))).collect()]
    assert got == [("Kd", "E2"), ("unknown", "E4"), ("relative_potency", "E3")]
    with pytest.raises(Exception, match="known: Kd"):
        spark.createDataFrame([("Kx",)], "t string").select(dims.param_type(F.col("t"))).collect()
    flags = spark.createDataFrame([(1.0, "Kd", "measured_fit", "agonist"), (None, "Kd", "measured_fit", "agonist"), (1.0, "unknown", None, "none")], "v double, t string, tier string, d string")
    got = [tuple(r) for r in flags.select(pharm.is_placeholder(F.col("v"), F.col("t"), F.col("tier")), pharm.is_estimate(F.col("v"), F.col("d"), F.col("tier"))).collect()]
    assert got == [(False, True), (True, False), (True, False)]
