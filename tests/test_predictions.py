"""Predictions and published orders, against plain Python and written-out cases."""

import itertools
import math

import pytest

from gainflow.operators import predictions as H
from gainflow.operators import validation as V

ITEM = "entry string, pos int, compound string, target string, rank double, value double, efficacy string, direction string, readout string, species string, assay string"


def items(spark, entries):
    """``entries``: name -> (list of (compound, rank, value, efficacy, direction), readout, species, assay)."""
    rows = [(e, i, c, None, *x, readout, species, assay) for e, (listed, readout, species, assay) in entries.items() for i, (c, *x) in enumerate(listed)]
    return spark.createDataFrame(rows, ITEM)


ENTRIES = {
    "ranked": ([("a", 2.0, None, "", ""), ("b", 1.0, None, "", "")], "EC50", "Drosophila", "binding"),
    "tied": ([("a", 1.0, None, "", ""), ("b", 1.0, None, "", "")], "EC50", "", ""),
    "valued": ([("a", None, 5.0, "", ""), ("b", None, 5.0, "", ""), ("c", None, 1.0, "", ""), ("d", None, None, "No effect at 1 mM", "")], "EC50", "Rattus norvegicus", "alpha4beta2 currents"),
    "falling": ([("a", None, 5.0, "", ""), ("b", 1.0, 9.0, "", ""), ("c", None, None, "inactive", "")], "Resistance ratio", "", ""),
    "untold": ([("a", None, 5.0, "", ""), ("b", None, 9.0, "", ""), ("c", None, None, "full", "")], "EC50", "", ""),
    "directed": ([("a", None, None, "", "insect"), ("b", None, None, "", "Vertebrate selective")], "", "", ""),
    "single": ([("a", 1.0, 1.0, "", "")], "", "", ""),
    "null": ([(None, None, None, None, None), (None, None, None, None, None)], None, None, None),
}


def test_published_ranks_and_where_they_come_from(spark):
    got = {(r.entry, r.pos): (r.order_source, r.published) for r in V.published(items(spark, ENTRIES)).collect()}
    want = {
        "ranked": ("published_rank", [2, 1]), "tied": ("tied", [None] * 2), "valued": ("published_value", [2.5, 2.5, 1, 4]), "falling": ("published_value", [2, 1, 3]),
        "untold": ("none", [None] * 3), "directed": ("direction_selectivity", [1, 2]), "single": ("few", [None]), "null": ("none", [None] * 2)}
    assert got == {(e, i): (source, x) for e, (source, ranks) in want.items() for i, x in enumerate(ranks)}
    assert V.published(items(spark, ENTRIES).limit(0)).count() == 0


EVIDENCE = [
    ("a", "insect_nAChR", "agonist", 1e-7), ("b", "insect_nAChR", "agonist", 1e-6), ("a", "vertebrate_nAChR_a4b2", "agonist", 1e-5), ("b", "vertebrate_nAChR_a4b2", "none", None),
    ("a", "insect_RDL", "antagonist", 1e-9), ("b", "insect_RDL", "antagonist", None), ("c", "vertebrate_GlyR", "none", 1e-9)]


@pytest.mark.parametrize(("species", "assay", "readout", "want"), [
    ("Drosophila melanogaster", "", "", "insect_nAChR"),  # two active compounds
    ("Rattus norvegicus", "", "", "vertebrate_nAChR_a4b2"),
    ("human", "insect cells", "", "insect_nAChR"),  # speaks of both, so of neither
    ("", "", "RDL block", "insect_RDL"),  # named, and two compounds have rows there
    ("", "glycine currents", "", "insect_nAChR"),  # named, but one compound only
])
def test_receptor_of_an_entry(spark, species, assay, readout, want):
    rows = items(spark, {"e": ([("a", 1.0, None, "", ""), ("b", 2.0, None, "", ""), ("c", 3.0, None, "", "")], readout, species, assay)})
    evidence = spark.createDataFrame(EVIDENCE, "compound string, receptor string, direction string, value_m double")
    assert [tuple(r) for r in V.receptors(rows, evidence).collect()] == [("e", want)]
    assert [tuple(r) for r in V.receptors(rows, evidence.filter("direction = 'none'")).collect()] == [("e", None)]


def test_agreement_and_reasons_to_skip(spark):
    scores = {"up": [3.0, 2.0, 1.0], "down": [1.0, 2.0, 3.0], "ties": [2.0, 2.0, 1.0], "same": [1.0, 1.0, 1.0], "lacks": [1.0, None, 2.0], "nan": [1.0, float("nan"), 2.0]}
    rows = [(e, i, float(i + 1), "published_rank", x) for e, xs in scores.items() for i, x in enumerate(xs)] + [("none", 0, None, "none", 1.0), ("none", 1, None, "none", 2.0)]
    out = V.validate(spark.createDataFrame(rows, "entry string, pos int, published double, order_source string, score double"))
    got = {r.entry: r for r in out.collect()}
    assert {e: r.skipped for e, r in got.items()} == {"up": None, "down": None, "ties": None, "same": "same_scores", "lacks": "no_score", "nan": "no_score", "none": "no_order"}
    for e in ("up", "down", "ties"):
        xs = scores[e]
        pairs = [(1, (xs[i] > xs[j]) - (xs[i] < xs[j])) for i, j in itertools.combinations(range(3), 2)]
        tau = sum(a * b for a, b in pairs) / math.sqrt(3 * sum(b * b for _, b in pairs))
        assert math.isclose(got[e].tau, tau, abs_tol=1e-9)
    assert (round(got["up"].rho, 9), round(got["down"].rho, 9), round(got["ties"].rho, 6)) == (1.0, -1.0, 0.866025)
    assert got["up"].exact and not got["ties"].exact and got["same"].rho is None
    s = V.summary(out.selectExpr("*", "'x' as assay")).first()
    assert (s.entries, s.evaluated, s.skipped, s.exact) == (7, 3, 4, 1) and math.isclose(s.mean_rho, 0.866025 / 3, abs_tol=1e-6)


def test_predictions(spark):
    nodes = spark.createDataFrame([(1, "acetylcholine"), (2, "gaba"), (3, "acetylcholine")], "body_id long, nt string")
    edges = spark.createDataFrame([(1, 2, 4.0), (1, 3, 4.0), (2, 3, 2.0)], "pre long, post long, weight double")
    driven, sets = nodes.filter("body_id = 1").select("body_id"), spark.createDataFrame([("end_hz", 3), ("mid_hz", 2)], "readout string, body_id long")
    evidence = spark.createDataFrame(
        [("block", "insect_nAChR", "antagonist", 0, 1e-7, 1.0), ("block", "vertebrate_nAChR", "antagonist", 1, 1e-4, 1.0), ("idle", "insect_RDL", "antagonist", 0, None, 1.0)],
        "compound string, receptor string, direction string, pos int, value_m double, n double")
    asked = [
        ("gap", "block", 1e-6, H.GAP, "engagement", None, "increase", "continuous"), ("less", "block", 1e-6, H.VEHICLE, "mean_hz", None, "decrease", "per"), ("wrong", "block", 1e-6, H.VEHICLE, "end_hz", None, "increase", "continuous"),
        ("same", "idle", 1e-6, H.VEHICLE, "mean_hz", None, "none", "per"), ("within", None, 0.0, H.WITHIN, "mid_hz", "end_hz", "increase", "per"), ("unknown", "other", 1e-6, H.VEHICLE, "mean_hz", None, "decrease", "per"),
        ("nowhere", "block", 1e-6, H.VEHICLE, "no_such_hz", None, "decrease", "per")]
    hypotheses = spark.createDataFrame(asked, H.HYPOTHESIS)
    found = H.effects(edges, nodes, evidence, hypotheses, driven, sets, draws=5, steps=30).persist()
    got = {r.h: r for r in H.predict(hypotheses, found).collect()}
    assert set(got) == {x[0] for x in asked}
    assert {h: r.matches for h, r in got.items()} == {"gap": True, "less": True, "wrong": False, "same": True, "within": True, "unknown": False, "nowhere": False}
    assert {h: r.n for h, r in got.items()} == {"gap": 5, "less": 5, "wrong": 5, "same": 5, "within": 5, "unknown": 0, "nowhere": 0}
    assert got["unknown"].effect is None and got["unknown"].observed is None and got["unknown"].per_group is None
    # an arm that changes nothing has its vehicle's rates in every replicate, however the drive is jittered
    assert got["same"].effect == 0 and got["same"].d is None and got["same"].per_group is None
    for h, r in got.items():
        xs = [x.effect for x in found.filter(f"h = '{h}'").collect()]
        if not xs:
            continue
        mean = sum(xs) / len(xs)
        sd = math.sqrt(sum((x - mean) ** 2 for x in xs) / (len(xs) - 1))
        assert math.isclose(r.effect, mean, abs_tol=1e-9) and math.isclose(r.sd, sd, abs_tol=1e-9)
        assert math.isclose(r.high - r.low, 2 * 1.959963985 * sd / math.sqrt(len(xs)), abs_tol=1e-9)
    p2 = 0.8 * (1 - min(max(got["less"].relative, 0.05), 0.5))
    za, zb, q = 1.959963985, 0.841621234, (0.8 + p2) / 2
    assert got["less"].per_group == math.ceil((za * math.sqrt(2 * q * (1 - q)) + zb * math.sqrt(0.16 + p2 * (1 - p2))) ** 2 / (0.8 - p2) ** 2)
    assert got["wrong"].per_group == math.ceil(2 * (za + zb) ** 2 / min(abs(got["wrong"].d), 1.0) ** 2)
    assert len({x.other for x in found.filter("h = 'less'").collect()}) == 5


def test_no_hypotheses_and_no_nodes(spark):
    e, n = spark.createDataFrame([], "pre long, post long, weight double"), spark.createDataFrame([], "body_id long, nt string")
    evidence = spark.createDataFrame([], "compound string, receptor string, direction string, pos int, value_m double, n double")
    none = spark.createDataFrame([], H.HYPOTHESIS)
    sets = spark.createDataFrame([], "readout string, body_id long")
    assert H.predict(none, H.effects(e, n, evidence, none, n.select("body_id"), sets, draws=2, steps=3)).count() == 0
    one = spark.createDataFrame([("h", None, 0.0, H.WITHIN, "a", "b", "none", "per")], H.HYPOTHESIS)
    assert [(r.n, r.effect) for r in H.predict(one, H.effects(e, n, evidence, one, n.select("body_id"), sets, draws=2, steps=3)).collect()] == [(0, None)]
