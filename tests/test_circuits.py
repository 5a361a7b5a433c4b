"""Networks run whole or step by step, planted graphs, ensembles, mixtures, expression and grouped ranks, against plain Python."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from gainflow.functions import dims
from gainflow.operators import conclusions as C
from gainflow.operators import graph as G
from gainflow.operators import networks as N
from gainflow.operators import planted as P
from gainflow.operators import stats as S
from gainflow.sources.sinks import stable_digests

NT = ["acetylcholine", "gaba", "glutamate", "octopamine", "histamine", "unclear"]


@pytest.fixture(scope="module")
def net(spark):
    pick = random.Random(3)
    nodes = [(i, NT[i % 6], ["sensory", "central", "motor"][i % 3]) for i in range(30)]
    edges = {(pick.randrange(30), pick.randrange(30)): float(pick.randint(1, 9)) for _ in range(160)}
    e = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "pre long, post long, weight double")
    return e.persist(), spark.createDataFrame(nodes, "body_id long, nt string, superclass string").persist(), nodes, edges


def plain(nodes, edges, gains, drive, steps, level=None):
    """Rates by loops; ``level(post, nt)`` weighs a gain at its target."""
    g = {k: 1.0 for k in dims.GAINS} | gains
    nt = {i: t for i, t, _ in nodes}
    w = {k: x * dims.SIGN.get(nt[k[0]], 0.0) for k, x in edges.items()}
    scale = {i: max(1.0, sum(abs(x) for (_, b), x in w.items() if b == i)) for i in nt}
    gain = lambda t: g[dims.GAIN_OF[t]] * (g["ach_tone"] if t == "acetylcholine" else 1) if t in dims.GAIN_OF else 1.0
    r = dict.fromkeys(nt, 0.0)
    for _ in range(steps):
        x = {i: drive.get(i, 0.0) for i in nt}
        for (a, b), v in w.items():
            e = 1.0 if level is None else level(b, nt[a])
            x[b] += v / scale[b] * r[a] * (1 + (gain(nt[a]) - 1) * e)
        r = {i: min(300.0, max(0.0, 0.7 * r[i] + 0.3 * g["g_nav"] * x[i])) for i in nt}
    return r


ARMS = {"vehicle": {}, "a": {"g_ach": 0.4, "ach_tone": 1.2, "g_nav": 0.9}, "b": {"g_gaba": 0.3, "g_glu": 1.7, "g_oct": 2.0}}


@pytest.mark.parametrize("whole", [True, False])
def test_rates_whole_and_step_by_step(spark, net, monkeypatch, whole):
    e, n, nodes, edges = net
    monkeypatch.setattr(G, "WHOLE" if not whole else "CHUNK", 0 if not whole else 200)
    drive = n.filter("superclass = 'sensory'").selectExpr("body_id", "40.0 as hz")
    got = {(r["arm"], r["body_id"]): r["hz"] for r in G.rates(e, n, drive, ARMS, steps=12).collect()}
    for arm, gains in ARMS.items():
        want = plain(nodes, edges, gains, {i: 40.0 for i, _, c in nodes if c == "sensory"}, 12)
        assert all(math.isclose(got[arm, i], x, rel_tol=1e-9, abs_tol=1e-9) for i, x in want.items())


@pytest.mark.parametrize("chunk", [1, 50, 100])
def test_rates_where_parts_of_arms_are_uneven(spark, net, monkeypatch, chunk):
    e, n, nodes, edges = net
    monkeypatch.setattr(G, "CHUNK", chunk)
    arms = {f"arm {k}": {"g_ach": 0.1 * k} for k in range(9)}
    drive = spark.createDataFrame([(name, 0, 40.0 + k) for k, name in enumerate(arms)], "arm string, body_id long, hz double")
    got = {(r["arm"], r["body_id"]): r["hz"] for r in G.rates(e, n, drive, arms, steps=6).collect()}
    assert len(got) == 9 * 30
    for k, (arm, gains) in enumerate(arms.items()):
        assert all(math.isclose(got[arm, i], x, rel_tol=1e-9, abs_tol=1e-9) for i, x in plain(nodes, edges, gains, {0: 40.0 + k}, 6).items())
    assert G.rates(e, n, drive, G.arm_table(spark, arms).limit(0), steps=2).count() == 0


@pytest.mark.parametrize("whole", [True, False])
def test_readouts_are_summed_up_where_the_rates_are(spark, net, monkeypatch, whole):
    e, n, nodes, edges = net
    monkeypatch.setattr(G, "WHOLE" if not whole else "CHUNK", 0 if not whole else 20)
    drive, sets = spark.createDataFrame([(0, 40.0), (3, 20.0)], "body_id long, hz double"), n.selectExpr("superclass as readout", "body_id").filter("readout <> 'central'")
    got = {(r["arm"], r["readout"]): r for r in G.readouts(e, n, drive, ARMS, sets, "all", steps=8).collect()}
    assert len(got) == 3 * 3
    base = plain(nodes, edges, {}, {0: 40.0, 3: 20.0}, 8)
    for arm, gains in ARMS.items():
        want = plain(nodes, edges, gains, {0: 40.0, 3: 20.0}, 8)
        for name in ("sensory", "motor", "all"):
            ids = [i for i, _, c in nodes if name in (c, "all")]
            r, mean = got[arm, name], lambda f: sum(map(f, ids)) / len(ids)  # noqa: B023
            assert r["n"] == len(ids) and np.allclose([r["hz"], r["off"], r["vehicle"]], [mean(want.get), mean(lambda i: abs(want[i] - base[i])), mean(base.get)])  # noqa: B023


@pytest.mark.parametrize("whole", [True, False])
def test_gains_weighted_at_their_targets(spark, net, monkeypatch, whole):
    e, n, nodes, edges = net
    if not whole:
        monkeypatch.setattr(G, "WHOLE", 0)
    rows = [("sensory", "nAChR", 0.25), ("motor", "RDL", 0.0), ("central", "nAChR", 1.0)]
    levels = spark.createDataFrame(rows, "superclass string, receptor string, level double")
    drive = n.filter("superclass = 'sensory'").selectExpr("body_id", "40.0 as hz")
    known, of = {(c, r): x for c, r, x in rows}, {i: c for i, _, c in nodes}
    level = lambda b, nt: known.get((of[b], N.RECEPTOR_OF[nt]), 1.0) if nt in N.RECEPTOR_OF else 0.0
    start, gains = {i: 40.0 for i, _, c in nodes if c == "sensory"}, ARMS["b"] | ARMS["a"]
    got = {r["body_id"]: r for r in N.expression_assay(e, n, drive, levels, gains, steps=8).collect()}
    uniform, weighted = plain(nodes, edges, gains, start, 8), plain(nodes, edges, gains, start, 8, level)
    for i in uniform:
        assert math.isclose(got[i]["uniform"], uniform[i], abs_tol=1e-9) and math.isclose(got[i]["weighted"], weighted[i], abs_tol=1e-9)
    assert any(abs(r["delta"]) > 1e-3 for r in got.values())


def test_planted_loops(spark, net):
    e, n, _, _ = net
    edges, nodes, ring = P.planted(e, n, (0.0, 3.0), 4, size=5)
    m = e.count()
    sizes = {(r["strength"], r["replicate"]): r["n"] for r in edges.groupBy("strength", "replicate").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert len(sizes) == 8 and all(sizes[0.0, i] == m and m < sizes[3.0, i] <= m + 5 for i in range(4))
    rings = {i: [r["body_id"] for r in sorted(ring.filter(f"replicate = {i}").collect(), key=lambda r: r["place"])] for i in range(4)}
    kinds = {(r["strength"], r["replicate"], r["body_id"]): r["nt"] for r in nodes.collect()}
    there = {(r["strength"], r["replicate"], r["pre"], r["post"]) for r in edges.collect()}
    for i, own in rings.items():
        assert len(set(own)) == 5 and all(kinds[3.0, i, b] == "acetylcholine" for b in own)
        assert all((3.0, i, a, b) in there for a, b in zip(own, own[1:] + own[:1]))
    assert sorted(x for (s, i, _), x in kinds.items() if (s, i) == (0.0, 0)) == sorted(r["nt"] for r in n.collect())


def test_null_models_find_strong_loops_and_raise_few_alarms(spark, net):
    e, n, _, _ = net
    edges, nodes, ring = P.planted(e, n, (0.0, 6.0), 6, size=6)
    drive = ring.filter("place < 3").selectExpr("replicate", "body_id", "40.0 as hz")
    found = P.detection(edges, nodes, drive, {"g_ach": 0.05}, ("weight_permute", "rewire"), (9, 19), alpha=0.05, steps=40).persist()
    rate = {r["strength"]: r["rate"] for r in P.power(found).filter("n = 19").collect()}
    assert P.power(found).filter("n = 9 and n_detected > 0").count() == 0  # nine draws can't reach 0.05
    assert found.count() == 48 and rate[6.0] >= 0.5 and rate[6.0] > rate[0.0] and rate[0.0] <= 0.5
    whole = P.recovery(P.power(found)).filter("n = 19").first()
    assert whole["recovered"] == (not whole["false_positive"]) and whole["smallest"] == 6.0


EVIDENCE = [("x", "insect_nAChR", "agonist", 2e-7, 1.3), ("x", "insect_RDL", "antagonist", 5e-6, 1.0), ("y", "insect_RDL", "antagonist", 3e-7, 1.0), ("y", "insect_nAChR", "antagonist", 2e-6, 1.6), ("z", "insect_GluCl", "agonist", 1e-7, 1.0), ("z", "insect_Nav", "antagonist", None, 1.0)]


def evidence(spark):
    return spark.createDataFrame([(*x[:3], 0, *x[3:]) for x in EVIDENCE], "compound string, receptor string, direction string, pos int, value_m double, n double")


RULE = {("insect_nAChR", True): ("g_ach", 0.4, 1.6), ("insect_nAChR", False): ("g_ach", -1.0, 0.0), ("insect_RDL", True): ("g_gaba", 0.4, 0.0), ("insect_RDL", False): ("g_gaba", -1.0, 0.0), ("insect_GluCl", True): ("g_glu", 0.8, 0.0), ("insect_GluCl", False): ("g_glu", -1.0, 0.0)}


def gains_of(doses):
    """Gains of a mixture of ``{compound: dose}``, by competition at each receptor."""
    out = {}
    for rec in {x[1] for x in EVIDENCE}:
        a = [((doses[c] / v) ** n, d in dims.ACTIVATING) for c, r, d, v, n in EVIDENCE if r == rec and c in doses and v]
        if not a:
            continue
        total, up = sum(x for x, _ in a), sum(x for x, act in a if act)
        act = up > total - up
        t = (up if act else total - up) / (1 + total)
        g, slope, curve = RULE[rec, act]
        out[g] = max(0.05, 1 + slope * t - curve * t * t)
    return out


def displaced(net, doses, steps):
    _, _, nodes, edges = net
    start = {i: 40.0 for i, _, c in nodes if c == "sensory"}
    v, r = plain(nodes, edges, {}, start, steps), plain(nodes, edges, gains_of(doses), start, steps)
    return sum(abs(r[i] - v[i]) for i in v) / sum(v.values())


def test_mixtures_against_bliss(spark, net):
    e, n, _, _ = net
    drive = n.filter("superclass = 'sensory'").selectExpr("body_id", "40.0 as hz")
    mixes = {"xy": {"x": 1e-7, "y": 4e-7}, "xz": {"x": 3e-7, "z": 2e-7}, "yz": {"y": 1e-15, "z": 1e-15}}
    grid = spark.createDataFrame([(m, c, v) for m, own in mixes.items() for c, v in own.items()], "mixture string, compound string, conc_m double")
    got = {r["mixture"]: r for r in N.mixture_assay(e, n, drive, evidence(spark).join(grid, "compound"), steps=9).collect()}
    for m, own in mixes.items():
        alone = [min(1.0, displaced(net, {c: v}, 9)) for c, v in sorted(own.items())]
        assert np.allclose([s["effect"] for s in got[m]["singles"]], alone, atol=1e-9) and math.isclose(got[m]["observed"], min(1.0, displaced(net, own, 9)), abs_tol=1e-9)
        if max(alone) < 1e-3:
            assert got[m]["verdict"] == "inconclusive" and got[m]["expected"] is None
        else:
            off = got[m]["observed"] - (1 - math.prod(1 - x for x in alone))
            assert math.isclose(got[m]["delta"], off, abs_tol=1e-9) and got[m]["verdict"] == ("synergistic" if off > 0.05 else "antagonistic" if off < -0.05 else "additive")
    assert (got["xy"]["shared_receptors"], got["xz"]["shared_receptors"]) == (2, 0)


def test_isoboles_on_the_network(spark, net):
    e, n, _, _ = net
    drive = n.filter("superclass = 'sensory'").selectExpr("body_id", "40.0 as hz")
    pairs = spark.createDataFrame([("x", "y"), ("x", "z")], "a string, b string")
    got = N.network_isobole(e, n, drive, evidence(spark), pairs, 0.05, fractions=(0.5,), steps=9).collect()
    reach = {c for c in "xyz" if any(displaced(net, {c: 10.0**k}, 9) >= 0.05 for k in range(-9, -2))}  # others have no rows
    assert {(r["a"], r["b"]) for r in got} == {p for p in (("x", "y"), ("x", "z")) if reach.issuperset(p)} and {"x", "y"} <= reach
    for r in got:
        assert math.isclose(displaced(net, {r["a"]: r["dose_a"], r["b"]: r["dose_b"]}, 9), 0.05, rel_tol=2e-3)
        single = [r["dose_a"] / 0.5, r["dose_b"] / 0.5]
        assert r["index"] > 0 and all(x > 0 for x in single)
    assert any(abs(r["index"] - 1) > 0.02 for r in got)
    assert N.network_isobole(e, n, drive, evidence(spark), pairs, 0.999, fractions=(0.5,), steps=9).count() == 0


def test_ensembles(spark, net):
    e, n, nodes, edges = net
    driven = n.filter("superclass = 'sensory'").select("body_id")
    sets = n.filter("superclass = 'motor'").selectExpr("'motor_hz' as readout", "body_id")
    doses = spark.createDataFrame([(1e-6,)], "conc_m double")
    got = {(r["compound"], r["readout"]): r for r in N.ensemble(e, n, evidence(spark), doses, driven, sets, draws=15, steps=6).collect()}
    assert len(got) == 3 * 4 and all(r["n"] == 15 and r["low"] <= r["mean"] <= r["high"] for r in got.values())
    r = plain(nodes, edges, gains_of({"x": 1e-6}), {i: 40.0 for i, _, c in nodes if c == "sensory"}, 6)
    assert math.isclose(got["x", "mean_hz"]["nominal"], sum(r.values()) / 30, abs_tol=1e-9)
    assert math.isclose(got["x", "motor_hz"]["nominal"], sum(r[i] for i, _, c in nodes if c == "motor") / 10, abs_tol=1e-9)
    assert got["z", "g_ach"]["sd"] == 0 and got["x", "g_ach"]["sd"] > 0


def test_ranks_inside_many_groups(spark):
    pick = random.Random(8)
    rows = [(g, pick.randint(0, 6) * 1.0, pick.random()) for g in range(40) for _ in range(pick.choice([2, 5, 60]))]
    got = {r["g"]: r["rho"] for r in N.spearman_within(spark.createDataFrame(rows, "g int, a double, b double"), ["g"], "a", "b").collect()}
    for g in range(40):
        a, b = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2))
        rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
        ok = len(a) >= 3 and a.std() > 0
        assert (got[g] is None) == (not ok) and (not ok or math.isclose(got[g], np.corrcoef(rank(a), rank(b))[0, 1], abs_tol=1e-9))


def test_quantiles_without_a_group_in_one_task(spark):
    pick = random.Random(9)
    rows = [(g, pick.choice([None, pick.random()])) for g in "ab" for _ in range(101)] + [("c", 4.0)]
    got = {r["g"]: (r["low"], r["half"]) for r in S.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"low": 0.025, "half": 0.5}).collect()}
    for g in "abc":
        own = [x for k, x in rows if k == g and x is not None]
        assert np.allclose(got[g], np.quantile(own, [0.025, 0.5]))


@pytest.mark.parametrize("chained", [True, False])
def test_rewiring_keeps_degrees_and_weights(spark, net, monkeypatch, chained):
    e, _, _, edges = net
    if not chained:
        monkeypatch.setattr(G, "CHAINED", 0)
    simple = {(a, b): w for (a, b), w in edges.items() if a != b}
    two = G.drawn(e.filter("pre <> post"), 2)
    got, swaps = G.rewire(two, 2.0 if not chained else 10.0, seed=4, by=("draw",))
    rows = got.collect()
    for d in range(2):
        own = [(r["pre"], r["post"]) for r in rows if r["draw"] == d]
        assert len(set(own)) == len(own) == len(simple) and all(a != b for a, b in own) and set(own) != set(simple)
        for i in (0, 1):
            assert sorted(x[i] for x in own) == sorted(x[i] for x in simple)
        assert sorted((r["pre"], r["weight"]) for r in rows if r["draw"] == d) == sorted((a, w) for (a, _), w in simple.items())
    assert swaps >= (2.0 if not chained else 10.0) * 2 * len(simple)


def test_conclusions(spark):
    rows = [("a", -1.0, 0.01), ("b", 2.0, None), ("c", float("nan"), 0.2), ("d", None, 0.04)]
    readouts = spark.createDataFrame(rows, "spec string, effect double, p double")
    decided = C.decide(readouts, {"down": "effect < 0", "sure": "p <= 0.05", "either": "effect < 0 or p <= 0.05"})
    assert {(r["spec"], r["conclusion"]): r["holds"] for r in decided.collect()} == {
        ("a", "down"): True, ("b", "down"): False, ("c", "down"): None, ("d", "down"): None, ("a", "sure"): True, ("b", "sure"): None, ("c", "sure"): False, ("d", "sure"): True,
        ("a", "either"): True, ("b", "either"): None, ("c", "either"): None, ("d", "either"): True}
    got = {r["conclusion"]: r for r in C.stability(decided).collect()}
    assert [got["down"][k] for k in ("n", "retained", "lost", "undecidable", "share", "share_decidable", "failing", "fragile")] == [4, 1, 1, 2, 0.25, 0.5, ["b"], True]
    labels = spark.createDataFrame([("sure", "a", "x"), ("sure", "c", "y"), ("sure", "d", "x")], "conclusion string, spec string, label string")
    assert {(r["label"], r["n"], r["retained"]) for r in C.breakdown(decided, labels).collect()} == {("x", 2, 2), ("y", 1, 0)}


@pytest.mark.parametrize("text", ["unheard_of < 1", "effect + 1", "effect <", "max(effect) > 0", "explode(array(true))"])
def test_conclusions_that_cannot_be_read(spark, text):
    readouts = spark.createDataFrame([("a", 1.0)], "spec string, effect double")
    with pytest.raises(ValueError, match="conclusion 'mine'"):
        C.decide(readouts, {"mine": text})


def test_sign_test_of_few_and_very_many_trials(spark):
    cases = [(0, 0), (0, 1), (1, 3), (7, 20), (3, 300), (140, 300), (50_000, 100_000), (49_500, 100_000), (10**9 // 2 - 40_000, 10**9)]
    got = [r["p"] for r in spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, k long, n long").withColumn("p", S.binomial_two_sided(F.col("k"), F.col("n"))).orderBy("i").collect()]
    for (k, n), p in zip(cases, got):
        if n == 0:
            assert p is None
        elif n <= 100_000:
            m = min(k, n - k)
            term = math.comb(n, m) if n <= 300 else None
            want = min(1.0, 2 * sum(math.comb(n, i) for i in range(m + 1)) / 2**n) if term is not None else min(1.0, math.erfc((n / 2 - m - 0.5) / math.sqrt(n / 2)))
            assert math.isclose(p, 1.0 if 2 * k == n else want, rel_tol=1e-9 if n <= 300 else 1e-3)
        else:
            assert math.isclose(p, math.erfc((n / 2 - k - 0.5) / math.sqrt(n / 2)), rel_tol=1e-3)


def test_bootstrap_intervals_of_indices(spark):
    """y = 3 a + b + noise-free rest: the intervals hold the true shares, a factor that does nothing is no finding."""
    pick = np.random.default_rng(2)
    x, z = pick.random((2, 4000, 3))
    f = lambda m: 3 * m[:, 0] + m[:, 1]
    rows = []
    for j, name in enumerate("abn"):
        mixed = x.copy()
        mixed[:, j] = z[:, j]
        rows += [(name, i, float(p), float(q), float(m)) for i, (p, q, m) in enumerate(zip(f(x), f(z), f(mixed)))]
    got = {r["factor"]: r for r in S.jansen_bootstrap(spark.createDataFrame(rows, "factor string, i int, a double, b double, ab double"), "factor", ("i",), 60, null="n").collect()}
    for name, share in (("a", 0.9), ("b", 0.1), ("n", 0.0)):
        assert got[name]["first_low"] <= share + 0.02 and got[name]["first_high"] >= share - 0.02 and got[name]["first_low"] <= got[name]["first"] <= got[name]["first_high"]
    assert (got["a"]["state"], got["n"]["state"]) == ("resolved", "null control")
    w = S.resampled(spark.range(20_000), 3, "id").groupBy("draw").agg({"w": "sum"}).collect()
    assert all(abs(r["sum(w)"] / 20_000 - 1) < 0.05 for r in w) and len({r["sum(w)"] for r in w}) > 1


def test_ladders_are_nested(spark, net):
    e, n, _, edges = net
    seeds = n.filter("body_id in (0, 7)").select("body_id")
    nodes, own = N.ladder(e, seeds, 3, (6, 12, 25))
    place, cuts = {r["body_id"]: r["place"] for r in nodes.collect()}, {}
    assert sorted(place.values()) == list(range(1, len(place) + 1)) and {place[0], place[7]} == {1, 2}
    for r in N.at_rungs(own, (6, 12, 25)).collect():
        cuts.setdefault(r["budget"], set()).add((r["pre"], r["post"], r["weight"]))
    for b in (6, 12, 25):
        held = {i for i, p in place.items() if p <= b}
        assert cuts.get(b, set()) == {(x, y, w) for (x, y), w in edges.items() if x in held and y in held}
    sizes = spark.createDataFrame([(1, 0), (2, 10_000), (3, 10**8)], "budget int, n_edges long")
    assert [r["draws"] for r in N.permutation_budget(sizes, 1.0, 1, 5, 60).orderBy("budget").collect()] == [60, 12, 5]


def test_digests_leave_run_times_out(spark):
    texts = {
        "a": '{"x": [1, {"runtime_s": 3, "y": null}], "created_at": "now"}', "b": '{"created_at": "then", "x": [1, {"y": null, "runtime_s": 4}]}', "c": '{"x": [{"y": null}, 1]}', "d": '{"x": [1, {}]}',
        "e": '{"x": [1, {"runtime_s": 0}]}', "f": "[]", "g": "{}", "h": '"x"', "i": None, "j": '{"x": {"y": 1}}', "k": '{"x.y": 1}', "l": '{"x": "1"}', "m": '{"x": 1}'}
    got = {r["k"]: r["digest"] for r in stable_digests(spark.createDataFrame(list(texts.items()), "k string, j string"), "k", "j").collect()}
    assert set(got) == set(texts) - {"i"} and got["a"] == got["b"] and got["d"] == got["e"]
    assert len(set(got.values())) == len(got) - 2
    assert stable_digests(spark.createDataFrame([], "k string, j string"), "k", "j").count() == 0


def test_a_resampled_row_is_hashed_once(spark):
    rows = spark.range(5).selectExpr("id", "id as a")
    plan = S.resampled(rows, 3, "id").groupBy("draw").agg({"w": "sum"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("md5(") == 1
    by = {(r.draw, r.id): r.w for r in S.resampled(rows, 40, "id", seed=2).collect()}
    import hashlib

    for d in range(1, 41):
        for i in range(5):
            u = (int(hashlib.md5(f"2:{d}:{i}".encode()).hexdigest()[:12], 16) + 1) / (1 << 48)
            assert by.get((d, i), 0) == sum(u > sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(16))


def test_random_graphs_propose_no_more_than_they_need(spark, net, monkeypatch):
    import hashlib

    e, n, nodes, edges = net
    number = lambda *key: int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:12], 16)
    weights, m = [edges[k] for k in sorted(edges)], len(edges)
    want = []
    for draw in range(3):
        seen = {}
        for i in range(8 * m):
            pair = number(5, "a", draw, i) % 30, number(5, "b", draw, i) % 30
            if pair[0] != pair[1] and pair not in seen and len(seen) < m:
                seen[pair] = weights[number(5, "w", draw, i) % m]
        want += [(draw, *pair, w) for pair, w in seen.items()]
    assert G.proposals(7_200_000, 54_000_000, 8) < 1.1 * 54_000_000
    for least in (None, 1):  # a guess that is too low is made good
        monkeypatch.setattr(G, "proposals", G.proposals if least is None else lambda n, m, more: least)
        assert sorted(tuple(r) for r in G.erdos_renyi(e, n, 3, seed=5).collect()) == sorted(want)
    assert G.erdos_renyi(e.limit(0), n, 2).count() == 0
