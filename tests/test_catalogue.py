import pytest

from gainflow.plans.circuits import QUERIES
from gainflow.plans.circuit_sql import SQL

from .oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(QUERIES[name](spark, SF), SQL[name], SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and set(QUERIES) - set(SQL) == {"degree_preserving_rewire", "design_runs", "hill_fit", "network_isoboles", "sobol_budget"}


def test_rewiring_keeps_degrees_and_forgets_targets(spark):
    from gainflow.operators import graph as G
    from gainflow.sources import fixtures as X

    e = X.order_edges(spark, SF).cache()
    new, swaps = G.rewire(e)
    m = e.count()
    assert swaps >= 10 * m
    a, b = ({r.body_id: (r.in_degree, r.out_degree, round(r.out_weight, 6)) for r in G.degrees(x).collect()} for x in (e, new))
    assert a == b
    assert new.count() == new.select("pre", "post").distinct().count() == m and new.filter("pre = post").count() == 0
    assert new.join(e, ["pre", "post"], "left_semi").count() < 0.2 * m
    both = G.drawn(e, 2)
    apart, _ = G.rewire(both, swaps_per_edge=1, by=("draw",))
    assert all(G.degrees(apart.filter(f"draw = {k}")).exceptAll(G.degrees(e).select("*")).select("body_id", "in_degree", "out_degree").exceptAll(G.degrees(e).select("body_id", "in_degree", "out_degree")).count() == 0 for k in (0, 1))
    tiny = spark.createDataFrame([(1, 2, 1.0)], "pre long, post long, weight double")
    assert [tuple(r) for r in G.rewire(tiny, rounds=3)[0].collect()] == [(1, 2, 1.0)] and G.rewire(tiny.limit(0))[0].count() == 0


def test_hill_fit_finds_the_planted_curve(spark):
    for r in QUERIES["hill_fit"](spark, SF).collect():
        assert abs(r.log_ic50 + 3.5) < 0.1 and r.low <= r.log_ic50 + 0.05 and r.high >= r.log_ic50 - 0.05
