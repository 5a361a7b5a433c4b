"""DuckDB SQL of the analyses, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from ..functions import dims
from .oracles import _GAIN, _SIGN, BOTH, EDGE, EV, GAINS, PERM, SQL, engaged, listed

__all__ = ["SQL"]

TYPES = list(dims.CEILING)
OE = f"""oe AS (SELECT pre, post, sum(w) AS weight FROM (SELECT arg_min(l_partkey, (l_linenumber, l_partkey)) AS pre, arg_max(l_partkey, (l_linenumber, l_partkey)) AS post, sum(l_quantity) AS w FROM lineitem GROUP BY l_orderkey) WHERE pre <> post GROUP BY ALL),
ond AS (SELECT p_partkey AS body_id, (['acetylcholine', 'gaba', 'glutamate', 'octopamine', 'histamine', 'unclear'])[p_partkey % 6 + 1] AS nt, (['sensory', 'central', 'motor', 'visual'])[p_size % 4 + 1] AS superclass FROM part)"""


def hashed(*parts: str) -> str:
    return "md5(" + " || ':' || ".join(parts) + ")"


def number(h: str) -> str:
    return f"('0x' || left({h}, 12))::BIGINT"


def erdos_renyi(edge: str, node: str, draws: int, name: str) -> str:
    at = lambda k: number(hashed("'0'", f"'{k}'", "draw", "i"))
    return f"""{name}c AS (SELECT (SELECT count(*) FROM {node}) AS n, (SELECT count(*) FROM {edge}) AS m), {name}t AS (SELECT draw, i, {at('a')} % n + 1 AS a, {at('b')} % n + 1 AS b FROM {name}c, range(8 * (SELECT count(*) FROM {edge})) t(i), range({draws}) d(draw)),
{name}f AS (SELECT draw, a, b, min(i) AS i FROM {name}t WHERE a <> b GROUP BY ALL), {name}k AS (SELECT draw, a, b, {at('w')} % m + 1 AS o, m, row_number() OVER (PARTITION BY draw ORDER BY i) AS k FROM {name}f CROSS JOIN {name}c),
{name}i AS (SELECT body_id, row_number() OVER (ORDER BY body_id) AS k FROM {node}), {name}w AS (SELECT weight, row_number() OVER (ORDER BY pre, post) AS o FROM {edge}),
{name} AS (SELECT draw, x.body_id AS pre, y.body_id AS post, weight FROM {name}k JOIN {name}i x ON x.k = a JOIN {name}i y ON y.k = b JOIN {name}w USING (o) WHERE {name}k.k <= m)"""


def weight_matched(edge: str, node: str, draws: int, name: str) -> str:
    return f"""{name}b AS (SELECT n.body_id, nt, coalesce(w, 0) AS w, row_number() OVER (ORDER BY round(coalesce(w, 0), 6) DESC, n.body_id) AS k FROM {node} n LEFT JOIN (SELECT pre, sum(weight) AS w FROM {edge} GROUP BY 1) o ON pre = n.body_id),
{name}m AS (SELECT *, (k - 1) // size AS part FROM {name}b, range({draws}) d(draw), (SELECT unnest([64, 32, 16, 8, 4, 2]) AS size)), {name}p AS (SELECT draw, size, part, body_id, w, row_number() OVER (PARTITION BY draw, size, part ORDER BY {hashed("'0'", "'matched'", "draw", "size", "body_id")}, body_id) AS i FROM {name}m),
{name}l AS (SELECT draw, size, part, nt, row_number() OVER (PARTITION BY draw, size, part ORDER BY k) AS i FROM {name}m), {name}n AS (SELECT draw, size, body_id, w, nt FROM {name}p JOIN {name}l USING (draw, size, part, i)), {name}r AS (SELECT nt, sum(w) AS w FROM {name}b GROUP BY 1),
{name}s AS (SELECT draw, size, nt, sum(w) AS w FROM {name}n GROUP BY ALL), {name}o AS (SELECT draw, size, max(abs({name}s.w - {name}r.w)) / (SELECT sum(w) FROM {name}b) AS off_ FROM {name}s JOIN {name}r USING (nt) GROUP BY ALL),
{name}z AS (SELECT draw, max(size) AS size FROM {name}o WHERE round(off_, 9) <= 0.02 GROUP BY 1),
{name} AS (SELECT draw, body_id, nt, size AS block FROM {name}n JOIN {name}z USING (draw, size) UNION ALL SELECT draw, body_id, nt, 1 FROM {name}b, range({draws}) d(draw) WHERE draw NOT IN (SELECT draw FROM {name}z))"""


def weights_dealt(edge: str, draws: int, name: str) -> str:
    return f"""{name}a AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY {hashed("'0'", "draw", "pre", "post")}, pre, post) AS k FROM {edge}, range({draws}) d(draw)), {name}h AS (SELECT weight, row_number() OVER (ORDER BY pre, post) AS k FROM {edge}),
{name} AS (SELECT draw, pre, post, {name}h.weight FROM {name}a JOIN {name}h USING (k))"""


def signs_dealt(node: str, draws: int, name: str) -> str:
    return f"""{name}a AS (SELECT body_id, draw, row_number() OVER (PARTITION BY draw ORDER BY {hashed("'0'", "'to'", "draw", "body_id")}, body_id) AS k FROM {node}, range({draws}) d(draw)), {name}l AS (SELECT nt, row_number() OVER (ORDER BY body_id) AS k FROM {node}),
{name} AS (SELECT draw, body_id, nt FROM {name}a JOIN {name}l USING (k))"""


SQL["erdos_renyi_nulls"] = f"WITH {OE}, {erdos_renyi('oe', 'ond', 3, 'er')} SELECT draw, pre, count(*) AS out_degree, round(sum(weight), 6) AS out_weight, sum(post)::BIGINT AS targets FROM er GROUP BY 1, 2"
SQL["weight_matched_nulls"] = f"""WITH {OE}, {weight_matched('oe', 'ond', 3, 'wm')}, o AS (SELECT pre, sum(weight) AS w FROM oe GROUP BY 1)
SELECT draw, nt, count(*) AS cells, round(coalesce(sum(w), 0), 6) AS out_weight, max(block) AS block FROM wm LEFT JOIN o ON pre = body_id GROUP BY 1, 2"""
SQL["weight_shuffle_nulls"] = f"WITH {OE}, {weights_dealt('oe', 3, 'wd')} SELECT draw, post, count(*) AS in_degree, round(sum(weight), 6) AS in_weight FROM wd GROUP BY 1, 2"

HEAVY = f"{EDGE}, he AS MATERIALIZED (SELECT pre, post, weight FROM edge WHERE pre <> post AND round(weight - (SELECT avg(weight) FROM edge WHERE pre <> post), 6) > 0)"


def typical(*doses: float) -> str:
    """Typical compounds and their gains: ``arm`` and the gains, and ``theta``."""
    t = "engagement"

    def g(receptor: str, up: tuple[float, float]) -> str:
        return f"coalesce(max(CASE WHEN direction = 'agonist' THEN greatest(0.05, 1 + {up[0]} * {t} - {up[1]} * {t} * {t}) ELSE greatest(0.05, 1 - {t}) END) FILTER (receptor = 'insect_{receptor}'), 1.0)"
    return f"""{EV}, tv AS (SELECT direction, receptor, exp(avg(ln(value_m))) AS v, avg(n) AS n FROM ev WHERE value_m IS NOT NULL GROUP BY ALL), te AS (SELECT direction, receptor, c, pow(c, n) / (pow(v, n) + pow(c, n)) AS engagement FROM tv, (SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in doses)}]) AS c)),
t0 AS (SELECT direction || '@' || round(c * 1e9)::BIGINT AS arm, {g('nAChR', (0.4, 1.6))} AS ach, {g('RDL', (0.4, 0.0))} AS g_gaba, {g('GluCl', (0.8, 0.0))} AS g_glu, {g('OctR', (0.5, 0.0))} AS g_oct, {g('Nav', (1.5, 0.0))} AS g_nav, coalesce(max({t}) FILTER (receptor = 'insect_AChE' AND direction <> 'agonist'), 0.0) AS x,
  max({t}) FILTER (receptor LIKE 'insect_%') AS theta FROM te GROUP BY ALL),
cell AS MATERIALIZED (SELECT arm, CASE WHEN x > 0 THEN greatest(0.05, ach * (1 + 2 * x) * (1 + 0.4 * x - 1.6 * x * x)) ELSE ach END AS g_ach, g_gaba, g_glu, g_oct, g_nav, 1 + 2 * x AS ach_tone, theta FROM t0)"""


GAIN = "CASE nt WHEN 'acetylcholine' THEN g_ach * ach_tone WHEN 'gaba' THEN g_gaba WHEN 'glutamate' THEN g_glu WHEN 'octopamine' THEN g_oct ELSE 1.0 END"


def rates(edges: str, nodes: str, arms: str, name: str, keys: str = "", steps: int = 80) -> str:
    """Rates of every arm on every graph, 80 steps; ``keys`` (with a comma at its end) tells graphs apart."""
    on = f"USING ({keys}pre)"
    out = f"""{name}e AS (SELECT {keys}pre, post, sum(weight) * {_SIGN} AS w FROM {edges} JOIN (SELECT {keys}body_id AS pre, nt FROM {nodes}) {on} GROUP BY {keys}pre, post, nt), {name}w AS MATERIALIZED (SELECT *, w / greatest(sum(abs(w)) OVER (PARTITION BY {keys}post), 1) AS u FROM {name}e),
{name}0 AS (SELECT {keys}arm, body_id, {GAIN} AS g, g_nav AS nav, CASE WHEN body_id IN (SELECT body_id FROM seed) THEN 40.0::DOUBLE ELSE 0 END AS hz, 0.0::DOUBLE AS r FROM {nodes} CROSS JOIN {arms})"""
    for i in range(1, steps + 1):
        p = f"{name}{i - 1}"
        out += f""", {name}{i} AS MATERIALIZED (SELECT a.* EXCLUDE (r, x), least(greatest(0.7 * r + 0.3 * nav * (hz + coalesce(x, 0)), 0), 300) AS r FROM (SELECT a.*, x FROM {p} a LEFT JOIN (SELECT {keys}arm, post AS body_id, sum(u * r * g) AS x FROM {name}w JOIN (SELECT {keys}arm, body_id AS pre, r, g FROM {p}) {on} GROUP BY ALL) USING ({keys}arm, body_id)) a)"""
    return out


def effect(name: str, keys: str = "") -> str:
    return f"""{name}m AS (SELECT {keys}arm, avg(r) AS hz FROM {name}80 WHERE body_id IN (SELECT body_id FROM node WHERE superclass = 'ASIA') GROUP BY ALL),
{name}f AS MATERIALIZED (SELECT {keys}a.arm, a.hz - v.hz AS effect, v.hz AS vehicle FROM {name}m a JOIN (SELECT {keys}hz FROM {name}m WHERE arm = 'vehicle') v {f'USING ({keys[:-2]})' if keys else 'ON true'} WHERE a.arm <> 'vehicle')"""


_VEHICLE = "SELECT 'vehicle' AS arm, 1.0::DOUBLE AS g_ach, 1.0::DOUBLE AS g_gaba, 1.0::DOUBLE AS g_glu, 1.0::DOUBLE AS g_oct, 1.0::DOUBLE AS g_nav, 1.0::DOUBLE AS ach_tone"
ARMS = f"arms AS MATERIALIZED (SELECT * EXCLUDE (theta) FROM cell UNION ALL {_VEHICLE})"
_D = "range(20) d(draw)"
SQL["dependence_landscape"] = f"""WITH {HEAVY}, {typical(1e-7, 1e-6)}, {ARMS}, {signs_dealt('node', 20, 'sd')}, {weight_matched('he', 'node', 20, 'wm')}, {weights_dealt('he', 20, 'wd')}, {erdos_renyi('he', 'node', 20, 'er')},
ne AS MATERIALIZED (SELECT 'sign_permute' AS mode, draw, pre, post, weight FROM he, {_D} UNION ALL SELECT 'weight_matched', draw, pre, post, weight FROM he, {_D} UNION ALL SELECT 'weight_permute', draw, pre, post, weight FROM wd UNION ALL SELECT 'erdos_renyi', draw, pre, post, weight FROM er),
nn AS MATERIALIZED (SELECT 'sign_permute' AS mode, draw, body_id, nt FROM sd UNION ALL SELECT 'weight_matched', draw, body_id, nt FROM wm UNION ALL SELECT mode, draw, body_id, nt FROM node, {_D}, (SELECT unnest(['weight_permute', 'erdos_renyi']) AS mode)),
{rates('he', 'node', 'arms', 'x')}, {effect('x')}, {rates('ne', 'nn', 'arms', 'y', 'mode, draw, ')}, {effect('y', 'mode, draw, ')},
q AS (SELECT y.arm, mode, y.effect, x.effect AS real, x.vehicle FROM (SELECT mode, draw, arm, effect FROM yf) y JOIN (SELECT arm, effect, vehicle FROM xf) x USING (arm)), q2 AS (SELECT *, avg(q.effect) OVER (PARTITION BY arm, mode) AS c FROM q),
t AS (SELECT arm, mode, max(real) AS real, max(vehicle) AS vehicle, quantile_cont(effect, 0.5) AS med, round((count(*) FILTER (abs(round(effect - c, 9)) >= abs(round(real - c, 9))) + 1) / (count(*) + 1), 9) AS p FROM q2 GROUP BY ALL),
s AS (SELECT arm, mode, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, arm, mode) AS k FROM t WHERE mode IN ('weight_permute', 'erdos_renyi')), b AS (SELECT arm, mode, least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM s),
v AS (SELECT t.*, q, CASE WHEN coalesce(q, p) <= 0.1 THEN 'distinguishable' WHEN abs(real - med) < 0.05 * abs(vehicle) THEN 'equivalent_within_tolerance' ELSE 'indeterminate' END AS verdict FROM t LEFT JOIN b USING (arm, mode)),
g AS (SELECT arm, bool_or(abs(real) <= greatest(1e-6, 0.01 * abs(vehicle))) AS none, bool_or(verdict = 'distinguishable' AND mode IN ('rewire', 'weight_permute', 'erdos_renyi')) FILTER (mode IN ('weight_permute', 'erdos_renyi')) AS s, bool_or(verdict = 'distinguishable' AND mode = 'sign_permute') AS g FROM v GROUP BY 1)
SELECT arm, mode, round(real, 6) AS real, round(med, 5) AS null_median, p, round(q, 9) AS q, verdict, CASE WHEN none THEN 'no-effect' WHEN g.s THEN 'topology-dependent' WHEN g.g THEN 'mixed' ELSE 'composition-dominated' END AS class FROM v JOIN g USING (arm)"""

_NET = "round((g_ach - 1) - (g_gaba - 1) - 0.4 * (g_glu - 1) + 0.2 * (g_oct - 1) + g_nav - 1, 9)"
SQL["baseline_ladder"] = f"""WITH {HEAVY}, {typical(1e-8, 1e-7, 1e-6, 1e-5)}, {ARMS}, net AS (SELECT *, {_NET} > 0 AS up FROM cell), mult AS (SELECT arm, CASE WHEN up THEN 1 + theta ELSE greatest(0.05, 1 - theta) END AS g FROM net),
plain AS MATERIALIZED (SELECT arm, g AS g_ach, g AS g_gaba, g AS g_glu, g AS g_oct, 1.0::DOUBLE AS g_nav, 1.0::DOUBLE AS ach_tone FROM mult UNION ALL {_VEHICLE}), {rates('he', 'node', 'arms', 'x')}, {effect('x')}, {rates('he', 'node', 'plain', 'y')}, {effect('y')},
c AS (SELECT arm, sum({_SIGN} * ({GAIN} - 1)) / (SELECT count(*) FROM node) AS composition FROM cell CROSS JOIN node GROUP BY 1), l AS (SELECT net.arm, round(xf.effect, 6) AS f, round(yf.effect, 6) AS t, round(composition, 6) AS c, round(CASE WHEN up THEN theta ELSE -theta END, 6) AS r FROM net JOIN xf USING (arm) JOIN yf USING (arm) JOIN c USING (arm)),
k AS (SELECT level, v, f, rank() OVER (PARTITION BY level ORDER BY v) + (count(*) OVER (PARTITION BY level, v) - 1) / 2 AS rv, rank() OVER (PARTITION BY level ORDER BY f) + (count(*) OVER (PARTITION BY level, f) - 1) / 2 AS rf FROM (SELECT 'receptor' AS level, r AS v, f FROM l UNION ALL SELECT 'composition', c, f FROM l UNION ALL SELECT 'topology', t, f FROM l UNION ALL SELECT 'full', f, f FROM l))
SELECT level, count(*) AS n, round(corr(rv, rf), 6) AS spearman FROM k GROUP BY 1"""

SQL["p_convergence"] = f"""WITH {PERM}, i AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY k1, k2) AS i, count(*) OVER (PARTITION BY cell) AS n FROM d), r AS (SELECT cell, round_even(n * f, 0)::BIGINT AS k, i, effect, real FROM i, (SELECT unnest([0.25, 0.5, 1.0]::DOUBLE[]) AS f)),
c AS (SELECT *, avg(effect) OVER (PARTITION BY cell, k) AS c FROM r WHERE i <= k), a AS (SELECT cell, k, (count(*) FILTER (abs(round(effect - c, 9)) >= abs(round(real - c, 9))) + 1) / (count(*) + 1) AS p FROM c GROUP BY ALL),
l AS (SELECT *, max(k) OVER w AS n, arg_max(p, k) OVER w AS last FROM a WINDOW w AS (PARTITION BY cell)), o AS (SELECT *, abs(p - last) AS shift, (p <= 0.5) = (last <= 0.5) AS same FROM l), g AS (SELECT *, coalesce(max(CASE WHEN round(shift, 9) > 0.02 OR NOT same THEN k END) OVER (PARTITION BY cell), 0) AS late FROM o)
SELECT cell, max(n) AS n, round(max(last), 9) AS p, round(coalesce(max(CASE WHEN k < n THEN shift END), 0), 9) AS p_max_shift, bool_and(same) AS verdict_stable, max(late) = 0 AS stabilised, min(CASE WHEN k > late AND k < n THEN k END) AS n_stabilised, max(last) <= 1 / (max(n) + 1) + 1e-12 AS resolution_limited FROM g GROUP BY 1"""
SQL["fdr_diagnostics"] = f"""WITH {PERM}, k AS (SELECT round(p, 9) AS p, resolution, count(*) OVER () AS m, row_number() OVER (ORDER BY round(p, 9)) AS k FROM perm), q AS (SELECT *, least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM k),
a AS (SELECT count(*) AS m, count(*) FILTER (q <= 0.5) AS n_rejected, max(resolution) AS res FROM q) SELECT m, n_rejected, round(res, 9) AS resolution, ceil(round(m * res / 0.5, 9))::BIGINT AS min_rejections, ceil(round(m * res / 0.5, 9)) <= m AS can_reject, res <= 0.5 / m AS single_rejection FROM a"""
_RULE = "CASE WHEN relation = 'unsupported' OR param_type IN ('relative_potency', 'class_order', 'unknown') THEN 'not_modelled' ELSE 'modelled' END"
_CHECKS = {
    "receptor_not_declared": f"receptor NOT IN ({listed([f'{o}_{x}' for o in ('insect', 'vertebrate') for x in dims.RECEPTORS])[1:-1]})",
    "bad_direction": "direction NOT IN ('agonist', 'partial_agonist', 'antagonist', 'positive_modulator', 'negative_modulator', 'inhibitor', 'none')", "bad_tier": "tier NOT IN ('literature_order', 'class_placeholder', 'measured_fit')", "no_source": "pos % 11 = 0",
    "value_not_modellable": f"{_RULE} = 'not_modelled' AND value_m IS NOT NULL", "value_of_unknown_type": "param_type = 'unknown' AND value_m IS NOT NULL", "value_not_positive": "value_m <= 0",
    "no_value_but_tier": "value_m IS NULL AND tier <> 'class_placeholder'", "placeholder_with_value": "value_m IS NOT NULL AND tier = 'class_placeholder'",
}
SQL["library_checks"] = f"""WITH {EV}, x AS (SELECT pos, compound, CASE WHEN pos % 97 = 0 THEN 'insect_unheard_of' ELSE receptor END AS receptor, param_type, relation, value_m, CASE WHEN pos % 89 = 0 THEN 'sideways' ELSE direction END AS direction, (['primary', 'secondary', 'class_placeholder', 'guess'])[pos % 4 + 1] AS tier FROM ev),
p AS ({' UNION ALL '.join(f"SELECT '{k}' AS problem, compound FROM x WHERE {c}" for k, c in _CHECKS.items())}) SELECT problem, count(*) AS n, count(DISTINCT compound) AS compounds FROM p GROUP BY 1"""

_W = f"le AS (SELECT pre, post, weight, weight * {_SIGN} AS b, weight * {_SIGN} * {_GAIN} AS a FROM oe JOIN ond ON pre = body_id WHERE {_SIGN} <> 0 AND post IN (SELECT body_id FROM ond))"
SQL["path_impact"] = f"""WITH {OE}, {_W}, p1 AS (SELECT pre, [pre, post] AS path, 1 AS length, weight AS w, b, a FROM le WHERE post IN (SELECT body_id FROM ond WHERE superclass = 'motor')), f AS (SELECT * FROM p1 ORDER BY round(abs(a), 6) DESC, path LIMIT 20000),
p2 AS (SELECT le.pre, list_prepend(le.pre, path) AS path, 2 AS length, least(w, le.weight) AS w, f.b * le.b AS b, f.a * le.a AS a FROM f JOIN le ON le.post = f.pre WHERE NOT list_contains(path, le.pre)), u AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2)
SELECT array_to_string(path, '>') AS path, length, round(w, 6) AS min_weight, round(b, 6) AS before, round(a, 6) AS after, round(a - b, 6) AS delta FROM (SELECT * FROM u ORDER BY round(abs(a), 6) DESC, u.path LIMIT 50)"""
SQL["edge_scan"] = "SELECT l_suppkey AS pre, count(*) AS n, round(sum(l_quantity), 6) AS weight FROM lineitem WHERE l_quantity >= 30 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1"
SQL["node_records"] = """WITH t AS (SELECT user_id, arg_min(event_type, event_id) AS nt FROM events GROUP BY 1) SELECT o AS body_id, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS superclass, nt
FROM (SELECT DISTINCT o_custkey AS o FROM orders) LEFT JOIN customer ON c_custkey = o LEFT JOIN t ON user_id = o"""


def _unit(salt: str) -> str:
    return f"({number(hashed(chr(39) + '0' + chr(39), chr(39) + salt + chr(39), 'pos', 'draw'))}::DOUBLE + 1) / {float(1 << 48)!r}"


SQL["credible_intervals"] = f"""WITH {EV}, x AS (SELECT pos, n, direction, value_m IS NOT NULL AS perturbed, CASE WHEN {_RULE} = 'modelled' THEN value_m END AS v, draw, sqrt(-2 * ln({_unit('a')})) * cos(6.283185307179586 * {_unit('b')}) AS z FROM ev, range(1, 101) d(draw)),
y AS (SELECT pos, perturbed, pow(1e-6, n) / (pow(v, n) + pow(1e-6, n)) AS point, pow(1e-6, n) / (pow(v * pow(10.0, 0.3 * z), n) + pow(1e-6, n)) AS y FROM x)
SELECT pos, round(max(point), 6) AS point, round(avg(y), 6) AS mean, round(quantile_cont(y, 0.025), 6) AS low, round(quantile_cont(y, 0.975), 6) AS high, bool_or(perturbed) AS perturbed FROM y GROUP BY 1"""
SQL["isobologram"] = f"""WITH {EV}, e AS (SELECT compound, receptor, min((value_m, n)) AS x FROM ev WHERE value_m IS NOT NULL GROUP BY ALL), p AS (SELECT a.compound // 2 AS pair, receptor, a.x[1] AS va, a.x[2] AS na, b.x[1] AS vb, b.x[2] AS nb, i / 6 AS f FROM e a JOIN e b USING (receptor), range(7) r(i) WHERE a.compound % 2 = 0 AND b.compound = a.compound + 1),
s AS (SELECT *, pow(10, list_reduce(list_transform(range(1, 61), lambda k: 16 / pow(2, k)), lambda x, h: CASE WHEN pow(f * pow(10, x + h), na) + pow((1 - f) * pow(10, x + h), nb) < 1 THEN x + h ELSE x END, -8.0::DOUBLE)) AS s FROM p)
SELECT pair, receptor, round(f, 6) AS fraction, round(f * va * s * 1e9, 6) AS dose_a_nm, round((1 - f) * vb * s * 1e9, 6) AS dose_b_nm, round(s, 6) AS ci FROM s"""
SQL["two_sided_signs"] = """WITH c AS (SELECT p_brand, count(*) FILTER (p_retailprice > (SELECT avg(p_retailprice) FROM part)) AS k, count(*) AS n FROM part GROUP BY 1), t AS (SELECT p_brand, k, n, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) AS tail FROM c, unnest(range(least(k, n - k) + 1)) r(i) GROUP BY ALL)
SELECT p_brand, k, n, round(CASE WHEN 2 * k = n THEN 1 ELSE least(1, 2 * tail) END, 9) AS p FROM t"""


SQL["evidence_coercion"] = f"""WITH {EV}, t AS (SELECT CASE WHEN pos % 13 = 0 THEN 'unknown' ELSE param_type END AS param_type, CASE WHEN pos % 17 = 0 THEN 'unsupported' ELSE relation END AS relation, (['binding_occupancy', 'functional_engagement', 'not_modelled'])[pos % 3 + 1] AS claimed FROM ev)
SELECT param_type, relation, CASE relation WHEN 'exact_compound_exact_receptor_exact_species' THEN 'E0' WHEN 'exact_compound_exact_receptor_other_species' THEN 'E1' WHEN 'exact_compound_related_receptor' THEN 'E2' WHEN 'class_extrapolation' THEN 'E3' ELSE 'E4' END AS distance, count(*) AS n,
count(*) FILTER (claimed <> 'not_modelled' AND (param_type IN ('relative_potency', 'class_order', 'unknown') OR (claimed = 'binding_occupancy' AND param_type NOT IN ('Kd', 'Ki')))) AS too_strong FROM t GROUP BY 1, 2"""
SQL["generic_multipliers"] = f"""WITH {engaged()}, {GAINS}, h AS (SELECT compound, max(engagement) AS theta FROM en WHERE receptor LIKE 'insect_%' GROUP BY 1), g AS (SELECT compound, {_NET} > 0 AS up, theta FROM gains LEFT JOIN h USING (compound))
SELECT compound, round(CASE WHEN theta IS NULL THEN 1 WHEN up THEN 1 + theta ELSE greatest(0.05, 1 - theta) END, 9) AS directed, round(coalesce(CASE WHEN theta IS NOT NULL THEN greatest(0.05, 1 - theta) END, 1), 9) AS depressant FROM g"""
SQL["scaled_cut"] = f"""WITH {BOTH}, r AS ({SQL["ranked_rings"]}), n AS (SELECT body_id, ring, row_number() OVER (ORDER BY ring, pull DESC, body_id) AS place FROM r), c AS (SELECT * FROM n WHERE place <= 60),
o AS (SELECT pre, count(*) AS edges, sum(weight) AS weight FROM h WHERE pre IN (SELECT body_id FROM c) AND post IN (SELECT body_id FROM c) GROUP BY 1) SELECT body_id, ring, place, coalesce(edges, 0) AS edges, round(coalesce(weight, 0), 6) AS weight FROM c LEFT JOIN o ON pre = body_id"""
