"""DuckDB SQL of the analyses on networks, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from statistics import NormalDist

from .analysis_sql import GAIN, HEAVY, OE, SQL, erdos_renyi, hashed, number, signs_dealt, typical, weights_dealt
from .oracles import _SIGN, EV, engaged

__all__ = ["SQL"]


def steps_over(weights: str, nodes: str, name: str, n: int, edge_gain: str = "g", keys: str = "") -> str:
    """Rates of ``nodes`` (``keys, arm, body_id, g, nav, hz``) over normalised weights ``keys, pre, post, u``; ``edge_gain`` may use their columns."""
    on = f"USING ({keys}pre)"
    out = f"{name}0 AS (SELECT {keys}arm, body_id, g, nav, hz, 0.0::DOUBLE AS r FROM {nodes})"
    for i in range(1, n + 1):
        p = f"{name}{i - 1}"
        out += f""", {name}{i} AS MATERIALIZED (SELECT a.* EXCLUDE (r, x), least(greatest(0.7 * r + 0.3 * nav * (hz + coalesce(x, 0)), 0), 300) AS r FROM (SELECT a.*, x FROM {p} a LEFT JOIN (SELECT {keys}arm, post AS body_id, sum(u * r * {edge_gain}) AS x FROM {weights} JOIN (SELECT {keys}arm, body_id AS pre, r, g FROM {p}) {on} GROUP BY ALL) USING ({keys}arm, body_id)) a)"""
    return out


def steps(edges: str, nodes: str, name: str, n: int, keys: str) -> str:
    """The same, over edges ``keys, pre, post, weight``; nodes have ``nt`` besides."""
    return f"""{name}e AS (SELECT {keys}pre, post, nt, sum(weight) * {_SIGN} AS w FROM {edges} JOIN (SELECT DISTINCT {keys}body_id AS pre, nt FROM {nodes}) USING ({keys}pre) GROUP BY {keys}pre, post, nt), {name}w AS MATERIALIZED (SELECT *, w / greatest(sum(abs(w)) OVER (PARTITION BY {keys}post), 1) AS u FROM {name}e), {steps_over(f'{name}w', nodes, name, n, 'g', keys)}"""


_CELLS = f"""{OE}, {erdos_renyi('oe', 'ond', 3, 'er')}, {signs_dealt('ond', 3, 'sd')},
ring AS (SELECT replicate, body_id, k - 1 AS place FROM (SELECT replicate, body_id, row_number() OVER (PARTITION BY replicate ORDER BY {hashed("'0'", "'ring'", "replicate", "body_id")}, body_id) AS k FROM ond, range(3) t(replicate)) WHERE k <= 5),
s AS (SELECT unnest([0.0, 1.0, 4.0]::DOUBLE[]) AS strength), loop AS (SELECT strength, a.replicate, a.body_id AS pre, b.body_id AS post, 6 * strength * (SELECT avg(weight) FROM er WHERE draw = a.replicate) AS weight FROM ring a JOIN ring b ON a.replicate = b.replicate AND b.place = (a.place + 1) % 5, s WHERE strength > 0),
pe AS MATERIALIZED (SELECT strength, replicate, pre, post, sum(weight) AS weight FROM (SELECT strength, draw AS replicate, pre, post, weight FROM er, s UNION ALL SELECT * FROM loop) GROUP BY ALL),
pn AS MATERIALIZED (SELECT strength, sd.draw AS replicate, sd.body_id, CASE WHEN place IS NOT NULL AND strength > 0 THEN 'acetylcholine' ELSE nt END AS nt, CASE WHEN place < 2 THEN 40.0::DOUBLE ELSE 0 END AS hz FROM sd LEFT JOIN ring ON ring.replicate = sd.draw AND ring.body_id = sd.body_id, s),
pa AS (SELECT *, row_number() OVER (PARTITION BY strength, replicate, draw ORDER BY {hashed("'0'", "strength", "replicate", "draw", "pre", "post")}, pre, post) AS k FROM pe, range(9) t(draw)), ph AS (SELECT strength, replicate, weight, row_number() OVER (PARTITION BY strength, replicate ORDER BY pre, post) AS k FROM pe),
ge AS MATERIALIZED (SELECT strength, replicate, draw, pre, post, ph.weight FROM pa JOIN ph USING (strength, replicate, k) UNION ALL SELECT strength, replicate, -1, pre, post, weight FROM pe),
gn AS MATERIALIZED (SELECT strength, replicate, draw, arm, body_id, nt, CASE WHEN arm = 'treated' AND nt = 'acetylcholine' THEN 0.05 ELSE 1.0 END::DOUBLE AS g, 1.0::DOUBLE AS nav, hz FROM pn, range(-1, 9) t(draw), (SELECT unnest(['vehicle', 'treated']) AS arm)),
{steps('ge', 'gn', 'x', 20, 'strength, replicate, draw, ')},
f AS MATERIALIZED (SELECT strength, replicate, draw, avg(r) FILTER (arm = 'treated') - avg(r) FILTER (arm = 'vehicle') AS effect FROM x20 GROUP BY ALL),
h AS (SELECT a.strength, a.replicate, n, a.effect, b.effect AS real, avg(a.effect) OVER (PARTITION BY a.strength, a.replicate, n) AS c FROM f a JOIN f b ON a.strength = b.strength AND a.replicate = b.replicate AND b.draw = -1, (SELECT unnest([5, 9]::BIGINT[]) AS n) WHERE a.draw >= 0 AND a.draw < n),
t AS MATERIALIZED (SELECT strength, replicate, n, max(real) AS real, (count(*) FILTER (abs(round(effect - c, 9)) >= abs(round(real - c, 9))) + 1) / (count(*) + 1) AS p FROM h GROUP BY ALL)"""
_POWER = "w AS (SELECT strength, n, count(*) AS replicates, count(*) FILTER (p <= 0.1) AS n_detected, count(*) FILTER (p <= 0.1) / count(*) AS rate, strength = 0 AS is_control FROM t GROUP BY ALL)"
SQL["planted_detection"] = f"WITH {_CELLS} SELECT strength, replicate, n, 'weight_permute' AS mode, round(real, 6) AS real, round(p, 9) AS p, p <= 0.1 AS detected FROM t"
SQL["planted_power"] = f"""WITH {_CELLS}, {_POWER}, v AS (SELECT n, min(strength) FILTER (strength > 0 AND rate > 0.5) AS smallest, sum(n_detected) FILTER (strength = 0) / sum(replicates) FILTER (strength = 0) AS false_positive_rate,
count(*) FILTER (strength > 0 AND rate > 0.5) > 0 AND NOT bool_or(strength = 0 AND rate > 0.5) AS recovered FROM w GROUP BY 1) SELECT w.*, smallest, false_positive_rate, recovered FROM w JOIN v USING (n)"""


def gains(rows: str, keys: str) -> str:
    """Gains per ``keys`` from one row of ``direction, engagement`` a receptor."""
    t = "engagement"

    def g(receptor: str, up: tuple[float, float]) -> str:
        return f"coalesce(max(CASE WHEN direction = 'agonist' THEN greatest(0.05, 1 + {up[0]} * {t} - {up[1]} * {t} * {t}) ELSE greatest(0.05, 1 - {t}) END) FILTER (receptor = 'insect_{receptor}'), 1.0)"
    own = f"SELECT {keys}, {g('nAChR', (0.4, 1.6))} AS ach, {g('RDL', (0.4, 0.0))} AS g_gaba, {g('GluCl', (0.8, 0.0))} AS g_glu, {g('OctR', (0.5, 0.0))} AS g_oct, {g('Nav', (1.5, 0.0))} AS g_nav, coalesce(max({t}) FILTER (receptor = 'insect_AChE' AND direction <> 'agonist'), 0.0) AS x FROM {rows} GROUP BY {keys}"
    return f"SELECT {keys}, CASE WHEN x > 0 THEN greatest(0.05, ach * (1 + 2 * x) * (1 + 0.4 * x - 1.6 * x * x)) ELSE ach END AS g_ach, g_gaba, g_glu, g_oct, g_nav, 1 + 2 * x AS ach_tone FROM ({own})"


def unit(*key: str) -> str:
    return f"(({number(hashed(*key))} + 1) / 281474976710656.0::DOUBLE)"


_TYPICAL = f"{EV}, {OE}, ty AS MATERIALIZED (SELECT direction AS compound, receptor, direction, exp(avg(ln(value_m))) AS v, avg(n) AS n FROM ev WHERE value_m IS NOT NULL GROUP BY ALL)"
_HZ = "CASE WHEN superclass = 'sensory' THEN 40.0::DOUBLE ELSE 0 END"


def run(arms: str, name: str, n: int = 10, hz: str = _HZ) -> str:
    """Rates of the arms on the order graph; ``hz`` may use the arm's columns."""
    return f"{name}n AS MATERIALIZED (SELECT arm, body_id, nt, {GAIN} AS g, g_nav AS nav, {hz} AS hz FROM ond CROSS JOIN {arms}), {steps('oe', f'{name}n', name, n, '')}"


_Z = f"sqrt(-2 * ln({unit(chr(39) + '0' + chr(39), chr(39) + 'a' + chr(39), 'compound', 'receptor', 'draw')})) * cos(6.283185307179586 * {unit(chr(39) + '0' + chr(39), chr(39) + 'b' + chr(39), 'compound', 'receptor', 'draw')})"
_U = unit("'0'", "'drive'", "draw")
SQL["ensemble_intervals"] = f"""WITH {_TYPICAL}, j AS (SELECT compound, receptor, direction, n, draw, v * CASE WHEN draw > 0 THEN pow(10, 0.3 * {_Z}) ELSE 1 END AS v FROM ty, range(13) t(draw)),
e AS (SELECT compound, draw, c, receptor, direction, pow(c, n) / (pow(v, n) + pow(c, n)) AS engagement FROM j, (SELECT unnest([1e-7, 1e-6]::DOUBLE[]) AS c)), ga AS MATERIALIZED (SELECT *, compound || '|' || draw || '|' || c AS arm FROM ({gains('e', 'compound, draw, c')})),
{run('ga', 'x', hz=f"CASE WHEN superclass = 'sensory' THEN 40.0 * CASE WHEN draw > 0 THEN 1 + 0.1 * (2 * {_U} - 1) ELSE 1 END ELSE 0 END")},
o AS (SELECT compound, c, draw, superclass, r, g_ach, g_gaba FROM x10 JOIN ga USING (arm) JOIN ond USING (body_id)),
v AS (SELECT compound, c, draw, 'mean_hz' AS readout, avg(r) AS y FROM o GROUP BY ALL UNION ALL SELECT compound, c, draw, superclass || '_hz', avg(r) FROM o WHERE superclass IN ('motor', 'visual') GROUP BY ALL UNION ALL SELECT compound, c, draw, 'g_ach', g_ach FROM ga UNION ALL SELECT compound, c, draw, 'g_gaba', g_gaba FROM ga),
k AS (SELECT *, row_number() OVER (PARTITION BY compound, c, readout ORDER BY y) AS k FROM v WHERE draw > 0), l AS (SELECT compound, c, readout, count(*) AS n, avg(y) AS mean, stddev_samp(y) AS sd, max(y) FILTER (k = 1) AS low, max(y) FILTER (k = 12) AS high FROM k GROUP BY ALL)
SELECT compound, round(c * 1e9, 6) AS conc_nm, readout, round(y, 6) AS nominal, round(mean, 6) AS mean, round(sd, 6) AS sd, round(low, 6) AS low, round(high, 6) AS high, n FROM l JOIN v USING (compound, c, readout) WHERE draw = 0"""

_MIX = f"""{_TYPICAL}, gr AS (SELECT a || '+' || b || '@' || x AS mixture, unnest([a, b]) AS compound, x::DOUBLE * 1e-9 AS c FROM (SELECT unnest([('agonist', 'antagonist'), ('agonist', 'inhibitor'), ('antagonist', 'inhibitor')]) AS p), (SELECT unnest(['100', '1000']) AS x), LATERAL (SELECT p[1] AS a, p[2] AS b)),
co AS (SELECT mixture AS arm, ty.*, c FROM gr JOIN ty USING (compound) UNION ALL SELECT mixture || '~' || compound, ty.*, c FROM gr JOIN ty USING (compound)),
si AS (SELECT arm, receptor, compound, direction, pow(c / v, n) AS a FROM co), fa AS (SELECT arm, receptor, sum(a) AS total, coalesce(sum(a) FILTER (direction = 'agonist'), 0) AS up, count(DISTINCT compound) AS shared, arg_min(direction, compound) FILTER (direction <> 'agonist') AS off_ FROM si GROUP BY ALL),
mi AS (SELECT arm, receptor, shared, CASE WHEN up > total - up THEN 'agonist' ELSE off_ END AS direction, CASE WHEN up > total - up THEN up ELSE total - up END / (1 + total) AS engagement FROM fa),
ar AS MATERIALIZED ({gains('mi', 'arm')} UNION ALL SELECT 'vehicle', 1, 1, 1, 1, 1, 1)"""
SQL["mixture_assays"] = f"""WITH {_MIX}, {run('ar', 'x')}, d AS (SELECT a.arm, least(avg(abs(a.r - v.r)) / avg(v.r), 1) AS y FROM x10 a JOIN x10 v ON v.arm = 'vehicle' AND a.body_id = v.body_id WHERE a.arm <> 'vehicle' GROUP BY 1),
s AS (SELECT mixture, list(y ORDER BY compound) AS y FROM gr JOIN d ON d.arm = mixture || '~' || compound GROUP BY 1), m AS (SELECT mixture, s.y[1] AS a, s.y[2] AS b, d.y AS o, CASE WHEN greatest(s.y[1], s.y[2]) < 0.9 AND greatest(s.y[1], s.y[2]) >= 0.001 THEN 1 - (1 - s.y[1]) * (1 - s.y[2]) END AS x FROM s JOIN d ON d.arm = mixture)
SELECT mixture, round(a, 6) AS effect_1, round(b, 6) AS effect_2, round(o, 6) AS observed, round(x, 6) AS expected, round(o - x, 6) AS delta, (SELECT count(*) FROM mi WHERE mi.arm = m.mixture AND shared > 1) AS shared_receptors, CASE WHEN x IS NULL THEN 'inconclusive' WHEN o - x > 0.05 THEN 'synergistic' WHEN o - x < -0.05 THEN 'antagonistic' ELSE 'additive' END AS verdict FROM m"""

_LEVELS = "lv AS (SELECT superclass, receptor, level FROM (SELECT (['sensory', 'central', 'motor', 'visual'])[p_size % 4 + 1] AS superclass, (['nAChR', 'RDL', 'GluCl'])[p_partkey % 3 + 1] AS receptor, ([1.0, 0.6, 0.25, 0.0, NULL]::DOUBLE[])[count(*) % 5 + 1] AS level FROM part GROUP BY ALL) WHERE level IS NOT NULL)"
_OF = "CASE nt WHEN 'acetylcholine' THEN 'nAChR' WHEN 'gaba' THEN 'RDL' WHEN 'glutamate' THEN 'GluCl' END"
_TREATED = "tr AS (SELECT 'vehicle' AS arm, 1.0::DOUBLE AS g_ach, 1.0::DOUBLE AS g_gaba, 1.0::DOUBLE AS g_glu, 1.0::DOUBLE AS g_oct, 1.0::DOUBLE AS g_nav, 1.0::DOUBLE AS ach_tone UNION ALL SELECT 'treated', 0.4, 0.7, 1.5, 1.3, 1, 1.2)"
SQL["expression_rates"] = f"""WITH {OE}, {_LEVELS}, {_TREATED}, {run('tr', 'x')}, ye AS MATERIALIZED (SELECT xw.*, CASE WHEN {_OF.replace('CASE nt', 'CASE xw.nt')} IS NULL THEN 0 ELSE coalesce(level, 1) END AS level FROM xw JOIN ond o ON o.body_id = xw.post LEFT JOIN lv ON lv.superclass = o.superclass AND lv.receptor = {_OF.replace('CASE nt', 'CASE xw.nt')}),
{steps_over('ye', 'xn', 'y', 10, "(1 + (g - 1) * level)")}
SELECT v.body_id, round(v.r, 6) AS vehicle, round(u.r, 6) AS uniform, round(y10.r, 6) AS weighted, round(y10.r - u.r, 6) AS delta FROM x10 v JOIN x10 u ON u.arm = 'treated' AND u.body_id = v.body_id JOIN y10 ON y10.arm = 'treated' AND y10.body_id = v.body_id WHERE v.arm = 'vehicle'"""
SQL["expression_coverage"] = f"""WITH {OE}, {_LEVELS}, t AS (SELECT unnest([('nAChR', 'acetylcholine'), ('RDL', 'gaba'), ('GluCl', 'glutamate')]) AS p), a AS (SELECT body_id, ond.superclass, p[1] AS receptor, p[2] AS tn, level IS NOT NULL AS has FROM ond CROSS JOIN t LEFT JOIN lv ON lv.superclass = ond.superclass AND lv.receptor = p[1]),
w AS (SELECT post, nt, sum(weight) AS w FROM oe JOIN ond ON body_id = pre WHERE post IN (SELECT body_id FROM ond) GROUP BY ALL)
SELECT receptor, count(*) AS nodes, count(*) FILTER (has) AS known, round(count(*) FILTER (has) / count(*), 6) AS node_share, round(coalesce(sum(w) FILTER (has), 0) / sum(w), 6) AS weight_share FROM a LEFT JOIN w ON post = body_id AND nt = tn GROUP BY 1"""

_GS = ("g_ach", "g_gaba", "g_glu", "g_oct", "g_nav")
_WHICH = f"floor({unit(chr(39) + '0' + chr(39), chr(39) + 'which' + chr(39), 'draw', 'arm')} * (5 - 1e-6))"
_SOME = lambda g, kind: f"(0.05 + 1.95 * {unit(chr(39) + '0' + chr(39), repr(kind), repr(g), 'draw', 'arm')})"
SQL["composition_reference"] = f"""WITH {HEAVY}, {OE}, {typical(1e-8, 1e-7, 1e-6, 1e-5)}, ce AS (SELECT * EXCLUDE (theta), draw FROM cell, range(5) t(draw)),
lo AS (SELECT draw, arm, unnest({list(_GS)}) AS gain, unnest([g_ach * ach_tone, g_gaba, g_glu, g_oct, g_nav]) AS y FROM ce), pl AS (SELECT draw, arm, gain, row_number() OVER (PARTITION BY draw, gain ORDER BY {hashed("'0'", "'shuffled'", "gain", "draw", "arm")}, arm) AS k FROM lo), he_ AS (SELECT draw, gain, y, row_number() OVER (PARTITION BY draw, gain ORDER BY arm) AS k FROM lo),
sh AS (SELECT draw, arm, {', '.join(f"max(y) FILTER (gain = '{g}') AS {g}" for g in _GS)} FROM pl JOIN he_ USING (draw, gain, k) GROUP BY ALL),
al AS MATERIALIZED (SELECT kind || '|' || draw || '|' || arm AS own, * FROM (SELECT 'dense' AS kind, draw, arm, {', '.join(f"{_SOME(g, 'dense')} AS {g}" for g in _GS)}, 1.0::DOUBLE AS ach_tone FROM ce
  UNION ALL SELECT 'sparse', draw, arm, {', '.join(f"CASE WHEN {_WHICH} = {i} THEN {_SOME(g, 'sparse')} ELSE 1 END" for i, g in enumerate(_GS))}, 1 FROM ce UNION ALL SELECT 'shuffled', draw, arm, {', '.join(_GS)}, 1 FROM sh UNION ALL SELECT 'real', 0, arm, {', '.join(_GS)}, ach_tone FROM cell)),
ar AS MATERIALIZED (SELECT own AS arm, {', '.join(_GS)}, ach_tone FROM al UNION ALL SELECT 'vehicle', 1, 1, 1, 1, 1, 1), {run('ar', 'x')},
m AS (SELECT arm, avg(r) AS hz FROM x10 WHERE body_id IN (SELECT body_id FROM ond WHERE superclass = 'motor') GROUP BY 1), f AS (SELECT arm AS own, round(hz - (SELECT hz FROM m WHERE arm = 'vehicle'), 6) AS f FROM m),
c AS (SELECT kind, draw, own, round(sum({_SIGN} * ({GAIN} - 1) * k) / (SELECT count(*) FROM ond), 6) AS c FROM al CROSS JOIN (SELECT nt, count(*) AS k FROM ond GROUP BY 1) GROUP BY ALL),
z AS (SELECT kind, draw, rank() OVER (PARTITION BY kind, draw ORDER BY c) + (count(*) OVER (PARTITION BY kind, draw, c) - 1) / 2 AS rc, rank() OVER (PARTITION BY kind, draw ORDER BY f) + (count(*) OVER (PARTITION BY kind, draw, f) - 1) / 2 AS rf FROM c JOIN f USING (own)),
h AS MATERIALIZED (SELECT kind, draw, count(*) AS n, corr(rc, rf) AS rho FROM z GROUP BY ALL), p AS (SELECT kind, avg((round(rho, 9) <= (SELECT round(rho, 9) FROM h WHERE kind = 'real'))::INT) AS percentile FROM h WHERE kind <> 'real' GROUP BY 1)
SELECT kind, draw, n, round(rho, 6) AS rho, round(percentile, 6) AS percentile FROM h LEFT JOIN p USING (kind)"""

_SHAPED = """CASE shape WHEN 'linear' THEN 1 + 0.4 * k * t WHEN 'saturating' THEN 1 + 0.4 * k * 1.25 * t / (0.25 + t) WHEN 'weak_biphasic' THEN 1 + 0.4 * k * t - 0.8 * k * t * t WHEN 'default_biphasic' THEN 1 + 0.4 * k * t - 1.6 * k * t * t ELSE 1 + 0.4 * k * t - 3.2 * k * t * t END"""
_SPECS = f"""{_TYPICAL}, te2 AS (SELECT compound, receptor, direction, pow(1e-6, n) / (pow(v, n) + pow(1e-6, n)) AS engagement FROM ty), g0 AS ({gains('te2', 'compound')}),
sp AS (SELECT shape, k, shape || '@' || CASE WHEN k = 1 THEN '1' ELSE k::VARCHAR END AS spec FROM (SELECT unnest(['linear', 'saturating', 'weak_biphasic', 'default_biphasic', 'strong_biphasic']) AS shape), (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5]::DOUBLE[]) AS k)),
ow AS (SELECT compound, engagement AS t FROM te2 WHERE receptor = 'insect_nAChR' AND direction = 'agonist'),
ar AS MATERIALIZED (SELECT spec || '|' || g0.compound AS arm, spec, g0.compound, CASE WHEN t IS NULL THEN g_ach ELSE greatest(0.05, least(10, {_SHAPED})) END AS g_ach, g_gaba, g_glu, g_oct, g_nav, ach_tone FROM g0 CROSS JOIN sp LEFT JOIN ow ON ow.compound = g0.compound UNION ALL SELECT 'vehicle', NULL, NULL, 1, 1, 1, 1, 1, 1),
{weights_dealt('oe', 9, 'wd')}, ge AS MATERIALIZED (SELECT draw, pre, post, weight FROM wd UNION ALL SELECT -1, pre, post, weight FROM oe),
gn AS MATERIALIZED (SELECT draw, arm, body_id, nt, {GAIN} AS g, g_nav AS nav, {_HZ} AS hz FROM ond CROSS JOIN ar, range(-1, 9) t(draw)), {steps('ge', 'gn', 'x', 10, 'draw, ')},
mo AS (SELECT draw, arm, avg(r) AS hz FROM x10 WHERE body_id IN (SELECT body_id FROM ond WHERE superclass = 'motor') GROUP BY ALL), ef AS (SELECT a.draw, a.arm, a.hz - v.hz AS effect, v.hz AS vehicle FROM mo a JOIN mo v ON v.arm = 'vehicle' AND v.draw = a.draw WHERE a.arm <> 'vehicle'),
nu AS (SELECT a.arm, a.effect, b.effect AS real, b.vehicle, avg(a.effect) OVER (PARTITION BY a.arm) AS c FROM ef a JOIN ef b ON a.arm = b.arm AND b.draw = -1 WHERE a.draw >= 0),
lg AS MATERIALIZED (SELECT spec, compound, max(real) AS real, max(vehicle) AS vehicle, quantile_cont(effect, 0.5) AS med, (count(*) FILTER (abs(round(effect - c, 9)) >= abs(round(real - c, 9))) + 1) / (count(*) + 1) AS p, max(g_ach) AS g FROM nu JOIN ar USING (arm) GROUP BY ALL),
wi AS (SELECT spec, max(vehicle) AS vehicle, {', '.join(f"max({c}) FILTER (compound = '{k}') AS {n}_{k}" for k in ('agonist', 'antagonist', 'inhibitor') for n, c in (('effect', 'real'), ('p', 'p'), ('median', 'med'), ('g', 'g')))} FROM lg GROUP BY 1),
de AS MATERIALIZED (SELECT spec, unnest([{{'c': 'agonist_lowers', 'h': effect_agonist < 0}}, {{'c': 'antagonist_lowers', 'h': effect_antagonist < 0}}, {{'c': 'agonist_beats_antagonist', 'h': abs(effect_agonist) > abs(effect_antagonist)}}, {{'c': 'agonist_needs_wiring', 'h': p_agonist <= 0.1}},
  {{'c': 'inhibitor_within_nulls', 'h': p_inhibitor > 0.1 AND abs(effect_inhibitor - median_inhibitor) < 0.05 * vehicle}}, {{'c': 'agonist_desensitises', 'h': CASE WHEN g_agonist > 0.05 THEN g_agonist < 1 END}}]) AS x FROM wi)"""
SQL["conclusion_stability"] = f"""WITH {_SPECS} SELECT x.c AS conclusion, count(*) AS n, count(*) FILTER (x.h) AS retained, count(*) FILTER (NOT x.h) AS lost, count(*) FILTER (x.h IS NULL) AS undecidable, round(count(*) FILTER (x.h) / count(*), 6) AS share,
round(count(*) FILTER (x.h) / nullif(count(*) FILTER (x.h IS NOT NULL), 0), 6) AS share_decidable, coalesce(string_agg(spec, ',' ORDER BY spec) FILTER (NOT x.h), '') AS failing, count(*) FILTER (x.h) < count(*) AS fragile FROM de GROUP BY 1"""
SQL["conclusion_breakdown"] = f"""WITH {_SPECS}, lb AS (SELECT CASE compound WHEN 'agonist' THEN 'agonist_needs_wiring' ELSE 'inhibitor_within_nulls' END AS conclusion, spec, CASE WHEN p <= 0.1 THEN 'distinguishable' WHEN abs(real - med) < 0.05 * abs(vehicle) THEN 'equivalent_within_tolerance' ELSE 'indeterminate' END AS label FROM lg WHERE compound IN ('agonist', 'inhibitor'))
SELECT conclusion, label, count(*) AS n, count(*) FILTER (x.h) AS retained FROM lb JOIN de ON de.spec = lb.spec AND de.x.c = conclusion GROUP BY ALL"""

_CUTS, _P, _UPTO = [], 0.36787944117144233, 0.0
for _k in range(16):
    _UPTO, _P = _UPTO + _P, _P / (_k + 1)
    _CUTS.append(_UPTO)
SQL["index_intervals"] = f"""WITH l AS (SELECT l_linenumber::INT AS factor, l_orderkey, l_partkey, l_extendedprice AS a, 1500 * l_quantity AS b, l_extendedprice * (1 - l_discount) AS ab FROM lineitem),
u AS (SELECT *, {unit("'0'", "draw", "factor", "l_orderkey", "l_partkey")} AS u FROM l, range(1, 21) t(draw)), w AS (SELECT *, {' + '.join(f'(u > {c!r}::DOUBLE)::INT' for c in _CUTS)} AS w FROM u),
g AS (SELECT factor, draw, sum(w) AS n, sum(w * (a + b)) AS s, sum(w * (a * a + b * b)) AS q, sum(w * pow(b - ab, 2)) AS db, sum(w * pow(a - ab, 2)) AS da FROM w WHERE w > 0 GROUP BY ALL),
v AS (SELECT *, (q - s * s / (2 * n)) / (2 * n - 1) AS v FROM g), e AS (SELECT factor, 1 - db / (2 * n * v) AS f, da / (2 * n * v) AS t FROM v WHERE v > 0),
i AS (SELECT factor, quantile_cont(f, 0.025) AS fl, quantile_cont(f, 0.975) AS fh, quantile_cont(t, 0.025) AS tl, quantile_cont(t, 0.975) AS th FROM e GROUP BY 1),
y AS (SELECT factor, var_samp(y) AS v FROM (SELECT factor, unnest([a, b]) AS y FROM l) GROUP BY 1), j AS (SELECT factor, 1 - sum(pow(b - ab, 2)) / (2 * count(*)) / max(v) AS f, sum(pow(a - ab, 2)) / (2 * count(*)) / max(v) AS t FROM l JOIN y USING (factor) GROUP BY 1),
z AS (SELECT greatest(coalesce(max(abs(f)) FILTER (factor = 7), 0), coalesce(max(-f) FILTER (f < 0), 0)) AS z FROM j)
SELECT factor, round(f, 6) AS first, round(t, 6) AS total, round(fl, 6) AS first_low, round(fh, 6) AS first_high, round(tl, 6) AS total_low, round(th, 6) AS total_high, CASE WHEN factor = 7 THEN 'null control' WHEN fl > 0 OR fh < 0 THEN 'resolved' WHEN abs(f) <= z THEN 'null control' ELSE 'unresolved' END AS state FROM j JOIN i USING (factor), z"""

_LADDER = f"""{OE}, bo AS MATERIALIZED (SELECT pre AS a, post AS b, weight FROM oe UNION ALL SELECT post, pre, weight FROM oe), r0 AS MATERIALIZED (SELECT pre AS id, 0 AS ring, 0.0::DOUBLE AS pull FROM oe WHERE pre IN (SELECT body_id FROM ond) GROUP BY pre ORDER BY round(sum(weight), 6) DESC, pre LIMIT 3)"""
for _i in range(1, 4):
    _LADDER += f", r{_i} AS MATERIALIZED (SELECT * FROM r{_i - 1} UNION ALL SELECT b, {_i}, sum(weight) FROM bo JOIN r{_i - 1} ON a = id WHERE b NOT IN (SELECT id FROM r{_i - 1}) GROUP BY b)"
_LADDER += """, pl AS (SELECT *, row_number() OVER (ORDER BY ring, round(pull, 6) DESC, id) AS place FROM r3), no AS MATERIALIZED (SELECT id, ring, CASE WHEN place <= 60 THEN 60 WHEN place <= 120 THEN 120 ELSE 240 END AS rung FROM pl WHERE place <= 240),
ed AS MATERIALIZED (SELECT pre, post, weight, greatest(x.rung, y.rung) AS rung FROM oe JOIN no x ON x.id = pre JOIN no y ON y.id = post)"""
SQL["ladder_rungs"] = f"""WITH {_LADDER}, e AS (SELECT rung, count(*) AS edges, round(sum(weight), 6) AS weight FROM ed GROUP BY 1) SELECT rung, count(*) AS nodes, max(ring) AS ring, sum(id)::BIGINT AS ids, max(edges) AS edges, max(weight) AS weight FROM no LEFT JOIN e USING (rung) GROUP BY 1"""
SQL["profile_over_scale"] = f"""WITH {_LADDER}, bu AS (SELECT unnest([60, 120, 240]) AS budget), be AS MATERIALIZED (SELECT budget, pre, post, weight FROM ed JOIN bu ON rung <= budget), bn AS MATERIALIZED (SELECT budget, body_id, nt, CASE WHEN body_id IN (SELECT id FROM r0) THEN 40.0::DOUBLE ELSE 0 END AS hz FROM no JOIN ond ON body_id = id JOIN bu ON rung <= budget),
si AS (SELECT budget, count(*) AS n_edges, sum(weight) AS weight, least(greatest(floor(round(0.5 / 3 / (1.09e-2 + 6.86e-6 * count(*)), 6)), 9), 15)::INT AS draws FROM be GROUP BY 1),
pa AS (SELECT *, row_number() OVER (PARTITION BY budget, draw ORDER BY {hashed("'0'", "budget", "draw", "pre", "post")}, pre, post) AS k FROM be, range(15) t(draw)), ph AS (SELECT budget, weight, row_number() OVER (PARTITION BY budget ORDER BY pre, post) AS k FROM be),
ge AS MATERIALIZED (SELECT budget, draw, pre, post, ph.weight FROM pa JOIN ph USING (budget, k) JOIN si USING (budget) WHERE draw < draws UNION ALL SELECT budget, -1, pre, post, weight FROM be),
gn AS MATERIALIZED (SELECT budget, draw, arm, body_id, nt, CASE WHEN arm = 'treated' THEN CASE nt WHEN 'acetylcholine' THEN 0.4 WHEN 'gaba' THEN 0.7 ELSE 1 END ELSE 1 END::DOUBLE AS g, 1.0::DOUBLE AS nav, hz FROM bn JOIN si USING (budget), range(-1, 15) t(draw), (SELECT unnest(['vehicle', 'treated']) AS arm) WHERE draw < draws),
{steps('ge', 'gn', 'x', 10, 'budget, draw, ')}, f AS (SELECT budget, draw, avg(r) FILTER (arm = 'treated') - avg(r) FILTER (arm = 'vehicle') AS effect, avg(r) FILTER (arm = 'vehicle') AS vehicle FROM x10 GROUP BY ALL),
h AS (SELECT a.budget, a.effect, b.effect AS real, b.vehicle, avg(a.effect) OVER (PARTITION BY a.budget) AS c FROM f a JOIN f b ON a.budget = b.budget AND b.draw = -1 WHERE a.draw >= 0)
SELECT budget, (SELECT count(*) FROM no WHERE rung <= budget) AS n_nodes, max(n_edges) AS n_edges, round(max(weight), 6) AS weight, max(draws) AS draws, round(max(real), 6) AS real, round(max(vehicle), 6) AS vehicle, round(quantile_cont(effect, 0.5), 6) AS null_median, round((count(*) FILTER (abs(round(effect - c, 9)) >= abs(round(real - c, 9))) + 1) / (count(*) + 1), 9) AS p FROM h JOIN si USING (budget) GROUP BY budget"""

_KEY = lambda *k: "".join(f'.{{"key":"{x}"}}' for x in k)
SQL["stable_digests"] = f"""SELECT c_custkey, sha256(list_aggregate(list_sort(['$={{}}', '${_KEY("id")}=' || c_custkey, '${_KEY("run")}={{}}', '${_KEY("run", "state")}="a"', '${_KEY("tags")}=[]', '${_KEY("tags")}[0]="' || c_mktsegment || '"', '${_KEY("tags")}[1]="x"']), 'string_agg', chr(10))) AS digest, true AS agree FROM customer"""
SQL["order_rates"] = f"""WITH {OE}, tr AS (SELECT 'vehicle' AS arm, 1.0::DOUBLE AS g_ach, 1.0::DOUBLE AS g_gaba, 1.0::DOUBLE AS g_glu, 1.0::DOUBLE AS g_oct, 1.0::DOUBLE AS g_nav, 1.0::DOUBLE AS ach_tone UNION ALL SELECT 'treated', 0.4, 0.7, 1, 1, 1, 1.2), {run('tr', 'x', 80)}
SELECT superclass, arm, count(*) AS n, round(avg(r), 6) AS mean_hz, round(max(r), 6) AS max_hz FROM x80 JOIN ond USING (body_id) GROUP BY ALL"""


_ZA, _ZB = (f"{NormalDist().inv_cdf(x)}::DOUBLE" for x in (0.975, 0.8))
_DRAWN = f"{_TYPICAL}, j AS (SELECT compound, receptor, direction, n, draw, v * pow(10, 0.3 * {_Z}) AS v FROM ty, range(1, 7) t(draw)), e AS MATERIALIZED (SELECT compound, draw, receptor, direction, v, pow(1e-6, n) / (pow(v, n) + pow(1e-6, n)) AS engagement FROM j)"
_ASKED = """hy AS (SELECT * FROM (VALUES ('h1', 'antagonist', 'gap', '', NULL, 'increase', 'c'), ('h2', 'agonist', 'v', 'mean_hz', NULL, 'decrease', 'per'), ('h3', 'antagonist', 'v', 'mean_hz', NULL, 'increase', 'c'), ('h4', 'inhibitor', 'v', 'visual_hz', NULL, 'none', 'per'),
('h5', 'vehicle', 'w', 'motor_hz', 'visual_hz', 'decrease', 'per'), ('h6', 'agonist', 'w', 'motor_hz', 'visual_hz', 'increase', 'c'), ('h7', 'unlisted', 'v', 'mean_hz', NULL, 'decrease', 'per')) t(h, compound, kind, readout, minus, direction, endpoint))"""
SQL["predictions"] = f"""WITH {_DRAWN}, ga AS MATERIALIZED (SELECT *, compound || '|' || draw AS arm FROM ({gains('e', 'compound, draw')} UNION ALL SELECT 'vehicle', draw, 1, 1, 1, 1, 1, 1 FROM range(1, 7) t(draw))),
{run('ga', 'x', hz=f"CASE WHEN superclass = 'sensory' THEN 40.0 * (1 + 0.1 * (2 * {_U} - 1)) ELSE 0 END")}, {_ASKED},
o AS (SELECT compound, draw, superclass, r FROM x10 JOIN ga USING (arm) JOIN ond USING (body_id)), v AS MATERIALIZED (SELECT compound, draw, 'mean_hz' AS readout, avg(r) AS y FROM o GROUP BY ALL UNION ALL SELECT compound, draw, superclass || '_hz', avg(r) FROM o WHERE superclass IN ('motor', 'visual') GROUP BY ALL),
pr AS (SELECT i.compound, i.draw, arg_max(i.engagement - w.engagement, w.v / i.v) AS gap FROM e i JOIN e w ON i.compound = w.compound AND i.draw = w.draw AND i.receptor LIKE 'insect!_%' ESCAPE '!' AND w.receptor = replace(i.receptor, 'insect_', 'vertebrate_') GROUP BY ALL),
ef AS (SELECT h, a.y AS t, b.y AS o, a.y - b.y AS f FROM hy JOIN v a ON a.compound = hy.compound AND a.readout = hy.readout JOIN v b ON b.draw = a.draw AND b.compound = CASE WHEN kind = 'w' THEN hy.compound ELSE 'vehicle' END AND b.readout = CASE WHEN kind = 'w' THEN minus ELSE hy.readout END WHERE kind <> 'gap' UNION ALL SELECT h, gap, NULL, gap FROM hy JOIN pr USING (compound) WHERE kind = 'gap'),
s AS (SELECT h, count(*) AS n, avg(f) AS effect, stddev_samp(f) AS sd, avg(t) AS treated, avg(o) AS other FROM ef GROUP BY 1),
m AS (SELECT *, CASE WHEN round(sd, 12) > 0 THEN effect / sd END AS d, CASE WHEN abs(other) > 1e-12 THEN abs(effect / other) END AS relative, CASE WHEN effect > 1e-9 THEN 'increase' WHEN effect < -1e-9 THEN 'decrease' WHEN effect IS NOT NULL THEN 'none' END AS observed FROM hy LEFT JOIN s USING (h)),
q AS (SELECT *, 0.8::DOUBLE * (1 - least(greatest(relative, 0.05), 0.5)) AS p2, CASE WHEN d IS NOT NULL THEN least(abs(d), 1) END AS dd FROM m)
SELECT h, coalesce(n, 0) AS n, round(effect, 6) AS effect, round(sd, 6) AS sd, round(effect - 1.959963985 * sd / sqrt(n), 6) AS low, round(effect + 1.959963985 * sd / sqrt(n), 6) AS high, round(treated, 6) AS treated, round(other, 6) AS other, round(relative, 6) AS relative, round(d, 4) AS d, observed, coalesce(observed = direction, false) AS matches,
CASE WHEN endpoint = 'per' AND relative > 0 THEN ceil(round(pow(({_ZA} * sqrt((0.8 + p2) * (1 - (0.8 + p2) / 2)) + {_ZB} * sqrt(0.16 + p2 * (1 - p2))) / (0.8 - p2), 2), 6)) WHEN dd > 1e-9 THEN ceil(round(2 * pow(({_ZA} + {_ZB}) / dd, 2), 6)) END::BIGINT AS per_group FROM q"""

_CLAIMS = f"""{engaged()}, li AS (SELECT l_partkey, round(avg(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1),
cl AS MATERIALIZED (SELECT *, CASE WHEN entry % 5 <> 0 THEN receptor END AS target, CASE WHEN entry % 4 = 1 AND entry % 7 <> 0 THEN s % 3 + 1 END AS rank, CASE WHEN s % 11 <> 0 AND entry % 7 <> 0 THEN price END AS value, entry % 3 = 0 AS falling FROM (SELECT ev.*, p_size AS s, pos // 6 AS entry, price FROM ev JOIN part ON p_partkey = pos LEFT JOIN li ON l_partkey = pos)),
rc AS (SELECT entry, e.receptor, count(DISTINCT c.compound) AS k, count(DISTINCT c.compound) FILTER (value_m IS NOT NULL) AS a, avg(log10(value_m)) AS m FROM (SELECT DISTINCT entry, compound FROM cl) c JOIN ev e USING (compound) GROUP BY ALL),
re AS MATERIALIZED (SELECT entry, coalesce((SELECT max(receptor) FROM rc WHERE rc.entry = x.entry AND x.entry % 10 = 0 AND receptor = 'insect_RDL' AND k >= 2), (SELECT receptor FROM rc WHERE rc.entry = x.entry AND a > 0 AND starts_with(receptor, CASE WHEN x.entry % 2 = 0 THEN 'insect_' ELSE 'vertebrate_' END) ORDER BY a DESC, round(m, 9), receptor LIMIT 1)) AS receptor FROM (SELECT DISTINCT entry FROM cl) x)"""
_AGREED = f"""{_CLAIMS}, sc AS (SELECT compound, receptor, arg_max_null(engagement, pos) AS y FROM en GROUP BY ALL), ln AS (SELECT cl.entry, cl.pos, cl.compound, coalesce(cl.target, re.receptor) AS receptor, rank, value, s, falling FROM cl JOIN re USING (entry)),
wr AS (SELECT entry, count(*) AS n, count(rank) AS k, count(DISTINCT rank) AS dk, count(value) AS v, bool_and(value IS NOT NULL OR s % 2 = 0) AS told, min(value) AS lo, max(value) AS hi, count(*) FILTER (s % 2 <> 0) AS ve FROM ln GROUP BY 1),
so AS (SELECT *, CASE WHEN n < 2 THEN 'few' WHEN k = n AND dk = 1 THEN 'tied' WHEN k = n THEN 'published_rank' WHEN v >= 2 AND told THEN 'published_value' WHEN entry % 7 = 0 AND ve > 0 AND ve < n THEN 'direction_selectivity' ELSE 'none' END AS src FROM wr),
pu AS (SELECT l.entry, l.pos, src, round(y, 12) AS y, CASE src WHEN 'published_rank' THEN rank WHEN 'direction_selectivity' THEN CASE WHEN s % 2 = 0 THEN 1 ELSE 2 END WHEN 'published_value' THEN CASE WHEN falling THEN -coalesce(value, lo / 10) ELSE coalesce(value, hi * 10) END END::DOUBLE AS key FROM ln l JOIN so USING (entry) LEFT JOIN sc ON sc.compound = l.compound AND sc.receptor = l.receptor),
sk AS (SELECT entry, count(*) AS n, max(src) AS order_source, CASE WHEN count(key) < count(*) THEN 'no_order' WHEN count(y) < count(*) THEN 'no_score' WHEN min(y) = max(y) THEN 'same_scores' END AS skipped FROM pu GROUP BY 1),
rk AS (SELECT entry, pos, y, CASE WHEN src = 'published_value' THEN rank() OVER (PARTITION BY entry ORDER BY key) + (count(*) OVER (PARTITION BY entry, key) - 1) / 2 ELSE key END AS a, rank() OVER (PARTITION BY entry ORDER BY y DESC) + (count(*) OVER (PARTITION BY entry, y) - 1) / 2 AS b FROM pu JOIN sk USING (entry) WHERE skipped IS NULL),
rh AS (SELECT entry, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS rho, bool_and(abs(a - b) < 1e-6) AS exact FROM rk GROUP BY 1),
ta AS (SELECT x.entry, sum(sign(x.a - z.a) * sign(x.b - z.b)) / sqrt(sum(abs(sign(x.a - z.a))) * sum(abs(sign(x.b - z.b)))) AS tau FROM rk x JOIN rk z ON x.entry = z.entry AND x.pos < z.pos GROUP BY 1),
al AS (SELECT entry, n, order_source, skipped, rho, tau, exact FROM sk LEFT JOIN rh USING (entry) LEFT JOIN ta USING (entry))"""
SQL["published_orders"] = f"WITH {_AGREED} SELECT entry, n, order_source, skipped, round(rho, 6) AS rho, round(tau, 6) AS tau, exact FROM al"
SQL["claimed_receptors"] = f"WITH {_CLAIMS} SELECT entry, receptor FROM re"
SQL["validation_summary"] = f"WITH {_AGREED} SELECT 'occupancy' AS assay, count(*) AS entries, count(*) FILTER (skipped IS NULL) AS evaluated, count(skipped) AS skipped, count(*) FILTER (exact) AS exact, round(avg(rho), 6) AS mean_rho FROM al"
