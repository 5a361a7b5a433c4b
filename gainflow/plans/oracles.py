"""DuckDB SQL of the catalogue's queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from ..functions import dims, pharm

SQL: dict[str, str] = {}


def values(rows, names: str) -> str:
    def one(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x).lower() if isinstance(x, bool) else f"'{x}'"
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


def listed(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


MODELS = values([(p, r, d, dims.model_of(p, d)) for p in dims.CEILING for r, d in dims.DISTANCE.items()], "param_type, relation, distance, model")
KEYS = [f"insect_{r}" for r in dims.RECEPTORS] + [f"vertebrate_{r}" for r in dims.RECEPTORS]
EV = f"""ev AS (SELECT p_partkey AS pos, p_partkey // 4 AS compound, ({listed(KEYS)})[(p_partkey * 7 + p_size) % 12 + 1] AS receptor,
  ({listed(list(dims.CEILING)[:5] + list(dims.CEILING)[7:])})[p_size % 6 + 1] AS param_type, ({listed(dims.DISTANCE)})[p_partkey % 5 + 1] AS relation,
  CASE WHEN p_size % 7 <> 0 THEN p_retailprice * 1e-9 END AS value_m, 1 + p_size % 5 * 0.1::DOUBLE AS n, (['agonist', 'antagonist', 'inhibitor'])[p_size % 3 + 1] AS direction FROM part)"""
EM = f"{EV}, em AS (SELECT ev.*, distance, model FROM ev JOIN (SELECT * FROM {MODELS}) USING (param_type, relation))"


def engaged(*doses: float) -> str:
    doses = doses or (1e-6,)
    return f"""{EM}, en AS (SELECT em.*, conc_m, CASE WHEN model = 'not_modelled' OR value_m IS NULL THEN NULL WHEN conc_m = 0 THEN 0.0::DOUBLE
      ELSE pow(conc_m, n) / (pow(value_m, n) + pow(conc_m, n)) END AS engagement FROM em CROSS JOIN (SELECT c::DOUBLE AS conc_m FROM {values([(d,) for d in doses], 'c')}))"""


SQL["engagement_at_dose"] = f"WITH {engaged()} SELECT pos, compound, receptor, distance, model, round(engagement, 9) AS engagement FROM en"
SQL["engagement_curve"] = f"""WITH {engaged(0.0, 1e-7, 1e-6, 1e-5, 1e-4)}, k AS (SELECT *, row_number() OVER (PARTITION BY compound, conc_m ORDER BY round(engagement, 9) DESC NULLS LAST, pos DESC) AS k FROM en)
SELECT compound, conc_m, round(max(engagement), 9) AS top, max(CASE WHEN k = 1 THEN receptor END) AS receptor, count(engagement) AS modelled FROM k GROUP BY ALL"""
SQL["evidence_rule_table"] = """WITH p AS (SELECT unnest(['Kd', 'Ki', 'EC50', 'IC50', 'Kb', 'relative_potency', 'class_order', 'unknown']) AS param_type),
d AS (SELECT * FROM (VALUES ('exact_compound_exact_receptor_exact_species', 'E0'), ('exact_compound_exact_receptor_other_species', 'E1'), ('exact_compound_related_receptor', 'E2'), ('class_extrapolation', 'E3'), ('unsupported', 'E4')) AS t(relation, distance))
SELECT param_type, relation, distance, CASE WHEN distance = 'E4' OR param_type IN ('relative_potency', 'class_order', 'unknown') THEN 'not_modelled' WHEN distance = 'E0' AND param_type IN ('Kd', 'Ki') THEN 'binding_occupancy' WHEN distance = 'E0' THEN 'functional_engagement'
  WHEN distance IN ('E1', 'E2') AND param_type IN ('Kd', 'Ki') THEN 'binding_engagement_proxy' ELSE 'functional_engagement_proxy' END AS model FROM p CROSS JOIN d"""
SQL["library_census"] = f"WITH {EM} SELECT param_type, relation, distance, model, receptor, count(*) AS n, count(value_m) AS n_valued FROM em GROUP BY GROUPING SETS ((param_type), (relation), (distance), (model), (receptor), (distance, model), ())"
SQL["library_violations"] = f"""WITH {EV}, v AS (SELECT 'no_value' AS problem, compound FROM ev WHERE value_m IS NULL UNION ALL SELECT 'value_not_positive', compound FROM ev WHERE value_m <= 0
  UNION ALL SELECT 'type_without_value', compound FROM ev WHERE param_type <> 'unknown' AND value_m IS NULL UNION ALL SELECT 'value_without_type', compound FROM ev WHERE param_type = 'unknown' AND value_m IS NOT NULL
  UNION ALL SELECT 'unsupported_with_value', compound FROM ev WHERE relation = 'unsupported' AND value_m IS NOT NULL) SELECT problem, count(*) AS n, count(DISTINCT compound) AS compounds FROM v GROUP BY 1"""
SQL["inverse_hill_threshold"] = f"WITH {engaged()} SELECT compound, round(min(value_m * pow(0.2 / 0.8, 1 / n) * 1e9), 6) AS threshold_nm, count(*) AS n FROM en WHERE engagement IS NOT NULL AND receptor LIKE 'vertebrate%' GROUP BY 1"
SQL["binding_models"] = f"""WITH {EV} SELECT pos, round(pow(1e-6, n) / (pow(value_m * 3, n) + pow(1e-6, n)), 9) AS competitive, round(1 + 2e-6 / value_m, 6) AS dose_ratio,
  round(pow(3.0 * 1e-6, n) / (pow(1e-6 + value_m, n) + pow(3.0 * 1e-6, n)), 9) AS response, round(5 + 95 / (1 + pow(10.0, -n * (log10(1e-6) - log10(value_m)))), 6) AS logistic FROM ev WHERE value_m IS NOT NULL"""


def gain(g: str, receptor: str, up: tuple[float, float], down: tuple[float, float] = (-1.0, 0.0)) -> str:
    pick = f"arg_max(CASE WHEN direction = 'agonist' THEN greatest(0.05, 1 + {up[0]} * engagement - {up[1]} * engagement * engagement) ELSE greatest(0.05, 1 + {down[0]} * engagement - {down[1]} * engagement * engagement) END, pos)"
    return f"coalesce({pick} FILTER (receptor = '{receptor}' AND engagement IS NOT NULL), 1.0) AS {g}"


GAINS = f"""g0 AS (SELECT compound, conc_m, {gain('g_ach', 'insect_nAChR', (0.4, 1.6))}, {gain('g_gaba', 'insect_RDL', (0.4, 0.0))}, {gain('g_glu', 'insect_GluCl', (0.8, 0.0))}, {gain('g_oct', 'insect_OctR', (0.5, 0.0))},
  {gain('g_nav', 'insect_Nav', (1.5, 0.0))}, coalesce(max(engagement) FILTER (receptor = 'insect_AChE' AND direction <> 'agonist'), 0.0) AS x FROM en GROUP BY ALL),
gains AS (SELECT compound, conc_m, CASE WHEN x > 0 THEN greatest(0.05, g_ach * (1 + 2 * x) * (1 + 0.4 * x - 1.6 * x * x)) ELSE g_ach END AS g_ach, g_gaba, g_glu, g_oct, g_nav, 1 + 2 * x AS ach_tone FROM g0)"""
SQL["gains_pivot"] = f"WITH {engaged(1e-7, 1e-6)}, {GAINS} SELECT compound, conc_m, {', '.join(f'round({g}, 9) AS {g}' for g in dims.GAINS)} FROM gains"
_SHAPE = f"""CASE shape WHEN 'linear' THEN 1 + 0.4 * coef * t WHEN 'saturating' THEN 1 + 0.4 * coef * {1 + pharm.SATURATING_K} * t / ({pharm.SATURATING_K} + t) WHEN 'weak_biphasic' THEN 1 + 0.4 * coef * t - 0.8 * coef * t * t
  WHEN 'default_biphasic' THEN 1 + 0.4 * coef * t - 1.6 * coef * t * t ELSE 1 + 0.4 * coef * t - 3.2 * coef * t * t END"""
SQL["spec_family_gains"] = f"""WITH {engaged()}, l AS (SELECT compound, arg_max(engagement, pos) AS t FROM en WHERE receptor = 'insect_nAChR' AND direction = 'agonist' AND engagement IS NOT NULL GROUP BY 1),
s AS (SELECT shape, coef::DOUBLE AS coef FROM {values([(s, c) for s in pharm.SHAPES for c in pharm.COEFFICIENTS], 'shape, coef')}) SELECT compound, shape, coef, round(greatest(0.05, least(10.0, {_SHAPE})), 9) AS g_ach FROM l CROSS JOIN s"""
SQL["net_drive_sign"] = f"WITH {engaged()}, {GAINS} SELECT sign(round((g_ach - 1) - (g_gaba - 1) - 0.4 * (g_glu - 1) + 0.2 * (g_oct - 1) + g_nav - 1, 9))::INT AS direction, count(*) AS n FROM gains GROUP BY 1"
PAIRS = """side AS (SELECT *, string_split(receptor, '_')[1] AS organism, string_split(receptor, '_')[2] AS target, row_number() OVER (PARTITION BY compound, receptor ORDER BY pos DESC) AS k FROM en),
pairs AS (SELECT coalesce(i.compound, v.compound) AS compound, coalesce(i.target, v.target) AS target, i.engagement IS NOT NULL AND v.engagement IS NOT NULL AS known, coalesce(i.param_type = v.param_type, false) AS same,
  i.engagement AS ie, v.engagement AS ve, CASE WHEN known THEN v.value_m / i.value_m END AS ratio FROM (SELECT * FROM side WHERE k = 1 AND organism = 'insect') i FULL JOIN (SELECT * FROM side WHERE k = 1 AND organism = 'vertebrate') v ON i.compound = v.compound AND i.target = v.target)"""
SQL["pair_selectivity"] = f"""WITH {engaged()}, {PAIRS} SELECT compound, target, round(ratio, 9) AS ratio, round(log10(ratio), 9) AS log_ratio, CASE WHEN known THEN round(ie - ve, 9) END AS difference, known AND same AS comparable,
  CASE WHEN NOT known THEN 'placeholder' WHEN NOT same THEN 'mixed_param_types' END AS reason FROM pairs"""
SQL["best_pair_rules"] = f"""WITH {engaged()}, {PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY compound ORDER BY round(log10(ratio), 9) DESC, target) AS a, row_number() OVER (PARTITION BY compound ORDER BY same DESC, round(log10(ratio), 9) DESC, target) AS b FROM pairs WHERE known)
SELECT compound, max(CASE WHEN a = 1 THEN target END) AS largest, max(CASE WHEN b = 1 THEN target END) AS comparable_first, max(CASE WHEN b = 1 AND same THEN target END) AS comparable_only FROM k GROUP BY 1"""
MIX = f"{EV}, mix AS (SELECT compound // 3 AS mixture, receptor, pos, value_m, n, 1e-7 * (1 + pos % 5) AS dose FROM ev WHERE value_m IS NOT NULL)"
SQL["mixture_competition"] = f"WITH {MIX}, s AS (SELECT *, sum(dose / value_m) OVER (PARTITION BY mixture, receptor) AS a FROM mix) SELECT mixture, receptor, pos, round(dose / value_m / (1 + a), 9) AS share, round(a / (1 + a), 9) AS total FROM s"
SQL["bliss_expected"] = f"WITH {engaged()} SELECT compound, round(1 - product(1 - engagement), 9) AS expected, count(*) AS n FROM en WHERE engagement IS NOT NULL GROUP BY 1"
SQL["loewe_index"] = f"WITH {MIX}, c AS (SELECT mixture, sum(dose / (value_m * pow(0.5 / 0.5, 1 / n))) AS ci FROM mix GROUP BY 1) SELECT mixture, round(ci, 6) AS ci, CASE WHEN ci < 1 / 1.25 THEN 'synergistic' WHEN ci > 1.25 THEN 'antagonistic' ELSE 'additive' END AS verdict FROM c"
SH = f"sh AS (SELECT n_nationkey * 5 AS compound, ({listed(KEYS[:6])})[n_nationkey % 6 + 1] AS receptor, 2.0::DOUBLE + n_nationkey * 0.5::DOUBLE AS fold FROM nation)"
SQL["genotype_shift"] = f"""WITH {EV}, {SH}, j AS (SELECT ev.*, fold, value_m * coalesce(fold, 1.0) AS m FROM ev LEFT JOIN sh USING (compound, receptor))
SELECT pos, CASE WHEN value_m IS NULL THEN 'not_modelled' WHEN fold IS NULL THEN 'unshifted' ELSE 'shifted' END AS state, round(m * 1e9, 6) AS shifted_nm, round(pow(1e-6, n) / (pow(m, n) + pow(1e-6, n)) - pow(1e-6, n) / (pow(value_m, n) + pow(1e-6, n)), 9) AS delta FROM j"""
SQL["unshifted_anti"] = f"WITH {EV}, {SH} SELECT compound::BIGINT AS compound, receptor, fold FROM sh WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.compound = sh.compound AND ev.receptor = sh.receptor)"
SQL["preferred_row"] = f"WITH {EV}, k AS (SELECT compound, pos, (pos % 3)::INT AS grade, row_number() OVER (PARTITION BY compound ORDER BY pos % 3 DESC, pos) AS k, count(*) OVER (PARTITION BY compound) - 1 AS alternatives FROM ev WHERE value_m IS NOT NULL) SELECT compound, pos, grade, alternatives FROM k WHERE k = 1"
SQL["exposure_profile"] = """WITH s AS (SELECT s_suppkey AS subject, 1e-6 * (1 + s_suppkey % 7) AS c0, 0.2::DOUBLE + s_suppkey % 5 * 0.2::DOUBLE AS ka, 0.1::DOUBLE + s_suppkey % 4 * 0.1::DOUBLE AS ke FROM supplier),
c AS (SELECT subject, i, i * 0.5::DOUBLE AS t, CASE WHEN abs(ka - ke) < 1e-9 THEN c0 * ka * t * exp(-ke * t) ELSE c0 * ka / (ka - ke) * (exp(-ke * t) - exp(-ka * t)) END AS c FROM s CROSS JOIN range(49) r(i))
SELECT subject, round(sum(c * 0.5 * CASE WHEN i IN (0, 48) THEN 0.5 ELSE 1 END) * 1e6, 6) AS auc_um_h, round(max(c) * 1e6, 6) AS cmax_um, arg_min(t, (-round(c, 12), t)) AS tmax FROM c GROUP BY 1"""
NODE = "node AS (SELECT n_nationkey AS body_id, (['acetylcholine', 'gaba', 'glutamate', 'octopamine', 'histamine'])[n_regionkey % 5 + 1] AS nt, r_name AS superclass FROM nation JOIN region ON n_regionkey = r_regionkey)"
_SIGN = "CASE nt " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.SIGN.items()) + " ELSE 0 END"
EDGE = f"""{NODE}, edge AS (SELECT s_nationkey AS pre, c_nationkey AS post, sum(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
lab AS (SELECT pre, post, nt, weight, weight * {_SIGN} AS before FROM edge JOIN node ON pre = body_id), seed AS (SELECT body_id FROM node WHERE superclass = 'AFRICA')"""
_GAIN = "CASE nt WHEN 'acetylcholine' THEN 0.4 * 1.2 WHEN 'gaba' THEN 0.7 ELSE 1.0 END"
SQL["edge_effective_weight"] = f"WITH {EDGE} SELECT pre, post, nt, round(weight, 6) AS weight, round(before, 6) AS before, round(before * {_GAIN}, 6) AS after, round(before * {_GAIN} - before, 6) AS delta FROM lab"
SQL["totals_by_transmitter"] = f"WITH {EDGE} SELECT nt, count(*) AS n_edges, round(sum(weight), 6) AS synapses, round(sum(abs(before)), 6) AS before, round(sum(abs(before * {_GAIN})), 6) AS after, round(CASE WHEN sum(abs(before)) = 0 THEN 1 ELSE sum(abs(before * {_GAIN})) / sum(abs(before)) END, 6) AS ratio FROM lab GROUP BY 1"
SQL["composition_shares"] = f"""WITH {EDGE}, c AS (SELECT nt, count(*) AS cells FROM node GROUP BY 1), o AS (SELECT nt, sum(weight) AS w FROM lab GROUP BY 1)
SELECT nt, cells, round(cells / (sum(cells) OVER ()), 6) AS cell_share, round(coalesce(w, 0), 6) AS out_weight, round(coalesce(w, 0) / (sum(w) OVER ()), 9) AS weight_share FROM c LEFT JOIN o USING (nt)"""
BIG = "big AS (SELECT l_suppkey AS pre, l_partkey AS post, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL)"
SQL["weighted_degree"] = f"WITH {BIG}, e AS (SELECT pre AS body_id, 1 AS o, weight FROM big UNION ALL SELECT post, 0, weight FROM big) SELECT body_id, count(*) FILTER (o = 0) AS in_degree, count(*) FILTER (o = 1) AS out_degree, round(coalesce(sum(weight) FILTER (o = 0), 0), 6) AS in_weight, round(coalesce(sum(weight) FILTER (o = 1), 0), 6) AS out_weight FROM e GROUP BY 1"
SQL["graph_census"] = f"""WITH {EDGE}, d AS (SELECT b, count(*) AS k FROM (SELECT pre AS b FROM edge UNION ALL SELECT post FROM edge) GROUP BY 1), n AS (SELECT count(*) AS n FROM node)
SELECT n AS n_nodes, count(*) AS n_edges, round(sum(weight), 6) AS synapses, round(count(*) / (n * (n - 1)), 9) AS density, round(count(*) FILTER (post IN (SELECT body_id FROM seed)) / count(*), 9) AS seed_share, round(count(DISTINCT post) / n, 9) AS input_share, (SELECT max(k) FROM d) AS largest_degree FROM edge CROSS JOIN n GROUP BY n"""
SQL["induced_subgraph"] = f"WITH {EDGE} SELECT pre, post, round(weight, 6) AS weight FROM edge WHERE pre % 2 = 0 AND post % 2 = 0"
SQL["touching_edges"] = f"WITH {EDGE} SELECT pre, post, round(weight, 6) AS weight FROM edge WHERE weight >= 1000 AND (pre IN (SELECT body_id FROM seed) OR post IN (SELECT body_id FROM seed))"
BOTH = f"{BIG}, h AS (SELECT * FROM big WHERE weight >= 45), b AS (SELECT pre, post, weight FROM h UNION ALL SELECT post, pre, weight FROM h)"
SQL["khop_frontier"] = f"WITH {BOTH}, h0 AS (SELECT 1 AS body_id, 0 AS hop), h1 AS (SELECT DISTINCT post AS body_id, 1 AS hop FROM b WHERE pre = 1 AND post <> 1), h2 AS (SELECT DISTINCT post AS body_id, 2 AS hop FROM b WHERE pre IN (SELECT body_id FROM h1) AND post <> 1 AND post NOT IN (SELECT body_id FROM h1)) SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2"
SQL["ranked_rings"] = f"""WITH {BOTH}, r0 AS (SELECT 1 AS body_id, 0 AS ring, 0.0::DOUBLE AS pull), r1 AS (SELECT post AS body_id, 1 AS ring, sum(weight) AS pull FROM b WHERE pre = 1 AND post <> 1 GROUP BY 1), c1 AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1),
r2 AS (SELECT post AS body_id, 2 AS ring, sum(weight) AS pull FROM b WHERE pre IN (SELECT body_id FROM c1) AND post NOT IN (SELECT body_id FROM c1) GROUP BY 1), u AS (SELECT * FROM c1 UNION ALL SELECT * FROM r2)
SELECT body_id, ring, round(pull, 6) AS pull, row_number() OVER (PARTITION BY ring ORDER BY round(pull, 6) DESC, body_id) AS place FROM u"""


def hops(n: int) -> str:
    joins = " ".join(f"JOIN edge e{i} ON e{i}.pre = e{i - 1}.post" for i in range(2, n + 1))
    ids = ["s.body_id", *(f"e{i}.post" for i in range(1, n + 1))]
    apart = " AND ".join(f"{a} <> {b}" for i, a in enumerate(ids) for b in ids[:i])
    return f"""WITH {EDGE}, p AS (SELECT s.body_id AS source, {' * '.join(f'(e{i}.weight / 1000)' for i in range(1, n + 1))} AS strength, [{', '.join(ids)}] AS way FROM seed s JOIN edge e1 ON e1.pre = s.body_id {joins} WHERE {apart}),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY strength DESC, way) AS rank FROM p) SELECT source, rank, round(strength, 6) AS strength, array_to_string(way, '>') AS path FROM k WHERE rank <= 10"""


SQL["two_hop_paths"], SQL["three_hop_paths"] = hops(2), hops(3)


def rates(normalise: str = "row_abs", gain: str = "1.0", name: str = "x", steps: int = 80) -> str:
    by = {"row_abs": "greatest(sum(abs(before)) OVER (PARTITION BY post), 1)", "none": "1", "degree": "greatest(count(*) FILTER (before <> 0) OVER (PARTITION BY post), 1)"}[normalise]
    out = f"{name}w AS (SELECT pre, post, before / {by} * {gain} AS w FROM lab), {name}0 AS (SELECT body_id, CASE WHEN body_id IN (SELECT body_id FROM seed) THEN 40.0::DOUBLE ELSE 0 END AS hz, 0.0::DOUBLE AS r FROM node)"
    for i in range(1, steps + 1):
        p = f"{name}{i - 1}"
        out += f", {name}{i} AS MATERIALIZED (SELECT a.body_id, a.hz, least(greatest(0.7 * a.r + 0.3 * (a.hz + coalesce(x, 0)), 0), 300) AS r FROM {p} a LEFT JOIN (SELECT post, sum(w * r) AS x FROM {name}w JOIN {p} ON pre = body_id GROUP BY 1) ON post = a.body_id)"
    return out


for _n in ("row_abs", "none", "degree"):
    SQL[f"rate_{_n}_k10"] = f"WITH {EDGE}, {rates(_n, steps=10)} SELECT body_id, round(r, 6) AS hz FROM x10"
SQL["rate_by_superclass"] = f"WITH {EDGE}, {rates()} SELECT superclass, round(avg(r), 6) AS mean_hz, round(max(r), 6) AS max_hz FROM x80 JOIN node USING (body_id) GROUP BY 1"
SQL["treated_minus_vehicle"] = f"WITH {EDGE}, {rates()}, {rates(gain=_GAIN, name='y')} SELECT body_id, round(x80.r, 6) AS vehicle, round(y80.r, 6) AS treated, round(y80.r - x80.r, 6) AS delta FROM x80 JOIN y80 USING (body_id)"
SQL["top_changed"] = SQL["treated_minus_vehicle"] + " ORDER BY abs(round(y80.r - x80.r, 6)) DESC, body_id LIMIT 15"
SQL["census_index"] = f"""WITH {NODE}, c AS (SELECT 40.0 * count(*) FILTER (nt = 'acetylcholine') / count(*) AS a, 40.0 * count(*) FILTER (nt = 'gaba') / count(*) AS b, 40.0 * count(*) FILTER (nt = 'glutamate') / count(*) AS g FROM node),
v AS (SELECT arm, convention, greatest(0, a * ga + x * g - 1.1 * b * gb) AS e, greatest(0, b * gb + y * g) AS i FROM c CROSS JOIN {values([('vehicle', 1.0, 1.0), ('treated', 0.4, 0.7)], 'arm, ga, gb')} CROSS JOIN (SELECT * FROM {values([('wholens', 0.3, 0.7), ('rate_engine', -0.4, 0.4)], 'convention, x, y')}))
SELECT arm, convention, round(e::DOUBLE, 9) AS excitation, round(i::DOUBLE, 9) AS inhibition, CASE WHEN i > 1e-9 THEN round(e::DOUBLE / i::DOUBLE, 9) END AS ratio FROM v"""
SQL["average_ranks"] = "SELECT p_partkey, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS rank FROM part"
SQL["rank_correlations"] = """WITH r AS (SELECT p_size::DOUBLE AS a, p_retailprice AS b, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS ra, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS rb FROM part)
SELECT count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r"""
SQL["kendall_tau_b"] = """WITH c AS (SELECT l_returnflag AS f, l_quantity AS x, l_discount AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), p AS (SELECT a.f, sign(b.x - a.x) AS dx, sign(b.y - a.y) AS dy, a.n * b.n AS k FROM c a JOIN c b ON a.f = b.f AND (a.x < b.x OR (a.x = b.x AND a.y < b.y)))
SELECT f AS l_returnflag, round(sum(dx * dy * k) / sqrt(sum(abs(dx) * k) * sum(abs(dy) * k)), 6) AS tau FROM p GROUP BY 1"""
PERM = """d AS (SELECT l_suppkey AS cell, l_orderkey AS k1, l_linenumber AS k2, l_extendedprice AS effect, (60000 + l_suppkey % 40 * 1000)::DOUBLE AS real FROM lineitem), m AS (SELECT cell, avg(effect) AS c FROM d GROUP BY 1),
perm AS (SELECT cell, max(real) AS real, count(*) AS n, max(c) AS null_mean, quantile_cont(effect, 0.5) AS null_median, quantile_cont(effect, 0.025) AS ci_low, quantile_cont(effect, 0.975) AS ci_high, (count(*) FILTER (abs(round(effect - c, 9)) >= abs(round(real - c, 9))) + 1) / (count(*) + 1) AS p, 1 / (count(*) + 1) AS resolution FROM d JOIN m USING (cell) GROUP BY 1)"""
SQL["permutation_p"] = f"WITH {PERM} SELECT cell, real, n, round(null_mean, 6) AS null_mean, round(null_median, 6) AS null_median, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p, 9) AS p, round(resolution, 9) AS resolution FROM perm"
SQL["bh_fdr"] = f"""WITH {PERM}, t AS (SELECT cell, CASE WHEN cell % 10 <> 0 THEN round(p, 9) END AS p FROM perm), mm AS (SELECT count(p) AS m FROM t), k AS (SELECT t.*, m, row_number() OVER (ORDER BY p NULLS LAST, cell) AS k FROM t CROSS JOIN mm),
q AS (SELECT cell, p, m, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM k WHERE p IS NOT NULL UNION ALL SELECT cell, p, m, NULL FROM k WHERE p IS NULL) SELECT cell, p, m, round(q, 9) AS q, coalesce(q <= 0.5, false) AS rejected FROM q"""
MODES = f"""{PERM}, modes AS (SELECT cell // 4 AS cell, (['rewire', 'weight_permute', 'sign_permute', 'erdos_renyi'])[cell % 4 + 1] AS mode, real - 60000 AS real, CASE WHEN round(p, 9) <= 0.5 THEN 'distinguishable' WHEN abs(real - 60000 - (round(null_median, 6) - 60000)) < 25000 THEN 'equivalent_within_tolerance' ELSE 'indeterminate' END AS verdict FROM perm)"""
SQL["mode_verdicts"] = f"WITH {MODES} SELECT mode, verdict, count(*) AS n FROM modes GROUP BY ALL"
SQL["classify_cells"] = f"""WITH {MODES} SELECT cell, CASE WHEN max(real) IS NULL THEN 'undefined' WHEN abs(max(real)) <= 3500 THEN 'no-effect' WHEN bool_or(verdict = 'distinguishable' AND mode IN ('rewire', 'weight_permute')) THEN 'topology-dependent'
  WHEN bool_or(verdict = 'distinguishable' AND mode = 'sign_permute') THEN 'mixed' ELSE 'composition-dominated' END AS class, count(*) FILTER (verdict = 'indeterminate') AS n_indeterminate FROM modes GROUP BY 1"""
SQL["necessary_level"] = f"WITH {MODES}, l AS (SELECT *, list_position(['erdos_renyi', 'weight_permute', 'rewire', 'sign_permute'], mode) AS level FROM modes) SELECT cell, arg_min(mode, level) FILTER (verdict <> 'distinguishable') AS sufficient, count(*) FILTER (verdict = 'distinguishable') AS n_distinguishable FROM l GROUP BY 1"
SQL["prefix_convergence"] = f"""WITH {PERM}, i AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY k1, k2) AS i, count(*) OVER (PARTITION BY cell) AS n FROM d), a AS (SELECT cell, fraction, avg(effect) AS mean FROM i JOIN (SELECT f::DOUBLE AS fraction FROM {values([(0.25,), (0.5,), (1.0,)], 'f')}) ON i <= ceil(n * fraction) GROUP BY ALL),
l AS (SELECT cell, mean AS last FROM a WHERE fraction = 1), o AS (SELECT a.*, abs(round(mean - last, 9)) > 0.02 * abs(last) AS off_, last FROM a JOIN l USING (cell)), g AS (SELECT cell, coalesce(max(CASE WHEN off_ THEN fraction END), 0) AS late FROM o GROUP BY 1)
SELECT cell, round(max(last), 6) AS mean, count(*) FILTER (off_) AS n_off, min(fraction) FILTER (fraction > late) AS settled FROM o JOIN g USING (cell) GROUP BY 1"""
SQL["threshold_crossing"] = """WITH c AS (SELECT o_orderkey // 8 AS curve, o_orderkey % 8 AS u, o_totalprice / 200000 AS y FROM orders), l AS (SELECT *, lag(u) OVER w AS pu, lag(y) OVER w AS py FROM c WINDOW w AS (PARTITION BY curve ORDER BY u)),
f AS (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY u) AS k FROM l WHERE y >= 1) SELECT curve, round(CASE WHEN pu IS NULL THEN u::DOUBLE ELSE pu + (1 - py) / (y - py) * (u - pu) END, 6) AS log_crossing, pu IS NULL AS at_first FROM f WHERE k = 1"""
SQL["verdict_islands"] = """WITH c AS (SELECT o_custkey, o_orderkey, o_orderstatus AS s, CASE WHEN lag(o_orderstatus) OVER w <> o_orderstatus THEN 1 ELSE 0 END AS ch FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), r AS (SELECT *, sum(ch) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM c)
SELECT o_custkey, sum(ch)::BIGINT AS changes, count(*) FILTER (run = last) AS agreeing, arg_max(s, o_orderkey) AS final FROM (SELECT *, max(run) OVER (PARTITION BY o_custkey) AS last FROM r) GROUP BY 1"""
SQL["psth_bins"] = "SELECT floor(epoch(ts) / 3600)::BIGINT AS bin, count(*) AS spikes, count(DISTINCT user_id) AS cells FROM events GROUP BY 1"
SQL["raster_budget"] = "WITH e AS (SELECT user_id, count(*) AS spikes FROM events GROUP BY 1), k AS (SELECT *, least(spikes, 8) AS kept, row_number() OVER (ORDER BY spikes DESC, user_id) AS ordinal FROM e) SELECT user_id, spikes, kept, (SELECT sum(kept) FROM k)::BIGINT AS all_kept, ordinal FROM k WHERE ordinal <= 50"
SQL["experiment_summary"] = "SELECT o_orderpriority AS compound, o_orderstatus AS arm, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS sd FROM orders GROUP BY 1, 2"
SQL["stability_matrix"] = """WITH m AS (SELECT o_orderpriority AS conclusion, o_orderkey % 25 AS spec, avg(CASE WHEN o_orderkey % 7 <> 0 THEN (o_totalprice > 150000)::INT END) AS share FROM orders GROUP BY ALL)
SELECT conclusion, count(*) AS n, count(*) FILTER (share > 0.5) AS retained, count(*) FILTER (share IS NULL) AS undecidable, round(avg(share), 6) AS share FROM m GROUP BY 1"""
SQL["threshold_grid"] = f"WITH {engaged()}, {PAIRS}, g AS (SELECT f::DOUBLE AS frac, v::DOUBLE AS vert_limit FROM {values([(f, v) for f in (0.25, 0.4, 0.5) for v in (0.1, 0.2, 0.3)], 'f, v')}) SELECT frac, vert_limit, count(*) AS n, count(*) FILTER (ie >= frac AND ve < vert_limit) AS amplified FROM pairs CROSS JOIN g WHERE known GROUP BY ALL"
SQL["jansen_indices"] = """WITH k AS (SELECT l_linenumber::INT AS factor, l_extendedprice AS a, 1500 * l_quantity AS b, l_extendedprice * (1 - l_discount) AS ab FROM lineitem),
v AS (SELECT factor, var_samp(y) AS v FROM (SELECT factor, a AS y FROM k UNION ALL SELECT factor, b FROM k) GROUP BY 1) SELECT factor, round(1 - sum(pow(b - ab, 2)) / (2 * count(*)) / max(v), 6) AS first, round(sum(pow(a - ab, 2)) / (2 * count(*)) / max(v), 6) AS total FROM k JOIN v USING (factor) GROUP BY 1"""
SQL["ishigami"] = "WITH x AS (SELECT l_returnflag, (l_quantity / 25 - 1) * 3.141592653589793::DOUBLE AS a, (l_discount * 20 - 1) * 3.141592653589793::DOUBLE AS b, (l_tax * 25 - 1) * 3.141592653589793::DOUBLE AS c FROM lineitem) SELECT l_returnflag, round(avg(sin(a) + 7 * pow(sin(b), 2) + 0.1 * pow(c, 4) * sin(a)), 5) AS mean, round(var_samp(sin(a) + 7 * pow(sin(b), 2) + 0.1 * pow(c, 4) * sin(a)), 4) AS variance FROM x GROUP BY 1"
SQL["sign_permute_nulls"] = f"""WITH {EDGE}, n AS (SELECT body_id, nt, i AS draw FROM node CROSS JOIN range(20) r(i)), p AS (SELECT draw, body_id, row_number() OVER (PARTITION BY draw ORDER BY md5('0:to:' || draw || ':' || body_id), body_id) AS k FROM n), l AS (SELECT draw, nt, row_number() OVER (PARTITION BY draw ORDER BY body_id) AS k FROM n)
SELECT draw, round(sum(weight * {_SIGN}), 6) AS net, round(sum(abs(weight * {_SIGN})), 6) AS absolute FROM p JOIN l USING (draw, k) JOIN edge ON pre = body_id GROUP BY 1"""
SQL["weight_permute_nulls"] = f"""WITH {EDGE}, n AS (SELECT pre, post, weight, i AS draw FROM edge CROSS JOIN range(5) r(i)), p AS (SELECT draw, pre, post, row_number() OVER (PARTITION BY draw, post ORDER BY md5('0:' || draw || ':' || pre || ':' || post), pre) AS k FROM n), l AS (SELECT draw, post, weight, row_number() OVER (PARTITION BY draw, post ORDER BY pre) AS k FROM n)
SELECT draw, pre, count(*) AS out_degree, round(sum(weight), 6) AS out_weight FROM p JOIN l USING (draw, post, k) GROUP BY 1, 2"""
SQL["sha_digest"] = "WITH l AS (SELECT source, doc_id // 256 AS block, sha256(doc_id || chr(9) || sha256(text)) AS h FROM documents) SELECT source, block, sha256(string_agg(h, chr(10) ORDER BY h)) AS digest, count(*) AS n FROM l GROUP BY 1, 2"
SQL["json_fields"] = "SELECT event_type, count(json_extract_string(props, '$.k')) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total, max(json_extract_string(props, '$.k')::BIGINT) AS top FROM events GROUP BY 1"
SQL["cited_numbers"] = r"WITH x AS (SELECT lang, unnest(regexp_extract_all(text, '[0-9]+\.[0-9]+')) AS x FROM documents) SELECT lang, count(*) AS n, count(DISTINCT x) AS different FROM x GROUP BY 1"
SQL["sensitivity_tornado"] = f"""WITH {engaged()}, m AS (SELECT pos, parameter, conc_m, value_m * CASE parameter WHEN 'value_m' THEN factor ELSE 1 END AS v, n * CASE parameter WHEN 'n' THEN factor ELSE 1 END AS s FROM en CROSS JOIN (SELECT parameter, factor::DOUBLE AS factor FROM {values([(p, f) for p in ('value_m', 'n') for f in (0.5, 2.0)], 'parameter, factor')}) WHERE engagement IS NOT NULL),
e AS (SELECT pos, parameter, pow(conc_m, s) / (pow(v, s) + pow(conc_m, s)) AS y FROM m) SELECT pos, parameter, round(min(y), 9) AS low, round(max(y), 9) AS high, round(max(y) - min(y), 9) AS span FROM e GROUP BY 1, 2"""
_TV = SQL["treated_minus_vehicle"]
SQL["circuit_disruption"] = f"WITH t AS ({_TV}) SELECT round(avg(abs(delta)) / avg(vehicle), 6) AS disruption, count(*) AS n FROM t"
SQL["normalisation_signs"] = f"WITH {EDGE}, " + ", ".join(f"{rates(h, name=f'v{i}_')}, {rates(h, _GAIN, f't{i}_')}" for i, h in enumerate(("row_abs", "none", "degree"))) + ", e AS (" + " UNION ALL ".join(f"SELECT '{h}' AS normalise, round((SELECT avg(r) FROM t{i}_80) - (SELECT avg(r) FROM v{i}_80), 6) AS effect" for i, h in enumerate(("row_abs", "none", "degree"))) + ") SELECT normalise, effect, sign(effect)::INT AS sign FROM e"
SQL["first_seen_edges"] = "WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) SELECT l_suppkey AS pre, l_partkey AS post, l_orderkey, round(l_quantity, 6) AS weight FROM k WHERE k = 1"
SQL["mixture_coverage"] = f"WITH {EV}, a AS (SELECT compound // 3 AS mixture, receptor, value_m FROM ev), g AS (SELECT DISTINCT a.mixture, b.receptor FROM a CROSS JOIN (SELECT DISTINCT receptor FROM a) b) SELECT mixture, count(*) AS missing FROM g WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.mixture = g.mixture AND a.receptor = g.receptor AND value_m IS NOT NULL) GROUP BY 1"
SQL["viewer_edges"] = f"WITH {BIG}, h AS (SELECT pre, post, round(weight, 6) AS weight FROM big WHERE weight >= 10) SELECT pre, post, weight, (SELECT count(*) FROM h) > 500 AS truncated FROM h ORDER BY weight DESC, pre, post LIMIT 500"
SQL["response_sample_sizes"] = f"""WITH {engaged()}, e AS (SELECT compound, least(max(engagement), 0.5) AS f FROM en WHERE receptor LIKE 'insect%' GROUP BY 1 HAVING max(engagement) IS NOT NULL), p AS (SELECT *, 0.8::DOUBLE AS a, 0.8::DOUBLE * (1 - f) AS b, (0.8::DOUBLE + 0.8::DOUBLE * (1 - f)) / 2 AS m FROM e)
SELECT compound, round(f, 9) AS drop, CASE WHEN f > 1e-9 THEN ceil(round(pow({__import__('statistics').NormalDist().inv_cdf(0.975)}::DOUBLE * sqrt(2 * m * (1 - m)) + {__import__('statistics').NormalDist().inv_cdf(0.8)}::DOUBLE * sqrt(a * (1 - a) + b * (1 - b)), 2) / pow(a - b, 2), 6))::BIGINT END AS per_group FROM p"""
SQL["pairwise_concordance"] = "WITH p AS (SELECT p_brand, p_size AS s, avg(p_retailprice) AS y FROM part GROUP BY ALL) SELECT a.p_brand, count(*) AS pairs, count(*) FILTER (a.y < b.y) AS agree, round(count(*) FILTER (a.y < b.y) / count(*), 9) AS share FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.s < b.s GROUP BY 1"
SQL["structure_separation"] = f"""WITH {EDGE}, o AS (SELECT pre AS body_id, sum(weight) AS out_weight, count(*)::DOUBLE AS out_degree FROM edge GROUP BY 1), i AS (SELECT post AS body_id, sum(weight) AS in_weight FROM edge GROUP BY 1), d AS (SELECT superclass, coalesce(in_weight, 0) AS a, coalesce(out_weight, 0) AS b, coalesce(out_degree, 0) AS c FROM o FULL JOIN i USING (body_id) JOIN node USING (body_id)),
l AS (SELECT superclass, 'in_weight' AS statistic, a AS v FROM d UNION ALL SELECT superclass, 'out_weight', b FROM d UNION ALL SELECT superclass, 'out_degree', c FROM d), s AS (SELECT statistic, superclass, min(v) AS low, max(v) AS high FROM l GROUP BY 1, 2)
SELECT statistic, superclass, round(low, 6) AS low, round(high, 6) AS high, lead(low) OVER (PARTITION BY statistic ORDER BY low, superclass) > high AS apart FROM s"""
SQL["balance_report"] = f"""WITH {EDGE}, n AS (SELECT body_id, nt, i AS draw FROM node CROSS JOIN range(20) r(i)), p AS (SELECT draw, body_id, row_number() OVER (PARTITION BY draw ORDER BY md5('0:to:' || draw || ':' || body_id), body_id) AS k FROM n), l AS (SELECT draw, nt, row_number() OVER (PARTITION BY draw ORDER BY body_id) AS k FROM n),
w AS (SELECT draw, nt, sum(weight) AS w FROM p JOIN l USING (draw, k) JOIN edge ON pre = body_id GROUP BY 1, 2), o AS (SELECT nt, sum(weight) AS real FROM lab GROUP BY 1), r AS (SELECT nt, coalesce(real, 0) AS real FROM (SELECT DISTINCT nt FROM node) LEFT JOIN o USING (nt))
SELECT nt, round(max(real), 6) AS real, round(avg(w), 6) AS mean, round(coalesce(stddev_samp(w), 0), 4) AS sd, round(min(w), 6) AS low, round(max(w), 6) AS high, round(max(abs(w - real)), 6) AS most_off FROM w JOIN r USING (nt) GROUP BY 1"""
SQL["source_overlap"] = r"WITH x AS (SELECT DISTINCT lang, unnest(regexp_extract_all(text, '[0-9]+\.[0-9]+')) AS x FROM documents) SELECT a.lang AS a, b.lang AS b, count(*) AS shared FROM x a JOIN x b ON a.x = b.x AND a.lang < b.lang GROUP BY 1, 2"
SQL["genotype_panel"] = f"""WITH {EV}, g AS (SELECT pos, genotype, pow(1e-6, n) / (pow(value_m * fold, n) + pow(1e-6, n)) AS y FROM ev CROSS JOIN (SELECT genotype, fold::DOUBLE AS fold FROM {values([('wild_type', 1.0), ('low', 2.0), ('high', 20.0)], 'genotype, fold')}) WHERE value_m IS NOT NULL)
SELECT pos, genotype, round(y, 9) AS engagement, round(y - max(CASE WHEN genotype = 'wild_type' THEN y END) OVER (PARTITION BY pos), 9) AS delta FROM g"""
SQL["exposure_occupancy"] = "WITH c AS (SELECT s_suppkey AS subject, 1e-6 * (1 + s_suppkey % 7) * 0.5 * h * exp(-0.5 * h) AS c FROM supplier CROSS JOIN range(25) r(h)) SELECT subject, round(avg(c / (5e-7 + c)), 9) AS mean, round(max(c / (5e-7 + c)), 9) AS top FROM c GROUP BY 1"
SQL["equivalence_margins"] = f"WITH t AS ({_TV}) SELECT body_id, round(0.05 * abs(vehicle), 6) AS margin, round(greatest(1e-6, 0.01 * abs(vehicle)), 8) AS floor, abs(delta) < 0.05 * abs(vehicle) AS within, abs(delta) <= greatest(1e-6, 0.01 * abs(vehicle)) AS no_effect FROM t"
