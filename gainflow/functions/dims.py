"""Rule tables as small DataFrames: they are data, joined like any other."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parameter types with the strongest engagement model each supports, in order of strength.
CEILING = {
    "Kd": "binding_occupancy", "Ki": "binding_occupancy", "EC50": "functional_engagement", "IC50": "functional_engagement",
    "Kb": "functional_engagement", "relative_potency": "not_modelled", "class_order": "not_modelled", "unknown": "not_modelled",
}
#: How far the evidence is from the compound and receptor in question.
DISTANCE = {
    "exact_compound_exact_receptor_exact_species": "E0", "exact_compound_exact_receptor_other_species": "E1", "exact_compound_related_receptor": "E2",
    "class_extrapolation": "E3", "unsupported": "E4",
}
#: Signs of transmitters at a synapse, and the gain that scales each.
SIGN = {"acetylcholine": 1.0, "gaba": -1.0, "glutamate": -0.4, "histamine": -0.5, "dopamine": 0.2, "serotonin": 0.2, "octopamine": 0.2}
GAIN_OF = {"acetylcholine": "g_ach", "gaba": "g_gaba", "glutamate": "g_glu", "octopamine": "g_oct"}
GAINS = ("g_ach", "g_gaba", "g_glu", "g_oct", "g_nav", "ach_tone")
RECEPTORS = ("nAChR", "RDL", "GluCl", "AChE", "Nav", "OctR")
ACTIVATING = ("agonist", "partial_agonist", "positive_modulator")
BLOCKING = ("antagonist", "negative_modulator", "inhibitor")
#: Gain rules as receptor, whether activating, gain, slope and curvature of 1 + slope * t - curvature * t^2.
RULES = (
    ("insect_nAChR", True, "g_ach", 0.4, 1.6), ("insect_nAChR", False, "g_ach", -1.0, 0.0),
    ("insect_RDL", True, "g_gaba", 0.4, 0.0), ("insect_RDL", False, "g_gaba", -1.0, 0.0),
    ("insect_GluCl", True, "g_glu", 0.8, 0.0), ("insect_GluCl", False, "g_glu", -1.0, 0.0),
    ("insect_Nav", True, "g_nav", 1.5, 0.0), ("insect_Nav", False, "g_nav", -1.0, 0.0),
    ("insect_OctR", True, "g_oct", 0.5, 0.0), ("insect_OctR", False, "g_oct", -1.0, 0.0),
)


def model_of(param_type: str, distance: str) -> str:
    """The engagement model that a parameter type supports at an evidence distance."""
    top = CEILING[param_type]
    if distance == "E4" or top == "not_modelled":
        return "not_modelled"
    if distance == "E0":
        return top
    return "binding_engagement_proxy" if top == "binding_occupancy" and distance != "E3" else "functional_engagement_proxy"


def models(spark: SparkSession) -> DataFrame:
    rows = [(p, r, d, model_of(p, d)) for p in CEILING for r, d in DISTANCE.items()]
    return spark.createDataFrame(rows, "param_type string, relation string, distance string, model string")


def signs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v, GAIN_OF.get(k)) for k, v in SIGN.items()], "nt string, sign double, gain string")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "receptor string, activating boolean, gain string, slope double, curve double")


def coerced(c: Column, known: Iterable[str], default: str) -> Column:
    """A name of ``known`` whatever its case and outer blanks; NULL is the default, any other text an error that lists the known."""
    out = F.raise_error(F.concat(F.lit("unknown value "), c, F.lit("; known: " + ", ".join(known)))).cast("string")
    for name in known:
        out = F.when(F.lower(F.trim(c)) == name.lower(), F.lit(name)).otherwise(out)
    return F.when(c.isNull(), F.lit(default)).otherwise(out)


def param_type(c: Column) -> Column:
    return coerced(c, CEILING, "unknown")


def relation(c: Column) -> Column:
    return coerced(c, DISTANCE, "unsupported")


def distance(c: Column) -> Column:
    """An evidence distance by its own name or that of a relation."""
    own = coerced(F.when(F.upper(F.trim(c)).isin(*DISTANCE.values()), c), DISTANCE.values(), "E4")
    of = relation(F.when(~F.coalesce(F.upper(F.trim(c)).isin(*DISTANCE.values()), F.lit(False)), c))
    named = F.lit(None).cast("string")
    for name, d in DISTANCE.items():
        named = F.when(of == name, d).otherwise(named)
    return F.when(F.coalesce(F.upper(F.trim(c)).isin(*DISTANCE.values()), F.lit(False)), own).otherwise(named)


def exceeds(model: Column, param_type_: Column) -> Column:
    """Whether a claimed model is stronger than its parameter type supports: an occupancy without a binding constant, or any model of a type that has none."""
    top = F.lit("not_modelled")
    for name, m in CEILING.items():
        top = F.when(param_type_ == name, m).otherwise(top)
    return (model != "not_modelled") & ((top == "not_modelled") | (model.startswith("binding") & (top != "binding_occupancy")))
