"""Experiment designs as grids of rows, sampling designs, variance budgets and sample sizes."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import engagement as E
from . import stats as S


@dataclass(frozen=True)
class Design:
    """A grid of compounds, doses and replicates, with jitter of the dose in log10 units."""

    compounds: tuple[str, ...]
    concentrations: tuple[float, ...]
    replicates: int = 1
    seed: int = 0
    jitter_log10: float = 0.0
    include_vehicle: bool = True
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.compounds or not self.concentrations or self.replicates < 1:
            raise ValueError("a design needs compounds, concentrations and at least one replicate")
        if any(c < 0 for c in self.concentrations):
            raise ValueError("a concentration is below 0")

    @classmethod
    def of(cls, config: dict) -> Design:
        """From a configuration, which may stand below ``spec`` or ``design``; aliases are merged and duplicates dropped in order."""
        d = config.get("spec") or config.get("design") or config
        alias = {"compound": "compounds", "doses": "concentrations", "conc_M": "concentrations", "n": "replicates"}
        d = {alias.get(k, k): v for k, v in d.items()}
        unknown = set(d) - {f for f in cls.__dataclass_fields__} - {"name", "description"}
        if unknown:
            raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
        many = lambda x: tuple(dict.fromkeys(x if isinstance(x, (list, tuple)) else [x]))
        keep = {k: v for k, v in d.items() if k in cls.__dataclass_fields__}
        keep |= {"compounds": many(d.get("compounds", ())), "concentrations": tuple(float(c) for c in many(d.get("concentrations", ())))}
        return cls(**keep)

    def grid(self, spark: SparkSession) -> DataFrame:
        """``condition, compound, conc_m, replicate``: the vehicle is a condition like any other; jitter is a hash of the row's key, so it doesn't depend on partitions."""
        c = spark.createDataFrame([(x,) for x in self.compounds], "compound string")
        doses = ([("vehicle", 0.0)] if self.include_vehicle else []) + [("treated", float(x)) for x in self.concentrations]
        g = c.crossJoin(spark.createDataFrame(doses, "condition string, dose double")).crossJoin(spark.range(self.replicates).select(F.col("id").cast("int").alias("replicate")))
        u = uniform(F.lit(self.seed), F.col("compound"), F.col("dose"), F.col("replicate"))
        return g.select("condition", "compound", (F.col("dose") * F.pow(F.lit(10.0), (2 * u - 1) * self.jitter_log10)).alias("conc_m"), "replicate")

    def fingerprint(self) -> str:
        import hashlib
        import json

        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key only."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / float(1 << 53)


def run(design: Design, evidence: DataFrame) -> DataFrame:
    """Gains of every row of a design's grid, its runs side by side."""
    grid = design.grid(evidence.sparkSession)
    doses = grid.select("compound", "conc_m").distinct()
    rows = evidence.join(F.broadcast(doses.select("compound").distinct()), "compound", "left_semi")
    engaged = E.engage(rows, doses.select("conc_m").distinct())
    return grid.join(E.gains(engaged), ["compound", "conc_m"], "left")


def latin_hypercube(spark: SparkSession, n: int, factors: list[str], seed: int = 0) -> DataFrame:
    """``row, factor, u``: one stratum per row and factor, in an order by hash; no factor's rows meet in one task."""
    f = spark.createDataFrame([(x,) for x in factors], "factor string")
    rows = spark.range(n).withColumnRenamed("id", "row").crossJoin(F.broadcast(f))
    placed = S.numbered(rows.withColumn("h", F.xxhash64(F.lit(seed), "factor", "row")), ["factor"], "h", "row", name="place")
    return placed.select("row", "factor", ((F.col("place") - 1 + uniform(F.lit(seed), F.lit("in"), "factor", "row")) / n).alias("u"))


def saltelli(spark: SparkSession, n: int, factors: list[str], seed: int = 0) -> DataFrame:
    """``row, matrix, swapped, factor, u``: matrices A, B and, per factor, A with that factor's column from B."""
    a = latin_hypercube(spark, n, factors, 2 * seed).withColumnRenamed("u", "a")
    both = a.join(latin_hypercube(spark, n, factors, 2 * seed + 1).withColumnRenamed("u", "b"), ["row", "factor"])
    kinds = spark.createDataFrame([("A", None), ("B", None), *[("AB", f) for f in factors]], "matrix string, swapped string")
    take = (F.col("matrix") == "B") | (F.col("swapped") == F.col("factor"))
    return both.crossJoin(F.broadcast(kinds)).select("row", "matrix", "swapped", "factor", F.when(F.coalesce(take, F.lit(False)), F.col("b")).otherwise(F.col("a")).alias("u"))


def sobol(design: DataFrame, model: Column) -> DataFrame:
    """First and total indices: ``model`` is an expression over ``x``, a map of factor to u, so evaluations are rows."""
    y = design.groupBy("row", "matrix", "swapped").agg(F.map_from_entries(F.collect_list(F.struct("factor", "u"))).alias("x")).select("row", "matrix", "swapped", model.alias("y"))
    of = lambda m: y.filter(F.col("matrix") == m)
    rows = of("AB").select("row", F.col("swapped").alias("factor"), F.col("y").alias("ab")).join(of("A").select("row", F.col("y").alias("a")), "row").join(of("B").select("row", F.col("y").alias("b")), "row")
    return S.jansen(rows, "factor")


def information_value(indices: DataFrame, variance: float) -> DataFrame:
    """Variance that knowing each factor would remove, and its rank; uses indices already made."""
    v = F.greatest(F.lit(0.0), F.col("first")) * variance
    return indices.withColumn("value", v).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "factor")))


def _quantiles(alpha: float, power: float) -> tuple[float, float]:
    return NormalDist().inv_cdf(1 - alpha / 2), NormalDist().inv_cdf(power)


def two_proportions(p1: Column, p2: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Group size that tells two response proportions apart; NULL where they are equal."""
    za, zb = _quantiles(alpha, power)
    spread = lambda p: p * (1 - p)
    root = za * F.sqrt(2 * spread((p1 + p2) / 2)) + zb * F.sqrt(spread(p1) + spread(p2))
    return F.when(F.abs(p1 - p2) > 1e-9, F.ceil(F.round(F.pow(root / (p1 - p2), 2), 6))).cast("long")


def two_means(d: Column, alpha: float = 0.05, power: float = 0.8, cap: float = 1.0) -> Column:
    """Group size to see a standardised difference, which is held to a cap; NULL for none and for an unknown one."""
    held = F.when(d.isNotNull(), F.least(F.abs(d), F.lit(cap)))
    return F.when(held > 1e-9, F.ceil(F.round(2 * F.pow(sum(_quantiles(alpha, power)) / held, 2), 6))).cast("long")


#: Weights of written expression levels.
LEVELS = {"high": 1.0, "medium": 0.6, "low": 0.25, "absent": 0.0}


def expression_weights(nodes: DataFrame, levels: DataFrame, prefix: str, unknown: float = 1.0, how: str = "mean") -> DataFrame:
    """Nodes with the weight of a receptor in their superclass: mean or max over its genes (a prefix match) of known level, else ``unknown``."""
    known = F.lit(None).cast("double")
    for name, w in LEVELS.items():
        known = F.when(F.col("level") == name, w).otherwise(known)
    own = levels.filter(F.startswith(F.lower("gene"), F.lit(prefix.lower()))).groupBy("superclass").agg((F.avg if how == "mean" else F.max)(known).alias("weight"))
    return nodes.join(F.broadcast(own), "superclass", "left").withColumn("weight", F.coalesce("weight", F.lit(unknown)))
