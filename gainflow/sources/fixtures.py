"""The library's relations, bound to the driver tables: evidence, graph nodes and edges, permutation draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dims import CEILING, DISTANCE, RECEPTORS


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Typed receptor evidence: ``pos, compound, receptor, param_type, relation, value_m, n, direction``."""
    p, s = F.col("p_partkey"), F.col("p_size")
    keys = [f"insect_{r}" for r in RECEPTORS] + [f"vertebrate_{r}" for r in RECEPTORS]
    return table(spark, d, "part").select(
        p.alias("pos"), F.floor(p / 4).cast("long").alias("compound"), pick(keys, p * 7 + s).alias("receptor"), pick(list(CEILING)[:5] + list(CEILING)[7:], s).alias("param_type"),
        pick(list(DISTANCE), p).alias("relation"), F.when(s % 7 != 0, F.col("p_retailprice") * 1e-9).alias("value_m"), (1 + s % 5 * 0.1).alias("n"), pick(["agonist", "antagonist", "inhibitor"], s).alias("direction"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Graph nodes: ``body_id, nt, superclass``."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("body_id"), pick(["acetylcholine", "gaba", "glutamate", "octopamine", "histamine"], F.col("n_regionkey")).alias("nt"), F.col("r_name").alias("superclass"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Weighted directed edges between nodes: ``pre, post, weight``."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("post"))
    supplier = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("pre"))
    # the line items are reduced to supplier and order first, so the joins above them carry one row each
    part = line.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("w"))
    joined = part.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("pre", "post").agg(F.sum("w").alias("weight"))


def big_edges(spark: SparkSession, d: str) -> DataFrame:
    """A larger graph: suppliers to parts."""
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("pre"), F.col("l_partkey").alias("post")).agg(F.sum("l_quantity").alias("weight"))


def order_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of :func:`order_edges`: ``body_id, nt, superclass``."""
    p = F.col("p_partkey")
    return table(spark, d, "part").select(p.alias("body_id"), pick(["acetylcholine", "gaba", "glutamate", "octopamine", "histamine", "unclear"], p).alias("nt"), pick(["sensory", "central", "motor", "visual"], F.col("p_size")).alias("superclass"))


def order_edges(spark: SparkSession, d: str) -> DataFrame:
    """A sparse graph that grows with the tables: from the part of each order's first line to that of its last, weighted by the order's quantity."""
    line = F.struct("l_linenumber", "l_partkey")
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", line).alias("pre"), F.max_by("l_partkey", line).alias("post"), F.sum("l_quantity").alias("w"))
    return o.filter("pre <> post").groupBy("pre", "post").agg(F.sum("w").alias("weight"))


def draws(spark: SparkSession, d: str) -> DataFrame:
    """Null draws: ``cell, k1, k2, effect`` with the cell's real effect ``real``."""
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("cell"), F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_extendedprice").alias("effect"),
        (60_000 + F.col("l_suppkey") % 40 * 1000).cast("double").alias("real"))


def doses(spark: SparkSession, *values: float) -> DataFrame:
    return spark.createDataFrame([(float(v),) for v in values], "conc_m double")


def expression_levels(spark: SparkSession, d: str) -> DataFrame:
    """Written levels of three receptors by class of :func:`order_nodes`: ``superclass, receptor, level``; what isn't known has no row."""
    p = table(spark, d, "part")
    n = p.groupBy(pick(["sensory", "central", "motor", "visual"], F.col("p_size")).alias("superclass"), pick(["nAChR", "RDL", "GluCl"], F.col("p_partkey")).alias("receptor")).agg(F.count("*").alias("n"))
    level = F.element_at(F.array(*map(F.lit, [1.0, 0.6, 0.25, 0.0, None])), (F.col("n") % 5 + 1).cast("int"))
    return n.select("superclass", "receptor", level.alias("level")).filter("level is not null")
