"""Connected components of a table of links, by lowest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SENT, stored

#: Parts into which the rows of one key are dealt where it is looked up.
SALTS = 256


def look_up(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` left-joined with a table of one row per ``key``, though a third of all rows may hold one key.

    The rows of a key are dealt into SALTS parts by a hash of column ``by``; each part's key, found by
    an aggregate that combines before its shuffle, fetches the table's row once.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    fetched = salted.select(key, "__salt").distinct().join(table, key)
    return salted.join(fetched, [key, "__salt"], "left").drop("__salt")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: for each node that a link names, the smallest node of its component.

    Every round takes the lowest label among a node and its neighbours (an aggregate that combines
    before its shuffle), then follows the label of the label; labels live in tables of the shared folder.
    Labels of few nodes are broadcast, so a round has one shuffle. Else neither a node with very many
    links nor a label of very many nodes fills one task.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    few = label.count() <= SENT
    find = (lambda rows, table, key, by: rows.join(F.broadcast(table), key, "left")) if few else look_up
    while True:
        near = find(both, label.withColumnRenamed("node", "b"), "b", "a").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        lower = near.join(F.broadcast(label) if few else label, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stored(find(lower, jump, "root", "node").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        moved = new.filter(F.col("old") != F.col("root")).limit(1).count()
        label = new.select("node", "root")
        if not moved:
            return label
