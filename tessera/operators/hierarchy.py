"""Walks over a shallow hierarchy given as an edge table, and relations between its leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ancestors(edges: DataFrame, depth: int = 4) -> DataFrame:
    """(node, ancestor, depth): every node with itself (0) and up to `depth` ancestors, by fixed self-joins."""
    nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).distinct()
    level = nodes.select("node", F.col("node").alias("ancestor"))
    out = level.withColumn("depth", F.lit(0))
    for k in range(1, depth + 1):
        level = level.join(edges, level["ancestor"] == edges["child"]).select("node", F.col("parent").alias("ancestor"))
        out = out.unionByName(level.withColumn("depth", F.lit(k)))
    return out


def lineage(edges: DataFrame, depth: int = 4) -> DataFrame:
    """(node, path): ancestors from the root down, the node last."""
    a = ancestors(edges, depth)
    return a.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "ancestor")), asc=False), lambda x: x["ancestor"]).alias("path"))


def common_ancestor(pairs: DataFrame, edges: DataFrame, depth: int = 4) -> DataFrame:
    """(a, b, ancestor, distance): the nearest common ancestor of each pair; pairs without one are left out."""
    w = ancestors(edges, depth)
    up = lambda c: w.select(F.col("node").alias(c), "ancestor", F.col("depth").alias(f"d_{c}"))
    both = pairs.join(up("a"), "a").join(up("b"), ["b", "ancestor"])
    return both.groupBy("a", "b").agg(F.min(F.struct((F.col("d_a") + F.col("d_b")).alias("distance"), "ancestor")).alias("x")).select("a", "b", "x.ancestor", "x.distance")


def forward_fill(rows: DataFrame, group: list[str], order: str, value: Column, reset: Column | None = None) -> Column:
    """The last non-null value so far within the group, and since the last row where reset holds."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if reset is None:
        return F.last(value, ignorenulls=True).over(w)
    at = F.last(F.when(reset, F.col(order)), ignorenulls=True).over(w)
    found = F.last(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v"))), ignorenulls=True).over(w)
    return F.when(at.isNull() | (found["o"] >= at), found["v"])


def first_per_group(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("_n = 1").drop("_n")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with rank and has_more."""
    w = Window.partitionBy(*group)
    out = rows.withColumns({"rank": F.row_number().over(w.orderBy(*order)).cast("long"), "has_more": F.count("*").over(w) > k})
    return out.filter(F.col("rank") <= k)
