"""Content addresses as trees: rows are hashed, digests are folded by the first digits of their hashes, level by level.

The tree of a group is told by its rows alone, so the same rows give the same address whatever their order and partitions. No level
gathers a group: a node folds the digests that share its digits, about one in 256 of the level below, and a large group is as
many tasks as it has digits. Repeated rows count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits that the nodes of each level share.
LEVELS = (4, 2, 0)


def tree_digests(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys, digest: the root of each group's tree over SHA-256 of `text` (null is told from empty)."""
    leaf = F.sha2(F.coalesce(F.concat(F.lit("="), text), F.lit("")), 256)
    t = rows.select(*keys, leaf.alias("digest")).withColumn("place", F.col("digest"))
    for digits in LEVELS:
        node = F.substring("place", 1, digits) if digits else F.lit("")
        t = t.groupBy(*keys, node.alias("node")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("below"))
        t = t.select(*keys, F.col("node").alias("place"), F.sha2(F.array_join("below.digest", ""), 256).alias("digest"))
    return t.select(*keys, "digest")


def content_address(digest: Column, policy: str, prefix: str = "ds-") -> Column:
    """A data set's id: its content and the review policy that it was read under; another policy is another id."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", digest, F.lit(policy)), 256), 1, 16))


def tree_sql(source: str, keys: str, text: str) -> str:
    """The same trees as CTEs `t4`, `t2` and `root` (keys, digest) in DuckDB, over rows of `source`."""
    return f"""t0 AS (SELECT {keys}, sha256(coalesce('=' || ({text}), '')) AS digest FROM {source}),
t4 AS (SELECT {keys}, substr(digest, 1, 4) AS place, sha256(string_agg(digest, '' ORDER BY digest)) AS digest FROM t0 GROUP BY ALL),
t2 AS (SELECT {keys}, substr(t4.place, 1, 2) AS place, sha256(string_agg(digest, '' ORDER BY t4.place)) AS digest FROM t4 GROUP BY {keys}, substr(t4.place, 1, 2)),
root AS (SELECT {keys}, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM t2 GROUP BY {keys})"""
