"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A benchmark item with n shingles that a document contains to a share t has at least ceil(t*n) of them in it, so one
of its n - ceil(t*n) + 1 least hashes is in the document: this bottom MinHash sketch misses nothing. Documents are
partitioned by size (powers of two); each partition keeps only those of its shingles that lie at or below the largest
sketch value of the items that could fit, and meets the sketches by an equality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persist_table, small_enough

BROADCAST_ROWS = 200_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(w: Column, k: int) -> Column:
    """Hashes of the k-word shingles of a word array, repeats included; fewer words are one shingle, none are none."""
    n = F.size(w)
    many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(n >= k, many).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 75, k: int = 5) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for every item contained in a document to at least percent/100.

    Words are runs of letters and digits, lowered. Items without words match nothing; an item of fewer than k words
    matches only a text with just these words. Null texts are empty. Rows with a null id are not reported; of rows that
    share an id, an item is reported once, with its largest containment. Either table may be empty.
    """
    items = bench.select(F.col(item_col).alias("item_id"), _words(F.col(item_text_col)).alias("w"))
    items = items.select("item_id", F.array_sort(F.array_distinct(_shingles(F.col("w"), k))).alias("g")).filter("item_id is not null and size(g) > 0")
    items = persist_table(items.dropDuplicates().withColumn("n_item", F.size("g")), "items")
    needed = F.floor((F.col("n_item") * percent + 99) / 100).cast("int")
    sketch = persist_table(items.select("item_id", needed.alias("needed"), F.explode(F.slice("g", F.lit(1), F.col("n_item") - needed + 1)).alias("h")), "sketch")
    # The largest sketch value among the items that fit into a size partition: at most 32 rows.
    classes = sketch.groupBy(F.floor(F.log2(F.col("needed"))).cast("int").alias("c")).agg(F.max("h").alias("top")).orderBy("c").collect()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    if not classes:
        return base.limit(0).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", dict(items.dtypes)["item_id"]), ("n_item", "bigint"), ("n_shared", "bigint"), ("containment", "double"))])
    size = F.greatest(F.size("w") - (k - 1), F.lit(1))
    bound, top = None, None
    for r in classes:
        top = r["top"] if top is None else max(top, r["top"])
        cond = size >= (1 << r["c"])
        bound = [(cond, top)] if bound is None else [*bound, (cond, top)]
    limit = F.lit(None).cast("bigint")
    for cond, t in bound:
        limit = F.when(cond, F.lit(t)).otherwise(limit)
    worded = base.select("doc_id", _words(F.col("text")).alias("w")).filter(F.size("w") > 0).select("doc_id", "w", limit.alias("limit")).filter("limit is not null")
    hashes = worded.select("doc_id", F.explode(F.filter(_shingles(F.col("w"), k), lambda h: h <= F.col("limit"))).alias("h"))
    probe = sketch.select("h", "item_id")
    found = hashes.join(F.broadcast(probe) if small_enough(sketch, BROADCAST_ROWS) else probe, "h").select("doc_id", "item_id").distinct()
    found = persist_table(found, "candidates")
    which = found.select("doc_id").distinct()
    texts = base.join(F.broadcast(which) if small_enough(which, BROADCAST_ROWS) else which, "doc_id", "left_semi")
    # Words are a column of their own first: within the shingles' lambda they would be split anew for every shingle.
    sets = texts.select("doc_id", _words(F.col("text")).alias("w")).select("doc_id", F.array_distinct(_shingles(F.col("w"), k)).alias("d"))
    of_items = items.select("item_id", "g", "n_item")
    pairs = sets.join(found, "doc_id").join(F.broadcast(of_items) if small_enough(items, BROADCAST_ROWS // 20) else of_items, "item_id")
    pairs = pairs.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), F.size(F.array_intersect("d", "g")).cast("long").alias("n_shared"))
    pairs = pairs.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_item", "x.n_shared", "x.containment")


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows whose id is reported by contaminated(); rows with a null id stay; columns stay as they are."""
    bad = persist_table(contaminated(docs, bench, id_col, text_col, **how).select(F.col("doc_id").alias("_contaminated")).distinct(), "contaminated")
    side = F.broadcast(bad) if small_enough(bad, BROADCAST_ROWS) else bad
    return docs.join(side, docs[id_col] == side["_contaminated"], "left_anti")
