"""Name suggestions: exact and compact matches first, then names near in letters; a suggestion is never a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalars as S
from tessera.session import broadcast_if_small, persist_table

# Limits of what is looked up by letters, and how many names are verified and suggested.
MOST_CHARS, MOST_TOKENS, VERIFIED, SUGGESTED = 40, 4, 10, 3
SENTENCE_MARKS = r"[?!.,;:？！。\n]"


def trigrams(name: Column) -> Column:
    """All runs of three characters of a name in lower case with a blank before and after."""
    padded = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substr(padded, i, F.lit(3)))


def _vectors(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, grams: map of counts, size: sum of squares)."""
    c = rows.select(key, F.explode(trigrams(F.col(text))).alias("g")).groupBy(key, "g").agg(F.count("*").cast("int").alias("n"))
    return c.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("g", "n"))).alias("grams"), F.sum(F.col("n") * F.col("n")).alias("size"))


def letter_neighbours(mentions: DataFrame, names: DataFrame, floor: float) -> DataFrame:
    """(mention, name, score): all pairs of distinct texts whose cosine over trigram counts is floor or more (score has six places).

    Names are listed under their rarest trigrams alone: the frequent rest of a name, shorter than floor times its length, cannot
    give the floor by itself, so a pair that reaches it shares a listed trigram.
    """
    n = persist_table(_vectors(names, "name", "name"), "name-vectors")
    m = persist_table(_vectors(mentions, "mention", "mention"), "mention-vectors")
    each = n.select("name", "size", F.explode("grams").alias("g", "k"))
    df = each.groupBy("g").agg(F.count("*").alias("df"))
    rest = Window.partitionBy("name").orderBy(F.desc("df"), "g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    listed = each.join(broadcast_if_small(persist_table(df, "trigram-counts")), "g").withColumn("tail", F.sum(F.col("k") * F.col("k")).over(rest))
    listed = persist_table(listed.filter(F.col("tail") >= (floor * floor - 1e-9) * F.col("size")).select("g", "name"), "listed")
    pairs = m.select("mention", F.explode("grams").alias("g", "k")).join(broadcast_if_small(listed), "g").select("mention", "name").distinct()
    both = pairs.join(m, "mention").join(n.withColumnsRenamed({"grams": "other", "size": "other_size"}), "name")
    dot = F.aggregate(F.map_entries("grams"), F.lit(0).cast("long"), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("other", e["key"]), F.lit(0)))
    score = F.round(dot / F.sqrt(F.col("size").cast("double") * F.col("other_size")), 6)
    return both.select("mention", "name", score.alias("score")).filter(F.col("score") >= floor)


def suggest_names(mentions: DataFrame, inventory: DataFrame, cosine: float = 0.25, spelling: float = 0.20) -> DataFrame:
    """(id, mention, status, method, entity, rank, score): a matched name, up to three suggestions, or a row that none was found.

    mentions: id, mention. inventory: entity, name (unique), active. Exact names match, then names of letters alone without their
    blanks. What is too long, has more than four words or a sentence mark is not looked up by letters. Of the ten nearest names
    those of `cosine` or more are suggested; if there is none, those of `spelling` or more that are one edit away. Names that are
    not active are no match and are not suggested. Nothing can be suggested from an empty inventory: unavailable.
    """
    inv = persist_table(inventory.select("entity", "name", "active"), "inventory")
    m = persist_table(mentions.select("id", "mention"), "mentions")
    live = inv.filter("active").select("entity", "name")
    row = lambda df, status, method: df.select("id", "mention", F.lit(status).alias("status"), F.lit(method).alias("method"), "entity", "rank", "score")
    none = lambda df: df.withColumns({"entity": F.lit(None).cast(inv.schema["entity"].dataType), "rank": F.lit(None).cast("int"), "score": F.lit(None).cast("double")})
    matched = lambda df: df.withColumns({"rank": F.lit(None).cast("int"), "score": F.lit(None).cast("double")})
    exact = m.join(live, F.col("mention") == F.col("name"))
    rest = m.join(exact.select("id"), "id", "left_anti").withColumn("compact", S.compact_name(F.col("mention")))
    close = rest.filter("compact is not null and compact <> mention").join(live, F.col("compact") == F.col("name"))
    rest = persist_table(rest.join(close.select("id"), "id", "left_anti").withColumn("sought", F.coalesce("compact", "mention")), "unmatched")
    searchable = (F.length("mention") <= MOST_CHARS) & (F.size(F.split(F.trim("mention"), r"\s+")) <= MOST_TOKENS) & ~F.col("mention").rlike(SENTENCE_MARKS)
    if inv.isEmpty():
        out = row(none(rest.filter(searchable)), "unavailable", "none")
        return out.unionByName(row(none(rest.filter(~F.coalesce(searchable, F.lit(False)))), "not_found", "none"))
    asked = rest.filter(searchable).select("id", "mention", "sought")
    near = letter_neighbours(asked.select(F.col("sought").alias("mention")).distinct(), inv.select("name"), min(cosine, spelling)).withColumnRenamed("mention", "sought")
    first = Window.partitionBy("sought").orderBy(F.desc("score"), "entity")
    top = near.join(broadcast_if_small(inv), "name").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= VERIFIED)
    top = top.withColumn("high", F.max(F.col("score") >= cosine).over(Window.partitionBy("sought")))
    ok = F.when(F.col("high"), F.col("score") >= cosine).otherwise((F.col("score") >= spelling) & S.one_edit(F.col("sought"), F.col("name")))
    good = top.filter(ok & F.col("active")).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= SUGGESTED).select("sought", "entity", "rank", F.round("score", 4).alias("score"))
    suggested = persist_table(asked.join(good, "sought"), "suggested")
    lost = rest.join(suggested.select("id"), "id", "left_anti")
    parts = [row(matched(exact), "matched", "exact"), row(matched(close), "matched", "compact"), row(suggested, "candidates", "letters"), row(none(lost), "not_found", "none")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
