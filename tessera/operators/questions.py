"""Relational questions: conjunctive trait conditions with coverage, peers that share categories, weighted similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import broadcast_if_small, persist_table

from . import pairs
from .filters import condition_holds


def evaluate_conditions(entities: DataFrame, claims: DataFrame, conditions: DataFrame) -> DataFrame:
    """(entity, evaluable, matched, best): per entity whether every condition has a claim, whether every one holds, and the least claim that holds.

    Conditions are a bounded parameter table (at most eight), so they are broadcast; claims are read once.
    """
    n = conditions.count()
    hits = claims.join(F.broadcast(conditions), "trait").withColumn("holds", condition_holds())
    per = hits.groupBy("entity", "cond").agg(F.bool_or("holds").alias("ok"), F.min(F.when(F.col("holds"), F.col("claim"))).alias("best"))
    per = per.groupBy("entity").agg(F.count("*").alias("present"), F.count_if("ok").alias("met"), F.min("best").alias("best"))
    out = entities.select("entity").join(per, "entity", "left")
    return out.select("entity", (F.coalesce("present", F.lit(0)) == n).alias("evaluable"), (F.coalesce("met", F.lit(0)) == n).alias("matched"), F.when(F.col("met") == n, F.col("best")).alias("best"))


def coverage(evaluated: DataFrame) -> DataFrame:
    """scoped >= evaluable >= matched, and a status: answer, empty (nothing matched) or insufficient_data (nothing evaluable)."""
    c = evaluated.agg(F.count("*").alias("scoped"), F.count_if("evaluable").alias("evaluable"), F.count_if(F.col("evaluable") & F.col("matched")).alias("matched"))
    return c.withColumn("status", F.when(F.col("matched") > 0, "answer").when(F.col("evaluable") > 0, "empty").otherwise("insufficient_data"))


def trait_answer(entities: DataFrame, claims: DataFrame, conditions: DataFrame, limit: int = 20) -> DataFrame:
    """The first `limit` matched entities by name and id, with their best claim and the coverage counts on each row."""
    ev = evaluate_conditions(entities, claims, conditions)
    top = ev.filter("matched").join(entities.select("entity", "name"), "entity").orderBy("name", "entity").limit(limit)
    return top.select("entity", "name", "best").crossJoin(coverage(ev))  # one row of counts


def category_peers(claims: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin, trait, value_text, peer): entities with the same text value of a trait in the same dataset as an origin, without itself."""
    o = claims.join(origins.select(F.col("entity")), "entity", "left_semi").select(F.col("entity").alias("origin"), "trait", "value_text", "dataset")
    p = claims.select(F.col("entity").alias("peer"), "trait", "value_text", "dataset")
    return o.filter("value_text is not null").join(p, ["trait", "value_text", "dataset"]).filter("origin <> peer").select("origin", "trait", "value_text", "peer").distinct()


def peers_sharing(claims: DataFrame, origins: DataFrame, trait: str, other: str) -> DataFrame:
    """(origin, peer, same): the peers of category_peers for `trait`, each with whether they share a value of `other` too: a row for each
    value of `trait` that they share, and for each of `other`.

    Entities that agree in their values of both are a cell. Cells are compared with cells; pairs of entities are made from the
    cells' lists alone, and are never shuffled.
    """
    value = F.struct("value_text", "dataset")
    c = claims.filter(F.col("value_text").isNotNull() & F.col("dataset").isNotNull() & F.col("trait").isin(trait, other))
    of = lambda t, name: F.array_sort(F.collect_set(F.when(F.col("trait") == t, value))).alias(name)
    asked = origins.select("entity").distinct().withColumn("asked", F.lit(True))
    e = c.groupBy("entity").agg(of(trait, "first"), of(other, "second")).filter("size(first) > 0").join(asked, "entity", "left")
    e = persist_table(e, "entities")
    cells = persist_table(e.groupBy("first", "second").agg(F.bool_or("asked").alias("asked")).withColumn("cell", F.monotonically_increasing_id()), "cells")
    e = persist_table(e.drop("asked").join(broadcast_if_small(cells.drop("asked")), ["first", "second"]).select("entity", "cell").join(asked, "entity", "left"), "members")
    opened = lambda name: cells.select("cell", "asked", F.explode(name).alias("v")).select("cell", "asked", "v.*")

    def meet(name: str) -> DataFrame:
        x = opened(name)
        left, right = x.filter("asked").select(F.col("cell").alias("l_cell"), "value_text", "dataset"), x.select(F.col("cell").alias("r_cell"), "value_text", "dataset")
        return left.join(right, ["value_text", "dataset"]).select("l_cell", "r_cell", "value_text").distinct().drop("value_text")

    between = meet("first").join(meet("second").withColumn("same", F.lit(True)), ["l_cell", "r_cell"], "left").withColumn("same", F.coalesce("same", F.lit(False)))
    p = pairs.block_pairs(e.filter("asked").select("cell", "entity"), e.select("cell", "entity"), ["cell"], between)
    return p.filter("l.entity <> r.entity").select(F.col("l.entity").alias("origin"), F.col("r.entity").alias("peer"), "same")


def category_counts(claims: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin, trait, value_text, peers): how many entities category_peers would give, from counts of groups.

    Only where an origin has a value from several datasets, whose members may repeat, are those members looked at.
    """
    c = claims.filter("value_text is not null").select("entity", "trait", "value_text", "dataset").distinct()
    sizes = c.groupBy("trait", "value_text", "dataset").agg(F.count("*").alias("members"))
    o = c.join(origins.select("entity"), "entity", "left_semi").withColumnRenamed("entity", "origin")
    o = o.withColumn("ways", F.count("*").over(Window.partitionBy("origin", "trait", "value_text")))
    one = o.filter("ways = 1").join(sizes, ["trait", "value_text", "dataset"]).select("origin", "trait", "value_text", (F.col("members") - 1).alias("peers"))
    many = o.filter("ways > 1").join(c, ["trait", "value_text", "dataset"]).filter("origin <> entity").groupBy("origin", "trait", "value_text").agg(F.count_distinct("entity").alias("peers"))
    return one.filter("peers > 0").unionByName(many)


def first_of(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """keys, firsts: the k first rows of each group by the columns of `order`, as an array of structs. Tasks keep k rows of a group each
    before anything is shuffled, so a hot group is no single task's work."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).filter(F.col("_n") <= k).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("firsts"))


def first_category_peers(claims: DataFrame, origins: DataFrame, k: int) -> DataFrame:
    """(origin, trait, value_text, peer, rank, has_more): the k first peers by id, from the k + 2 first members of each group."""
    c = claims.filter("value_text is not null").select("entity", "trait", "value_text", "dataset").distinct()
    g = first_of(c, ["trait", "value_text", "dataset"], ["entity"], k + 2)
    o = c.join(origins.select("entity"), "entity", "left_semi").withColumnRenamed("entity", "origin")
    x = o.join(g, ["trait", "value_text", "dataset"]).select("origin", "trait", "value_text", F.explode("firsts.entity").alias("peer")).filter("origin <> peer").distinct()
    return top_with_more(x, ["origin", "trait", "value_text"], ["peer"], k)


def top_with_more(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The k first rows of each group with rank, and has_more where there is another; groups must be short lists by now."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({"rank": F.row_number().over(w.orderBy(*order)).cast("long"), "has_more": F.count("*").over(w) > k}).filter(F.col("rank") <= k)


def related(entities: DataFrame, origins: DataFrame, k: int) -> DataFrame:
    """(origin, peer, relation, rank, has_more): the k first entities of the same genus, and the k first of the same order in other genera.

    An order's list holds at most k members of each genus and ends after 2k + 1, so whatever genus an origin leaves out, k + 1
    others stand in it where there are as many.
    """
    e = entities.select("entity", "genus", "order")
    genus = first_of(e, ["order", "genus"], ["entity"], k + 2)
    capped = genus.select("order", "genus", F.explode(F.slice("firsts.entity", 1, k)).alias("entity"))
    order = first_of(capped, ["order"], ["entity", "genus"], 2 * k + 1)
    o = e.join(origins.select("entity"), "entity", "left_semi").withColumnRenamed("entity", "origin")
    near = o.join(genus, ["order", "genus"]).select("origin", F.explode("firsts.entity").alias("peer"), F.lit("genus").alias("relation")).filter("origin <> peer")
    far = o.join(order, "order").select("origin", "genus", F.explode("firsts").alias("m")).filter("m.genus <> genus").select("origin", F.col("m.entity").alias("peer"), F.lit("order").alias("relation"))
    return top_with_more(near.unionByName(far), ["origin", "relation"], ["peer"], k)


def habitat_diet(claims: DataFrame, entities: DataFrame, origins: DataFrame, k: int) -> DataFrame:
    """(variant, origin, peer, name, rank, has_more): peers of an origin by name, in three variants.

    same_niche: the origin's habitat and diet; other_niche: its habitat, none of its diets; same_diet: its diet, whatever the habitat.
    Values are the same where trait, text and dataset are. Lists are cut as in `related`.
    """
    c = claims.filter("value_text is not null").select("entity", "trait", F.struct("value_text", "dataset").alias("value")).distinct()
    of = lambda trait, name: c.filter(F.col("trait") == trait).select("entity", F.col("value").alias(name))
    h, d = of("habitat", "habitat"), of("diet", "diet")
    e = entities.select("entity", "name")
    both = h.join(d, "entity").join(e, "entity")
    o = origins.select("entity")
    oh, od = (x.join(o, "entity", "left_semi").withColumnRenamed("entity", "origin") for x in (h, d))
    peers = lambda rows, variant: rows.filter("origin <> m.entity").select(F.lit(variant).alias("variant"), "origin", F.col("m.entity").alias("peer"), F.col("m.name").alias("name")).distinct()
    same = oh.join(od, "origin").join(first_of(both, ["habitat", "diet"], ["name", "entity"], k + 2), ["habitat", "diet"]).select("origin", F.explode("firsts").alias("m"))
    only = od.join(first_of(d.join(e, "entity"), ["diet"], ["name", "entity"], k + 2), "diet").select("origin", F.explode("firsts").alias("m"))
    # Those of a habitat by their sets of diets; an entity without a diet has the empty set.
    sets = h.join(d.groupBy("entity").agg(F.array_sort(F.collect_set("diet")).alias("diets")), "entity", "left").join(e, "entity").withColumn("diets", F.coalesce("diets", F.expr("array()").cast(f"array<{d.schema['diet'].dataType.simpleString()}>")))
    cells = first_of(sets, ["habitat", "diets"], ["name", "entity"], k + 2)
    own = od.groupBy("origin").agg(F.collect_set("diet").alias("own"))
    other = oh.join(own, "origin").join(cells, "habitat").filter(~F.arrays_overlap("own", "diets")).select("origin", F.explode("firsts").alias("m"))
    rows = peers(same, "same_niche").unionByName(peers(other, "other_niche")).unionByName(peers(only, "same_diet"))
    return top_with_more(rows, ["variant", "origin"], ["name", "peer"], k)


def similarity(entities: DataFrame, origins: DataFrame, k: int, within: str | None = None) -> DataFrame:
    """(origin, peer, score, rank): the k most similar entities of the same order; with `within`, k for each value of that column.

    entities: entity, order, genus, habitat, diet, depth. Weights: order 10, genus 20, habitat 10, diet 10, and closeness, which
    is the dense level of `depth` among the levels of the origin's pool, worth 50; where a peer's depth is unknown, the other
    parts are rescaled to 100. Equal scores are ordered by id. No pairs of entities are made: entities that agree in all of
    these are a cell with a count and its first ids, and all origins of a cell have the same scores and, but for themselves, the
    same best. So cells meet cells of their order, and each origin leaves itself out of its cell's list of k + 1.
    """
    extra = [within] if within else []
    key = ["order", "genus", "habitat", "diet", "depth", *extra]
    e = entities.select("entity", *key).join(origins.select("entity").distinct().withColumn("asked", F.lit(True)), "entity", "left")
    count = e.groupBy(*key).agg(F.count("*").alias("members"), F.bool_or("asked").alias("asked"))
    firsts = first_of(e, key, ["entity"], k + 1).withColumnsRenamed({c: f"f_{c}" for c in key})
    cells = persist_table(count.join(firsts, F.expr(" and ".join(f"(`{c}` <=> f_{c})" for c in key))).drop(*[f"f_{c}" for c in key]).withColumn("cell", F.monotonically_increasing_id()), "cells")
    o = cells.filter("asked").select(F.col("cell").alias("own"), *[F.col(c).alias(f"o_{c}") for c in key])
    # A cell whose one member is the origin is no peer's.
    x = o.join(cells, F.col("o_order") == F.col("order")).filter("own <> cell or members > 1")
    w = Window.partitionBy("own")
    x = x.withColumn("level", F.when(F.col("depth").isNotNull(), F.dense_rank().over(w.orderBy(F.col("depth").asc_nulls_last())))).withColumn("levels", F.max("level").over(w))
    agree = lambda c: F.expr(f"o_{c} <=> `{c}`")
    base = F.lit(10) + F.when(agree("genus"), 20).otherwise(0) + F.when(agree("habitat"), 10).otherwise(0) + F.when(agree("diet"), 10).otherwise(0)
    score = F.when(F.col("level").isNull(), F.bround(base * 2.0, 1)).otherwise(base + F.bround(50.0 * F.col("level") / F.col("levels"), 1)).cast("double")
    x = x.withColumn("score", score).select("own", "cell", "members", "score", *extra)
    # Members of cells with a higher score, all of which come first.
    above = F.sum("members").over(Window.partitionBy("own", *extra).orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("members").over(Window.partitionBy("own", "score", *extra))
    open_ = x.withColumn("above", above).filter(F.col("above") <= k).select("own", "cell", "score", *extra)
    peers = open_.join(broadcast_if_small(cells.select("cell", "firsts")), "cell").select("own", *extra, (-F.col("score")).alias("less"), F.explode("firsts.entity").alias("peer"))
    n = F.row_number().over(Window.partitionBy("own", *extra).orderBy("less", "peer"))
    best = peers.withColumn("n", n).filter(F.col("n") <= k + 1).groupBy("own", *extra).agg(F.array_sort(F.collect_list(F.struct("less", "peer"))).alias("best"))
    best = broadcast_if_small(persist_table(best, "best-of-cells"))
    of = e.filter("asked").select(F.col("entity").alias("origin"), *[F.col(c).alias(f"e_{c}") for c in key])
    mine = of.join(broadcast_if_small(o), F.expr(" and ".join(f"(e_{c} <=> o_{c})" for c in key))).select("origin", "own").join(best, "own")
    others = F.slice(F.filter("best", lambda p: p["peer"] != F.col("origin")), 1, k)
    out = mine.select("origin", *extra, F.posexplode(others).alias("at", "p"))
    return out.select("origin", "p.peer", (-F.col("p.less")).alias("score"), (F.col("at") + 1).cast("long").alias("rank"), *extra)


def closeness_levels(entities: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin, level, n, levels): how many peers of the same order an origin has at each level of depth, from counts by order and depth."""
    e = entities.filter("depth is not null").select("entity", "order", "depth")
    counts = e.groupBy("order", "depth").agg(F.count("*").alias("n"))
    o = entities.join(origins.select("entity"), "entity", "left_semi").select(F.col("entity").alias("origin"), "order", F.col("depth").alias("own"))
    x = o.join(counts, "order").withColumn("n", F.col("n") - F.when(F.col("own") == F.col("depth"), 1).otherwise(0)).filter("n > 0")
    w = Window.partitionBy("origin")
    x = x.withColumn("level", F.dense_rank().over(w.orderBy("depth")).cast("long"))
    return x.select("origin", "level", "n", F.max("level").over(w).alias("levels"))
