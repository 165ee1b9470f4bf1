"""Name relations, names to nodes of a hierarchy, and node support: every refusal has a reason, nothing is chosen among equals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hierarchy
from .rules import first_reason, require_none

#: The ranks that a scientific name may have by its number of words.
RANKS_BY_WORDS = {1: ("order", "family", "genus"), 2: ("species",), 3: ("subspecies",)}


def guarded_ancestors(nodes: DataFrame, edges: DataFrame, depth: int = 4) -> DataFrame:
    """(node, ancestor, depth) over paths of which every node and every edge passes the guard.

    nodes (node, ok) and edges (child, parent, ok): rows that fail the guard leave before any path is walked, which is
    the same as testing whole paths.
    """
    good = nodes.filter("ok").select("node")
    e = edges.filter("ok").select("child", "parent")
    e = e.join(good.withColumnRenamed("node", "child"), "child", "left_semi").join(good.withColumnRenamed("node", "parent"), "parent", "left_semi").select("child", "parent")
    return hierarchy.ancestors(e, depth)


def project_relations(records: DataFrame, taxa: DataFrame) -> DataFrame:
    """records (record, scientific_name, terms, ...) with taxon, reason and lower-cased terms: projected only where exactly one taxon has the name."""
    t = taxa.groupBy("scientific_name").agg(F.count_distinct("taxon").alias("targets"), F.min("taxon").alias("only"))
    j = records.join(t, "scientific_name", "left")
    reason = F.coalesce(first_reason({"no_active_taxon": F.col("targets").isNull(), "ambiguous_taxon": F.col("targets") > 1}), F.lit("projected"))
    return j.withColumns({"reason": reason, "taxon": F.when(F.col("targets") == 1, F.col("only")), "terms": F.transform("terms", lambda x: F.lower(x))}).drop("targets", "only")


def by_name(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(name, *keep): a row for each search term and for the scientific name, lower-cased, once each."""
    return rows.select(F.explode(F.array_distinct(F.concat("terms", F.array(F.lower("scientific_name"))))).alias("name"), *keep)


def relation_lookup(names: DataFrame, manifest: DataFrame, edges: DataFrame) -> DataFrame:
    """Per name: relations found over edges (record, taxon), records the manifest expects, how many are missing, and a status.

    status: incomplete where an expected edge is missing (never a shorter answer), none, domestic_form where one is
    among the relations, single where all lead to one taxon, else several.
    """
    want = by_name(manifest, ["record", "entity_kind"])
    found = want.join(edges.select("record", "taxon"), "record", "left")
    per = found.groupBy("name").agg(
        F.count("*").alias("expected"),
        F.count("taxon").alias("relations"),
        F.count_distinct("taxon").alias("taxa"),
        F.bool_or((F.col("entity_kind") == "domestic_form") & F.col("taxon").isNotNull()).alias("domestic"),
    )
    out = names.join(per, "name", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("expected", "relations", "taxa")})
    status = first_reason({"incomplete": F.col("expected") > F.col("relations"), "none": F.col("relations") == 0, "domestic_form": F.col("domestic"), "single": F.col("taxa") == 1})
    return out.select("name", "relations", (F.col("expected") - F.col("relations")).alias("missing"), F.coalesce(status, F.lit("several")).alias("status"))


def require_complete(looked_up: DataFrame) -> DataFrame:
    """The result of relation_lookup(), or an error where an expected relation is missing."""
    require_none(looked_up.filter("status = 'incomplete'"), "incomplete name relations")
    return looked_up


def _compact(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def taxon_candidates(surfaces: DataFrame, nodes: DataFrame) -> DataFrame:
    """surfaces (id, surface) with the one active taxon that each names, or a reason: not_found, ambiguous, label_rank_conflict.

    nodes (taxon, rank, scientific_name, label, active). A surface that looks like a scientific name is looked up as
    such: its number of words restricts the rank, and a hit of a rank that it cannot have is none. Others are labels,
    compared without blanks; a label that ends in the name of another rank than its node's is held.
    """
    shape = r"^[A-Z][a-z]+( [a-z]+){0,2}$"
    words = F.size(F.split("scientific_name", " "))
    allowed = F.coalesce(*[F.when(words == n, F.col("rank").isin(*ranks)) for n, ranks in RANKS_BY_WORDS.items()], F.lit(False))
    live = nodes.filter("active")
    named = live.groupBy("scientific_name").agg(F.count("*").alias("n"), F.bool_or(~allowed).alias("wrong"), F.min("taxon").alias("taxon"))
    a = surfaces.filter(F.col("surface").rlike(shape)).join(named, F.col("surface") == F.col("scientific_name"), "left")
    reason = first_reason({"not_found": F.col("n").isNull() | F.col("wrong"), "ambiguous": F.col("n") > 1})
    a = a.select("id", "surface", reason.alias("reason"), F.when(reason.isNull(), F.col("taxon")).alias("taxon"))
    labels = nodes.filter("label is not null").select(_compact(F.col("label")).alias("key"), F.struct("taxon", "rank", "scientific_name", "label").alias("of")).distinct()
    labels = labels.groupBy("key").agg(F.count("*").alias("n"), F.min("of").alias("of"))
    known = live.groupBy("rank", "scientific_name").agg(F.count("*").alias("nodes"), F.min("taxon").alias("live"))
    b = surfaces.filter(~F.col("surface").rlike(shape)).withColumn("key", _compact(F.col("surface"))).join(labels, "key", "left").select("id", "surface", "n", "of.*")
    b = b.join(known, ["rank", "scientific_name"], "left")
    stated = F.regexp_extract("label", r" (order|family|genus)$", 1)
    reason = first_reason(
        [
            ("not_found", F.col("n").isNull()),
            ("ambiguous", F.col("n") > 1),
            ("label_rank_conflict", (stated != "") & (stated != F.col("rank"))),
            ("not_found", (F.coalesce(F.col("nodes"), F.lit(0)) != 1) | (F.col("live") != F.col("taxon"))),
        ]
    )
    b = b.select("id", "surface", reason.alias("reason"), F.when(reason.isNull(), F.col("taxon")).alias("taxon"))
    return a.unionByName(b)


def node_support(annotations: DataFrame, sources: DataFrame, constraints: list[str]) -> DataFrame:
    """(node, supporting, conflicting): distinct sources of each node; only listed ones support, those of constraint studies count nowhere.

    annotations (node, study, source, kind supports or conflicts). Nodes without support are left out.
    """
    a = annotations.filter(~F.col("study").isin(*constraints)).join(sources.select("source").withColumn("listed", F.lit(True)), "source", "left")
    per = a.groupBy("node").agg(
        F.count_distinct(F.when((F.col("kind") == "supports") & F.col("listed"), F.col("source"))).alias("supporting"),
        F.count_distinct(F.when(F.col("kind") == "conflicts", F.col("source"))).alias("conflicting"),
    )
    return per.filter("supporting > 0")


def phylogeny_mapping(active: DataFrame, crosswalk: DataFrame, tips: DataFrame) -> DataFrame:
    """(taxon, reason, source_name) of every active taxon: mapped (null reason) only where identity holds on every side.

    active (taxon, scientific_name, concept, english), crosswalk (source_name, current_name, concept, english, category,
    number), tips (tip, evidence): number is the source's own id, evidence whether a tip has other than constraint evidence.
    """
    count = lambda rows, key, name: rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))
    a = active.join(count(active, "taxon", "same_taxon"), "taxon").join(count(active, "scientific_name", "same_name"), "scientific_name").join(count(active, "concept", "same_active"), "concept", "left")
    x = crosswalk.join(count(crosswalk, "concept", "same_concept"), "concept", "left").join(count(crosswalk, "source_name", "same_source"), "source_name").join(count(crosswalk, "number", "same_number"), "number", "left")
    x = x.filter("same_concept = 1").select("concept", "source_name", "current_name", F.col("english").alias("source_english"), "category", "same_source", "same_number")
    j = a.join(x, "concept", "left").join(tips, F.regexp_replace("source_name", " ", "_") == F.col("tip"), "left")
    reason = first_reason(
        {
            "ambiguous_active_identity": (F.col("same_taxon") > 1) | (F.col("same_name") > 1),
            "no_unique_crosswalk_concept": F.col("source_name").isNull(),
            "changed_or_ambiguous_source_identity": (F.col("category") != "species") | ~F.col("current_name").eqNullSafe(F.col("scientific_name")) | (F.col("same_source") > 1),
            "ambiguous_source_identity": ~F.col("same_number").eqNullSafe(F.lit(1)),
            "ambiguous_concept": F.col("same_active") > 1,
            "mismatched_english_identity": ~F.col("source_english").eqNullSafe(F.col("english")),
            "absent_from_phylogeny_only": F.col("tip").isNull(),
            "no_nonconstraint_tip_evidence": ~F.col("evidence"),
        }
    )
    return j.select("taxon", reason.alias("reason"), F.when(reason.isNull(), F.col("source_name")).alias("source_name"))
