"""Links from taxa to assessments of another source: one to one on every side, with the first reason why not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import names as N

from .rules import first_reason

# Grades of a checklist that name a category, and categories of the source with their codes.
GRADES = ("LC", "NT", "VU", "EN", "CR", "EW", "EX", "DD", "CR (PE)", "CR (PEW)")
CATEGORIES = {"Least Concern": "LC", "Near Threatened": "NT", "Vulnerable": "VU", "Endangered": "EN", "Critically Endangered": "CR", "Data Deficient": "DD"}


def _count(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def link_assessments(active: DataFrame, source: DataFrame, distributions: DataFrame, link_prefix: str, url_prefix: str) -> DataFrame:
    """active (taxon, name, authority, grade, reference, ...) with reason (null where linked), category, assessment, year and method.

    source (sis, accepted, name, authority, citation, url, status), distributions (sis, category, citation): the source's
    species and their global assessments. A link is the reference under link_prefix; it, the species' number, names and
    assessments must each be the only ones.
    """
    species = source.filter("status = 'accepted'")
    s = species.join(_count(source, ["sis"], "same_sis"), "sis").join(_count(species, ["name"], "same_name"), "name")
    s = s.filter("same_sis = 1").select("sis", F.col("name").alias("s_name"), F.col("authority").alias("s_authority"), "accepted", "same_name", "url", F.col("citation").alias("s_citation"))
    d = distributions.groupBy("sis").agg(F.count("*").alias("global"), F.first("category").alias("raw_category"), F.first("citation").alias("d_citation"))
    codes = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    a = active.join(_count(active, ["taxon"], "same_taxon"), "taxon").join(_count(active, ["name"], "same_active"), "name")
    a = a.join(_count(active.filter("reference is not null"), ["reference"], "same_reference"), "reference", "left")
    a = a.withColumn("sis", F.regexp_extract(F.coalesce("reference", F.lit("")), "^" + link_prefix.replace(".", r"\.") + "([1-9][0-9]*)$", 1))
    j = a.join(_count(source, ["sis"], "all_sis"), "sis", "left").join(s, "sis", "left").join(d, "sis", "left")
    grade = F.upper(F.trim("grade"))
    method = N.author_match(F.col("authority"), F.col("s_authority"))
    identity = N.assessment_identity(F.col("url"), F.col("s_citation"), F.col("sis"), url_prefix)
    j = j.withColumns({"code": F.element_at(codes, F.col("raw_category")), "method": method, "identity": identity})
    reason = first_reason(
        [
            ("ambiguous_active_identity", (F.col("same_taxon") > 1) | (F.col("same_active") > 1)),
            ("not_evaluated_requires_concept_review", grade == "NE"),
            ("unconfirmed_taxonomy_category", ~F.coalesce(grade.isin(*GRADES), F.lit(False))),
            ("missing_exact_link", F.coalesce("reference", F.lit("")) == ""),
            ("invalid_or_ambiguous_exact_link", (F.col("sis") == "") | (F.col("same_reference") > 1)),
            ("duplicate_source_id", F.col("all_sis") > 1),
            ("no_accepted_source_species", F.col("s_name").isNull()),
            ("ambiguous_source_identity", ~F.col("accepted").eqNullSafe(F.col("sis")) | (F.col("same_name") > 1)),
            ("scientific_name_mismatch", F.col("s_name") != F.col("name")),
            ("authority_mismatch", ~F.coalesce(F.col("method").isin("exact", "single_author_initials_omitted"), F.lit(False))),
            ("missing_or_ambiguous_global_assessment", ~F.col("global").eqNullSafe(F.lit(1))),
            ("unsupported_source_category", F.col("code").isNull()),
            ("assessment_identity_or_citation_mismatch", F.col("identity").isNull() | ~F.col("d_citation").eqNullSafe(F.col("s_citation"))),
        ]
    )
    only = lambda c, n: F.when(reason.isNull(), c).alias(n)
    return j.select(*active.columns, reason.alias("reason"), only(F.col("code"), "category"), only(F.col("identity.assessment"), "assessment"), only(F.col("identity.year"), "year"), only(F.col("method"), "method"))
