"""Policy guards, validation into issue rows, and one-row quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S


def allowed_chunks(chunk: DataFrame, document: DataFrame, embedding: bool = False) -> DataFrame:
    """Chunks whose own status and whose document's status and flags allow them; a chunk without a document is denied."""
    d = document.filter("policy_status = 'allowed' AND fulltext_allowed AND chunk_allowed" + (" AND embedding_allowed" if embedding else ""))
    return chunk.filter("policy_status = 'allowed'").join(d.select("document", "source", "lang"), "document")


def registered(rows: DataFrame, registry: DataFrame, key: str = "source") -> DataFrame:
    """Rows whose source is registered, enabled and allowed."""
    return rows.join(registry.filter("enabled AND policy_status = 'allowed'"), key, "left_semi")


def masked_coordinates(obs: DataFrame) -> DataFrame:
    public = F.col("sensitivity") == "public"
    return obs.withColumns({"lat": F.when(public, F.col("lat")), "lon": F.when(public, F.col("lon")), "withheld": ~public & (F.col("lat").isNotNull() | F.col("lon").isNotNull())})


def issues(rows: DataFrame, key: Column, rules: list[tuple[str, str, Column]], stage: str = "validate", severity: str = "blocked") -> DataFrame:
    """(record_key, stage, reason_code, severity, field_path): one row for each rule (reason, field, condition) that a row breaks."""
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(reason).alias("reason_code"), F.lit(field).alias("field_path"))) for reason, field, cond in rules]))
    return rows.select(key.cast("string").alias("record_key"), F.explode(found).alias("i")).select("record_key", F.lit(stage).alias("stage"), "i.reason_code", F.lit(severity).alias("severity"), "i.field_path")


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """All reasons that hold for a row, in rule order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(reason)) for reason, cond in rules]))


def gate(rows: DataFrame, measures: dict[str, Column], failures: list[tuple[str, Column]]) -> DataFrame:
    """One row: measures over all rows, ready, and the failed checks (conditions over the measures), in order."""
    m = rows.agg(*[c.alias(n) for n, c in measures.items()])
    m = m.withColumn("reasons", F.array_join(reasons(failures), ","))
    return m.withColumn("ready", F.col("reasons") == "")


def answer_issues(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answers (cited, text, …) with unknown_citation, and private_value where the text holds the private value of what it cites.

    evidence: cited (unique), private (null where nothing is private). An answer is refused where either holds.
    """
    j = answers.join(evidence.select("cited", F.lit(True).alias("_known"), F.col("private").cast("string").alias("_private")), "cited", "left")
    leaks = F.coalesce((F.col("_private") != "") & F.contains("text", "_private"), F.lit(False))
    return j.withColumns({"unknown_citation": F.col("_known").isNull(), "private_value": leaks}).drop("_known", "_private")


def run_gates(rows: DataFrame, keys: list[str], measures: dict[str, Column], page_limit: int, most_rejected: float = 0.25) -> DataFrame:
    """One row a run: measures (raw, rejected, pages, page_errors, complete), ready, and the failed gates: page_error, no_records, none_valid,
    reject_ratio over most_rejected, and truncated where the pages reach their limit before the source is complete."""
    m = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])
    failures = [
        ("page_error", F.col("page_errors") > 0),
        ("no_records", F.col("raw") == 0),
        ("none_valid", F.col("raw") == F.col("rejected")),
        ("reject_ratio", F.col("rejected") > most_rejected * F.col("raw")),
        ("truncated", ~F.col("complete") & (F.col("pages") >= page_limit)),
    ]
    m = m.withColumn("reasons", F.array_join(reasons(failures), ","))
    return m.withColumn("ready", F.col("reasons") == "")


def relation_issues(records: DataFrame, kinds: tuple[str, ...], types: tuple[str, ...], own_type: dict[str, str], other_type: str, most_terms: int = 12, longest: int = 200) -> DataFrame:
    """(id, issue) of a manifest of name relations (id, entity_id, entity_kind, relation_type, name, scientific_name, note, terms, urls, titles).

    Ids are given and unique; kinds and types are known ones and agree (own_type by kind, else other_type); texts are not blank; there
    are 1 to most_terms trimmed terms; an entity has one definition (name, kind, terms); citations are titled https URLs.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    copies = records.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_copies"))
    shape = F.to_json(F.struct("name", "entity_kind", F.array_sort(F.transform("terms", lambda t: F.lower(t))).alias("terms")))
    ways = records.groupBy(F.col("entity_id").alias("_entity")).agg(F.count_distinct(shape).alias("_ways"))
    j = records.join(copies, F.col("id").eqNullSafe(F.col("_id")), "left").join(ways, F.col("entity_id").eqNullSafe(F.col("_entity")), "left")
    expected = F.coalesce(*[F.when(F.col("entity_kind") == k, t) for k, t in own_type.items()], F.lit(other_type))
    bad_term = F.exists("terms", lambda t: t.isNull() | blank(t) | (t != F.trim(t)) | (F.length(t) > longest))
    known = F.coalesce(F.col("entity_kind").isin(*kinds) & F.col("relation_type").isin(*types), F.lit(False))
    uri = lambda u: F.coalesce(S.web_url(u) & F.lower(u).startswith("https:"), F.lit(False))
    rules = [
        ("id_not_unique", blank(F.col("id")) | (F.col("_copies") > 1)),
        ("unknown_type", ~known),
        ("kind_and_type_disagree", known & (F.col("relation_type") != expected)),
        ("missing_field", blank(F.col("entity_id")) | blank(F.col("name")) | blank(F.col("scientific_name")) | blank(F.col("note"))),
        ("invalid_terms", F.coalesce(~F.size("terms").between(1, most_terms) | bad_term, F.lit(True))),
        ("conflicting_definition", F.col("_ways") > 1),
        ("invalid_citation", F.coalesce((F.size("urls") < 1) | F.exists("urls", lambda u: ~uri(u)) | F.exists("titles", blank) | (F.size("urls") != F.size("titles")), F.lit(True))),
    ]
    return j.select("id", F.explode(reasons(rules)).alias("issue"))


def manifest_mismatch(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, reason) of files that differ from a manifest of path, sha256 and bytes."""
    j = actual.select("path", F.col("sha256").alias("a_sha"), F.col("bytes").alias("a_bytes")).join(manifest, "path", "full")
    reason = F.when(F.col("a_sha").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("bytes") != F.col("a_bytes"), "bytes").when(F.col("sha256") != F.col("a_sha"), "sha256")
    return j.select("path", reason.alias("reason")).filter("reason is not null")


def distribution_issues(rows: DataFrame, key: str, shares: Column) -> DataFrame:
    return rows.select(key, S.distribution_status(shares).alias("status"))
