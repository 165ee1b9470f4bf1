"""Queries of record validation: records are JSON texts that SQL derives from the given tables, so that each rule is broken by some."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import validation as V
from tessera.streaming import occurrences

from .registry import query
from .stand_ins import table
from .stream_queries import _REASONED, _raw

_TYPES = ("taxonomy", "observation", "document", "chunk", "place")


def _field(name: str, id_: str, good: str, bad: dict[int, str | None], text: bool = True) -> str:
    """SQL of one JSON field: `good` (an SQL text), but where the id leaves no rest by a number, what is given there (None: no field)."""
    quote = '"' if text else ""
    cases = "".join(f"WHEN {id_} % {m} = 0 THEN " + (f"""',"{name}":{raw}' """ if raw is not None else "'' ") for m, raw in bad.items())
    whole = f"""',"{name}":{quote}' || {good} || '{quote}'"""
    return f"CASE {cases}ELSE {whole} END" if bad else whole


def _json(id_: str, fields: list[str]) -> str:
    return f"""'{{"n":' || CAST({id_} AS STRING) || """ + " || ".join(fields) + " || '}'"


_N, _I = "CAST(event_id AS STRING)", "event_id"
_COMMON_FIELDS = [_field("record_key", _I, f"'r' || {_N}", {173: None}), _field("source_id", _I, "'s'", {179: '""'}), *[_field(f, _I, "'x'", {m: "null"}) for f, m in (("source_release", 181), ("external_id", 191), ("raw_object_uri", 193), ("raw_sha256", 197), ("retrieved_at", 199), ("parser_version", 211), ("ingestion_run_id", 223))], _field("license_policy_status", _I, "'allowed'", {61: '"maybe"', 227: None, 71: "7"})]
_OF = {
    "taxonomy": [_field(f, _I, "'t'", {m: raw}) for f, m, raw in (("source_taxon_id", 11, None), ("rank", 13, '""'), ("taxonomic_status", 17, "null"), ("scientific_name_raw", 19, None), ("concept_set_version", 23, '""'))],
    "observation": [
        *[_field(f, _I, "'o'", {m: None}) for f, m in (("occurrence_id", 29), ("scientific_name_raw", 31), ("basis_of_record", 37))],
        _field("event_date_raw", _I, "CAST(CAST(ts AS DATE) AS STRING)", {41: '"2024-02-30"', 43: None, 47: "20240101", 11: '"2024-13"', 13: '"2024-05"', 53: '"yesterday"'}), _field("event_date_precision", _I, "'day'", {59: '"week"', 11: '"month"', 13: '"month"', 17: '"year"', 19: None}),
        _field("latitude_private", _I, "CAST(event_id % 91 AS STRING)", {7: "91.5", 23: None, 67: '"north"'}, False), _field("longitude_private", _I, "CAST(event_id % 181 AS STRING)", {9: "-180.5", 29: None, 73: "true"}, False),
        _field("latitude_public", _I, "'1.25'", {6: None, 7: "-91", 17: None}, False), _field("longitude_public", _I, "'2.5'", {6: None, 79: "null", 14: "2.0", 9: "200"}, False),
        _field("count", _I, "CAST(event_id % 7 AS STRING)", {3: None, 31: "-1", 37: "1.5", 41: '"2"', 43: "true"}, False), _field("sensitivity_class", _I, "'public'", {8: '"secret"', 4: '"unknown"', 83: None}), _field("occurrence_status", _I, "'present'", {12: '"maybe"', 89: '""'}),
    ],
    "document": [*[_field(f, _I, "'d'", {m: None}) for f, m in (("document_id", 11), ("title", 13), ("language", 17))], *[_field(f, _I, "'true'", {m: raw}, False) for f, m, raw in (("fulltext_storage_allowed", 19, '"yes"'), ("chunk_storage_allowed", 23, None), ("embedding_allowed", 29, "1"))]],
    "chunk": [*[_field(f, _I, "'c'", {m: '""'}) for f, m in (("chunk_id", 11), ("document_id", 13), ("section_path", 17), ("text", 19), ("locator", 23), ("content_hash", 29))], _field("ordinal", _I, "CAST(event_id % 5 AS STRING)", {31: None, 37: "1.0", 41: '"1"'}, False)],
    "place": [],
}
_TYPE = "CASE event_id % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END"
_RECORD = "CASE event_id % 5 " + " ".join(f"WHEN {i} THEN {_json(_I, _COMMON_FIELDS + _OF[t])}" for i, t in enumerate(_TYPES)) + " END"
_RECORDS = f"SELECT {_TYPE} AS record_type, {_RECORD} AS record FROM events"


def _x(f: str) -> str:
    return f"json_extract(j, '$.{f}')"


def _kind(f: str) -> str:
    return f"coalesce(json_type(j, '$.{f}'), 'NULL')"


def _missing(*fields: str) -> list[tuple[str, str, str]]:
    return [("missing_required_field", f, f"{_kind(f)} = 'NULL' OR json_extract_string(j, '$.{f}') = ''") for f in fields]


def _closed(f: str, values: tuple[str, ...], reason: str) -> tuple[str, str, str]:
    return reason, f, f"NOT coalesce({_kind(f)} = 'VARCHAR' AND json_extract_string(j, '$.{f}') IN {values}, false)"


_INTS, _NUMS = "('BIGINT', 'UBIGINT')", "('BIGINT', 'UBIGINT', 'DOUBLE')"


def _pair(lat: str, lon: str) -> list[tuple[str, str, str]]:
    off = lambda f, most: f"NOT coalesce({_kind(f)} IN {_NUMS} AND try_cast(json_extract_string(j, '$.{f}') AS DOUBLE) BETWEEN -{most} AND {most}, false)"
    here = lambda f: f"{_kind(f)} <> 'NULL'"
    return [("incomplete_coordinate", lat, f"NOT {here(lat)} AND {here(lon)}"), ("incomplete_coordinate", lon, f"{here(lat)} AND NOT {here(lon)}"), ("invalid_latitude", lat, f"{here(lat)} AND {here(lon)} AND {off(lat, 90)}"), ("invalid_longitude", lon, f"{here(lat)} AND {here(lon)} AND NOT ({off(lat, 90)}) AND {off(lon, 180)}")]


_D, _P = "json_extract_string(j, '$.event_date_raw')", "json_extract_string(j, '$.event_date_precision')"
_DAY = "regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast({0} AS DATE) IS NOT NULL"
_SQL_RULES = {
    None: [*_missing("record_key", "source_id", "source_release", "external_id", "raw_object_uri", "raw_sha256", "retrieved_at", "parser_version", "ingestion_run_id", "license_policy_status"), _closed("license_policy_status", V.POLICY_STATUSES, "invalid_policy_status")],
    "taxonomy": _missing("source_taxon_id", "rank", "taxonomic_status", "scientific_name_raw", "concept_set_version"),
    "observation": [
        *_missing("occurrence_id", "scientific_name_raw", "event_date_raw", "event_date_precision", "basis_of_record", "sensitivity_class", "occurrence_status"),
        ("invalid_date", "event_date_raw", f"{_kind('event_date_raw')} <> 'VARCHAR' OR ({_P} IN ('day', 'instant') AND NOT ({_DAY.format('substr(' + _D + ', 1, 10)')})) OR ({_P} = 'month' AND length({_D}) = 7 AND NOT ({_DAY.format('(' + _D + chr(32) + '|| ' + chr(39) + '-01' + chr(39) + ')')}))"),
        ("invalid_date_precision", "event_date_precision", f"{_kind('event_date_raw')} = 'VARCHAR' AND NOT coalesce({_P} IN {V.DATE_PRECISIONS}, false)"),
        *_pair("latitude_private", "longitude_private"), *_pair("latitude_public", "longitude_public"),
        ("invalid_count", "count", f"{_kind('count')} <> 'NULL' AND NOT coalesce({_kind('count')} IN {_INTS} AND try_cast(json_extract_string(j, '$.count') AS DOUBLE) >= 0, false)"),
        _closed("sensitivity_class", V.SENSITIVITY_CLASSES, "invalid_sensitivity_class"), _closed("occurrence_status", V.OCCURRENCE_STATUSES, "invalid_occurrence_status"),
        ("unknown_sensitivity_has_public_coordinate", "latitude_public", f"json_extract_string(j, '$.sensitivity_class') = 'unknown' AND ({_kind('latitude_public')} <> 'NULL' OR {_kind('longitude_public')} <> 'NULL')"),
    ],
    "document": [*_missing("document_id", "title", "language"), *[("invalid_document_policy_flag", f, f"{_kind(f)} <> 'BOOLEAN'") for f in ("fulltext_storage_allowed", "chunk_storage_allowed", "embedding_allowed")]],
    "chunk": [*_missing("chunk_id", "document_id", "section_path", "text", "locator", "content_hash"), ("invalid_chunk_ordinal", "ordinal", f"NOT coalesce({_kind('ordinal')} IN {_INTS} AND try_cast(json_extract_string(j, '$.ordinal') AS DOUBLE) >= 1, false)")],
}


def _issues_sql(rules: list[tuple[str, str, str]], key: str, source: str, where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT coalesce(json_extract_string(j, '$.{key}'), '<missing-record-key>') AS record_key, 'validate' AS stage, '{reason}' AS reason_code, 'error' AS severity, '{field}' AS field_path FROM {source} WHERE {where} AND coalesce({cond}, false)" for reason, field, cond in rules)


_VAL01 = f"WITH r AS MATERIALIZED (SELECT record_type, record::JSON AS j FROM ({_RECORDS.replace('STRING', 'VARCHAR')})) " + " UNION ALL ".join(_issues_sql(rules, "record_key", "r", f"record_type = '{t}'" if t else "true") for t, rules in _SQL_RULES.items()) + " UNION ALL " + _issues_sql([("unknown_record_type", "record_type", f"record_type NOT IN {tuple(V.BY_TYPE)}")], "record_key", "r")


@query("val01_issue_rows", _VAL01)
def val01(spark, d):
    rows = table(spark, d, "events").select(F.expr(_TYPE).alias("record_type"), F.parse_json(F.expr(_RECORD)).alias("record"))
    return V.staging_issues(rows)


_S = "p_partkey"
_REGISTRY_FIELDS = [
    _field("source_id", _S, "'s' || CAST(p_partkey AS STRING)", {101: None}), *[_field(f, _S, "'x'", {m: raw}) for f, m, raw in (("name", 103, '""'), ("provider", 107, "null"), ("adapter_owner", 109, None))],
    _field("landing_uri", _S, "'https://example.org/'", {11: '"ftp://example.org/"', 113: None, 127: "5"}), _field("license_uri", _S, "'http://example.org/licence'", {13: '"example.org"', 131: '""'}),
    _field("access_method", _S, "'api'", {17: '"scrape"', 137: None}), _field("auth_method", _S, "'none'", {19: '"password"', 139: "null"}), _field("release_strategy", _S, "'versioned'", {23: '"rolling"', 149: None}),
    _field("enabled", _S, "'false'", {29: '"yes"', 151: "null", 31: "1"}, False), _field("license_policy_status", _S, "'denied'", {37: '"maybe"', 157: None}),
]
_ENTRY = _json(_S, _REGISTRY_FIELDS)
_ENTRIES = f"SELECT {_ENTRY} AS record FROM part"
_URI = lambda f: ("invalid_uri", f, f"{_kind(f)} = 'VARCHAR' AND NOT regexp_matches(json_extract_string(j, '$.{f}'), '^https?://')")
_REGISTRY_RULES = [
    *_missing("source_id", "name", "provider", "landing_uri", "access_method", "auth_method", "release_strategy", "license_uri", "adapter_owner", "enabled", "license_policy_status"), _URI("landing_uri"), _URI("license_uri"),
    _closed("access_method", V.ACCESS_METHODS, "invalid_access_method"), _closed("auth_method", V.AUTH_METHODS, "invalid_auth_method"), _closed("release_strategy", V.RELEASE_STRATEGIES, "invalid_release_strategy"),
    ("invalid_enabled_flag", "enabled", f"{_kind('enabled')} <> 'BOOLEAN'"), _closed("license_policy_status", V.POLICY_STATUSES, "invalid_policy_status"),
]


@query("val04_registry_rows", f"WITH r AS MATERIALIZED (SELECT record::JSON AS j FROM ({_ENTRIES.replace('STRING', 'VARCHAR')})) " + _issues_sql(_REGISTRY_RULES, "source_id", "r"))
def val04(spark, d):
    return V.registry_issues(table(spark, d, "part").select(F.parse_json(F.expr(_ENTRY)).alias("record")))


@query("val05_occurrence_reasons", f"WITH {_REASONED} SELECT event_id, array_to_string(reasons, ',') AS reasons, len(reasons)::INTEGER AS n FROM marked")
def val05(spark, d):
    raw = _raw(spark, d).withColumn("issues", F.array_compact(F.array("issue")))
    reasons = occurrences.occurrence_reasons({c: F.col(f"`{c}`") for c in raw.columns}, F.col("raw_sha256"), "KR")
    return raw.select("event_id", F.array_join(reasons, ",").alias("reasons"), F.size(reasons).alias("n"))
