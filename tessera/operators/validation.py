"""Validation of records of several types, held as variants, against a table of rules for each type.

A rule is (reason, field, broken): broken(record) is a column that is true where the rule is broken. Every rule of a record's type,
and those of all types, are tried on every record; each broken one is an issue row with the field's path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The closed sets of the record fields.
POLICY_STATUSES = ("allowed", "restricted", "review_required", "denied")
SENSITIVITY_CLASSES = ("public", "generalized", "withheld", "unknown")
OCCURRENCE_STATUSES = ("present", "absent", "unknown")
DATE_PRECISIONS = ("instant", "day", "month", "year", "range", "unknown")
ACCESS_METHODS = ("api", "download", "manual")
AUTH_METHODS = ("none", "api_key", "oauth", "manual")
RELEASE_STRATEGIES = ("versioned", "dated_snapshot", "mutable")


class Record:
    """Typed access to the fields of a variant; a field of another type than asked for is null.

    Rules name the fields that they use; `unpacked` then takes each of them out of the variant once a row, however many rules use it.
    """

    def __init__(self, name: str = "") -> None:
        self.name, self.fields = name, {}

    def unpacked(self, rows: DataFrame, variant: Column) -> DataFrame:
        """The rows with the kind and the text of each field used; null where the variant is null, which costs nothing."""
        of = lambda what, f: f"{what} {self.name}.{f}"
        got = rows.withColumns({of("field", f): F.try_variant_get(variant, f"$.{f}", "variant") for f in self.fields})
        got = got.withColumns({of("kind", f): F.nullif(F.schema_of_variant(F.col(f"`{of('field', f)}`")), F.lit("VOID")) for f in self.fields})
        return got.withColumns({of("text", f): F.when(F.col(f"`{of('kind', f)}`") != "BOOLEAN", F.try_variant_get(F.col(f"`{of('field', f)}`"), "$", "string")) for f in self.fields})

    def kind(self, field: str) -> Column:
        """STRING, BIGINT, DOUBLE, DECIMAL(…), BOOLEAN and so on; null for a missing field or a null."""
        self.fields[field] = None
        return F.col(f"`kind {self.name}.{field}`")

    def _as_text(self, field: str) -> Column:
        return F.col(f"`text {self.name}.{field}`")

    def text(self, field: str) -> Column:
        return F.when(self.kind(field) == "STRING", self._as_text(field))

    def number(self, field: str) -> Column:
        return F.when(self.kind(field).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), self._as_text(field).try_cast("double"))

    def whole(self, field: str) -> Column:
        return F.when(self.kind(field) == "BIGINT", self._as_text(field).try_cast("bigint"))

    def missing(self, field: str) -> Column:
        return self.kind(field).isNull() | (self.text(field) == "")

    def has(self, field: str) -> Column:
        return self.kind(field).isNotNull()


Rule = tuple[str, str, Callable[[Record], Column]]


def required(*fields: str) -> list[Rule]:
    return [("missing_required_field", f, lambda r, f=f: r.missing(f)) for f in fields]


def one_of(field: str, values: Iterable[str], reason: str) -> Rule:
    return reason, field, lambda r: ~F.coalesce(r.text(field).isin(*values), F.lit(False))


def boolean(field: str, reason: str) -> Rule:
    return reason, field, lambda r: ~F.coalesce(r.kind(field) == "BOOLEAN", F.lit(False))


def web_uri(field: str) -> Rule:
    return "invalid_uri", field, lambda r: ~r.text(field).rlike("^https?://")


def dated(value: str, precision: str) -> list[Rule]:
    """A text, of a known precision; days and instants begin with a day of the calendar, months of seven characters are months."""
    known = lambda r: F.coalesce(r.text(precision).isin(*DATE_PRECISIONS), F.lit(False))
    day = lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull()

    def bad(r: Record) -> Column:
        t, p = r.text(value), r.text(precision)
        wrong = F.when(p.isin("day", "instant"), ~day(F.substring(t, 1, 10))).when((p == "month") & (F.length(t) == 7), ~day(F.concat(t, F.lit("-01"))))
        return t.isNull() | (known(r) & F.coalesce(wrong, F.lit(False)))

    return [("invalid_date", value, bad), ("invalid_date_precision", precision, lambda r: r.text(value).isNotNull() & ~known(r))]


def coordinate(lat: str, lon: str) -> list[Rule]:
    """Both or neither; each a number within its range. The latitude is told first."""
    off = lambda r, f, most: r.has(f) & ~F.coalesce(r.number(f).between(-most, most), F.lit(False))
    return [
        ("incomplete_coordinate", lat, lambda r: ~r.has(lat) & r.has(lon)),
        ("incomplete_coordinate", lon, lambda r: r.has(lat) & ~r.has(lon)),
        ("invalid_latitude", lat, lambda r: r.has(lon) & off(r, lat, 90)),
        ("invalid_longitude", lon, lambda r: r.has(lat) & ~off(r, lat, 90) & off(r, lon, 180)),
    ]


COMMON: list[Rule] = [
    *required("record_key", "source_id", "source_release", "external_id", "raw_object_uri", "raw_sha256", "retrieved_at", "parser_version", "ingestion_run_id", "license_policy_status"),
    one_of("license_policy_status", POLICY_STATUSES, "invalid_policy_status"),
]
BY_TYPE: dict[str, list[Rule]] = {
    "taxonomy": required("source_taxon_id", "rank", "taxonomic_status", "scientific_name_raw", "concept_set_version"),
    "observation": [
        *required("occurrence_id", "scientific_name_raw", "event_date_raw", "event_date_precision", "basis_of_record", "sensitivity_class", "occurrence_status"),
        *dated("event_date_raw", "event_date_precision"),
        *coordinate("latitude_private", "longitude_private"),
        *coordinate("latitude_public", "longitude_public"),
        ("invalid_count", "count", lambda r: r.has("count") & ~F.coalesce(r.whole("count") >= 0, F.lit(False))),
        one_of("sensitivity_class", SENSITIVITY_CLASSES, "invalid_sensitivity_class"),
        one_of("occurrence_status", OCCURRENCE_STATUSES, "invalid_occurrence_status"),
        ("unknown_sensitivity_has_public_coordinate", "latitude_public", lambda r: (r.text("sensitivity_class") == "unknown") & (r.has("latitude_public") | r.has("longitude_public"))),
    ],
    "document": [
        *required("document_id", "title", "language"),
        *[boolean(f, "invalid_document_policy_flag") for f in ("fulltext_storage_allowed", "chunk_storage_allowed", "embedding_allowed")],
    ],
    "chunk": [
        *required("chunk_id", "document_id", "section_path", "text", "locator", "content_hash"),
        ("invalid_chunk_ordinal", "ordinal", lambda r: ~F.coalesce(r.whole("ordinal") >= 1, F.lit(False))),
    ],
}
REGISTRY: list[Rule] = [
    *required("source_id", "name", "provider", "landing_uri", "access_method", "auth_method", "release_strategy", "license_uri", "adapter_owner", "enabled", "license_policy_status"),
    web_uri("landing_uri"),
    web_uri("license_uri"),
    one_of("access_method", ACCESS_METHODS, "invalid_access_method"),
    one_of("auth_method", AUTH_METHODS, "invalid_auth_method"),
    one_of("release_strategy", RELEASE_STRATEGIES, "invalid_release_strategy"),
    boolean("enabled", "invalid_enabled_flag"),
    one_of("license_policy_status", POLICY_STATUSES, "invalid_policy_status"),
]


def broken(record: Record, rules: list[Rule]) -> Column:
    """The broken rules as an array of (reason_code, field_path)."""
    found = [F.when(F.coalesce(bad(record), F.lit(False)), F.struct(F.lit(reason).alias("reason_code"), F.lit(field).alias("field_path"))) for reason, field, bad in rules]
    return F.array_compact(F.array(*found))


_KEY = "the key"


def _issue_rows(rows: DataFrame, found: Column) -> DataFrame:
    got = rows.select(F.coalesce(_KEY, F.lit("<missing-record-key>")).alias("record_key"), F.explode(found).alias("i"))
    return got.select("record_key", F.lit("validate").alias("stage"), "i.reason_code", F.lit("error").alias("severity"), "i.field_path")


def staging_issues(rows: DataFrame, kind: str = "record_type", record: str = "record") -> DataFrame:
    """(record_key, stage, reason_code, severity, field_path) of all broken rules of rows (record_type, record: a variant)."""
    v, k = F.col(record), F.col(kind)
    known = F.coalesce(k.isin(*BY_TYPE), F.lit(False))
    common, of_type = Record(), {name: Record(name) for name in BY_TYPE}
    parts = [F.when(k == name, broken(of_type[name], rules)) for name, rules in BY_TYPE.items()]
    found = F.concat(broken(common, COMMON), F.coalesce(*parts, broken(common, [("unknown_record_type", "record_type", lambda _: ~known)])))
    got = common.unpacked(rows.select(kind, record, F.try_variant_get(v, "$.record_key", "string").alias(_KEY)), v)
    for name, r in of_type.items():
        got = r.unpacked(got, F.when(k == name, v))
    return _issue_rows(got, found)


def registry_issues(rows: DataFrame, record: str = "record") -> DataFrame:
    """As staging_issues, for entries of the source registry; their key is the source."""
    r = Record()
    found = broken(r, REGISTRY)
    return _issue_rows(r.unpacked(rows.select(record, F.try_variant_get(F.col(record), "$.source_id", "string").alias(_KEY)), F.col(record)), found)
