"""Column functions: names, dates, licences, shares, identifiers, vectors. All run inside the JVM unless they say otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Licences that allow reuse, and vocabularies of policy and occurrence fields.
ALLOWED_LICENCES = ("http://creativecommons.org/publicdomain/zero/1.0/", "http://creativecommons.org/licenses/by/4.0/", "http://creativecommons.org/licenses/by-nc/4.0/")
POLICY_STATES = ("allowed", "restricted", "review_required", "denied")
NULL_TOKENS = ("", "NA")
#: Fixed value: keys that hold secrets.
# Parts of keys that name secrets, and the bounds of a redacted payload.
SECRET_PARTS = ("api_key", "apikey", "api-key", "private_key", "secret", "password", "passwd", "authorization", "credential", "bearer", "cookie")
MOST_TEXT, MOST_ITEMS = 2000, 50


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark has no function for."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    """Case folded, without diacritics and apostrophes."""
    drop = dict.fromkeys(map(ord, "'’ʼ`"))
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x.casefold().translate(drop)) if not unicodedata.combining(c)))


def normalize_name(c: Column, most: int = 120) -> Column:
    """NFC, outer blanks cut, inner ones collapsed; null where nothing or too much is left."""
    t = F.trim(F.regexp_replace(nfc(c), r"\s+", " "))
    return F.when(F.length(t).between(1, most), t)


def compact_name(c: Column) -> Column:
    """Names of letters and blanks alone lose their blanks; others give null."""
    return F.when(c.rlike(r"^[\p{L} ]+$"), F.regexp_replace(c, r"\s+", ""))


def one_edit(a: Column, b: Column) -> Column:
    """Exactly one insertion, deletion, substitution or swap of neighbours apart."""
    n = F.length(a)
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    i = F.try_element_at(differ, F.lit(1))
    swap = (n == F.length(b)) & (F.size(differ) == 2) & (F.try_element_at(differ, F.lit(2)) == i + 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i + 1, F.lit(1))) & (F.substr(a, i + 1, F.lit(1)) == F.substr(b, i, F.lit(1)))
    return (F.levenshtein(a, b) == 1) | F.coalesce(swap, F.lit(False))


def null_token(c: Column) -> Column:
    """'' and 'NA' are missing values."""
    return F.when(~F.trim(c).isin(*NULL_TOKENS), F.trim(c))


def licence_uri(c: Column) -> Column:
    """Lower case, http for https, one trailing slash, without legalcode; null where it is not on the allow list."""
    u = F.concat(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^https:", "http:"), "(/legalcode)?/*$", ""), F.lit("/"))
    return F.when(u.isin(*ALLOWED_LICENCES), u)


def date_precision(c: Column) -> Column:
    """instant, day, month, year, range or unknown, from the raw text alone."""
    return (
        F.when(c.contains("/"), "range")
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}T"), "instant")
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day")
        .when(c.rlike(r"^\d{4}-\d{2}$"), "month")
        .when(c.rlike(r"^\d{4}$"), "year")
        .otherwise("unknown")
    )


def partial_date_ok(raw: Column, precision: Column) -> Column:
    """Whether the raw date has the form and the calendar day that its declared precision asks for; nothing is filled in."""
    day = F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd").isNotNull()
    return (
        F.when(precision == "instant", raw.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}") & day)
        .when(precision == "day", raw.rlike(r"^\d{4}-\d{2}-\d{2}$") & day)
        .when(precision == "month", raw.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"))
        .when(precision == "year", raw.rlike(r"^\d{4}$"))
        .when(precision == "range", raw.contains("/"))
        .when(precision == "unknown", F.lit(True))
        .otherwise(F.lit(False))
    )


def coordinate_issue(lat: Column, lon: Column) -> Column:
    """Null where both or none are given and in range; else the reason."""
    return (
        F.when(lat.isNull() != lon.isNull(), "coordinate_pair_incomplete")
        .when(lat.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(lat) | F.isnan(lon), "coordinate_not_finite")
        .when(~lat.between(-90, 90) | ~lon.between(-180, 180), "coordinate_out_of_range")
    )


def web_url(c: Column) -> Column:
    """http or https, with a host and without user info."""
    part = lambda p: F.try_parse_url(c, F.lit(p))
    return F.coalesce(F.lower(part("PROTOCOL")).isin("http", "https") & (F.length(part("HOST")) > 0) & part("USERINFO").isNull(), F.lit(False))


def positive_number(c: Column) -> Column:
    """A finite number over 0 from text; null tokens and all else give null."""
    x = null_token(c).try_cast("double")
    return F.when((x > 0) & (x < float("inf")) & ~F.isnan(x), x)


def month_prefix(raw: Column) -> Column:
    return F.substring(raw, 1, 7)


def lexical_between(raw: Column, first: str, last: str) -> Column:
    """Both ends count; the first ten characters of a raw date are compared as text."""
    return F.substring(raw, 1, 10).between(first, last)


def share(m: Column, keys: list[str]) -> Column:
    """Sum of the positive shares (over 0, at most 100, finite) that a map holds under distinct keys; null where there is none."""
    values = F.filter(F.transform(F.array_distinct(F.array(*map(F.lit, keys))), lambda k: F.try_element_at(m, k)), lambda x: (x > 0) & (x <= 100))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x))


def distribution_status(m: Column) -> Column:
    """invalid_value, invalid_sum, inexact_sum or ok for a map of percentages."""
    values = F.filter(F.map_values(m), lambda x: x.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.exists(values, lambda x: (x < 0) | (x > 100) | F.isnan(x)), "invalid_value").when(~total.between(99, 101), "invalid_sum").when(total != 100, "inexact_sum").otherwise("ok")


def decode_value(num: Column, text: Column, boolean: Column, json: Column) -> Column:
    """The value as text: JSON (but for a JSON null) wins, then number, text, boolean."""
    return F.coalesce(F.when(json != "null", json), num.cast("string"), text, boolean.cast("string"))


def category(c: Column) -> Column:
    """Conservation categories with qualifiers in brackets come down to the bare code; raw text stays with the caller."""
    return F.upper(F.regexp_replace(F.trim(c), r"\s*\(.*\)$", ""))


def content_hash(*cols: Column) -> Column:
    """SHA-256 of a canonical text: parts joined by a unit separator, null as its own mark."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]), "\x1f"), 256)


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def vector_issue(v: Column, dimensions: int, tolerance: float = 1e-3) -> Column:
    """wrong_length, not_finite, zero_norm or not_unit; null for a good vector."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return (
        F.when(v.isNull() | (F.size(v) != dimensions), "wrong_length")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
        .when(norm == 0, "zero_norm")
        .when(F.abs(norm - 1) > tolerance, "not_unit")
    )


def caption(c: Column, most: int = 72) -> Column:
    """The first clause on one line, cut with an ellipsis."""
    t = F.trim(F.regexp_replace(F.split(c, ";")[0], r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def cut_text(c: Column, longest: int = MOST_TEXT) -> Column:
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit("...[truncated]"))).otherwise(c)


def redact(m: Column, most: int = MOST_ITEMS) -> Column:
    """A string map for a log: values of keys that name a secret (or end with "token") are "[redacted]", others are cut; past its first `most`
    entries a map ends with the key "[truncated]"."""
    secret = lambda k: F.lower(k).rlike("|".join(SECRET_PARTS)) | F.lower(k).endswith("token")
    entries = F.transform(F.slice(F.map_entries(m), 1, most), lambda e: F.struct(e["key"].alias("key"), F.when(secret(e["key"]), "[redacted]").otherwise(cut_text(e["value"])).alias("value")))
    more = F.when(F.size(m) > most, F.array(F.struct(F.lit("[truncated]").alias("key"), F.lit("true").alias("value")))).otherwise(F.slice(entries, 1, 0))
    return F.map_from_entries(F.concat(entries, more))


def redact_items(items: Column, most: int = MOST_ITEMS) -> Column:
    """The first `most` texts of an array, each cut, and "[truncated]" where there were more."""
    kept = F.transform(F.slice(items, 1, most), lambda x: cut_text(x))
    return F.when(F.size(items) > most, F.concat(kept, F.array(F.lit("[truncated]")))).otherwise(kept)


def cosine(a: Column, b: Column) -> Column:
    """Inner product over norms, in double."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b)))


def label(code: Column, labels: dict[str, str], missing: tuple[str, ...] = ("", "NA", "NULL", "none")) -> Column:
    """The label of a code: "no data" for null and null-like tokens, "unknown" for a code without one."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    token = F.trim(code)
    return F.when(token.isNull() | F.lower(token).isin(*[m.lower() for m in missing]), "no data").otherwise(F.coalesce(F.try_element_at(known, token), F.lit("unknown")))


def distribution_text(shares: Column, labels: dict[str, str]) -> Column:
    """The positive shares of a map as text, the largest first (ties by key): "name 60%, other 40%"; null where there is none."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    entries = F.filter(F.map_entries(shares), lambda e: e["value"] > 0)
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("key"))))
    number = lambda x: F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(F.round(x, 1).cast("string"))
    text = F.transform(ordered, lambda e: F.concat(F.coalesce(F.try_element_at(known, e["key"]), e["key"]), F.lit(" "), number(-e["order"]), F.lit("%")))
    return F.when(F.size(text) > 0, F.array_join(text, ", "))


def listed_as_inferred(fields: Column, name: Column) -> Column:
    """Whether a name stands in a list of inferred fields between semicolons, blanks and case aside; false for a null list."""
    return F.coalesce(F.array_contains(F.transform(F.split(fields, ";"), lambda x: F.lower(F.trim(x))), F.lower(name)), F.lit(False))


def ordinal(code: Column, names: dict[int, str]) -> Column:
    """(value, issue) of a number that stands for a step: an unknown one is an issue and has no value, null tokens have neither."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    token = null_token(code)
    value = F.try_element_at(known, token.try_cast("int"))
    return F.struct(value.alias("value"), F.when(token.isNotNull() & value.isNull(), "unknown_code").alias("issue"))


def whole_number(c: Column) -> Column:
    """A whole number over 0 from text ("12", "12.0"); null tokens and all else give null."""
    x = positive_number(c)
    return F.when(x == F.floor(x), x.cast("long"))


def canonical_json(names: list[str]) -> Column:
    """The named columns as JSON with keys in alphabetical order, nulls included: equal records have equal texts."""
    return F.to_json(F.struct(*[F.col(f"`{n}`").alias(n) for n in sorted(names)]), {"ignoreNullFields": "false"})
