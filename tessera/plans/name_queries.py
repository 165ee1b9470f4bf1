"""Queries over names: phonetic components, authors, English names, range texts, assessment identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import names as N

from .registry import query
from .stand_ins import table


def case(key: str, *options: str | None) -> str:
    """SQL, the same in Spark and DuckDB, that picks an option by key modulo their number; options are SQL too."""
    return f"CASE {key} % {len(options)} " + " ".join(f"WHEN {i} THEN {'NULL' if o is None else o}" for i, o in enumerate(options)) + " END"


def quoted(*texts: str | None) -> list[str | None]:
    return [None if t is None else "'" + t.replace("'", "''") + "'" for t in texts]


# Names of four or more syllable blocks; the second differs from the first in none, one or two of them.
_BLOCKS = quoted("가", "각", "나", "낙", "다", "라", "마", "바", "사", "아", "자")
_NAME_A = f"{case('p_partkey', *_BLOCKS)} || {case('p_size', *_BLOCKS)} || '미' || {case('p_partkey', *_BLOCKS[4:])} || {case('p_size', *quoted('', '새', ' 새'))}"
_NAME_B = f"{case('(p_partkey + p_partkey % 3)', *_BLOCKS)} || {case('p_size', *_BLOCKS)} || {case('p_partkey', *quoted('미', '미', '매', ' 미', 'x'))} || {case('p_partkey', *_BLOCKS[4:])} || {case('p_size', *quoted('', '새', '새'))}"
_FN05 = f"""WITH i AS (SELECT p_partkey, regexp_replace({_NAME_A}, '\\s+', '', 'g') AS x, regexp_replace({_NAME_B}, '\\s+', '', 'g') AS y FROM part),
c AS (SELECT *, list_transform(range(1, length(x) + 1), lambda i: ord(substr(x, i, 1)) - 44032) AS u, list_transform(range(1, length(y) + 1), lambda i: ord(substr(y, i, 1)) - 44032) AS v FROM i)
SELECT p_partkey, x AS name, y AS other, regexp_full_match(x, '[가-힣]{{4,40}}') AND regexp_full_match(y, '[가-힣]+') AND length(x) = length(y) AND
  list_sum(list_transform(range(1, len(u) + 1), lambda i: (u[i] // 588 <> v[i] // 588)::INTEGER + (u[i] // 28 % 21 <> v[i] // 28 % 21)::INTEGER
    + CASE WHEN (u[i] % 28 = 0) <> (v[i] % 28 = 0) THEN 2 ELSE (u[i] % 28 <> v[i] % 28)::INTEGER END)) = 1 AS apart FROM c"""


@query("fn05_component_substitution", _FN05)
def fn05(spark, d):
    i = table(spark, d, "part").select("p_partkey", F.expr(_NAME_A).alias("a"), F.expr(_NAME_B).alias("b"))
    return i.select("p_partkey", F.regexp_replace("a", r"\s+", "").alias("name"), F.regexp_replace("b", r"\s+", "").alias("other"), N.one_component_apart(F.col("a"), F.col("b")).alias("apart"))


_AUTHOR_A = case("c_custkey", *quoted("Smith, J. A., 1901", "(Smith, J. A., 1901)", "Smith, J. A. & Brown, C., 1901", "von Smith, 1901", "Smith et al., J., 1901", "SMITH, 1901", "Brown, C; Smith, J.-A., 1902"))
_AUTHOR_B = case("c_custkey", *quoted("Smith, 1901", "(Smith, 1901)", " smith,  J. A., 1901", "Smith & Brown, 1901", "Smith, J & Brown, 1901", "Brown; Smith, 1902", "", "Smith, 1902", None, "Smith", "(Brown, C., 1901)"))
_PARSE = """SELECT c_custkey, s, trim(s) AS t, regexp_full_match(trim(s), '\\(.*\\)') AS br FROM ({0})"""
_FN06_ONE = """{0}0 AS (SELECT c_custkey, {1} AS s, regexp_full_match(trim({1}), '\\(.*\\)') AS br FROM i),
{0}1 AS (SELECT c_custkey, s, br, CASE WHEN br THEN trim(trim(s)[2:-2]) ELSE trim(s) END AS bare FROM {0}0),
{0}2 AS (SELECT *, regexp_extract(bare, '^(.+),\\s*([0-9]{{4}})$', 2) AS yr, list_transform(string_split_regex(regexp_extract(bare, '^(.+),\\s*([0-9]{{4}})$', 1), '\\s*[;&]\\s*'),
  lambda n: {{'n': len(string_split(n, ',')), 's': lower(trim(regexp_replace(string_split(n, ',')[1], '\\s+', ' ', 'g'))), 'i': trim(coalesce(string_split(n, ',')[2], ''))}}) AS au FROM {0}1),
{0} AS (SELECT c_custkey, lower(trim(regexp_replace(coalesce(s, ''), '\\s+', ' ', 'g'))) AS same, br, yr, list_transform(au, lambda x: x.s) AS sn, list_transform(au, lambda x: regexp_replace(x.i, '[^\\p{{L}}]', '', 'g')) AS ini,
  coalesce(regexp_matches(bare, '^(.+),\\s*([0-9]{{4}})$') AND NOT regexp_matches(bare, '[()]') AND len(list_filter(au, lambda x: x.n > 2 OR x.s = '' OR regexp_matches(x.s, '\\bet\\s+al\\b') OR NOT regexp_matches(x.i, '^$|^[\\p{{Lu}}.\\-\\s]*\\p{{Lu}}[\\p{{Lu}}.\\-\\s]*$'))) = 0, false) AS ok FROM {0}2)"""
_FN06 = f"""WITH i AS (SELECT c_custkey, {_AUTHOR_A} AS x, {_AUTHOR_B} AS y FROM customer), {_FN06_ONE.format('a', 'x')}, {_FN06_ONE.format('b', 'y')},
m AS (SELECT c_custkey, a.same AS sa, b.same AS sb, a.ini AS ia, b.ini AS ib, a.ok AND b.ok AND a.br = b.br AND a.yr = b.yr AND a.sn = b.sn AND len(list_filter(range(1, len(a.ini) + 1), lambda k: NOT starts_with(a.ini[k], b.ini[k]))) = 0 AS f FROM a JOIN b USING (c_custkey))
SELECT c_custkey, CASE WHEN sa <> '' AND sa = sb THEN 'exact' WHEN f AND len(ia) = 1 AND ia[1] <> '' AND ib[1] = '' THEN 'single_author_initials_omitted' WHEN f THEN 'author_initials_normalized' END AS match FROM m"""


def _authors(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.expr(_AUTHOR_A).alias("a"), F.expr(_AUTHOR_B).alias("b"))


@query("fn06_author_match", _FN06)
def fn06(spark, d):
    return _authors(spark, d).select("c_custkey", N.author_match(F.col("a"), F.col("b")).alias("match"))


_SURNAMES = "list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(regexp_replace(coalesce({0}, ''), '[0-9]', ' ', 'g'), '\\p{{Lu}}[\\p{{L}}''’\\-]{{2,}}'), lambda w: w <> upper(w)), lambda w: lower(w)), lambda w: w NOT IN ('van', 'von', 'der')))"
_YEAR = "regexp_extract_all({0}, '\\b(1[5-9][0-9]{{2}}|20[0-9]{{2}})\\b')[-1]"
_FN07 = f"""WITH i AS (SELECT c_custkey, {_AUTHOR_B} AS x, {_AUTHOR_A} AS y FROM customer), p AS (SELECT c_custkey, coalesce(trim(x), '') AS s, list_has_any({_SURNAMES.format('x')}, {_SURNAMES.format('y')}) AS meet, {_YEAR.format('x')} AS a, {_YEAR.format('y')} AS b FROM i)
SELECT c_custkey, CASE WHEN s = '' THEN 'authority_missing_in_source' WHEN NOT meet THEN 'authority_surname_mismatch' WHEN a <> b THEN 'authority_year_mismatch' END AS reason,
  CASE WHEN s = '' THEN 'authority_missing_in_source' WHEN NOT meet THEN 'authority_surname_mismatch' WHEN a IS NULL THEN 'authority_year_missing_in_source' WHEN a <> b THEN 'authority_year_mismatch' END AS strict FROM p"""


@query("fn07_author_check", _FN07)
def fn07(spark, d):
    return _authors(spark, d).select("c_custkey", N.author_check(F.col("b"), F.col("a")).alias("reason"), N.author_check(F.col("b"), F.col("a"), require_year=True).alias("strict"))


_ENGLISH = case("p_partkey", "'Great ' || p_name", "upper(substr(p_name, 1, 1)) || substr(p_name, 2)", "p_name", "' '", None, "'Red ' || p_name || ' / Blue'", "'Sort ' || p_name || ' æ'", "'Sæd ' || p_name", "'Red ' || p_name || ' Group'", "'RED ' || p_name", "'A b c d e ' || p_name", "'Red- ' || p_name", "'  O''Neil’s   ' || p_name || '  '", "'Émile ' || p_name")
_RULES_SQL = " ".join(f"WHEN {'' if found else 'NOT '}regexp_matches(v, '{pattern.replace(chr(39), chr(39) * 2)}') THEN '{reason}'" for reason, pattern, found in N.ENGLISH_NAME_RULES)


@query("fn08_english_names", f"WITH i AS (SELECT p_partkey, trim(regexp_replace(coalesce({_ENGLISH}, ''), '[\\s\\xA0]+', ' ', 'g')) AS v FROM part) SELECT p_partkey, v AS name, CASE {_RULES_SQL} END AS issue FROM i")
def fn08(spark, d):
    i = table(spark, d, "part").select("p_partkey", F.expr(_ENGLISH).alias("raw"))
    return i.select("p_partkey", N.collapsed(F.col("raw")).alias("name"), N.english_name_issue(F.col("raw")).alias("issue"))


_PLACE = "Asgard"
_CLAUSES = ("Asgard", "southern Asgard", "n. Asgard", "northeastern Asgard", "coastal Asgard", "formerly Asgard", "seas off Asgard", "Asgardian coast", "the Asgard Peninsula", "Asgardn peninsula", "east, Asgard", "Midgard", "introduced to Midgard", "Asgard?", "no longer in Utgard", "southernmost Asgard", "NS Asgard", "sn. Asgard", "SE Asgard", "se Asgard")
_RANGE = f"{case('c_custkey', *quoted(*_CLAUSES))} || '; ' || {case('c_nationkey', *quoted(*_CLAUSES[::2], 'islands'))} || {case('c_custkey', *quoted('', '; SW Asgard', '; lakes', ''))}"
_Q = f"lower(regexp_extract(m, '^([A-Za-z]+)\\.?\\s+{_PLACE}', 1))"
_NAMED = f"regexp_extract(m, '({_PLACE}\\w*(?:\\s+[Pp]eninsula)?)$', 1)"
_FN09 = f"""WITH i AS (SELECT c_custkey, {_RANGE} AS t FROM customer), c AS (SELECT *, list_filter(string_split(t, ';'), lambda c: regexp_matches(c, '\\b{_PLACE}')) AS cl FROM i),
k AS (SELECT *, flatten(list_transform(cl, lambda c: regexp_extract_all(c, '(?:[A-Za-z.]+\\s+)?\\b{_PLACE}\\w*(?:\\s+[Pp]eninsula)?'))) AS ms FROM c)
SELECT c_custkey, t AS range_text, CASE WHEN len(cl) = 0 THEN 'no_mention' ELSE array_to_string(list_sort(list_filter([
  CASE WHEN regexp_matches(t, '(?i){N.UNCERTAIN_TEXT}') THEN 'negation_past_introduced_or_uncertain_wording' END,
  CASE WHEN len(list_filter(cl, lambda c: regexp_matches(c, '(?i){N.MARINE_TEXT}'))) > 0 THEN 'surrounding_waters_ambiguous' END,
  CASE WHEN len(list_filter(ms, lambda m: NOT regexp_matches({_NAMED}, '^{_PLACE}(n\\s+[Pp]eninsula|\\s+[Pp]eninsula)?$'))) > 0 THEN 'ambiguous_mention' END,
  CASE WHEN len(list_filter(ms, lambda m: starts_with({_Q}, 'north') OR {_Q} IN ('n', 'ne', 'nw'))) > 0 THEN 'north_qualified' END,
  CASE WHEN len(list_filter(ms, lambda m: NOT (starts_with({_Q}, 'north') OR {_Q} IN ('n', 'ne', 'nw')) AND regexp_matches({_Q}, '{N.DIRECTIONAL}') AND {_Q} NOT IN {N.ALLOWED_QUALIFIERS})) > 0 THEN 'non_south_directional_qualifier' END], lambda r: r IS NOT NULL)), ',') END AS reasons FROM k"""


@query("fn09_place_reasons", _FN09)
def fn09(spark, d):
    i = table(spark, d, "customer").select("c_custkey", F.expr(_RANGE).alias("t"))
    return i.select("c_custkey", F.col("t").alias("range_text"), F.array_join(N.place_reasons(F.col("t"), _PLACE), ",").alias("reasons"))


_PREFIX = "https://list.example.org/species/"
_K = "CAST(p_partkey AS VARCHAR(20))"
_A = "CAST(p_partkey + 7 AS VARCHAR(20))"
_URL = case("p_partkey", f"'{_PREFIX}' || {_K} || '/' || {_A}", f"'{_PREFIX}' || {_K} || '/' || {_A}", f"'{_PREFIX}' || {_A} || '/' || {_K}", f"'http://other.example.org/' || {_K}", f"'{_PREFIX}' || {_K} || '/' || {_A}", None, f"'{_PREFIX}' || {_K} || '/' || {_A}")
_CITE = "'Red List of Threatened Species ' || " + case("p_size", *quoted("2018", "2021")) + " || ': e.T1A1. doi UK.' || " + case("p_partkey", *quoted("2018", "2021", "20")) + " || '-3.RLTS.T' || " + _K + " || 'A' || " + case("p_partkey", _A, _A, _K, _A, f"{_A} || '.en RLTS.T1A1'") + " || '.en'"
_FN10 = f"""WITH i AS (SELECT p_partkey, {_URL} AS u, {_CITE} AS c FROM part), p AS (SELECT p_partkey, regexp_extract(u, '^{_PREFIX.replace('.', chr(92) + '.')}([1-9][0-9]*)/([1-9][0-9]*)$', 1) AS sp, regexp_extract(u, '^{_PREFIX.replace('.', chr(92) + '.')}([1-9][0-9]*)/([1-9][0-9]*)$', 2) AS n,
  regexp_extract_all(c, 'RLTS\\.(T[1-9][0-9]*A[1-9][0-9]*)\\.en', 1) AS cited, regexp_extract_all(c, 'Red List of Threatened Species ([0-9]{{4}}):', 1) AS y, regexp_extract_all(c, 'UK\\.([0-9]{{4}})-', 1) AS z FROM i)
SELECT p_partkey, CASE WHEN ok THEN n::BIGINT END AS assessment, CASE WHEN ok AND len(y) = 1 AND y = z THEN y[1]::INTEGER END AS year FROM (SELECT *, coalesce(sp = p_partkey::VARCHAR AND cited = ['T' || sp || 'A' || n], false) AS ok FROM p)"""


@query("fn10_assessment_identity", _FN10)
def fn10(spark, d):
    i = table(spark, d, "part").select("p_partkey", F.expr(_URL).alias("u"), F.expr(_CITE).alias("c"))
    return i.select("p_partkey", N.assessment_identity(F.col("u"), F.col("c"), F.col("p_partkey"), _PREFIX).alias("a")).select("p_partkey", "a.assessment", "a.year")
