"""Queries over evaluations, outcome tags, packaged cases, name audits and collection points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.operators import evaluation

from .name_queries import case, quoted
from .policy_queries import _REGISTRY, _registry
from .reference_queries import K
from .registry import query
from .stand_ins import table

_in = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"

_TAGS = [
    "event_id",
    f"{case('event_id', *quoted('answer', 'clarify', None, 'abstain', 'error', 'answer', 'maybe'))} AS disposition",
    f"{case('user_id', *quoted(None, 'none', 'taxon_not_found', 'upstream_error', 'ambiguous_name', 'drop table', 'invalid_plan', 'insufficient_data', None, 'unknown', 'none'))} AS reason",
    f"{case('(event_id + user_id)', *quoted('none', 'routing', None, 'Mr Smith', 'retrieval'))} AS stage",
    f"{case('event_id', *quoted('profile', 'evidence', 'x', None))} AS intent",
    f"{case('user_id', *quoted('semantic', None, 'jev', 'y', 'explicit', 'none'))} AS method",
]
_FN25 = f"""WITH i AS (SELECT {', '.join(_TAGS)} FROM events), k AS (SELECT event_id, CASE WHEN disposition IN {_in(evaluation.DISPOSITIONS)} THEN disposition END AS d, CASE WHEN reason IN {_in(evaluation.REASONS)} THEN reason END AS r,
  CASE WHEN stage IN {_in(evaluation.STAGES)} THEN stage END AS s, CASE WHEN intent IN {_in(evaluation.INTENTS)} THEN intent ELSE 'none' END AS selected_intent, CASE WHEN method IN {_in(evaluation.METHODS)} THEN method ELSE 'none' END AS route_method FROM i),
x AS (SELECT *, coalesce(d = 'answer' AND coalesce(r, 'none') = 'none', false) AS clean FROM k),
y AS (SELECT *, CASE WHEN clean THEN 'answer' WHEN r IN {_in(evaluation.TECHNICAL)} OR (d IS NULL AND r IS NOT NULL) THEN 'error' ELSE coalesce(d, 'answer') END AS response_disposition FROM x)
SELECT event_id, response_disposition, CASE WHEN clean THEN 'none' ELSE coalesce(r, CASE WHEN response_disposition = 'answer' THEN 'none' ELSE 'unknown' END) END AS response_reason,
  CASE WHEN clean THEN 'none' ELSE coalesce(s, CASE WHEN response_disposition = 'answer' THEN 'none' ELSE 'unknown' END) END AS failure_stage, selected_intent, route_method FROM y"""


@query("fn25_outcome_tags", _FN25)
def fn25(spark, d):
    t = evaluation.outcome_tags(table(spark, d, "events").selectExpr(*_TAGS))
    return t.select("event_id", "response_disposition", "response_reason", "failure_stage", "selected_intent", "route_method")


# Plans: gold slots of a part, and what a parser would have found, which loses or changes some.
_SLOTS = ("taxon", "trait", "value")
_CASES = [
    "p_type AS suite",
    f"{case('p_partkey', *quoted('traits', 'traits', 'relation', None))} AS expected_kind",
    f"{case('(p_partkey + p_partkey % 9)', *quoted('traits', 'traits', 'relation', 'traits'))} AS raw_kind",
    f"{case('p_size', *quoted('answer', 'answer', 'hold'))} AS expected",
    "p_partkey % 6 <> 0 AS raw_executes",
    f"{case('p_partkey', *quoted('answer', 'answer', 'hold', 'answer', 'clarify'))} AS gated",
    "p_type AS want_taxon",
    "CASE WHEN p_partkey % 12 = 5 THEN 'ECONOMY' ELSE p_type END AS got_taxon",
    "p_brand AS want_trait",
    "CASE WHEN p_partkey % 10 = 4 THEN NULL ELSE p_brand END AS got_trait",
    "CASE WHEN p_size > 10 THEN p_size END AS want_value",
    "CASE WHEN p_size > 12 THEN p_size END AS got_value",
]
_EXACT = " AND ".join(f"want_{s} IS NOT DISTINCT FROM got_{s}" for s in _SLOTS)
_AG14 = f"""WITH c AS (SELECT {', '.join(_CASES)} FROM part), x AS (SELECT *, raw_kind IS NOT DISTINCT FROM expected_kind AND {_EXACT} AS rt, expected = 'answer' AS w, gated = 'answer' AS g FROM c)
SELECT suite, count(*)::BIGINT AS n, round(count(*) FILTER (raw_kind = expected_kind)::DOUBLE / count(expected_kind), 6) AS kind_accuracy, round(count(*) FILTER (w AND raw_executes AND rt)::DOUBLE / count(*) FILTER (w), 6) AS raw_coverage,
  round(count(*) FILTER (raw_executes AND NOT (w AND rt))::DOUBLE / count(*), 6) AS raw_false_execution, round(count(*) FILTER (w AND g AND rt)::DOUBLE / count(*) FILTER (w), 6) AS gated_coverage,
  round(count(*) FILTER (g AND NOT (w AND rt))::DOUBLE / count(*), 6) AS gated_false_execution, sum({' + '.join(f'(want_{s} IS NOT NULL AND got_{s} IS NULL)::INTEGER' for s in _SLOTS)})::BIGINT AS lost_conditions,
  {', '.join(f'round(count(*) FILTER (want_{s} IS NOT DISTINCT FROM got_{s})::DOUBLE / count(*), 6) AS {s}_accuracy' for s in _SLOTS)} FROM x GROUP BY 1"""


@query("ag14_slot_scores", _AG14)
def ag14(spark, d):
    return evaluation.slot_metrics(table(spark, d, "part").selectExpr(*_CASES), ["suite"], list(_SLOTS))


# Families of four cases: two equivalents, a contrast, and a fourth that is a contrast in some families only.
_FAMILY = [
    "p_partkey - p_partkey % 4 AS family",
    "CASE WHEN p_partkey % 4 < 2 THEN 'equivalent' WHEN p_partkey % 4 = 2 OR p_size % 5 = 0 THEN 'contrast' ELSE 'other' END AS role",
    "CASE WHEN p_partkey % 23 = 3 THEN 'fail' ELSE 'pass' END AS status",
    f"CASE WHEN p_partkey % 4 < 2 THEN CASE WHEN p_partkey % 17 = 1 THEN 'changed' ELSE 'plan' || CAST((p_partkey - p_partkey % 4) % 28 AS STRING) END ELSE 'plan' || CAST(p_size % 4 * 4 AS STRING) END AS signature",
]
_AG15 = f"""WITH c AS (SELECT {', '.join(_FAMILY)} FROM part), f AS (SELECT family, list(signature) FILTER (role = 'equivalent') AS e, count(*) FILTER (role = 'equivalent' AND status = 'pass') AS p, list(signature) FILTER (role = 'contrast') AS k, count(*) FILTER (role = 'contrast' AND status = 'pass') AS q FROM c GROUP BY 1),
g AS (SELECT *, coalesce(len(e) = 2 AND p = 2 AND e[1] = e[2], false) AS pair FROM f), h AS (SELECT *, coalesce(pair AND len(k) = 1 AND q = 1 AND k[1] <> e[1], false) AS told FROM g)
SELECT family, pair AS equivalent_pair_exact, told AS contrast_distinguished, CASE WHEN told THEN 'pass' ELSE 'fail' END AS status FROM h"""


@query("ag15_family_evaluation", _AG15)
def ag15(spark, d):
    return evaluation.family_evaluation(table(spark, d, "part").selectExpr(*_FAMILY))


_PACK = ["o_orderkey AS id", "'question ' || CAST(CASE WHEN o_orderkey % 1000 = 9 THEN o_orderkey - 1 ELSE o_orderkey END AS STRING) AS question", "o_orderpriority AS suite", "o_orderstatus AS rank"]
_AG23 = f"""WITH c AS (SELECT {', '.join(_PACK)} FROM orders), r AS (SELECT o_orderkey AS id, count(*) AS results, bool_and(o_orderkey % 777 <> 5) AS passed FROM orders, (VALUES (0), (1)) v(x) WHERE (x = 0 AND o_orderkey % 500 <> 3) OR (x = 1 AND o_orderkey % 700 = 4) GROUP BY 1), j AS (SELECT c.*, results, passed FROM c LEFT JOIN r USING (id)),
t AS (SELECT count(*) AS n, count(DISTINCT id) AS ids, count(DISTINCT question) AS qs, count(*) FILTER (results IS DISTINCT FROM 1) AS u, count(*) FILTER (NOT passed) AS f FROM j),
s AS (SELECT suite, count(*) AS n FROM j GROUP BY 1), e AS (SELECT suite, expected FROM (SELECT o_orderpriority AS suite, count(*) AS expected FROM orders WHERE o_orderkey % 9999 <> 2 GROUP BY 1) UNION ALL SELECT '6-NONE', 5)
SELECT 'assertion' AS section, key, n::BIGINT AS n, n = 0 AS ok FROM (SELECT unnest(['unique_ids', 'unique_questions', 'one_result_each', 'all_passed']) AS key, unnest([n - ids, n - qs, u, f]) AS n FROM t)
UNION ALL SELECT 'suite', coalesce(s.suite, e.suite), coalesce(n, 0)::BIGINT, n IS NOT DISTINCT FROM expected FROM s FULL JOIN e ON s.suite = e.suite
UNION ALL SELECT 'rank', rank, count(*)::BIGINT, true FROM j GROUP BY 2 UNION ALL SELECT 'trait', l_returnflag || l_linestatus, count(*)::BIGINT, true FROM lineitem WHERE l_orderkey IN (SELECT id FROM c) GROUP BY 2"""


@query("ag23_packaged_cases", _AG23)
def ag23(spark, d):
    o = table(spark, d, "orders")
    results = o.filter("o_orderkey % 500 <> 3").unionByName(o.filter("o_orderkey % 700 = 4")).selectExpr("o_orderkey AS id", "o_orderkey % 777 <> 5 AS passed")
    suites = o.filter("o_orderkey % 9999 <> 2").groupBy(F.col("o_orderpriority").alias("suite")).agg(F.count("*").alias("expected")).unionByName(o.agg(F.max(F.lit("6-NONE")).alias("suite"), F.max(F.lit(5)).cast("long").alias("expected")))
    return evaluation.package_cases(o.selectExpr(*_PACK), results, table(spark, d, "lineitem").selectExpr("l_orderkey AS id", "l_returnflag || l_linestatus AS trait"), suites)


_CLS = ["lang AS expected", f"CASE WHEN doc_id % 11 = 3 THEN 'uncertain' WHEN doc_id % 9 = 0 THEN 'en' ELSE lang END AS predicted"]


@query("ag13_classification_summary", f"""WITH x AS (SELECT {', '.join(_CLS)} FROM documents), l AS (SELECT label, 2.0 * (SELECT count(*) FROM x WHERE expected = label AND predicted = label) / ((SELECT count(*) FROM x WHERE expected = label) + (SELECT count(*) FROM x WHERE predicted = label)) AS f FROM (SELECT DISTINCT expected AS label FROM x))
SELECT count(*)::BIGINT AS n, round(count(*) FILTER (expected = predicted)::DOUBLE / count(*), 6) AS accuracy, (SELECT round(avg(f::DOUBLE), 6) FROM l) AS macro_f1, round(count(*) FILTER (predicted <> 'uncertain')::DOUBLE / count(*), 6) AS automatic_rate,
  round(count(*) FILTER (predicted NOT IN ('uncertain', expected))::DOUBLE / count(*), 6) AS misclassification_rate, round(count(*) FILTER (predicted = 'uncertain')::DOUBLE / count(*), 6) AS clarification_rate FROM x""")
def ag13_summary(spark, d):
    return evaluation.classification_summary(table(spark, d, "documents").selectExpr(*_CLS))


_SPECIES = ["p_partkey AS taxon", f"'taxon ' || {K} AS scientific_name"]
_REVIEWED = ["p_partkey AS taxon", f"'name ' || {K} AS name", f"'old ' || {K} AS source_scientific_name"]
_REJECTED = [f"'taxon ' || {K} AS scientific_name", f"'odd ' || {K} AS name", "'duplicate' AS why"]
_RECORDS = [
    f"{case('p_size', *quoted('list', 'journal', 'zoo'))} AS source",
    f"{case('p_partkey', *[x.format(K) for x in (chr(39) + 'taxon ' + chr(39) + ' || {}', chr(39) + 'taxon ' + chr(39) + ' || {}', chr(39) + 'old ' + chr(39) + ' || {}', chr(39) + 'gone ' + chr(39) + ' || {}', chr(39) + 'taxon ' + chr(39) + ' || {}')])} AS scientific_name",
    f"CASE p_partkey % 7 WHEN 0 THEN 'odd ' || {K} WHEN 1 THEN 'name ' || CAST(p_partkey + 2 AS STRING) WHEN 2 THEN '' WHEN 3 THEN 'new ' || {K} ELSE 'name ' || {K} END AS name",
]
_Q28 = f"""WITH rec AS (SELECT {', '.join(_RECORDS)} FROM part), sp AS (SELECT {', '.join(_SPECIES)} FROM part WHERE p_partkey % 13 <> 0), rv AS (SELECT {', '.join(_REVIEWED)} FROM part WHERE p_partkey % 3 <> 1), rj AS (SELECT {', '.join(_REJECTED)} FROM part WHERE p_partkey % 2 = 1),
j AS (SELECT rec.source, sp.taxon, o.name AS own, rec.name, (rec.scientific_name, rec.name) IN (SELECT (source_scientific_name, name) FROM rv) AS x, rec.name IN (SELECT name FROM rv) AS used, rj.why FROM rec LEFT JOIN sp ON sp.scientific_name = rec.scientific_name LEFT JOIN rv o ON o.taxon = sp.taxon
  LEFT JOIN rj ON rj.scientific_name = rec.scientific_name AND rj.name = rec.name WHERE rec.name <> '')
SELECT source, CASE WHEN own = name THEN 'reviewed_exact' WHEN x THEN 'reviewed_crosswalk' WHEN taxon IS NULL THEN 'no_exact_active_species' WHEN own IS NOT NULL THEN 'existing_reviewed_name_preserved' WHEN used THEN 'conflicts_with_reviewed_other_species' WHEN why IS NOT NULL THEN 'previously_reviewed_rejection' ELSE 'unreviewed_source_candidate' END AS decision,
  count(*)::BIGINT AS names, count(why)::BIGINT AS rejected_before FROM j GROUP BY 1, 2"""


@query("q28_reviewed_name_audit", _Q28)
def q28(spark, d):
    p = table(spark, d, "part")
    a = evaluation.name_audit(p.selectExpr(*_RECORDS), p.filter("p_partkey % 13 <> 0").selectExpr(*_SPECIES), p.filter("p_partkey % 3 <> 1").selectExpr(*_REVIEWED), p.filter("p_partkey % 2 = 1").selectExpr(*_REJECTED))
    return a.groupBy("source", "decision").agg(F.count("*").alias("names"), F.count("previous_reason").alias("rejected_before"))


_SCOPES = ("region", "world")
_POINTS = f"WITH r AS ({_REGISTRY}), p AS (SELECT source, CASE WHEN length(source) > 4 THEN 'world' ELSE 'region' END AS scope, enabled AND policy_status = 'allowed' AS collectable FROM r)"
_CHOICES = [(s, b) for s in (None, *_SCOPES) for b in (False, True)]


@query("flt06_collection_select", _POINTS + " " + " UNION ALL ".join(f"SELECT '{s or 'all'}' AS asked, {str(b).lower()} AS with_blocked, source, collectable FROM p WHERE " + (f"scope = '{s}'" if s else "true") + ("" if b else " AND collectable") for s, b in _CHOICES))
def flt06(spark, d):
    points = _registry(spark, d).select("source", F.when(F.length("source") > 4, "world").otherwise("region").alias("scope"), (F.col("enabled") & (F.col("policy_status") == "allowed")).alias("collectable"))
    one = lambda s, b: evaluation.select_points(points, _SCOPES, s, b).select(F.lit(s or "all").alias("asked"), F.lit(b).alias("with_blocked"), "source", "collectable")
    return reduce(lambda x, y: x.unionByName(y), [one(s, b) for s, b in _CHOICES])
