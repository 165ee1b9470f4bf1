"""Queries for policy, validation, gates, scalar functions and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalars as S
from tessera.operators import filters, policy, snapshots

from .registry import query
from .stand_ins import chunk, claim, document, entity, evidence, observation, table, with_sql

_OK_DOC = "d.policy_status = 'allowed' AND d.fulltext_allowed AND d.chunk_allowed"


@query("pol01_allowed_chunks", f"WITH {with_sql('document', 'chunk')} SELECT d.source, d.lang, count(*)::BIGINT AS chunks, sum(length(c.text))::BIGINT AS chars FROM chunk c JOIN document d ON d.document = c.document WHERE c.policy_status = 'allowed' AND {_OK_DOC} GROUP BY 1, 2")
def pol01(spark, d):
    return policy.allowed_chunks(chunk(spark, d), document(spark, d)).groupBy("source", "lang").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


@query("pol01_embeddable_chunks", f"WITH {with_sql('document', 'chunk')} SELECT c.chunk, c.document FROM chunk c JOIN document d ON d.document = c.document WHERE c.policy_status = 'allowed' AND {_OK_DOC} AND d.embedding_allowed")
def pol01_embed(spark, d):
    return policy.allowed_chunks(chunk(spark, d), document(spark, d), embedding=True).select("chunk", "document")


_REGISTRY = "SELECT source, max(doc_id) % 4 <> 1 AS enabled, CASE WHEN min(doc_id) % 5 = 2 THEN 'denied' ELSE 'allowed' END AS policy_status FROM documents GROUP BY source"


def _registry(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.max("doc_id").alias("hi"), F.min("doc_id").alias("lo"))
    return g.select("source", (F.col("hi") % 4 != 1).alias("enabled"), F.when(F.col("lo") % 5 == 2, "denied").otherwise("allowed").alias("policy_status"))


@query("pol02_registered_sources", f"WITH r AS ({_REGISTRY}) SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM r WHERE enabled AND policy_status = 'allowed')")
def pol02(spark, d):
    return policy.registered(table(spark, d, "documents").select("doc_id", "source"), _registry(spark, d)).select("doc_id", "source")


@query("src10_collection_points", f"WITH r AS ({_REGISTRY}) SELECT c.source, c.docs, r.enabled AND r.policy_status = 'allowed' AS collectable, CASE WHEN NOT r.enabled THEN 'disabled' ELSE '' END AS a, CASE WHEN r.policy_status <> 'allowed' THEN 'policy' ELSE '' END AS b FROM (SELECT source, count(*) AS docs FROM documents GROUP BY 1) c LEFT JOIN r USING (source)")
def src10(spark, d):
    points = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs")).join(_registry(spark, d), "source", "left")
    ok = F.col("policy_status") == "allowed"
    return points.select("source", "docs", (F.col("enabled") & ok).alias("collectable"), F.when(~F.col("enabled"), "disabled").otherwise("").alias("a"), F.when(~ok, "policy").otherwise("").alias("b"))


_LIC = "CASE WHEN u IN ('http://creativecommons.org/publicdomain/zero/1.0/', 'http://creativecommons.org/licenses/by/4.0/', 'http://creativecommons.org/licenses/by-nc/4.0/') THEN u END"
_U = "regexp_replace(regexp_replace(lower(trim(licence)), '^https:', 'http:'), '(/legalcode)?/*$', '') || '/'"


@query("pol03_licence_uris", f"WITH {with_sql('observation')}, n AS (SELECT licence, {_U} AS u FROM observation) SELECT licence, {_LIC} AS uri, count(*)::BIGINT AS n FROM n GROUP BY 1, 2")
def pol03(spark, d):
    return observation(spark, d).select("licence", S.licence_uri(F.col("licence")).alias("uri")).groupBy("licence", "uri").agg(F.count("*").alias("n"))


@query("pol04_masked_coordinates", f"WITH {with_sql('observation')} SELECT observation, CASE WHEN sensitivity = 'public' THEN lat END::DOUBLE AS lat, CASE WHEN sensitivity = 'public' THEN lon END::DOUBLE AS lon, sensitivity <> 'public' AND (lat IS NOT NULL OR lon IS NOT NULL) AS withheld FROM observation")
def pol04(spark, d):
    return policy.masked_coordinates(observation(spark, d)).select("observation", "lat", "lon", "withheld")


@query("pol05_privacy_audit", f"WITH {with_sql('observation', 'document', 'chunk')} SELECT (SELECT count(*) FROM observation WHERE sensitivity <> 'public' AND (lat IS NOT NULL OR lon IS NOT NULL))::BIGINT AS private_coordinates, (SELECT count(*) FROM chunk c WHERE c.policy_status = 'allowed' AND c.document NOT IN (SELECT document FROM document WHERE policy_status = 'allowed'))::BIGINT AS blocked_chunks")
def pol05(spark, d):
    private = observation(spark, d).agg(F.count_if((F.col("sensitivity") != "public") & (F.col("lat").isNotNull() | F.col("lon").isNotNull())).alias("private_coordinates"))
    blocked = chunk(spark, d).filter("policy_status = 'allowed'").join(document(spark, d).filter("policy_status = 'allowed'").select("document"), "document", "left_anti").agg(F.count("*").alias("blocked_chunks"))
    return private.crossJoin(blocked)  # one row each


_KEYS = ("user", "API_KEY", "x-api-key", "private_key_id", "Secret", "passwd2", "Authorization", "credentials", "bearer_x", "Cookies", "access_Token", "tokens", "note")
_KEY = "CASE event_id % 13 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KEYS)) + " END"
_SECRET = "regexp_matches(lower(key), 'api_key|apikey|api-key|private_key|secret|password|passwd|authorization|credential|bearer|cookie') OR lower(key) LIKE '%token'"


@query("pol06_redaction", f"""WITH e AS (SELECT event_id, {_KEY} AS key, user_id::VARCHAR AS v, repeat(event_type, (100 + event_id % 400)::INTEGER) AS body, event_id % 90 AS n FROM events)
SELECT event_id, CASE WHEN {_SECRET} THEN '[redacted]' ELSE v END AS value, CASE WHEN length(body) > 2000 THEN substr(body, 1, 2000) || '...[truncated]' ELSE body END AS body,
  least(n, 50)::INTEGER + (n > 50)::INTEGER AS items, CASE WHEN n > 50 THEN '[truncated]' WHEN n > 0 THEN n::VARCHAR END AS last_item FROM e""")  # fmt: skip
def pol06(spark, d):
    """Keys that name secrets in one way or another, bodies around the longest text, and lists around the most items."""
    m = F.create_map(F.expr(_KEY), F.col("user_id").cast("string"), F.lit("body"), F.expr("repeat(event_type, cast(100 + event_id % 400 as int))"))
    items = F.expr("CASE WHEN event_id % 90 = 0 THEN array() ELSE transform(sequence(1L, event_id % 90), x -> cast(x as string)) END").cast("array<string>")
    r = table(spark, d, "events").select("event_id", F.expr(_KEY).alias("key"), S.redact(m).alias("m"), S.redact_items(items).alias("items"))
    return r.select("event_id", F.element_at("m", F.col("key")).alias("value"), F.element_at("m", "body").alias("body"), F.size("items").alias("items"), F.try_element_at("items", F.lit(-1)).alias("last_item"))


_ANSWER_TEXT = "text || CASE WHEN conv_id % 3 = 0 THEN ' at 37.' || (conv_id * 3 + turn) || '1 N' ELSE '' END"


@query("pol07_answer_citations", f"""WITH a AS (SELECT conv_id, turn, conv_id * 3 + turn AS cited, {_ANSWER_TEXT} AS text FROM conversations), p AS (SELECT doc_id, '37.' || doc_id || '1' AS value FROM documents WHERE doc_id % 2 = 0)
SELECT conv_id, turn, cited NOT IN (SELECT doc_id FROM documents) AS unknown_citation, EXISTS (SELECT 1 FROM p WHERE p.doc_id = cited AND contains(a.text, p.value)) AS private_value FROM a""")  # fmt: skip
def pol07(spark, d):
    """Answers that cite documents, some unknown; some texts hold the private value of what they cite."""
    answers = table(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") * 3 + F.col("turn")).alias("cited"), F.expr(_ANSWER_TEXT).alias("text"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("cited"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("37."), F.col("doc_id").cast("string"), F.lit("1"))).alias("private"))
    return policy.answer_issues(answers, docs).select("conv_id", "turn", "unknown_citation", "private_value")


@query("val02_partial_dates", "WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y-%m') WHEN 3 THEN strftime(ts, '%Y') WHEN 4 THEN strftime(ts, '%Y-%m-%d') || '/' || strftime(ts, '%Y-%m') ELSE strftime(ts, '%Y') || '-02-30' END AS raw FROM events) SELECT event_id, raw, CASE event_id % 6 WHEN 0 THEN 'instant' WHEN 1 THEN 'day' WHEN 2 THEN 'month' WHEN 3 THEN 'year' WHEN 4 THEN 'range' ELSE 'day' END AS precision, event_id % 6 <> 5 AS ok FROM r")
def val02(spark, d):
    i = F.col("event_id") % 6
    f = lambda p: F.date_format("ts", p)
    raw = F.when(i == 0, f("yyyy-MM-dd'T'HH:mm:ss")).when(i == 1, f("yyyy-MM-dd")).when(i == 2, f("yyyy-MM")).when(i == 3, f("yyyy")).when(i == 4, F.concat_ws("/", f("yyyy-MM-dd"), f("yyyy-MM"))).otherwise(F.concat(f("yyyy"), F.lit("-02-30")))
    rows = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return rows.withColumn("precision", S.date_precision(F.col("raw"))).withColumn("ok", S.partial_date_ok(F.col("raw"), F.col("precision")))


@query("val03_coordinates", f"WITH {with_sql('observation')} SELECT CASE WHEN (lat IS NULL) <> (lon IS NULL) THEN 'coordinate_pair_incomplete' WHEN lat IS NULL THEN NULL WHEN NOT lat BETWEEN -90 AND 90 OR NOT lon BETWEEN -180 AND 180 THEN 'coordinate_out_of_range' END AS issue, count(*)::BIGINT AS n FROM observation GROUP BY 1")
def val03(spark, d):
    return observation(spark, d).groupBy(S.coordinate_issue(F.col("lat"), F.col("lon")).alias("issue")).agg(F.count("*").alias("n"))


_SHARES = "SELECT l_partkey AS entity, l_returnflag AS k, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2"
# Whole shares: the last letter takes what rounding leaves, but for every fourth part; sevenths lose a tenth, elevenths have a negative one.
_SKEWED = "CASE WHEN entity % 11 = 0 AND k = 'A' THEN -5.0 WHEN entity % 7 = 0 THEN floor(90.0 * q / t) WHEN entity % 4 = 0 THEN round(100.0 * q / t, 1) ELSE CASE k WHEN 'A' THEN 20.0 WHEN 'N' THEN 30.0 ELSE 50.0 END END"


def _shares(spark, d):
    """entity, shares: percentages of quantity by return flag as a map."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("k")).agg(F.sum("l_quantity").alias("q"))
    g = g.withColumn("t", F.sum("q").over(Window.partitionBy("entity"))).select("entity", "k", F.expr(_SKEWED).cast("double").alias("share"))
    return g.groupBy("entity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "share")))).alias("shares"))


@query("val06_distribution_check", f"""WITH s AS ({_SHARES}), t AS (SELECT entity, k, {_SKEWED} AS share FROM (SELECT *, sum(q) OVER (PARTITION BY entity) AS t FROM s)),
v AS (SELECT entity, bool_or(share < 0 OR share > 100) AS bad, list_reduce(list(share ORDER BY k), lambda a, b: a + b) AS total FROM t GROUP BY 1)
SELECT entity, CASE WHEN bad THEN 'invalid_value' WHEN NOT total BETWEEN 99 AND 101 THEN 'invalid_sum' WHEN total <> 100 THEN 'inexact_sum' ELSE 'ok' END AS status FROM v""")  # fmt: skip
def val06(spark, d):
    return policy.distribution_issues(_shares(spark, d), "entity", F.col("shares"))


_RAW_MEASURE = "CASE c_custkey % 9 WHEN 0 THEN 'NA' WHEN 1 THEN ' ' WHEN 2 THEN 'Infinity' WHEN 3 THEN 'ten' WHEN 4 THEN CAST(c_custkey AS VARCHAR(20)) WHEN 5 THEN ' 12.0 ' WHEN 6 THEN '12.5' WHEN 7 THEN '-3' ELSE 'NaN' END"


@query("val07_measurements", f"""WITH r AS (SELECT c_custkey, trim({_RAW_MEASURE}) AS t FROM customer), n AS (SELECT *, t IN ('', 'NA') AS missing, try_cast(t AS DOUBLE) AS x FROM r)
SELECT c_custkey, CASE WHEN NOT missing AND x > 0 AND isfinite(x) THEN x END AS value, CASE WHEN NOT missing AND x > 0 AND isfinite(x) AND x = floor(x) THEN x::BIGINT END AS sample_size, missing,
  CASE WHEN missing THEN NULL WHEN x IS NULL OR NOT isfinite(x) OR NOT x > 0 THEN 'invalid_measurement' WHEN x <> floor(x) THEN 'sample_size_not_whole' END AS issue FROM n""")  # fmt: skip
def val07(spark, d):
    """Null tokens, infinities, words, whole numbers with and without a point, fractions and numbers below 0."""
    r = table(spark, d, "customer").select("c_custkey", F.expr(_RAW_MEASURE).alias("raw"))
    v = r.select("c_custkey", S.positive_number(F.col("raw")).alias("value"), S.whole_number(F.col("raw")).alias("sample_size"), S.null_token(F.col("raw")).isNull().alias("missing"))
    return v.withColumn("issue", F.when(F.col("missing"), None).when(F.col("value").isNull(), "invalid_measurement").when(F.col("sample_size").isNull(), "sample_size_not_whole"))


@query("val08_vectors", "WITH v AS (SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN list_transform(embedding, lambda x: 0.0::FLOAT) WHEN 1 THEN list_transform(embedding, lambda x: 2 * x) WHEN 2 THEN embedding[1:63] ELSE embedding END AS e FROM embeddings) SELECT CASE WHEN len(e) <> 64 THEN 'wrong_length' WHEN vec_id % 5 = 0 THEN 'zero_norm' WHEN vec_id % 5 = 1 THEN 'not_unit' END AS issue, count(*)::BIGINT AS n FROM v GROUP BY 1")
def val08(spark, d):
    i, e = F.col("vec_id") % 5, F.col("embedding")
    v = F.when(i == 0, F.transform(e, lambda x: F.lit(0.0).cast("float"))).when(i == 1, F.transform(e, lambda x: (x * 2).cast("float"))).when(i == 2, F.slice(e, 1, 63)).otherwise(e)
    return table(spark, d, "embeddings").groupBy(S.vector_issue(v, 64).alias("issue")).agg(F.count("*").alias("n"))


_RELATION = {
    "id": "CASE WHEN p_partkey % 71 = 0 THEN NULL WHEN p_partkey % 73 = 0 THEN 'r1' ELSE 'r' || p_partkey END",
    "entity_id": "CASE WHEN p_partkey % 83 = 0 THEN ' ' WHEN p_partkey % 89 = 0 THEN 'shared' WHEN p_partkey % 10 < 2 THEN 'e' || (p_partkey - p_partkey % 10) ELSE 'e' || p_partkey END",
    "entity_kind": "CASE WHEN p_partkey % 10 < 2 THEN 'usage' WHEN p_partkey % 3 = 0 THEN 'domestic_form' WHEN p_partkey % 29 = 0 THEN 'hybrid' ELSE 'usage' END",
    "relation_type": "CASE WHEN p_partkey % 31 = 0 THEN 'domesticated_from' WHEN p_partkey % 10 >= 2 AND p_partkey % 3 = 0 THEN 'domesticated_from' WHEN p_partkey % 37 = 0 THEN 'kin' ELSE 'common_usage' END",
    "name": "CASE WHEN p_partkey % 10 < 2 THEN 'pair' ELSE p_name END",
    "scientific_name": "CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE p_type END",
    "note": "CASE WHEN p_partkey % 43 = 0 THEN '' ELSE 'n' END",
}
_N_TERMS = "CASE WHEN p_partkey % 10 < 2 THEN 1 ELSE p_partkey % 14 END"
_TERM = "CASE WHEN p_partkey % 47 = 0 THEN ' a' WHEN p_partkey % 53 = 0 THEN repeat('x', 201) WHEN p_partkey % 10 = 0 THEN 'Pair' WHEN p_partkey % 10 = 1 THEN 'pair' ELSE 't' END"
_CITED = "CASE WHEN p_partkey % 59 = 0 THEN 'http://example.org/a' WHEN p_partkey % 61 = 0 THEN 'https://me@example.org/a' ELSE 'https://example.org/a' END"
_TITLED = "CASE WHEN p_partkey % 67 = 0 THEN '' ELSE 'title' END"


@query("val09_one_definition", f"""WITH r AS (SELECT p_partkey, {', '.join(f'{e} AS {c}' for c, e in _RELATION.items())}, {_N_TERMS} AS terms, {_TERM} AS term, {_CITED} AS url, {_TITLED} AS title FROM part),
w AS (SELECT *, count(*) OVER (PARTITION BY id) AS copies FROM r), v AS (SELECT entity_id AS ent, count(DISTINCT (name, entity_kind, terms, lower(term))) AS ways FROM r GROUP BY 1),
x AS (SELECT w.*, ways, entity_kind IN ('usage', 'domestic_form') AND relation_type IN ('common_usage', 'domesticated_from') AS known FROM w LEFT JOIN v ON ent = entity_id)
SELECT id, unnest(list_filter([CASE WHEN id IS NULL OR copies > 1 THEN 'id_not_unique' END, CASE WHEN NOT known THEN 'unknown_type' END, CASE WHEN known AND relation_type <> CASE WHEN entity_kind = 'domestic_form' THEN 'domesticated_from' ELSE 'common_usage' END THEN 'kind_and_type_disagree' END,
  CASE WHEN trim(entity_id) = '' OR trim(name) = '' OR coalesce(trim(scientific_name), '') = '' OR trim(note) = '' THEN 'missing_field' END, CASE WHEN NOT terms BETWEEN 1 AND 12 OR term <> trim(term) OR length(term) > 200 THEN 'invalid_terms' END,
  CASE WHEN ways > 1 THEN 'conflicting_definition' END, CASE WHEN url NOT LIKE 'https://%' OR contains(url, '@') OR title = '' THEN 'invalid_citation' END], lambda i: i IS NOT NULL)) AS issue FROM x""")  # fmt: skip
def val09(spark, d):
    """Relations of which some break each rule; pairs of records define one entity in the same way but for the case of a term."""
    terms = F.when(F.expr(_N_TERMS) == 0, F.array().cast("array<string>")).otherwise(F.array_repeat(F.expr(_TERM), F.expr(_N_TERMS).cast("int")))
    rows = table(spark, d, "part").select(*[F.expr(e).alias(c) for c, e in _RELATION.items()], terms.alias("terms"), F.array(F.expr(_CITED)).alias("urls"), F.array(F.expr(_TITLED)).alias("titles"))
    return policy.relation_issues(rows, ("usage", "domestic_form"), ("common_usage", "domesticated_from"), {"domestic_form": "domesticated_from"}, "common_usage")


@query("val10_web_urls", f"WITH {with_sql('evidence')} SELECT locator, locator LIKE 'https://%' AND evidence % 3 <> 0 AS ok FROM evidence")
def val10(spark, d):
    bad = F.when(F.col("evidence") % 3 == 0, F.regexp_replace("locator", "//", "//user:pw@")).otherwise(F.col("locator"))
    return evidence(spark, d).select("locator", S.web_url(bad).alias("ok"))


@query("gate01_load_gate", """WITH b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 40 = 0 THEN -1 ELSE o_custkey END AS c, o_custkey AS good, o_totalprice AS claim FROM orders),
r AS (SELECT 'good' AS load, k, good AS c, claim FROM b UNION ALL SELECT 'unmatched', k, c, claim FROM b UNION ALL SELECT 'twice', k % 9999, good, claim FROM b UNION ALL SELECT 'other_hash', k, good, CASE WHEN k % 7 <> 3 THEN claim END FROM b),
l AS (SELECT unnest(['good', 'no_rows', 'unmatched', 'twice', 'other_hash']) AS load),
m AS (SELECT l.load, count(k)::BIGINT AS row_count, count(DISTINCT k)::BIGINT AS ids, count(*) FILTER (r.c IN (SELECT c_custkey FROM customer))::BIGINT AS matched, count(claim)::BIGINT AS claims, l.load <> 'other_hash' AS same_hash FROM l LEFT JOIN r USING (load) GROUP BY 1, 6)
SELECT load, row_count, ids, matched, claims, concat_ws(',', CASE WHEN NOT same_hash THEN 'hash' END, CASE WHEN row_count = 0 THEN 'empty' END, CASE WHEN ids <> row_count THEN 'duplicate_ids' END, CASE WHEN matched < 0.99 * row_count THEN 'match_ratio' END, CASE WHEN claims = 0 THEN 'no_claims' END) AS reasons FROM m""")  # fmt: skip
def gate01(spark, d):
    """A good load, an empty one, one with unmatched rows, one with repeated ids, and one whose file has another hash than its manifest."""
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.lit(1).alias("known")).distinct()
    b, k = table(spark, d, "orders"), F.col("o_orderkey")
    base = lambda i, c, claim=F.col("o_totalprice"): b.select(i.alias("k"), c.alias("c"), claim.alias("claim"))
    good = base(k, F.col("o_custkey"))
    loads = {"good": good, "no_rows": good.limit(0), "unmatched": base(k, F.when(k % 40 == 0, -1).otherwise(F.col("o_custkey"))), "twice": base(k % 9999, F.col("o_custkey")), "other_hash": base(k, F.col("o_custkey"), F.when(k % 7 != 3, F.col("o_totalprice")))}
    told = snapshots.fingerprint(good)
    out = []
    for name, rows in loads.items():
        # A load's manifest holds the fingerprint of what was meant to be loaded; the last one was changed since.
        same = snapshots.fingerprint(rows) == (told if name == "other_hash" else snapshots.fingerprint(rows))
        measures = {"row_count": F.count("*"), "ids": F.count_distinct("k"), "matched": F.count("known"), "claims": F.count("claim")}
        fails = [("hash", ~F.lit(same)), ("empty", F.col("row_count") == 0), ("duplicate_ids", F.col("ids") != F.col("row_count")), ("match_ratio", F.col("matched") < 0.99 * F.col("row_count")), ("no_claims", F.col("claims") == 0)]
        out.append(policy.gate(rows.join(known, "c", "left"), measures, fails).drop("ready").withColumn("load", F.lit(name)))
    return reduce(lambda x, y: x.unionByName(y), out)


_BAD = "individual_count < 0 OR licence = 'all rights reserved'"


@query("gate02_reject_ratio", f"""WITH {with_sql('observation')}, p AS (SELECT entity % 5 AS run, external_id % 40 AS page, observation, {_BAD} AS bad, external_id % 40 = 7 AND entity % 5 = 1 AS failed FROM observation),
m AS (SELECT run, count(*) FILTER (NOT failed)::BIGINT AS raw, count(*) FILTER (bad AND NOT failed)::BIGINT AS rejected, count(DISTINCT page)::BIGINT AS pages, count(DISTINCT CASE WHEN failed THEN page END)::BIGINT AS page_errors, bool_or(run <> 2) AS complete FROM p GROUP BY 1)
SELECT run, raw, rejected, pages, page_errors, concat_ws(',', CASE WHEN page_errors > 0 THEN 'page_error' END, CASE WHEN raw = 0 THEN 'no_records' END, CASE WHEN raw = rejected THEN 'none_valid' END, CASE WHEN rejected > 0.25 * raw THEN 'reject_ratio' END, CASE WHEN NOT complete AND pages >= 20 THEN 'truncated' END) AS reasons FROM m""")  # fmt: skip
def gate02(spark, d):
    """Runs of pages: one with a failed page, one that ends at its page limit, and all with their share of rejects."""
    o = observation(spark, d).select((F.col("entity") % 5).alias("run"), (F.col("external_id") % 40).alias("page"), F.expr(_BAD).alias("bad"), ((F.col("external_id") % 40 == 7) & (F.col("entity") % 5 == 1)).alias("failed"))
    measures = {"raw": F.count_if(~F.col("failed")), "rejected": F.count_if(F.col("bad") & ~F.col("failed")), "pages": F.count_distinct("page"), "page_errors": F.count_distinct(F.when(F.col("failed"), F.col("page"))), "complete": F.bool_or(F.col("run") != 2)}
    return policy.run_gates(o, ["run"], measures, page_limit=20).drop("complete", "ready")


_SNAPSHOT = "CASE WHEN p_partkey % 97 = 5 THEN ' ' WHEN p_partkey % 101 = 7 THEN NULL ELSE p_name END"
_CHECKS = "row_count, malformed, names, concat_ws(',', CASE WHEN malformed > 0 THEN 'malformed' END, CASE WHEN row_count = 0 THEN 'empty' END, CASE WHEN names * 2 > row_count THEN 'too_many_names' END) AS reasons"


@query("gate03_name_snapshot", f"""WITH m AS (SELECT part, count(*)::BIGINT AS row_count, count(*) FILTER (n IS NULL OR trim(n) = '')::BIGINT AS malformed, count(DISTINCT n)::BIGINT AS names
  FROM (SELECT 'whole' AS part, {_SNAPSHOT} AS n FROM part UNION ALL SELECT 'clean', p_name FROM part) GROUP BY 1)
SELECT part, {_CHECKS}, malformed = 0 AND row_count > 0 AND names * 2 <= row_count AS ready FROM m UNION ALL SELECT 'none', 0, 0, 0, 'empty', false""")  # fmt: skip
def gate03(spark, d):
    """A snapshot with malformed names, a clean one and an empty one."""
    p = table(spark, d, "part")
    out = []
    for part, rows in (("whole", p.withColumn("n", F.expr(_SNAPSHOT))), ("clean", p.withColumn("n", F.col("p_name"))), ("none", p.limit(0).withColumn("n", F.col("p_name")))):
        measures = {"row_count": F.count("*"), "malformed": F.count_if(F.col("n").isNull() | (F.trim("n") == "")), "names": F.count_distinct("n")}
        fails = [("malformed", F.col("malformed") > 0), ("empty", F.col("row_count") == 0), ("too_many_names", F.col("names") * 2 > F.col("row_count"))]
        out.append(policy.gate(rows, measures, fails).withColumn("part", F.lit(part)))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("fn02_compact_names", "SELECT p_partkey, replace(p_name, ' ', '') AS compact FROM part")
def fn02(spark, d):
    return table(spark, d, "part").select("p_partkey", S.compact_name(F.col("p_name")).alias("compact"))


_MESSY = "CASE p_partkey % 6 WHEN 0 THEN '  ' || replace(p_name, ' ', '   ') WHEN 1 THEN p_name || chr(9) || 'cafe\u0301' || chr(10) WHEN 2 THEN repeat(p_name, 20) WHEN 3 THEN '  ' || chr(9) WHEN 4 THEN NULL ELSE p_name END"


@query("fn01_normalized_names", f"SELECT p_partkey, CASE WHEN length(n) BETWEEN 1 AND 120 THEN n END AS name FROM (SELECT p_partkey, trim(regexp_replace(nfc_normalize({_MESSY}), '\\s+', ' ', 'g')) AS n FROM part)")
def fn01(spark, d):
    """Blanks of all kinds, a letter with a combining accent, a text that is too long, blanks alone, null and a plain name."""
    return table(spark, d, "part").select("p_partkey", S.normalize_name(F.expr(_MESSY)).alias("name"))


@query("fn03_folded_words", "SELECT lang, count(DISTINCT replace(lower(strip_accents(w)), 'ß', 'ss'))::BIGINT AS folded FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY 1")
def fn03(spark, d):
    w = table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-zÀ-ÿ]+)"))).alias("w")).distinct()
    return w.groupBy("lang").agg(F.count_distinct(S.fold("w")).alias("folded"))


@query("fn04_one_edit", "WITH n AS (SELECT DISTINCT p_name FROM part) SELECT p_name AS name, CASE length(p_name) % 4 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(p_name, 3) WHEN 2 THEN substr(p_name, 2) ELSE p_name || 'xy' END AS other, length(p_name) % 4 = 2 OR (length(p_name) % 4 = 1 AND substr(p_name, 1, 1) <> substr(p_name, 2, 1)) AS one_edit FROM n")
def fn04(spark, d):
    n, k = F.col("name"), F.length("name") % 4
    other = F.when(k == 0, n).when(k == 1, F.concat(F.substring(n, 2, 1), F.substring(n, 1, 1), F.substr(n, F.lit(3)))).when(k == 2, F.substr(n, F.lit(2))).otherwise(F.concat(n, F.lit("xy")))
    return table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("other", other).withColumn("one_edit", S.one_edit(n, F.col("other")))


@query("fn11_categories", "SELECT p_partkey, p_type || ' (' || p_brand || ')' AS raw, upper(p_type) AS category FROM part")
def fn11(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")")).alias("raw")).withColumn("category", S.category(F.col("raw")))


_DATED = "CASE observation % 7 WHEN 0 THEN event_date_raw WHEN 1 THEN substr(event_date_raw, 1, 10) WHEN 2 THEN substr(event_date_raw, 1, 7) WHEN 3 THEN substr(event_date_raw, 1, 4) WHEN 4 THEN substr(event_date_raw, 1, 10) || '/' || substr(event_date_raw, 1, 7) WHEN 5 THEN 'spring' END"


@query("fn12_date_precision", f"""WITH {with_sql('observation')}, r AS (SELECT {_DATED} AS raw FROM observation)
SELECT CASE WHEN contains(raw, '/') THEN 'range' WHEN regexp_matches(raw, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T') THEN 'instant' WHEN regexp_full_match(raw, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'day' WHEN regexp_full_match(raw, '\\d{{4}}-\\d{{2}}') THEN 'month' WHEN regexp_full_match(raw, '\\d{{4}}') THEN 'year' ELSE 'unknown' END AS precision, count(*)::BIGINT AS n FROM r GROUP BY 1""")  # fmt: skip
def fn12(spark, d):
    return observation(spark, d).groupBy(S.date_precision(F.expr(_DATED)).alias("precision")).agg(F.count("*").alias("n"))


@query("fn13_month_and_range", f"WITH {with_sql('observation')} SELECT substr(event_date_raw, 1, 7) AS month, count(*)::BIGINT AS n FROM observation WHERE substr(event_date_raw, 1, 10) BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY 1")
def fn13(spark, d):
    return observation(spark, d).filter(S.lexical_between(F.col("event_date_raw"), "2024-01-05", "2024-01-20")).groupBy(S.month_prefix(F.col("event_date_raw")).alias("month")).agg(F.count("*").alias("n"))


@query("fn14_share_groups", "WITH e AS (SELECT event_id, (props::JSON->>'k')::DOUBLE AS k FROM events) SELECT event_id, CASE WHEN k > 0 AND k <= 100 THEN k END AS share FROM e")
def fn14(spark, d):
    return table(spark, d, "events").select("event_id", S.share(F.from_json("props", "map<string,double>"), ["k", "k", "missing"]).alias("share"))


_NUM, _BOOL, _DOC = "CASE WHEN p_partkey % 5 = 0 THEN p_size END", "CASE WHEN p_partkey % 3 = 0 THEN p_size > 25 END", "CASE p_partkey % 7 WHEN 0 THEN '{\"a\":1}' WHEN 1 THEN 'null' END"


@query("fn15_decoded_values", f"SELECT p_partkey, coalesce(nullif({_DOC}, 'null'), ({_NUM})::VARCHAR, CASE WHEN p_partkey % 2 = 0 THEN p_name END, ({_BOOL})::VARCHAR) AS value FROM part")
def fn15(spark, d):
    """JSON over numbers, numbers over texts, texts over flags; a JSON null counts as none."""
    return table(spark, d, "part").select("p_partkey", S.decode_value(F.expr(_NUM), F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_name END"), F.expr(_BOOL), F.expr(_DOC)).alias("value"))


_CODE = "CASE p_partkey % 8 WHEN 0 THEN ' NA ' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'D' WHEN 4 THEN 'null' WHEN 5 THEN 'A ' WHEN 6 THEN 'B' ELSE 'C' END"
_PARTS = ("p_partkey % 5 * 10", "p_size % 3 * 12.5", "p_partkey % 2 * 30")


@query("fn16_code_labels", f"""WITH c AS (SELECT p_partkey, trim({_CODE}) AS c FROM part), e AS (SELECT p_partkey, unnest([{{'v': ({_PARTS[0]})::DOUBLE, 'k': 'a'}}, {{'v': ({_PARTS[1]})::DOUBLE, 'k': 'b'}}, {{'v': ({_PARTS[2]})::DOUBLE, 'k': 'c'}}], recursive := true) FROM part),
t AS (SELECT p_partkey, string_agg(CASE k WHEN 'a' THEN 'north' WHEN 'b' THEN 'south' ELSE k END || ' ' || CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE round(v, 1)::VARCHAR END || '%', ', ' ORDER BY v DESC, k) AS text FROM e WHERE v > 0 GROUP BY 1)
SELECT c.p_partkey, CASE WHEN c IS NULL OR lower(c) IN ('', 'na', 'null', 'none') THEN 'no data' ELSE coalesce(CASE c WHEN 'A' THEN 'certain' WHEN 'B' THEN 'likely' WHEN 'C' THEN 'possible' END, 'unknown') END AS label, t.text AS shares FROM c LEFT JOIN t USING (p_partkey)""")  # fmt: skip
def fn16(spark, d):
    """Codes with blanks, null-like tokens and one without a label; shares as text, the largest first."""
    shares = F.create_map(*[x for k, e in zip("abc", _PARTS, strict=True) for x in (F.lit(k), F.expr(e).cast("double"))])
    return table(spark, d, "part").select("p_partkey", S.label(F.expr(_CODE), {"A": "certain", "B": "likely", "C": "possible"}).alias("label"), S.distribution_text(shares, {"a": "north", "b": "south"}).alias("shares"))


_INFERRED = "CASE entity % 4 WHEN 0 THEN ' Size; HABITAT ' WHEN 1 THEN 'price' WHEN 2 THEN NULL ELSE '' END"


@query("fn17_inferred_flags", f"""WITH {with_sql('claim')} SELECT claim, CASE WHEN trait = 'diet' THEN certainty = 'D' ELSE coalesce(list_contains(list_transform(string_split({_INFERRED}, ';'), lambda x: lower(trim(x))), trait), false) END AS inferred FROM claim""")
def fn17(spark, d):
    flag = F.when(F.col("trait") == "diet", F.col("certainty") == "D").otherwise(S.listed_as_inferred(F.expr(_INFERRED), F.col("trait")))
    return claim(spark, d).select("claim", flag.alias("inferred"))


_STEP = "CASE p_size % 6 WHEN 4 THEN 'NA' WHEN 5 THEN 'x' ELSE CAST(p_size % 6 AS VARCHAR(5)) END"


@query("fn18_ordinal_codes", f"SELECT p_partkey, CASE c WHEN '1' THEN 'dense' WHEN '2' THEN 'semi_open' WHEN '3' THEN 'open' END AS density, CASE WHEN c <> 'NA' AND c NOT IN ('1', '2', '3') THEN 'unknown_code' END AS issue FROM (SELECT p_partkey, {_STEP} AS c FROM part)")
def fn18(spark, d):
    step = S.ordinal(F.expr(_STEP), {1: "dense", 2: "semi_open", 3: "open"})
    return table(spark, d, "part").select("p_partkey", step.alias("o")).select("p_partkey", F.col("o.value").alias("density"), "o.issue")


@query("fn19_content_hashes", """SELECT p_partkey, sha256(p_name || chr(31) || p_type || chr(31) || p_size) AS digest,
  sha256('{"brand":' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE '"' || p_brand || '"' END || ',"name":"' || p_name || '","size":' || p_size || '}') AS record_digest FROM part""")  # fmt: skip
def fn19(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type", F.col("p_size").alias("size"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("brand"))
    return p.select("p_partkey", S.content_hash(F.col("name"), F.col("p_type"), F.col("size")).alias("digest"), F.sha2(S.canonical_json(["size", "name", "brand"]), 256).alias("record_digest"))


@query("fn20_evidence_urls", "SELECT p_partkey, 'https://example.org/record?name=' || replace(p_name, ' ', '+') AS url FROM part")
def fn20(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("https://example.org/record?name="), F.url_encode("p_name")).alias("url"))


@query("fn21_display_names", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 5 = 0 THEN p_brand ELSE p_type END AS display FROM part")
def fn21(spark, d):
    local, english = F.when(F.col("p_size") % 3 == 0, F.col("p_name")), F.when(F.col("p_size") % 5 == 0, F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(local, english, "p_type").alias("display"))


@query("fn26_sensitivity", f"WITH {with_sql('observation')} SELECT observation, CASE WHEN sensitivity = 'private' THEN 'withheld' WHEN lon IS NULL THEN 'generalized' ELSE 'public' END AS class, coalesce(place, 'unknown') AS place FROM observation")
def fn26(spark, d):
    c = F.when(F.col("sensitivity") == "private", "withheld").when(F.col("lon").isNull(), "generalized").otherwise("public")
    return observation(spark, d).select("observation", c.alias("class"), F.coalesce("place", F.lit("unknown")).alias("place"))


@query("fn27_captions", "SELECT doc_id, CASE WHEN length(t) > 72 THEN rtrim(substr(t, 1, 71)) || '…' ELSE t END AS caption FROM (SELECT doc_id, trim(regexp_replace(string_split(text, ';')[1], '\\s+', ' ', 'g')) AS t FROM documents)")
def fn27(spark, d):
    return table(spark, d, "documents").select("doc_id", S.caption(F.col("text")).alias("caption"))


@query("fn28_unit_vectors", "SELECT vec_id, round(list_inner_product(list_transform(embedding, lambda x: 3 * x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_inner_product(list_transform(embedding, lambda x: 3 * x::DOUBLE), list_transform(embedding, lambda x: 3 * x::DOUBLE))), 6) AS dot FROM embeddings")
def fn28(spark, d):
    u = S.unit_vector(F.transform("embedding", lambda x: x.cast("double") * 3))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(F.zip_with(u, "embedding", lambda a, b: a * b.cast("double")), F.lit(0.0), lambda s, x: s + x), 6).alias("dot"))


_GUARD = "(inferred = false OR (inferred IS NULL AND trait = 'diet' AND certainty IN ('A', 'B', 'C'))) AND (taxonomy_release IS NULL OR taxonomy_release = 'r1') AND policy_status = 'allowed'"


@query("flt01_claim_guard", f"WITH {with_sql('claim')} SELECT trait, certainty, count(*)::BIGINT AS n FROM claim WHERE {_GUARD} GROUP BY 1, 2")
def flt01(spark, d):
    return claim(spark, d).filter(filters.claim_guard()).groupBy("trait", "certainty").agg(F.count("*").alias("n"))


@query("flt02_active_context", f"WITH {with_sql('entity')}, s AS (SELECT max(release) AS release FROM entity) SELECT e.entity, e.name FROM entity e WHERE policy_status = 'allowed' AND release = (SELECT release FROM s)")
def flt02(spark, d):
    e = entity(spark, d)
    return filters.active(e, e.agg(F.max("release").alias("release"))).select("entity", "name")


_KNOWN = "SELECT DISTINCT e.entity, e.name, e.entity % 4 = 0 AS in_region FROM entity e WHERE e.entity % 3 <> 0"


@query("flt03_species_scopes", f"WITH {with_sql('entity')}, k AS ({_KNOWN}) SELECT s.scope, count(*)::BIGINT AS n FROM (VALUES ('all'), ('inside'), ('outside'), ('unknown')) s(scope), entity e LEFT JOIN k ON k.entity = e.entity AND k.name = e.name WHERE s.scope = 'all' OR (s.scope = 'inside' AND k.in_region) OR (s.scope = 'outside' AND NOT k.in_region) OR (s.scope = 'unknown' AND k.entity IS NULL) GROUP BY 1")
def flt03(spark, d):
    e = entity(spark, d).select("entity", "name")
    known = e.filter("entity % 3 <> 0").withColumn("in_region", F.col("entity") % 4 == 0)
    parts = [filters.in_scope(e, known, s).agg(F.count("*").alias("n")).select(F.lit(s).alias("scope"), "n") for s in ("all", "inside", "outside", "unknown")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


CONDITIONS = [(1, "size", "gte", None, 20.0, "cm"), (2, "price", "lt", None, 1500.0, "usd"), (3, "diet", "eq", None, None, None)]
CONDITIONS_SQL = "cond(cond, trait, op, value, threshold, want_unit) AS (VALUES (1, 'size', 'gte', NULL, 20.0::DOUBLE, 'cm'), (2, 'price', 'lt', NULL, 1500.0::DOUBLE, 'usd'), (3, 'diet', 'eq', (SELECT min(p_type) FROM part), NULL, NULL))"
HOLDS_SQL = "coalesce(CASE op WHEN 'eq' THEN value_text = value WHEN 'gte' THEN unit IS NOT DISTINCT FROM want_unit AND value_num >= threshold WHEN 'lt' THEN unit IS NOT DISTINCT FROM want_unit AND value_num < threshold END, false)"


def conditions(spark, d):
    """Three conditions; the value of the last is the first type by name."""
    c = spark.createDataFrame(CONDITIONS, "cond int, trait string, op string, value string, threshold double, want_unit string")
    return c.crossJoin(table(spark, d, "part").agg(F.min("p_type").alias("m"))).withColumn("value", F.when(F.col("op") == "eq", F.col("m"))).drop("m")  # one row


@query("flt04_typed_conditions", f"WITH {with_sql('claim')}, {CONDITIONS_SQL} SELECT c.cond, {HOLDS_SQL} AS holds, count(*)::BIGINT AS n FROM claim JOIN cond c USING (trait) GROUP BY 1, 2")
def flt04(spark, d):
    return claim(spark, d).join(F.broadcast(conditions(spark, d)), "trait").groupBy("cond", filters.condition_holds().alias("holds")).agg(F.count("*").alias("n"))


@query("flt05_optional_search", f"WITH {with_sql('observation')} SELECT observation, entity, place FROM observation WHERE contains(lower(place), 'ur') AND entity = 7 AND substr(event_date_raw, 1, 10) >= '2024-01-10'")
def flt05(spark, d):
    return filters.search(observation(spark, d), {"place": "UR", "licence": None}, {"entity": 7, "sensitivity": None}, first="2024-01-10").select("observation", "entity", "place")


