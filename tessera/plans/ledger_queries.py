"""Queries that build ledgers: index builds with exclusion reasons, name reviews, audits and replays."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalars as S
from tessera.operators import hierarchy, linking, reconcile

from .name_queries import case, quoted
from .reference_queries import K, SCIENCE
from .registry import query
from .relation_queries import _XW, _crosswalk
from .stand_ins import claim, entity, table, with_sql


@query("fn22_agreed_names", """WITH r AS (SELECT p_partkey + CASE WHEN p_partkey % 8 = 6 THEN 1 ELSE 0 END AS id, CASE WHEN p_partkey % 8 = 2 THEN 'other' ELSE p_name END AS scientific, CASE WHEN p_partkey % 8 = 4 THEN 'Other' ELSE p_brand END AS english, 'local ' || p_partkey AS local FROM part WHERE p_partkey % 2 = 0)
SELECT p.p_partkey, CASE WHEN r.scientific = p.p_name AND r.english = p.p_brand THEN r.local END AS local, CASE WHEN r.id IS NULL THEN 'not_reviewed' WHEN r.scientific <> p.p_name THEN 'scientific_name_differs' WHEN r.english <> p.p_brand THEN 'english_name_differs' END AS reason FROM part p LEFT JOIN r ON r.id = p.p_partkey""")  # fmt: skip
def fn22(spark, d):
    """A reviewed name holds where id, scientific and English name agree; some reviews differ in each of the three."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    reviewed = p.filter("p_partkey % 2 = 0").select((k + F.when(k % 8 == 6, 1).otherwise(0)).alias("p_partkey"), F.when(k % 8 == 2, "other").otherwise(F.col("p_name")).alias("scientific"), F.when(k % 8 == 4, "Other").otherwise(F.col("p_brand")).alias("english"), F.concat(F.lit("local "), k.cast("string")).alias("text"))
    j = p.join(reviewed, "p_partkey", "left")
    reason = F.when(F.col("text").isNull(), "not_reviewed").when(F.col("scientific") != F.col("p_name"), "scientific_name_differs").when(F.col("english") != F.col("p_brand"), "english_name_differs")
    return j.select("p_partkey", F.when(reason.isNull(), F.col("text")).alias("local"), reason.alias("reason"))


@query("fn23_summaries", f"WITH {with_sql('claim')}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, trait ORDER BY claim) AS n FROM claim WHERE value_text IS NOT NULL) SELECT entity, string_agg(trait || ': ' || value_text, '; ' ORDER BY trait) AS summary FROM r WHERE n = 1 GROUP BY 1")
def fn23(spark, d):
    first = hierarchy.first_per_group(claim(spark, d).filter("value_text is not null"), ["entity", "trait"], [F.col("claim")])
    return first.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "trait", "value_text"))), "; ").alias("summary"))


@query("jn06_preferred_sheet", "WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_returnflag FROM r WHERE n = 1")
def jn06(spark, d):
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return hierarchy.first_per_group(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey"], [rank, F.col("l_linenumber")])


@query("jn07_mapped_with_family", "SELECT n.n_nationkey, count(s.s_suppkey)::BIGINT AS suppliers, count(*) FILTER (s.s_suppkey % 5 <> n.n_regionkey)::BIGINT AS mismatches FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY 1")
def jn07(spark, d):
    j = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_nationkey").agg(F.count("s_suppkey").alias("suppliers"), F.count_if(F.col("s_suppkey") % 5 != F.col("n_regionkey")).alias("mismatches"))


_LINK_PREFIX, _URL_PREFIX = "https://zone.example.org/species/", "https://list.example.org/species/"
_K7 = "CAST(p_partkey + 7 AS STRING)"
_YY = "CAST(1950 + p_partkey % 40 AS STRING)"
_CITED = f"'Red List of Threatened Species 2021: e. UK.' || CASE WHEN p_partkey % 3 = 0 THEN '2018' ELSE '2021' END || '-3.RLTS.T' || {K} || 'A' || CASE WHEN p_partkey % 41 = 8 THEN {K} ELSE {_K7} END || '.en'"
_ACT = ["p_partkey AS taxon", "p_partkey", "p_name", "p_type", f"{SCIENCE} AS name", f"'Smith, J., ' || {_YY} AS authority", f"{case('p_partkey', *quoted('LC', 'en ', 'VU', 'NE', 'LC', 'CR (PE)', 'NT', 'XX', 'DD', 'LC', 'EX', None))} AS grade",
  f"CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 17 = 1 THEN 'http://zone.example.org/' || {K} WHEN p_partkey % 34 = 5 THEN '{_LINK_PREFIX}' || CAST(p_partkey - 1 AS STRING) ELSE '{_LINK_PREFIX}' || {K} END AS reference"]
_SRC = [f"{K} AS sis", f"CASE WHEN p_partkey % 29 = 5 THEN 'x' ELSE {K} END AS accepted", f"CASE WHEN p_partkey % 31 = 6 THEN 'other ' || {K} ELSE {SCIENCE} END AS name", f"CASE WHEN p_partkey % 37 = 7 THEN 'Brown, ' WHEN p_partkey % 2 = 0 THEN 'Smith, ' ELSE 'Smith, J., ' END || {_YY} AS authority",
  f"{_CITED} AS citation", f"'{_URL_PREFIX}' || {K} || '/' || {_K7} AS url"]
_DIST = [f"{K} AS sis", f"{case('p_partkey', *quoted('Least Concern', 'Endangered', 'Vulnerable', 'Near Threatened', 'Data Deficient', 'Lower Risk', 'Least Concern'))} AS category", f"CASE WHEN p_partkey % 61 = 13 THEN 'another' ELSE {_CITED} END AS citation"]
_LINK = f"""act AS (SELECT {', '.join(_ACT)} FROM part), src AS (SELECT {', '.join(_SRC)}, CASE WHEN p_partkey % 43 = 9 THEN 'synonym' ELSE 'accepted' END AS status FROM part WHERE p_partkey % 19 <> 3 UNION ALL SELECT {', '.join(_SRC)}, 'synonym' FROM part WHERE p_partkey % 23 = 4),
dist AS (SELECT {', '.join(_DIST)} FROM part WHERE p_partkey % 47 <> 10 UNION ALL SELECT {', '.join(_DIST)} FROM part WHERE p_partkey % 53 = 11),
sp AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY name) AS same_name FROM src WHERE status = 'accepted') WHERE sis IN (SELECT sis FROM src GROUP BY 1 HAVING count(*) = 1)),
g AS (SELECT sis, count(*) AS global, any_value(category) AS category, any_value(citation) AS citation FROM dist GROUP BY 1),
a AS (SELECT *, count(*) OVER (PARTITION BY taxon) AS same_taxon, count(*) OVER (PARTITION BY name) AS same_active, count(*) OVER (PARTITION BY reference) AS same_reference, regexp_extract(coalesce(reference, ''), '^{_LINK_PREFIX.replace('.', chr(92) + '.')}([1-9][0-9]*)$', 1) AS sis, upper(trim(grade)) AS gr FROM act),
lj AS (SELECT a.*, sp.name AS s_name, sp.authority AS s_auth, sp.accepted, sp.same_name, sp.citation AS s_cit, g.global, g.category AS raw, g.citation AS d_cit, (SELECT count(*) FROM src WHERE src.sis = a.sis) AS all_sis,
  regexp_extract_all(sp.citation, 'RLTS\\.(T[1-9][0-9]*A[1-9][0-9]*)\\.en', 1) = ['T' || a.sis || 'A' || regexp_extract(sp.url, '/([0-9]+)$', 1)] AS same_id, regexp_extract(sp.url, '/([0-9]+)$', 1) AS num,
  sp.authority = a.authority OR sp.authority = replace(a.authority, ' J.,', '') AS auth_ok FROM a LEFT JOIN sp ON sp.sis = a.sis LEFT JOIN g ON g.sis = a.sis),
lx AS (SELECT *, CASE raw {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in linking.CATEGORIES.items())} END AS code FROM lj),
lk AS (SELECT *, CASE WHEN same_taxon > 1 OR same_active > 1 THEN 'ambiguous_active_identity' WHEN gr = 'NE' THEN 'not_evaluated_requires_concept_review' WHEN gr IS NULL OR gr NOT IN ({', '.join(f"'{x}'" for x in linking.GRADES)}) THEN 'unconfirmed_taxonomy_category'
  WHEN reference IS NULL THEN 'missing_exact_link' WHEN sis = '' OR same_reference > 1 THEN 'invalid_or_ambiguous_exact_link' WHEN all_sis > 1 THEN 'duplicate_source_id' WHEN s_name IS NULL THEN 'no_accepted_source_species' WHEN accepted <> sis OR same_name > 1 THEN 'ambiguous_source_identity'
  WHEN s_name <> name THEN 'scientific_name_mismatch' WHEN NOT auth_ok THEN 'authority_mismatch' WHEN global IS DISTINCT FROM 1 THEN 'missing_or_ambiguous_global_assessment' WHEN code IS NULL THEN 'unsupported_source_category' WHEN NOT same_id OR d_cit <> s_cit THEN 'assessment_identity_or_citation_mismatch' ELSE 'linked' END AS reason FROM lx)"""
_REVIEW = ("ambiguous_active_identity", "invalid_or_ambiguous_exact_link", "duplicate_source_id", "ambiguous_source_identity", "scientific_name_mismatch", "authority_mismatch", "assessment_identity_or_citation_mismatch")
_OPEN = ("missing_exact_link", "no_accepted_source_species", "missing_or_ambiguous_global_assessment")
_IN = lambda names: ", ".join(f"'{x}'" for x in names)


def _assessed(spark, d):
    p = table(spark, d, "part")
    status = F.when(F.col("p_partkey") % 43 == 9, "synonym").otherwise("accepted").alias("status")
    src = p.filter("p_partkey % 19 <> 3").select(*map(F.expr, _SRC), status).unionByName(p.filter("p_partkey % 23 = 4").select(*map(F.expr, _SRC), F.lit("synonym").alias("status")))
    dist = p.filter("p_partkey % 47 <> 10").selectExpr(*_DIST).unionByName(p.filter("p_partkey % 53 = 11").selectExpr(*_DIST))
    return linking.link_assessments(p.selectExpr(*_ACT), src, dist, _LINK_PREFIX, _URL_PREFIX)


def _links(spark, d):
    return _assessed(spark, d).withColumn("reason", F.coalesce("reason", F.lit("linked")))


@query("jn08_linked_with_reasons", f"WITH {_LINK} SELECT p_partkey, reason, CASE WHEN reason = 'linked' THEN code END AS category, CASE WHEN reason = 'linked' THEN num::BIGINT END AS assessment, CASE WHEN reason = 'linked' AND p_partkey % 3 <> 0 THEN 2021 END AS year FROM lk")
def jn08(spark, d):
    return _links(spark, d).select("p_partkey", "reason", "category", "assessment", "year")


@query("jn09_reference_only", f"WITH {_LINK}, l AS (SELECT DISTINCT p_name FROM lk WHERE reason = 'linked') SELECT lk.p_partkey, lk.p_name IN (SELECT p_name FROM l) AS same_name_linked FROM lk WHERE reason <> 'linked'")
def jn09(spark, d):
    k = _links(spark, d)
    linked = k.filter("reason = 'linked'").select("p_name").distinct().withColumn("hit", F.lit(True))
    return k.filter("reason <> 'linked'").join(linked, "p_name", "left").select("p_partkey", F.coalesce("hit", F.lit(False)).alias("same_name_linked"))


@query("q13_index_coverage", f"WITH {_LINK} SELECT reason, count(*)::BIGINT AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM lk), 6) AS share, count(DISTINCT CASE WHEN reason = 'linked' THEN code END)::BIGINT AS categories FROM lk GROUP BY 1")
def q13(spark, d):
    k = _links(spark, d)
    per = k.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("category").alias("categories"))
    return per.crossJoin(F.broadcast(k.agg(F.count("*").alias("t")))).select("reason", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"), "categories")  # one row of counts


@query("q25_reconciliation_ledger", f"WITH {_LINK}, r AS (SELECT reason, p_type, p_partkey, row_number() OVER (PARTITION BY reason, p_type ORDER BY p_partkey) AS n FROM lk) SELECT reason, p_type, count(*)::BIGINT AS n, string_agg(CASE WHEN n <= 5 THEN p_partkey::VARCHAR END, ',' ORDER BY p_partkey) AS examples FROM r GROUP BY 1, 2")
def q25(spark, d):
    w = Window.partitionBy("reason", "p_type")
    r = _links(spark, d).withColumns({"k": F.row_number().over(w.orderBy("p_partkey")), "n": F.count("*").over(w)}).filter("k <= 5")
    return r.groupBy("reason", "p_type").agg(F.max("n").alias("n"), F.array_join(F.array_sort(F.collect_list("p_partkey")), ",").alias("examples"))


@query("q26_unresolved_candidates", f"WITH {_LINK}, u AS (SELECT p_partkey, p_name, p_type FROM lk WHERE reason IN ({_IN(_OPEN)})), ok AS (SELECT p_name, p_type, count(*) AS candidates, min(p_partkey) AS first FROM lk WHERE reason = 'linked' GROUP BY 1, 2) SELECT u.p_partkey, candidates::BIGINT AS candidates, first FROM u JOIN ok USING (p_name, p_type)")
def q26(spark, d):
    k = _links(spark, d)
    g = k.filter("reason = 'linked'").groupBy("p_name", "p_type").agg(F.count("*").alias("candidates"), F.min("p_partkey").alias("first"))
    return k.filter(F.col("reason").isin(*_OPEN)).select("p_partkey", "p_name", "p_type").join(g, ["p_name", "p_type"]).select("p_partkey", "candidates", "first")


@query("q32_catalog_replay", f"WITH {_LINK} SELECT CASE WHEN reason = 'linked' THEN 'assessed' WHEN reason IN ({_IN(_REVIEW)}) THEN 'review' ELSE 'missing' END AS status, count(*)::BIGINT AS n, count(DISTINCT p_partkey) = count(*) AS identity_kept FROM lk GROUP BY 1")
def q32(spark, d):
    s = F.when(F.col("reason") == "linked", "assessed").when(F.col("reason").isin(*_REVIEW), "review").otherwise("missing")
    return _links(spark, d).groupBy(s.alias("status")).agg(F.count("*").alias("n"), (F.count_distinct("p_partkey") == F.count("*")).alias("identity_kept"))


@query("q12_conservation_status", f"WITH {_LINK} SELECT lk.p_partkey, CASE WHEN lk.p_partkey % 50 = 7 THEN 'override' WHEN reason = 'linked' THEN 'checklist' WHEN p.p_size % 2 = 0 THEN 'snapshot' END AS layer, upper(lk.p_type) AS category FROM lk JOIN part p USING (p_partkey)")
def q12(spark, d):
    k = _links(spark, d).join(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    layer = F.coalesce(F.when(F.col("p_partkey") % 50 == 7, F.lit("override")), F.when(F.col("reason") == "linked", F.lit("checklist")), F.when(F.col("p_size") % 2 == 0, F.lit("snapshot")))
    return k.select("p_partkey", layer.alias("layer"), S.category(F.concat("p_type", F.lit(" (PE)"))).alias("category"))


@query("jn28_group_members", "WITH g AS (SELECT p_type || '/' || p_brand AS grp, min(p_partkey) AS k FROM part GROUP BY 1) SELECT t.p_type AS member, count(*)::BIGINT AS groups FROM g JOIN (SELECT DISTINCT p_type FROM part) t ON list_contains(string_split(g.grp, '/'), t.p_type) GROUP BY 1")
def jn28(spark, d):
    p = table(spark, d, "part")
    g = p.select(F.concat_ws("/", "p_type", "p_brand").alias("grp")).distinct().select("grp", F.explode(F.split("grp", "/")).alias("member")).distinct()
    return g.join(p.select(F.col("p_type").alias("member")).distinct(), "member", "left_semi").groupBy("member").agg(F.count("*").alias("groups"))


@query("q27_resolution_ledger", "WITH e AS (SELECT p.p_partkey, count(l.l_orderkey) AS n, bool_or(l.l_returnflag = 'R') AS r FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey AND l.l_quantity > 45 GROUP BY 1) SELECT p_partkey, CASE WHEN n = 0 THEN 'no_source' WHEN n = 1 AND r THEN 'exact' WHEN n = 1 THEN 'single' ELSE 'broader' END AS disposition FROM e")
def q27(spark, d):
    li = table(spark, d, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    j = table(spark, d, "part").join(li, "p_partkey", "left")
    return j.select("p_partkey", F.when(F.col("n").isNull(), "no_source").when((F.col("n") == 1) & F.col("r"), "exact").when(F.col("n") == 1, "single").otherwise("broader").alias("disposition"))


@query("jn31_applied_reviews", "WITH c AS (SELECT p_partkey AS id, p_name AS label, p_size AS qid FROM part WHERE p_partkey % 6 = 0), t AS (SELECT p_name AS label, count(*) AS n, min(p_partkey) AS taxon FROM part WHERE p_partkey % 6 = 1 GROUP BY 1) SELECT c.id, CASE WHEN t.n = 1 THEN t.taxon END AS taxon, CASE WHEN t.n = 1 THEN 'applied' WHEN t.n IS NULL THEN 'no_taxon' ELSE 'ambiguous' END AS outcome FROM c LEFT JOIN t USING (label)")
def jn31(spark, d):
    p = table(spark, d, "part")
    c = p.filter("p_partkey % 6 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    m = reconcile.exact_match(c, p.filter("p_partkey % 6 = 1").select(F.col("p_partkey").alias("taxon"), F.col("p_name").alias("label")), "label", "id", "taxon")
    return m.select("id", "taxon", F.when(F.col("status") == "matched", "applied").when(F.col("status") == "not_found", "no_taxon").otherwise("ambiguous").alias("outcome"))


@query("q11_subordinate_traits", f"WITH {with_sql('claim')}, x AS (SELECT DISTINCT entity, trait FROM claim WHERE inferred = false) SELECT c.entity, c.trait, count(*)::BIGINT AS n FROM claim c WHERE c.inferred AND NOT EXISTS (SELECT 1 FROM x WHERE x.entity = c.entity AND x.trait = c.trait) GROUP BY 1, 2")
def q11(spark, d):
    c = claim(spark, d)
    return c.filter("inferred").join(c.filter("inferred = false").select("entity", "trait").distinct(), ["entity", "trait"], "left_anti").groupBy("entity", "trait").agg(F.count("*").alias("n"))


@query("q15_distribution_build", "WITH a AS (SELECT user_id AS entity, 'list' AS basis FROM events WHERE event_type = 'signup' UNION ALL SELECT user_id, 'text' FROM events WHERE event_type = 'view' AND value > 90) SELECT entity, CASE WHEN count(DISTINCT basis) > 1 THEN 'both' ELSE min(basis) END AS basis, count(*)::BIGINT AS n FROM a GROUP BY 1")
def q15(spark, d):
    e = table(spark, d, "events")
    a = e.filter("event_type = 'signup'").select(F.col("user_id").alias("entity"), F.lit("list").alias("basis")).unionByName(e.filter("event_type = 'view' AND value > 90").select(F.col("user_id").alias("entity"), F.lit("text").alias("basis")))
    return a.groupBy("entity").agg(F.when(F.count_distinct("basis") > 1, "both").otherwise(F.min("basis")).alias("basis"), F.count("*").alias("n"))


@query("q20_child_display", "SELECT n.n_name AS parent, s.s_suppkey AS child, CASE WHEN length(s.s_name) > 72 THEN substr(s.s_name, 1, 71) || '…' ELSE s.s_name END AS caption, CASE WHEN s.s_suppkey % 3 = 0 THEN 'reviewed' ELSE 'pending' END AS status FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey")
def q20(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("n_name").alias("parent"), F.col("s_suppkey").alias("child"), S.caption(F.col("s_name")).alias("caption"), F.when(F.col("s_suppkey") % 3 == 0, "reviewed").otherwise("pending").alias("status"))


@query("q29_child_audit", "SELECT n.n_name AS parent, count(s.s_suppkey)::BIGINT AS children, count(*) FILTER (s.s_name IS NULL AND s.s_suppkey IS NOT NULL)::BIGINT AS unlabeled FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY 1")
def q29(spark, d):
    j = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy(F.col("n_name").alias("parent")).agg(F.count("s_suppkey").alias("children"), F.count_if(F.col("s_name").isNull() & F.col("s_suppkey").isNotNull()).alias("unlabeled"))


@query("q23_taxonomy_differences", f"""WITH {with_sql('entity')}, a AS (SELECT entity, "order" AS o FROM entity WHERE release = 'r1'), b AS (SELECT entity, CASE WHEN entity % 21 = 0 THEN 'MOVED' ELSE "order" END AS o FROM entity WHERE entity % 17 <> 0) SELECT CASE WHEN b.entity IS NULL THEN 'source_only' WHEN a.entity IS NULL THEN 'graph_only' WHEN a.o <> b.o THEN 'moved' ELSE 'same' END AS difference, count(*)::BIGINT AS n FROM a FULL JOIN b USING (entity) GROUP BY 1""")
def q23(spark, d):
    e = entity(spark, d)
    a = e.filter("release = 'r1'").select("entity", F.col("order").alias("a"))
    b = e.filter("entity % 17 <> 0").select("entity", F.when(F.col("entity") % 21 == 0, "MOVED").otherwise(F.col("order")).alias("b"))
    diff = F.when(F.col("b").isNull(), "source_only").when(F.col("a").isNull(), "graph_only").when(F.col("a") != F.col("b"), "moved").otherwise("same")
    return a.join(b, "entity", "full").groupBy(diff.alias("difference")).agg(F.count("*").alias("n"))
