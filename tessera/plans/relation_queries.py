"""Queries over hierarchies, claims and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import filters, hierarchy, questions, reconcile
from tessera.session import persist_table

from .policy_queries import _GUARD, CONDITIONS_SQL, HOLDS_SQL, conditions
from .registry import query
from .stand_ins import claim, entity, evidence, observation, table, with_sql

_EDGES = """edge AS (SELECT DISTINCT p_type AS parent, p_type || '|' || p_brand AS child FROM part UNION ALL SELECT p_type || '|' || p_brand, 'p' || p_partkey FROM part)"""


def edges(spark, d):
    p = table(spark, d, "part")
    g = F.concat_ws("|", "p_type", "p_brand")
    return p.select(F.col("p_type").alias("parent"), g.alias("child")).distinct().unionByName(p.select(g.alias("parent"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("child")))


@query("jn11_lineages", f"WITH {_EDGES} SELECT 'p' || p_partkey AS node, p_type || ' > ' || p_type || '|' || p_brand || ' > ' || 'p' || p_partkey AS path FROM part")
def jn11(spark, d):
    return hierarchy.lineage(edges(spark, d), 2).filter(F.size("path") == 3).select("node", F.array_join("path", " > ").alias("path"))


@query("jn12_descendants", f"WITH {_EDGES} SELECT p_type AS root, count(*)::BIGINT AS leaves FROM part GROUP BY 1")
def jn12(spark, d):
    return hierarchy.ancestors(edges(spark, d), 2).filter("depth = 2").groupBy(F.col("ancestor").alias("root")).agg(F.count("*").alias("leaves"))


#: The query set of peer and similarity searches; their peers are all entities.
_QUERY_SET = "entity % 20 = 0"
_ORIGINS = f"SELECT entity FROM entity WHERE {_QUERY_SET}"


@query("jn13_family_without_genus", f"""WITH {with_sql('entity')} SELECT a.entity AS origin, count(*)::BIGINT AS peers FROM entity a JOIN entity b ON a."order" = b."order" AND a.genus <> b.genus GROUP BY 1""")
def jn13(spark, d):
    """Peers of every entity: those of its order less those of its own genus, from counts by genus, so that no pair is made."""
    e = entity(spark, d).filter("genus is not null and `order` is not null")
    genus = persist_table(e.groupBy("order", "genus").agg(F.count("*").alias("n")), "genera")
    peers = genus.join(genus.groupBy("order").agg(F.sum("n").alias("all")), "order").select("order", "genus", (F.col("all") - F.col("n")).alias("peers"))
    return e.join(peers.filter("peers > 0"), ["order", "genus"]).select(F.col("entity").alias("origin"), "peers")


_RECORD = ["entity", "dataset", "source_record"]
_SUPPORT = "e.entity = c.entity AND e.dataset = c.dataset AND e.source_record = c.source_record AND e.policy_status = 'allowed' AND e.locator LIKE 'https://%'"


@query("jn10_supported_claims", f"WITH {with_sql('claim', 'evidence')} SELECT c.trait, count(*)::BIGINT AS pairs, count(DISTINCT c.claim)::BIGINT AS claims FROM claim c JOIN evidence e ON {_SUPPORT} WHERE {_GUARD.replace('policy_status', 'c.policy_status')} GROUP BY 1")
def jn10(spark, d):
    c = claim(spark, d).filter(filters.claim_guard()).select("claim", "trait", *_RECORD)
    return c.join(filters.support(evidence(spark, d)), _RECORD).groupBy("trait").agg(F.sum("pieces").alias("pairs"), F.count_distinct("claim").alias("claims"))


@query("ag04_first_evidence", f"WITH {with_sql('claim', 'evidence')} SELECT c.claim, min(e.evidence) AS evidence, arg_min(e.locator, e.evidence) AS locator FROM claim c JOIN evidence e ON {_SUPPORT} GROUP BY 1")
def ag04(spark, d):
    s = claim(spark, d).select("claim", *_RECORD).join(filters.support(evidence(spark, d)), _RECORD)
    return s.groupBy("claim").agg(F.min("evidence").alias("evidence"), F.min_by("locator", "evidence").alias("locator"))


_EVAL = f"""h AS (SELECT entity, cond, bool_or({HOLDS_SQL}) AS ok, min(CASE WHEN {HOLDS_SQL} THEN claim END) AS best FROM claim JOIN cond c USING (trait) WHERE {_GUARD} GROUP BY 1, 2),
p AS (SELECT entity, count(*) AS present, count(*) FILTER (ok) AS met, min(best) AS best FROM h GROUP BY 1),
ev AS (SELECT e.entity, e.name, coalesce(present, 0) = 3 AS evaluable, coalesce(met, 0) = 3 AS matched, CASE WHEN met = 3 THEN best END AS best FROM ok e LEFT JOIN p USING (entity)),
cov AS (SELECT count(*)::BIGINT AS scoped, count(*) FILTER (evaluable)::BIGINT AS evaluable, count(*) FILTER (evaluable AND matched)::BIGINT AS matched FROM ev)"""
_OKE = "ok AS (SELECT * FROM entity WHERE policy_status = 'allowed' AND release = 'r1')"


def _ok(spark, d):
    return entity(spark, d).filter("policy_status = 'allowed' AND release = 'r1'")


@query("ag05_condition_coverage", f"WITH {with_sql('claim', 'entity')}, {CONDITIONS_SQL}, {_OKE}, {_EVAL} SELECT entity, evaluable, matched, best FROM ev")
def ag05(spark, d):
    return questions.evaluate_conditions(_ok(spark, d), claim(spark, d).filter(filters.claim_guard()), conditions(spark, d))


@query("q05_taxon_traits", f"WITH {with_sql('claim', 'entity')}, {CONDITIONS_SQL}, {_OKE}, {_EVAL} SELECT t.*, cov.*, CASE WHEN cov.matched > 0 THEN 'answer' WHEN cov.evaluable > 0 THEN 'empty' ELSE 'insufficient_data' END AS status FROM (SELECT entity, name, best FROM ev WHERE matched ORDER BY name, entity LIMIT 20) t, cov")
def q05(spark, d):
    return questions.trait_answer(_ok(spark, d), claim(spark, d).filter(filters.claim_guard()), conditions(spark, d))


_PAIRS = "SELECT a.p_partkey AS a, a.p_partkey * 7 % (SELECT max(p_partkey) FROM part) + 1 AS b FROM part a"


@query("jn22_common_ancestor", f"WITH pr AS ({_PAIRS}) SELECT 'p' || pr.a AS a, 'p' || pr.b AS b, CASE WHEN pr.a = pr.b THEN 'p' || pr.a WHEN x.p_brand = y.p_brand THEN x.p_type || '|' || x.p_brand ELSE x.p_type END AS ancestor, CASE WHEN pr.a = pr.b THEN 0 WHEN x.p_brand = y.p_brand THEN 2 ELSE 4 END AS distance FROM pr JOIN part x ON x.p_partkey = pr.a JOIN part y ON y.p_partkey = pr.b WHERE x.p_type = y.p_type")
def jn22(spark, d):
    p = table(spark, d, "part")
    top = p.agg(F.max("p_partkey").alias("m"))
    pr = p.crossJoin(top).select(F.concat(F.lit("p"), "p_partkey").alias("a"), F.concat(F.lit("p"), F.col("p_partkey") * 7 % F.col("m") + 1).alias("b"))
    return hierarchy.common_ancestor(pr, edges(spark, d), 2)


@query("q01_common_taxonomy", f"WITH pr AS ({_PAIRS}) SELECT pr.a, pr.b, CASE WHEN pr.a = pr.b THEN 'same' WHEN x.p_partkey IS NULL OR y.p_partkey IS NULL THEN 'out_of_scope' WHEN x.p_type <> y.p_type THEN 'none' WHEN x.p_brand = y.p_brand THEN 'genus' ELSE 'order' END AS status FROM pr LEFT JOIN part x ON x.p_partkey = pr.a LEFT JOIN part y ON y.p_partkey = pr.b")
def q01(spark, d):
    p = table(spark, d, "part")
    pr = p.crossJoin(p.agg(F.max("p_partkey").alias("m"))).select(F.col("p_partkey").alias("a"), (F.col("p_partkey") * 7 % F.col("m") + 1).alias("b"))
    side = lambda c: p.select(F.col("p_partkey").alias(c), F.col("p_type").alias(f"t_{c}"), F.col("p_brand").alias(f"b_{c}"))
    j = pr.join(side("a"), "a", "left").join(side("b"), "b", "left")
    status = F.when(F.col("a") == F.col("b"), "same").when(F.col("t_a").isNull() | F.col("t_b").isNull(), "out_of_scope").when(F.col("t_a") != F.col("t_b"), "none").when(F.col("b_a") == F.col("b_b"), "genus").otherwise("order")
    return j.select("a", "b", status.alias("status"))


@query("q02_same_genus", f"""WITH {with_sql('entity')}, x AS (SELECT a.entity AS origin, b.entity AS peer, b.name, row_number() OVER (PARTITION BY a.entity ORDER BY b.name, b.entity) AS rank, count(*) OVER (PARTITION BY a.entity) > 20 AS has_more FROM entity a JOIN entity b ON a.genus = b.genus AND a.entity <> b.entity WHERE b.policy_status = 'allowed' AND b.entity % 3 <> 0) SELECT * FROM x WHERE rank <= 20""")
def q02(spark, d):
    """Every entity with the first 20 allowed peers of its genus; a genus' first 22 hold them and tell whether there are more."""
    e = entity(spark, d)
    ok = e.filter("policy_status = 'allowed' AND entity % 3 <> 0 AND genus is not null").select("genus", F.col("entity").alias("peer"), "name")
    first = hierarchy.top_per_group(ok, ["genus"], [F.col("name"), F.col("peer")], 22).drop("rank", "has_more")
    x = e.select(F.col("entity").alias("origin"), "genus").join(first, "genus").filter("origin <> peer").select("origin", "peer", "name")
    return hierarchy.top_per_group(x, ["origin"], [F.col("name"), F.col("peer")], 20)


_SHARE = "sh AS (SELECT l_partkey AS entity, 100.0 * sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) / sum(l_quantity) AS share FROM lineitem GROUP BY 1)"


def _share(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("entity"))
    return li.agg((100.0 * F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))) / F.sum("l_quantity")).alias("share"))


@query("q03_order_share_ranking", f"""WITH {with_sql('entity')}, {_SHARE}, x AS (SELECT "order", entity, round(share, 6) AS share, row_number() OVER (PARTITION BY "order" ORDER BY round(share, 6) DESC, entity) AS rank FROM entity JOIN sh USING (entity) WHERE share > 0 AND share <= 100 AND policy_status = 'allowed') SELECT * FROM x WHERE rank <= 20""")
def q03(spark, d):
    x = entity(spark, d).filter("policy_status = 'allowed'").join(_share(spark, d).filter("share > 0 and share <= 100"), "entity").select("order", "entity", F.round("share", 6).alias("share"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("order").orderBy(F.desc("share"), "entity")).cast("long")).filter("rank <= 20")


@query("tk04_share_order", f"WITH {_SHARE} SELECT entity, round(share, 6) AS share FROM sh WHERE share > 0 ORDER BY round(share, 6) DESC, entity LIMIT 50")
def tk04(spark, d):
    return _share(spark, d).filter("share > 0").select("entity", F.round("share", 6).alias("share")).orderBy(F.desc("share"), "entity").limit(50)


_PEERS = f"""o AS (SELECT c.* FROM claim c WHERE c.entity % 20 = 0 AND c.value_text IS NOT NULL), pe AS (SELECT DISTINCT o.entity AS origin, o.trait, o.value_text, p.entity AS peer FROM o JOIN claim p ON p.trait = o.trait AND p.value_text = o.value_text AND p.dataset = o.dataset AND p.entity <> o.entity)"""


@query("jn20_category_peers", f"WITH {with_sql('claim')}, {_PEERS} SELECT origin, trait, value_text, count(*)::BIGINT AS peers FROM pe GROUP BY 1, 2, 3")
def jn20(spark, d):
    c = claim(spark, d)
    return questions.category_counts(c, c.filter(_QUERY_SET))


@query("jn21_habitat_not_diet", f"WITH {with_sql('claim')}, {_PEERS} SELECT h.origin, h.peer, dt.peer IS NOT NULL AS same_diet FROM pe h LEFT JOIN pe dt ON dt.trait = 'diet' AND dt.origin = h.origin AND dt.peer = h.peer WHERE h.trait = 'habitat'")
def jn21(spark, d):
    c = claim(spark, d)
    return questions.peers_sharing(c, c.filter(_QUERY_SET), "habitat", "diet").withColumnRenamed("same", "same_diet")


@query("q04_habitat_same_diet", f"""WITH {with_sql('claim', 'entity')}, o AS (SELECT DISTINCT entity FROM claim WHERE entity % 20 = 0), h AS (SELECT DISTINCT entity, value_text AS v, dataset FROM claim WHERE trait = 'habitat' AND value_text IS NOT NULL), dt AS (SELECT DISTINCT entity, value_text AS v, dataset FROM claim WHERE trait = 'diet' AND value_text IS NOT NULL),
ph AS (SELECT DISTINCT a.entity AS origin, b.entity AS peer FROM o JOIN h a USING (entity) JOIN h b ON b.v = a.v AND b.dataset = a.dataset AND b.entity <> a.entity), pd AS (SELECT DISTINCT a.entity AS origin, b.entity AS peer FROM o JOIN dt a USING (entity) JOIN dt b ON b.v = a.v AND b.dataset = a.dataset AND b.entity <> a.entity),
x AS (SELECT 'same_niche' AS variant, ph.* FROM ph JOIN pd USING (origin, peer) UNION ALL SELECT 'other_niche', ph.* FROM ph ANTI JOIN pd USING (origin, peer) WHERE origin IN (SELECT entity FROM dt) UNION ALL SELECT 'same_diet', pd.* FROM pd),
r AS (SELECT x.*, e.name, row_number() OVER (PARTITION BY variant, origin ORDER BY e.name, peer) AS rank, count(*) OVER (PARTITION BY variant, origin) > 20 AS has_more FROM x JOIN entity e ON e.entity = x.peer) SELECT * FROM r WHERE rank <= 20""")  # fmt: skip
def q04(spark, d):
    c = claim(spark, d)
    return questions.habitat_diet(c, entity(spark, d), c.filter(_QUERY_SET).select("entity").distinct(), 20)


@query("q07_related_species", f"""WITH {with_sql('entity')}, o AS ({_ORIGINS}), x AS (SELECT a.entity AS origin, b.entity AS peer, CASE WHEN a.genus = b.genus THEN 'genus' ELSE 'order' END AS relation FROM entity a JOIN o USING (entity) JOIN entity b ON a."order" = b."order" AND a.entity <> b.entity), y AS (SELECT *, row_number() OVER (PARTITION BY origin, relation ORDER BY peer) AS rank, count(*) OVER (PARTITION BY origin, relation) > 12 AS has_more FROM x) SELECT * FROM y WHERE rank <= 12""")
def q07(spark, d):
    e = entity(spark, d)
    return questions.related(e, e.filter(_QUERY_SET), 12)


@query("q08_ecological_relations", f"WITH {with_sql('claim')}, {_PEERS}, y AS (SELECT *, row_number() OVER (PARTITION BY origin, trait, value_text ORDER BY peer) AS rank, count(*) OVER (PARTITION BY origin, trait, value_text) > 3 AS has_more FROM pe) SELECT * FROM y WHERE rank <= 3")
def q08(spark, d):
    c = claim(spark, d)
    return questions.first_category_peers(c, c.filter(_QUERY_SET), 3)


@query("wn04_top_per_group", """WITH y AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) > 3 AS has_more FROM orders) SELECT * FROM y WHERE rank <= 3""")
def wn04(spark, d):
    return hierarchy.top_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


_SIM = """o AS (SELECT * FROM entity WHERE entity % 20 = 0), pool AS (SELECT o.entity AS origin, b.entity AS peer, CASE WHEN b.entity % 4 = 0 THEN NULL ELSE b.entity % 5 END AS depth, o."order" = b."order" AS f, o.genus = b.genus AS g, o.entity % 3 = b.entity % 3 AS h, o.entity % 2 = b.entity % 2 AS di FROM o JOIN entity b ON o."order" = b."order" AND o.entity <> b.entity),
lv AS (SELECT *, CASE WHEN depth IS NOT NULL THEN dense_rank() OVER (PARTITION BY origin, depth IS NULL ORDER BY depth) END AS level FROM pool),
sc AS (SELECT origin, peer, CASE WHEN level IS NULL THEN 2.0 * ((CASE WHEN f THEN 10 ELSE 0 END) + (CASE WHEN f AND g THEN 20 ELSE 0 END) + (CASE WHEN h THEN 10 ELSE 0 END) + (CASE WHEN di THEN 10 ELSE 0 END)) ELSE (CASE WHEN f THEN 10 ELSE 0 END) + (CASE WHEN f AND g THEN 20 ELSE 0 END) + (CASE WHEN h THEN 10 ELSE 0 END) + (CASE WHEN di THEN 10 ELSE 0 END) + round_even(50.0::DOUBLE * level / max(level) OVER (PARTITION BY origin), 1) END::DOUBLE AS score FROM lv),
rk AS (SELECT origin, peer, score, row_number() OVER (PARTITION BY origin ORDER BY score DESC, peer) AS rank FROM sc WHERE score > 0)"""


def _similar(spark, d, k, within=None):
    i = F.col("entity")
    e = entity(spark, d).withColumns({"habitat": i % 3, "diet": i % 2, "depth": F.when(i % 4 != 0, i % 5), "named": i % 3 == 0})
    return questions.similarity(e, e.filter(_QUERY_SET), k, within)


@query("q09_similar_species", f"WITH {with_sql('entity')}, {_SIM} SELECT * FROM rk WHERE rank <= 20")
def q09(spark, d):
    return _similar(spark, d, 20)


@query("tk05_score_order", f"WITH {with_sql('entity')}, {_SIM} SELECT origin, peer, score FROM rk WHERE rank <= 5")
def tk05(spark, d):
    return _similar(spark, d, 5).select("origin", "peer", "score")


@query("tk03_priority_fill", f"WITH {with_sql('entity')}, {_SIM}, n AS (SELECT *, peer % 3 = 0 AS named FROM rk), p AS (SELECT *, CASE WHEN named THEN 0 WHEN rank <= 3 THEN 1 END AS pri FROM n), f AS (SELECT origin, peer, score, row_number() OVER (PARTITION BY origin ORDER BY pri, rank) AS place FROM p WHERE pri IS NOT NULL) SELECT * FROM f WHERE place <= 3")
def tk03(spark, d):
    """Named peers come first; the three best of each kind tell who is among the three best of all."""
    p = _similar(spark, d, 3, "named")
    of_all = F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("score"), "peer"))
    p = p.withColumn("rank", of_all).withColumn("pri", F.when(F.col("named"), 0).when(F.col("rank") <= 3, 1)).filter("pri is not null")
    return p.select("origin", "peer", "score", F.row_number().over(Window.partitionBy("origin").orderBy("pri", "rank")).cast("long").alias("place")).filter("place <= 3")


@query("wn03_ordinal_closeness", f"WITH {with_sql('entity')}, {_SIM} SELECT origin, level, max(level) OVER (PARTITION BY origin) AS levels, count(*)::BIGINT AS n FROM lv WHERE level IS NOT NULL GROUP BY origin, level")
def wn03(spark, d):
    i = F.col("entity")
    e = entity(spark, d).withColumn("depth", F.when(i % 4 != 0, i % 5))
    return questions.closeness_levels(e, e.filter(_QUERY_SET))


@query("wn01_forward_fill", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations")
def wn01(spark, d):
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", hierarchy.forward_fill(t, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("text"))).alias("last_user"))


@query("wn05_ordinals", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
n AS (SELECT *, sum((length(l) < 60)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS section FROM l WHERE trim(l) <> '')
SELECT doc_id * 1000000 + pos AS line, doc_id, section, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ordinal, row_number() OVER (PARTITION BY doc_id, section ORDER BY pos) AS in_section FROM n""")  # fmt: skip
def wn05(spark, d):
    """Short lines begin a section; lines are counted within the document and within their section."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "l")).filter(F.trim("l") != "")
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = t.withColumn("section", F.sum(F.when(F.length("l") < 60, 1).otherwise(0)).over(w))
    t = t.withColumns({"ordinal": F.row_number().over(w).cast("long"), "in_section": F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("pos")).cast("long")})
    return t.select((F.col("doc_id") * 1000000 + F.col("pos") + 1).alias("line"), "doc_id", "section", "ordinal", "in_section")


@query("wn06_keep_first", f"WITH {with_sql('observation')} SELECT external_id, min(observation) AS observation, count(*)::BIGINT AS copies FROM observation GROUP BY 1")
def wn06(spark, d):
    o = observation(spark, d).select("external_id", "observation").withColumn("copies", F.count("*").over(Window.partitionBy("external_id")))
    return hierarchy.first_per_group(o, ["external_id"], [F.col("observation")])


@query("wn07_oldest_open_event", "SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type <> 'purchase' GROUP BY 1")
def wn07(spark, d):
    return hierarchy.first_per_group(table(spark, d, "events").filter("event_type <> 'purchase'").select("user_id", "event_id"), ["user_id"], [F.col("event_id")])


@query("wn09_version_chain", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS supersedes FROM orders")
def wn09(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("supersedes"))


@query("wn10_latest_citation", "SELECT l_partkey, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS orderkey FROM lineitem GROUP BY 1")
def wn10(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("orderkey"))


# --- reconciliation ----------------------------------------------------------------------------------------------


@query("jn01_exact_names", "WITH t AS (SELECT p_name, count(DISTINCT p_partkey % 97) AS n, min(p_partkey % 97) AS target FROM part GROUP BY 1), s AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'no such name' ELSE p_name END AS p_name FROM part) SELECT s.p_partkey, s.p_name, CASE WHEN t.n = 1 THEN t.target END AS target, CASE WHEN t.n IS NULL THEN 'not_found' WHEN t.n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM s LEFT JOIN t USING (p_name)")
def jn01(spark, d):
    p = table(spark, d, "part")
    s = p.select("p_partkey", F.when(F.col("p_partkey") % 6 == 0, "no such name").otherwise(F.col("p_name")).alias("p_name"))
    return reconcile.exact_match(s, p.select("p_name", (F.col("p_partkey") % 97).alias("target")), "p_name", "p_partkey", "target")


_XS = "s AS (SELECT c_custkey AS source_id, c_name AS source_name, CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 10 = 1 THEN 'K' || (c_custkey // 100) ELSE ' K' || c_custkey END AS k FROM customer), t AS (SELECT o_custkey AS target_id, CASE WHEN o_custkey % 4 = 0 THEN 'Customer x' || o_custkey WHEN o_custkey % 4 = 1 THEN (SELECT min(c_name) FROM customer) ELSE 'n' || o_custkey END AS target_name, 'k' || CASE WHEN o_custkey % 15 = 2 THEN o_custkey + 1 ELSE o_custkey END AS k FROM (SELECT DISTINCT o_custkey FROM orders))"
_XW = f"""{_XS}, sk AS (SELECT *, lower(trim(k)) AS key FROM s), tk AS (SELECT lower(trim(k)) AS key, count(*) AS t_n, min((target_id, target_name)) AS t FROM t GROUP BY 1), sn AS (SELECT key, count(*) AS s_n FROM sk GROUP BY 1), nm AS (SELECT source_name AS own_name, min(source_id) AS lo, max(source_id) AS hi FROM s GROUP BY 1),
j AS (SELECT sk.source_id, sk.source_name, CASE WHEN sk.key = '' THEN 'no_key' WHEN s_n > 1 THEN 'duplicate_source_key' WHEN t_n IS NULL THEN 'not_found' WHEN t_n > 1 THEN 'duplicate_target_key' WHEN own_name IS NOT NULL AND (lo <> source_id OR hi <> source_id) AND source_name <> own_name THEN 'name_conflict' ELSE 'accepted' END AS reason, t[1] AS tid FROM sk LEFT JOIN sn USING (key) LEFT JOIN tk USING (key) LEFT JOIN nm ON nm.own_name = t[2]), xw AS (SELECT source_id, source_name, reason, CASE WHEN reason = 'accepted' THEN tid END AS target_id FROM j)"""


def _crosswalk(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    i = F.col("c_custkey")
    s = c.select(i.alias("source_id"), F.col("c_name").alias("source_name"), F.when(i % 9 == 0, "").when(i % 10 == 1, F.concat(F.lit("K"), F.floor(i / 100).cast("string"))).otherwise(F.concat(F.lit(" K"), i.cast("string"))).alias("ck"))
    k = F.col("k")
    t = o.crossJoin(c.agg(F.min("c_name").alias("least"))).select(k.alias("target_id"), F.when(k % 4 == 0, F.concat(F.lit("Customer x"), k.cast("string"))).when(k % 4 == 1, F.col("least")).otherwise(F.concat(F.lit("n"), k.cast("string"))).alias("target_name"), F.concat(F.lit("k"), F.when(k % 15 == 2, k + 1).otherwise(k).cast("string")).alias("ck"))
    return reconcile.crosswalk(s, t, F.col("ck"), F.col("ck"))


@query("jn02_concept_crosswalk", f"WITH {_XW} SELECT * FROM xw")
def jn02(spark, d):
    return _crosswalk(spark, d)


@query("q14_crosswalk_summary", f"WITH {_XW} SELECT reason, count(*)::BIGINT AS n, count(DISTINCT target_id)::BIGINT AS targets FROM xw GROUP BY 1")
def q14(spark, d):
    return _crosswalk(spark, d).groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("target_id").alias("targets"))


@query("jn04_demoted_conflicts", "WITH m AS (SELECT p_partkey AS source_id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_partkey // 2 END AS target_id, CASE WHEN p_size % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS status FROM part) SELECT source_id, target_id, CASE WHEN status = 'accepted' AND count(*) FILTER (status = 'accepted') OVER (PARTITION BY target_id) > 1 THEN 'review' ELSE status END AS status FROM m")
def jn04(spark, d):
    p = table(spark, d, "part")
    ok = F.col("p_size") % 3 != 0
    return reconcile.demote_conflicts(p.select(F.col("p_partkey").alias("source_id"), F.when(ok, F.floor(F.col("p_partkey") / 2)).alias("target_id"), F.when(ok, "accepted").otherwise("rejected").alias("status")))


@query("jn05_gap_fill", f"WITH {_XW}, rest AS (SELECT o_custkey AS target_id, min(o_orderkey) AS source_id FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 HAVING count(*) = 1) SELECT * FROM rest WHERE target_id NOT IN (SELECT target_id FROM xw WHERE target_id IS NOT NULL)")
def jn05(spark, d):
    """Targets that the crosswalk leaves open are filled from urgent orders, where a target has one of them."""
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    once = reconcile.unique_only(urgent.select(F.col("o_custkey").alias("target_id"), F.col("o_orderkey").alias("source_id")), "target_id")
    return once.join(_crosswalk(spark, d).filter("target_id is not null").select("target_id"), "target_id", "left_anti")


@query("jn03_chained_crosswalk", """WITH s AS (SELECT p_partkey AS id, p_name || ' ' || p_size AS name FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_name || ' ' || p_size AS name, p_brand AS bridge, CASE WHEN p_partkey % 5 = 0 THEN '1:many' ELSE '1:1' END AS kind FROM part WHERE p_partkey % 2 = 1),
f AS (SELECT 'Brand#' || (s_suppkey % 20) AS bridge, s_suppkey AS concept, s_suppkey % 7 <> 0 AS accepted FROM supplier WHERE s_suppkey % 20 <> 3 AND s_suppkey < 60 AND (s_suppkey < 40 OR s_suppkey % 20 = 4)), t AS (SELECT o_custkey AS concept, count(*) AS n, min(o_orderkey) AS target FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
sn AS (SELECT name, count(*) AS n FROM s GROUP BY 1), bn AS (SELECT name, count(*) AS n, min(bridge) AS bridge, min(kind) AS kind FROM b GROUP BY 1), fn AS (SELECT bridge, count(*) FILTER (accepted) AS n, min(concept) FILTER (accepted) AS concept FROM f GROUP BY 1),
j AS (SELECT s.id, CASE WHEN sn.n > 1 THEN 'source_not_unique' WHEN bn.n IS NULL THEN 'no_bridge' WHEN bn.n > 1 THEN 'bridge_not_unique' WHEN bn.kind <> '1:1' THEN 'bridge_not_one_to_one' WHEN fn.n IS NULL THEN 'no_profile' WHEN fn.n = 0 THEN 'profile_rejected' WHEN fn.n > 1 THEN 'profile_not_unique' WHEN t.n IS NULL THEN 'no_target' WHEN t.n > 1 THEN 'target_not_unique' ELSE 'accepted' END AS reason, t.target
  FROM s JOIN sn USING (name) LEFT JOIN bn USING (name) LEFT JOIN fn ON fn.bridge = bn.bridge LEFT JOIN t ON t.concept = fn.concept)
SELECT id, reason, CASE WHEN reason = 'accepted' THEN target END AS target FROM j""")  # fmt: skip
def jn03(spark, d):
    """Names over bridges of type 1:1 to profiles to concepts to targets; each hop must be unique, and the first that fails gives the reason."""
    p, o = table(spark, d, "part"), table(spark, d, "orders")
    name = F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name")
    source = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), name)
    bridge = p.filter("p_partkey % 2 = 1").select(name, F.col("p_brand").alias("bridge"), F.when(F.col("p_partkey") % 5 == 0, "1:many").otherwise("1:1").alias("kind"))
    k = F.col("s_suppkey")
    profile = table(spark, d, "supplier").filter("s_suppkey % 20 <> 3 AND s_suppkey < 60 AND (s_suppkey < 40 OR s_suppkey % 20 = 4)").select(F.concat(F.lit("Brand#"), (k % 20).cast("string")).alias("bridge"), k.alias("concept"), (k % 7 != 0).alias("accepted"))
    target = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("concept"), F.col("o_orderkey").alias("target"))
    return reconcile.chained_crosswalk(source, bridge, profile, target)


@query("jn15_collected_matches", "WITH t AS (SELECT lower(p_name) AS k, list(DISTINCT p_size ORDER BY p_size) AS ids FROM part WHERE p_size <= 3 GROUP BY 1) SELECT p_partkey, coalesce(len(ids), 0)::INTEGER AS matches, CASE WHEN ids IS NULL THEN 'no_match' WHEN len(ids) = 1 THEN 'write' ELSE 'ambiguous' END AS outcome FROM part LEFT JOIN t ON t.k = lower(p_name)")
def jn15(spark, d):
    p = table(spark, d, "part")
    t = p.filter("p_size <= 3").groupBy(F.lower("p_name").alias("k")).agg(F.array_sort(F.collect_set("p_size")).alias("ids"))
    j = p.join(t, F.lower("p_name") == F.col("k"), "left")
    return j.select("p_partkey", F.coalesce(F.size("ids"), F.lit(0)).alias("matches"), F.when(F.col("ids").isNull(), "no_match").when(F.size("ids") == 1, "write").otherwise("ambiguous").alias("outcome"))


@query("jn27_candidate_routes", "WITH a AS (SELECT c.c_custkey AS source_id, s.s_suppkey AS target_id, 'nation' AS route FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey UNION ALL SELECT c_custkey, s_suppkey, 'key' FROM customer JOIN supplier ON c_custkey = s_suppkey) SELECT source_id, target_id, string_agg(DISTINCT route, ',' ORDER BY route) AS routes FROM a GROUP BY 1, 2")
def jn27(spark, d):
    side = lambda name, key, nation, alias: table(spark, d, name).select(F.col(key).alias(alias), F.col(nation).alias("nation"), F.col(key).alias("key"))
    return reconcile.keyed_routes(side("customer", "c_custkey", "c_nationkey", "source_id"), side("supplier", "s_suppkey", "s_nationkey", "target_id"), ("nation", "key"))


_NAMES = "n AS (SELECT p_type || '|' || p_brand AS entity, p_name AS label FROM part), r AS (SELECT DISTINCT * FROM n), a AS (SELECT entity FROM r GROUP BY 1 HAVING count(*) > 1), b AS (SELECT label FROM r GROUP BY 1 HAVING count(*) > 1)"


@query("ag18_label_conflicts", f"WITH {_NAMES}, x AS (SELECT entity, label, concat_ws('+', CASE WHEN entity IN (SELECT entity FROM a) THEN 'many_labels' END, CASE WHEN label IN (SELECT label FROM b) THEN 'many_entities' END) AS kind FROM r) SELECT * FROM x WHERE kind <> ''")
def ag18(spark, d):
    return reconcile.label_conflicts(table(spark, d, "part").select(F.concat_ws("|", "p_type", "p_brand").alias("entity"), F.col("p_name").alias("label")))


@query("q16_name_consensus", "WITH x AS (SELECT p_type || '|' || p_brand AS entity, 's' || (p_partkey % 3) AS source, lower(p_name) AS label FROM part), p AS (SELECT entity, source, count(DISTINCT label) AS k, min(label) AS label FROM x GROUP BY 1, 2) SELECT entity, count(*) FILTER (k = 1)::BIGINT AS clean_sources, count(DISTINCT CASE WHEN k = 1 THEN label END)::BIGINT AS labels, CASE WHEN count(*) FILTER (k = 1) = 0 THEN 'excluded' WHEN count(DISTINCT CASE WHEN k = 1 THEN label END) > 1 THEN 'conflict' ELSE 'accepted' END AS status FROM p GROUP BY 1")
def q16(spark, d):
    x = table(spark, d, "part").select(F.concat_ws("|", "p_type", "p_brand").alias("entity"), F.concat(F.lit("s"), (F.col("p_partkey") % 3).cast("string")).alias("source"), F.lower("p_name").alias("label"))
    p = x.groupBy("entity", "source").agg(F.count_distinct("label").alias("k"), F.min("label").alias("label"))
    one = F.when(F.col("k") == 1, F.col("label"))
    g = p.groupBy("entity").agg(F.count(one).alias("clean_sources"), F.count_distinct(one).alias("labels"))
    return g.withColumn("status", F.when(F.col("clean_sources") == 0, "excluded").when(F.col("labels") > 1, "conflict").otherwise("accepted"))


@query("snk01_upsert", "SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0) o FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice * 2 END AS v FROM orders WHERE o_orderkey % 2 = 0) n ON n.k = o.k")
def snk01(spark, d):
    o = table(spark, d, "orders")
    old = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") * 2).alias("v"))
    return reconcile.upsert(old, new, "k")


@query("set01_union", "SELECT count(*)::BIGINT AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def set01(spark, d):
    return table(spark, d, "customer").select("c_nationkey").union(table(spark, d, "supplier").select("s_nationkey")).distinct().agg(F.count("*").alias("n"))


@query("set02_equality", "SELECT NOT EXISTS (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem) AND NOT EXISTS (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part) AS equal")
def set02(spark, d):
    a, b = table(spark, d, "part").select(F.col("p_partkey").alias("k")).distinct(), table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).distinct()
    return reconcile.set_difference(a, b).agg((F.count("*") == 0).alias("equal"))


@query("set03_two_way_difference", "WITH o AS (SELECT DISTINCT o_custkey + 7 AS k FROM orders) SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT k FROM o) UNION ALL SELECT k, 'right' FROM o WHERE k NOT IN (SELECT c_custkey FROM customer)")
def set03(spark, d):
    """Keys of customers against those of orders, which are moved, so that either side has some of its own."""
    return reconcile.set_difference(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select((F.col("o_custkey") + 7).alias("k")).distinct())


@query("set04_intersection", "SELECT p_type, count(*)::BIGINT AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N') GROUP BY 1")
def set04(spark, d):
    li = table(spark, d, "lineitem")
    both = li.filter("l_returnflag = 'R'").select("l_partkey").intersect(li.filter("l_returnflag = 'N'").select("l_partkey"))
    return table(spark, d, "part").join(both, F.col("p_partkey") == F.col("l_partkey"), "left_semi").groupBy("p_type").agg(F.count("*").alias("n"))


@query("set05_merged_inventories", "SELECT coalesce(a.k, b.k) AS k, concat_ws('; ', a.t, b.t) AS note FROM (SELECT p_brand AS k, 'parts ' || count(*) AS t FROM part WHERE p_size < 25 GROUP BY 1) a FULL JOIN (SELECT p_brand AS k, 'types ' || count(DISTINCT p_type) AS t FROM part WHERE p_size > 45 GROUP BY 1) b USING (k)")
def set05(spark, d):
    p = table(spark, d, "part")
    a = p.filter("p_size < 25").groupBy(F.col("p_brand").alias("k")).agg(F.concat(F.lit("parts "), F.count("*").cast("string")).alias("a"))
    b = p.filter("p_size > 45").groupBy(F.col("p_brand").alias("k")).agg(F.concat(F.lit("types "), F.count_distinct("p_type").cast("string")).alias("b"))
    return a.join(b, "k", "full").select("k", F.concat_ws("; ", "a", "b").alias("note"))


@query("set06_stale_keys", "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01')")
def set06(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("k")).distinct().join(li.filter(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp")).select(F.col("l_partkey").alias("k")), "k", "left_anti")


@query("set07_known_ids", "SELECT count(*)::BIGINT AS n FROM (SELECT c_custkey AS id FROM customer UNION SELECT s_suppkey FROM supplier UNION SELECT p_partkey FROM part)")
def set07(spark, d):
    ids = [table(spark, d, t).select(F.col(c).alias("id")) for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))]
    return ids[0].unionByName(ids[1]).unionByName(ids[2]).distinct().agg(F.count("*").alias("n"))


@query("tk01_named_first", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name END AS local, p_name FROM part ORDER BY local IS NULL, coalesce(local, p_name), p_partkey LIMIT 20")
def tk01(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("local"), "p_name")
    return p.orderBy(F.col("local").isNull(), F.coalesce("local", "p_name"), "p_partkey").limit(20)


@query("tk02_pages", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50")
def tk02(spark, d):
    return table(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").offset(50).limit(25)


@query("ag22_sample_statistics", "SELECT p_type, round(avg(p_retailprice::DECIMAL(18, 2))::DECIMAL(18, 6), 2)::DOUBLE AS mean, min(p_retailprice) AS least, max(p_retailprice) AS most, count(*)::BIGINT AS n FROM part GROUP BY 1")
def ag22(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.round(F.avg(F.col("p_retailprice").cast("decimal(18,2)")), 2).cast("double").alias("mean"), F.min("p_retailprice").alias("least"), F.max("p_retailprice").alias("most"), F.count("*").alias("n"))
