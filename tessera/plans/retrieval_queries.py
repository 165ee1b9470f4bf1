"""Queries over text, vectors, aggregates, profiles and observations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalars as S
from tessera.operators import digests, evaluation, hierarchy, pairs, policy, retrieval

from .policy_queries import _LIC, _OK_DOC, _U
from .registry import query
from .stand_ins import chunk, claim, document, entity, observation, table, with_sql

# --- text and vectors --------------------------------------------------------------------------------------------

_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_BM = f"""ch AS (SELECT doc_id AS id, text FROM documents), qs AS (SELECT item_id AS query, text FROM benchmark),
t AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest({_TOK}) AS token FROM ch) GROUP BY 1, 2), q AS (SELECT DISTINCT query, unnest({_TOK}) AS token FROM qs),
size AS (SELECT id, sum(tf) AS dl FROM t GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM size), df AS (SELECT token, count(*) AS df FROM t GROUP BY 1),
w AS (SELECT t.id, t.token, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS w FROM t JOIN df USING (token) JOIN size USING (id), st WHERE t.token IN (SELECT token FROM q)),
sc AS (SELECT query, id, round(sum(w), 6) AS score FROM q JOIN w USING (token) GROUP BY 1, 2), bm AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sc)"""


def _bm25(spark, d, k=5):
    return retrieval.bm25(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text"), k)


@query("txt01_full_text_top_k", f"WITH {_BM} SELECT query, id, rank FROM bm WHERE rank <= 3")
def txt01(spark, d):
    return _bm25(spark, d, 3).select("query", "id", "rank")


@query("wn02_reciprocal_ranks", f"WITH {_BM} SELECT query, id, round(1.0::DOUBLE / rank, 9) AS rr FROM bm WHERE rank <= 5")
def wn02(spark, d):
    return _bm25(spark, d).select("query", "id", F.round(1.0 / F.col("rank"), 9).alias("rr"))


_REL = "rel AS (SELECT DISTINCT b.item_id AS query, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), forb AS (SELECT doc_id AS id FROM labels WHERE toxic = 1)"


def _relevant(spark, d):
    """Pairs where the item's text stands in the document."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("q"))
    return retrieval.containing(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), b)


@query("ag11_search_metrics", f"WITH {_BM}, {_REL}, top AS (SELECT * FROM bm WHERE rank <= 5), per AS (SELECT r.query, count(*) AS rel, count(t.id) AS hits, min(t.rank) AS first FROM rel r LEFT JOIN top t ON t.query = r.query AND t.id = r.id GROUP BY 1) SELECT round(sum(hits)::DOUBLE / sum(rel), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, NOT EXISTS (SELECT 1 FROM top WHERE id IN (SELECT id FROM forb)) AS policy_safe, (SELECT count(*) FROM qs)::BIGINT AS queries FROM per")
def ag11(spark, d):
    forbidden = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return retrieval.search_metrics(_bm25(spark, d), _relevant(spark, d), forbidden, table(spark, d, "benchmark"), 5)


_COS = "c AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0{}), cv AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM c)"


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label"), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))


@query("txt02_vector_top_k", f"WITH {_COS.format('')} SELECT query, id, rank FROM cv WHERE rank <= 3")
def txt02(spark, d):
    v, q = _vectors(spark, d)
    return retrieval.cosine_top_k(v.filter(S.vector_issue(F.col("v"), 64).isNull()), q, 3).select("query", "id", "rank")


@query("txt03_scoped_cosine", f"WITH {_COS.format(' AND v.label < 5')} SELECT query, id, rank FROM cv WHERE rank <= 3")
def txt03(spark, d):
    v, q = _vectors(spark, d)
    return retrieval.cosine_top_k(v.filter("label < 5"), q, 3).select("query", "id", "rank")


@query("txt04_score_convention", f"WITH {_COS.format('')} SELECT query, id, round(least(greatest(2 * round((1 + score) / 2, 6) - 1, -1), 1), 5) AS cosine FROM cv WHERE rank <= 3")
def txt04(spark, d):
    v, q = _vectors(spark, d)
    # Spark's round() takes the exact binary value, which may lie just under a half of the sixth place: 3,714 of the 2,000,001 possible scores.
    half_up = F.floor((1 + F.col("score")) / 2 * 1e6 + 0.5) / 1e6
    return retrieval.cosine_top_k(v, q, 3).select("query", "id", F.round(F.least(F.greatest(2 * half_up - 1, F.lit(-1.0)), F.lit(1.0)), 5).alias("cosine"))


_FUSE = "rk AS (SELECT query, 'text' AS channel, id, rank FROM bm WHERE rank <= 5 UNION ALL SELECT query * 0 + (SELECT min(item_id) FROM benchmark) + query // 20, 'vector', id, rank FROM cv WHERE rank <= 5), fu AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(channel, '+' ORDER BY channel) AS channels FROM rk GROUP BY 1, 2)"


def _rankings(spark, d):
    v, q = _vectors(spark, d)
    vec = retrieval.cosine_top_k(v, q, 5).crossJoin(table(spark, d, "benchmark").agg(F.min("item_id").alias("m")))
    return _bm25(spark, d).select("query", F.lit("text").alias("channel"), "id", "rank").unionByName(vec.select((F.col("m") + F.floor(F.col("query") / 20)).alias("query"), F.lit("vector").alias("channel"), "id", "rank"))


@query("txt05_rank_fusion", f"WITH {_BM}, {_COS.format('')}, {_FUSE} SELECT * FROM fu")
def txt05(spark, d):
    return retrieval.fuse(_rankings(spark, d))


@query("tk06_fused_order", f"WITH {_BM}, {_COS.format('')}, {_FUSE} SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS n FROM fu) WHERE n <= 3")
def tk06(spark, d):
    return retrieval.top_k(retrieval.fuse(_rankings(spark, d)), 3).select("query", "id", "score")


@query("txt06_hybrid_search", f"WITH {_BM}, {_COS.format('')}, rk0 AS (SELECT query, 'text' AS channel, id, rank FROM bm WHERE rank <= 5 UNION ALL SELECT (SELECT min(item_id) FROM benchmark) + query // 20, 'vector', id, rank FROM cv WHERE rank <= 5), ok AS (SELECT rk0.* FROM rk0 JOIN (WITH {with_sql('document')} SELECT * FROM document) d ON d.document = rk0.id WHERE d.policy_status = 'allowed' AND (channel = 'text' OR d.embedding_allowed)), rk AS (SELECT query, channel, id, row_number() OVER (PARTITION BY query, channel ORDER BY rank, id) AS rank FROM ok) SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(channel, '+' ORDER BY channel) AS channels FROM rk GROUP BY 1, 2")
def txt06(spark, d):
    ok = document(spark, d).filter("policy_status = 'allowed'").select(F.col("document").alias("id"), "embedding_allowed")
    kept = _rankings(spark, d).join(ok, "id").filter("channel = 'text' OR embedding_allowed")
    again = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query", "channel").orderBy("rank", "id")))
    return retrieval.fuse(again)


@query("txt10_prototype_labels", "WITH p AS (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY 1), s AS (SELECT v.vec_id AS id, p.label, round(list_inner_product(v.embedding::DOUBLE[], p.q::DOUBLE[]) / (sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_inner_product(p.q::DOUBLE[], p.q::DOUBLE[]))), 6) AS score FROM embeddings v, p), r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY id ORDER BY score DESC, label)) SELECT id, CASE WHEN score >= 0.5 AND round(score - next, 6) >= 0.05 THEN label END AS label FROM r WHERE n = 1")
def txt10(spark, d):
    v, _ = _vectors(spark, d)
    proto = v.groupBy("label").agg(F.min_by("v", "id").alias("q"))
    return retrieval.prototype_labels(v.drop("label"), proto, 0.5, 0.05).select("id", "label")


@query("wn08_winner_and_margin", "WITH g AS (SELECT l_partkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS n, lead(q) OVER w AS next FROM g WINDOW w AS (PARTITION BY l_partkey ORDER BY q DESC, l_returnflag)) SELECT l_partkey, l_returnflag AS winner, q - coalesce(next, 0) AS margin FROM r WHERE n = 1")
def wn08(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("l_partkey").orderBy(F.desc("q"), "l_returnflag")
    return g.withColumns({"n": F.row_number().over(w), "next": F.lead("q").over(w)}).filter("n = 1").select("l_partkey", F.col("l_returnflag").alias("winner"), (F.col("q") - F.coalesce("next", F.lit(0.0))).alias("margin"))


@query("txt11_nearest_examples", f"WITH {_COS.format(' AND v.vec_id % 20 <> 0')} SELECT query, id, rank FROM cv WHERE rank <= 5")
def txt11(spark, d):
    v, q = _vectors(spark, d)
    return retrieval.cosine_top_k(v.filter("id % 20 <> 0"), q, 5).select("query", "id", "rank")


# --- joins over documents, observations and profiles -------------------------------------------------------------


@query("jn17_observation_join", f"WITH {with_sql('observation')}, n AS (SELECT *, {_U} AS u FROM observation) SELECT n.observation, c.c_name AS name, n.place, CASE WHEN {_LIC} IS NOT NULL THEN u END AS media_licence FROM n JOIN customer c ON c.c_custkey = n.entity")
def jn17(spark, d):
    o = observation(spark, d).withColumn("media_licence", S.licence_uri(F.col("licence")))
    return o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name")), "entity").select("observation", "name", "place", "media_licence")


@query("jn18_policy_recheck", f"WITH {with_sql('document', 'chunk')} SELECT c.chunk, d.source, d.lang FROM chunk c JOIN document d ON d.document = c.document WHERE c.policy_status = 'allowed' AND {_OK_DOC}")
def jn18(spark, d):
    return policy.allowed_chunks(chunk(spark, d), document(spark, d)).select("chunk", "source", "lang")


@query("jn19_citations", "SELECT l.l_orderkey, l.l_linenumber, coalesce(s.s_name, 'unknown') AS source, n.n_name AS licence FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey")
def jn19(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    j = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return j.select("l_orderkey", "l_linenumber", F.coalesce("s_name", F.lit("unknown")).alias("source"), F.col("n_name").alias("licence"))


@query("jn14_rank_name_candidates", "SELECT a.p_partkey AS a, b.p_partkey AS b, 'candidate' AS status FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_type = b.p_type WHERE a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1")
def jn14(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    x = pairs.block_pairs(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 2 = 1"), ["p_name", "p_type"])
    return x.select(F.col("l.p_partkey").alias("a"), F.col("r.p_partkey").alias("b"), F.lit("candidate").alias("status"))


@query("jn16_recovered_traits", f"WITH {with_sql('claim')}, own AS (SELECT DISTINCT entity, trait FROM claim WHERE inferred = false) SELECT c.entity, c.trait, c.dataset FROM claim c WHERE c.inferred IS NULL AND NOT EXISTS (SELECT 1 FROM own WHERE own.entity = c.entity AND own.trait = c.trait)")
def jn16(spark, d):
    c = claim(spark, d)
    return c.filter("inferred is null").join(c.filter("inferred = false").select("entity", "trait").distinct(), ["entity", "trait"], "left_anti").select("entity", "trait", "dataset")


@query("jn23_common_prefix_depth", """WITH pr AS (SELECT a.p_partkey AS a, b.p_partkey AS b, (a.p_type = b.p_type)::INTEGER + (a.p_type = b.p_type AND a.p_brand = b.p_brand)::INTEGER AS depth FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT depth, count(*)::BIGINT AS n FROM pr GROUP BY 1""")
def jn23(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.array("p_type", F.concat_ws("|", "p_type", "p_brand")).alias("path"))
    j = p.select(F.col("p_partkey").alias("a"), F.col("path").alias("x")).join(p.select((F.col("p_partkey") - 1).alias("a"), F.col("path").alias("y")), "a")
    same = F.zip_with("x", "y", lambda u, v: u.eqNullSafe(v))
    return j.groupBy(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int").alias("depth")).agg(F.count("*").alias("n"))


@query("jn25_children", "SELECT n.n_name AS parent, s.s_suppkey AS child, coalesce(CASE WHEN s.s_suppkey % 2 = 0 THEN s.s_name END, 'unnamed') AS name FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey")
def jn25(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("n_name").alias("parent"), F.col("s_suppkey").alias("child"), F.coalesce(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")), F.lit("unnamed")).alias("name"))


_REVIEWED = "CASE WHEN doc_id % 4 = 2 THEN text || '!' ELSE text END"


@query("jn26_reviewed_texts", f"""WITH r AS (SELECT doc_id, sha256({_REVIEWED}) AS hash, doc_id % 4 <> 1 AS done FROM documents WHERE doc_id % 4 <> 0)
SELECT d.doc_id, CASE WHEN r.hash IS NULL THEN 'missing' WHEN NOT done THEN 'pending' WHEN r.hash <> sha256(d.text) THEN 'stale' ELSE 'reviewed' END AS status FROM documents d LEFT JOIN r USING (doc_id)""")  # fmt: skip
def jn26(spark, d):
    t = table(spark, d, "documents")
    review = t.filter("doc_id % 4 <> 0").select("doc_id", F.sha2(F.expr(_REVIEWED), 256).alias("hash"), (F.col("doc_id") % 4 != 1).alias("done"))
    j = t.select("doc_id", F.sha2("text", 256).alias("now")).join(review, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("hash").isNull(), "missing").when(~F.col("done"), "pending").when(F.col("hash") != F.col("now"), "stale").otherwise("reviewed").alias("status"))


@query("q10_layered_profiles", f"WITH {with_sql('claim')}, l AS (SELECT *, CASE WHEN inferred = false THEN 1 WHEN inferred IS NULL THEN 2 ELSE 3 END AS layer FROM claim), r AS (SELECT *, row_number() OVER (PARTITION BY entity, trait ORDER BY layer, claim) AS n FROM l) SELECT entity, trait, layer, claim FROM r WHERE n = 1")
def q10(spark, d):
    c = claim(spark, d).withColumn("layer", F.when(F.col("inferred") == F.lit(False), 1).when(F.col("inferred").isNull(), 2).otherwise(3))
    return hierarchy.first_per_group(c, ["entity", "trait"], [F.col("layer"), F.col("claim")]).select("entity", "trait", "layer", "claim")


@query("q18_observation_search", f"WITH {with_sql('observation')}, n AS (SELECT *, {_U} AS u FROM observation) SELECT observation, entity, place, CASE WHEN sensitivity = 'public' THEN lat END::DOUBLE AS lat FROM n WHERE {_LIC} IS NOT NULL AND contains(lower(place), 'i') AND substr(event_date_raw, 1, 10) <= '2024-01-25' ORDER BY event_date_raw DESC, observation LIMIT 100 OFFSET 10")
def q18(spark, d):
    o = policy.masked_coordinates(observation(spark, d)).filter(S.licence_uri(F.col("licence")).isNotNull() & F.lower("place").contains("i") & (F.substring("event_date_raw", 1, 10) <= "2024-01-25"))
    return o.orderBy(F.desc("event_date_raw"), "observation").offset(10).limit(100).select("observation", "entity", "place", "lat")


@query("q24_before_after", "WITH b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1) SELECT CASE WHEN a.n IS NULL THEN 'lost' WHEN b.n IS NULL THEN 'new' WHEN a.n < b.n THEN 'less' ELSE 'kept' END AS change, count(*)::BIGINT AS n FROM b FULL JOIN a USING (o_custkey) GROUP BY 1")
def q24(spark, d):
    o, cut = table(spark, d, "orders"), F.lit("1996-01-01").cast("timestamp")
    n = lambda c, name: o.filter(c).groupBy("o_custkey").agg(F.count("*").alias(name))
    j = n(F.col("o_orderdate") < cut, "b").join(n(F.col("o_orderdate") >= cut, "a"), "o_custkey", "full")
    return j.groupBy(F.when(F.col("a").isNull(), "lost").when(F.col("b").isNull(), "new").when(F.col("a") < F.col("b"), "less").otherwise("kept").alias("change")).agg(F.count("*").alias("n"))


@query("q22_coverage_audit", "SELECT CASE WHEN l.l_partkey IS NULL THEN 'no_evidence' WHEN p.p_partkey % 13 = 0 THEN 'denied' WHEN p.p_size > 40 THEN 'out_of_range' ELSE 'ok' END AS reason, p.p_type, count(*)::BIGINT AS n FROM part p LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem) l ON l.l_partkey = p.p_partkey GROUP BY 1, 2")
def q22(spark, d):
    seen = table(spark, d, "lineitem").select("l_partkey").distinct()
    j = table(spark, d, "part").join(seen, F.col("p_partkey") == F.col("l_partkey"), "left")
    reason = F.when(F.col("l_partkey").isNull(), "no_evidence").when(F.col("p_partkey") % 13 == 0, "denied").when(F.col("p_size") > 40, "out_of_range").otherwise("ok")
    return j.groupBy(reason.alias("reason"), "p_type").agg(F.count("*").alias("n"))


@query("q30_search_evaluation", f"WITH {_BM}, {_REL}, per AS (SELECT q.query, (SELECT count(*) FROM rel WHERE rel.query = q.query) AS relevant, (SELECT count(*) FROM rel JOIN bm ON bm.query = rel.query AND bm.id = rel.id WHERE rel.query = q.query AND bm.rank <= 3) AS hits FROM qs q) SELECT query, relevant::BIGINT AS relevant, hits::BIGINT AS hits FROM per")
def q30(spark, d):
    rel = _relevant(spark, d)
    hits = _bm25(spark, d, 3).join(rel, ["query", "id"]).groupBy("query").agg(F.count("*").alias("hits"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query")).join(rel.groupBy("query").agg(F.count("*").alias("relevant")), "query", "left").join(hits, "query", "left")
    return q.select("query", F.coalesce("relevant", F.lit(0)).alias("relevant"), F.coalesce("hits", F.lit(0)).alias("hits"))


# --- aggregates --------------------------------------------------------------------------------------------------


@query("ag01_uniqueness", "SELECT n AS copies, count(*)::BIGINT AS keys FROM (SELECT p_name, count(*)::BIGINT AS n FROM part GROUP BY 1) GROUP BY 1")
def ag01(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("keys"))


@query("ag02_single_targets", "SELECT p_name || ' ' || p_size AS name, min(p_brand) AS brand FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def ag02(spark, d):
    p = table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"), "p_brand")
    return p.groupBy("name").agg(F.min("p_brand").alias("brand"), F.max("p_brand").alias("other")).filter("brand = other").select("name", "brand")


@query("ag03_paired_choice", "SELECT p_type, min((p_name, p_size))[1] AS name, min((p_name, p_size))[2] AS size FROM part GROUP BY 1")
def ag03(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.min(F.struct("p_name", "p_size")).alias("x")).select("p_type", F.col("x.p_name").alias("name"), F.col("x.p_size").alias("size"))


@query("ag06_collected_citations", f"WITH {with_sql('observation')} SELECT entity, string_agg(DISTINCT place, ',' ORDER BY place) AS places, arg_max(place, (ts, observation)) AS latest, count(*)::BIGINT AS n FROM observation GROUP BY 1")
def ag06(spark, d):
    return observation(spark, d).groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("place")), ",").alias("places"), F.max_by("place", F.struct("ts", "observation")).alias("latest"), F.count("*").alias("n"))


@query("ag07_category_shares", """WITH p AS (SELECT p_partkey % 700 AS id, p_type, p_partkey % 23 <> 0 AS valid FROM part), n AS (SELECT id, count(*) AS copies FROM p WHERE valid GROUP BY 1)
SELECT p_type, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share, count(*) FILTER (NOT valid)::BIGINT AS invalid, count(*) FILTER (valid AND copies > 1)::BIGINT AS duplicates FROM p LEFT JOIN n USING (id) GROUP BY 1""")  # fmt: skip
def ag07(spark, d):
    """Categories with their shares, rows without a valid identity and rows whose id stands elsewhere too."""
    p = table(spark, d, "part").select((F.col("p_partkey") % 700).alias("id"), "p_type", (F.col("p_partkey") % 23 != 0).alias("valid"))
    copies = p.filter("valid").groupBy("id").agg(F.count("*").alias("copies"))
    g = p.join(copies, "id", "left").groupBy("p_type").agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("valid") & (F.col("copies") > 1)).alias("duplicates"))
    total = F.sum("n").over(Window.partitionBy())  # a row a category
    return g.withColumn("share", F.round(F.col("n") / total, 6))


@query("ag08_coverage_matrix", f"WITH {with_sql('claim')} SELECT trait, count(*) FILTER (inferred = false)::BIGINT AS exact, count(*) FILTER (inferred)::BIGINT AS inferred, count(*) FILTER (inferred IS NULL)::BIGINT AS unknown FROM claim GROUP BY 1")
def ag08(spark, d):
    kind = F.when(F.col("inferred").isNull(), "unknown").when(F.col("inferred"), "inferred").otherwise("exact")
    return claim(spark, d).withColumn("kind", kind).groupBy("trait").pivot("kind", ["exact", "inferred", "unknown"]).count()


@query("ag09_quarantine_counts", f"WITH {with_sql('observation')} SELECT place AS stage, CASE WHEN individual_count < 0 THEN 'count' WHEN lon IS NULL THEN 'coordinate' ELSE 'ok' END AS reason, count(*)::BIGINT AS n FROM observation GROUP BY 1, 2")
def ag09(spark, d):
    r = F.when(F.col("individual_count") < 0, "count").when(F.col("lon").isNull(), "coordinate").otherwise("ok")
    return observation(spark, d).groupBy(F.col("place").alias("stage"), r.alias("reason")).agg(F.count("*").alias("n"))


@query("ag10_representatives", "WITH r AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part) SELECT p_type, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS examples FROM r WHERE n <= 5 GROUP BY 1")
def ag10(spark, d):
    top = hierarchy.top_per_group(table(spark, d, "part").select("p_type", "p_partkey"), ["p_type"], [F.col("p_partkey")], 5)
    return top.groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_list("p_partkey")), ",").alias("examples"))


@query("ag12_latency_summary", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY 1")
def ag12(spark, d):
    return retrieval.percentile_rows(table(spark, d, "events"), ["event_type"], "value")


_CLS = "SELECT d.lang AS e, CASE WHEN d.doc_id % 9 = 0 THEN 'en' ELSE d.lang END AS p FROM documents d"


@query("ag13_label_metrics", f"WITH x AS ({_CLS}), l AS (SELECT DISTINCT e AS label FROM x) SELECT label, (SELECT count(*) FROM x WHERE e = label)::BIGINT AS n, round((SELECT count(*) FROM x WHERE e = label AND p = label)::DOUBLE / (SELECT count(*) FROM x WHERE e = label), 6) AS accuracy, round(2.0::DOUBLE * (SELECT count(*) FROM x WHERE e = label AND p = label) / ((SELECT count(*) FROM x WHERE e = label) + (SELECT count(*) FROM x WHERE p = label)), 6) AS f1 FROM l")
def ag13(spark, d):
    return retrieval.label_metrics(table(spark, d, "documents"), F.col("lang"), F.when(F.col("doc_id") % 9 == 0, "en").otherwise(F.col("lang")))


@query("ag16_multiset_contracts", """WITH e AS (SELECT l_orderkey AS q, list_sort(list(l_returnflag || '|' || l_linenumber % 3 || '|' || floor(l_quantity / 10)::BIGINT)) AS c, count(*) % 3 AS scope FROM lineitem GROUP BY 1),
g AS (SELECT l_orderkey AS q, list_sort(list(l_returnflag || '|' || l_linenumber % 3 || '|' || floor((l_quantity + CASE WHEN l_orderkey % 5 = 1 AND l_linenumber = 1 THEN 10 ELSE 0 END) / 10)::BIGINT)) AS c, CASE WHEN l_orderkey % 7 = 2 THEN 9 ELSE count(*) % 3 END AS scope, l_orderkey % 11 <> 4 AS ok FROM lineitem WHERE l_orderkey % 13 <> 6 GROUP BY 1)
SELECT e.q, CASE WHEN g.q IS NULL THEN 'no_answer' WHEN NOT g.ok THEN 'status' WHEN g.scope <> e.scope THEN 'scope' WHEN g.c <> e.c THEN 'conditions' ELSE 'ok' END AS contract FROM e LEFT JOIN g USING (q)""")  # fmt: skip
def ag16(spark, d):
    """Saved answers against their cases: conditions as multisets of (field, operator, value) in any order, then scope and status."""
    li = table(spark, d, "lineitem").withColumn("q", F.col("l_orderkey"))
    shifted = F.col("l_quantity") + F.when((F.col("q") % 5 == 1) & (F.col("l_linenumber") == 1), 10).otherwise(0)
    condition = lambda v: F.struct(F.col("l_returnflag").alias("field"), (F.col("l_linenumber") % 3).alias("operator"), F.floor(v / 10).alias("value"))
    cases = li.groupBy("q").agg(F.collect_list(condition(F.col("l_quantity"))).alias("conditions"), (F.count("*") % 3).alias("scope"))
    answers = li.filter("q % 13 <> 6").orderBy(F.desc("l_linenumber")).groupBy("q").agg(F.collect_list(condition(shifted)).alias("conditions"), F.when(F.col("q") % 7 == 2, 9).otherwise(F.count("*") % 3).alias("scope"), (F.col("q") % 11 != 4).alias("ok"))
    return evaluation.answer_contracts(cases, answers)


@query("ag17_corpus_statistics", f"WITH {with_sql('chunk')} SELECT count(DISTINCT document)::BIGINT AS documents, count(*)::BIGINT AS chunks, sum(length(text))::BIGINT AS chars, (SELECT count(*) FROM embeddings)::BIGINT AS vectors FROM chunk")
def ag17(spark, d):
    c = chunk(spark, d).agg(F.count_distinct("document").alias("documents"), F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
    return c.crossJoin(table(spark, d, "embeddings").agg(F.count("*").alias("vectors")))  # one row each


_ORDER = "o_orderkey || ':' || o_orderstatus"


@query("ag19_manifest_digests", f"WITH {digests.tree_sql('orders', 'o_custkey', _ORDER)} SELECT o_custkey, digest FROM root")
def ag19(spark, d):
    return digests.tree_digests(table(spark, d, "orders"), ["o_custkey"], F.expr(_ORDER))


@query("ag20_distribution_basis", f"WITH {with_sql('observation')} SELECT entity, CASE WHEN count(DISTINCT sensitivity) > 1 THEN 'mixed' ELSE min(sensitivity) END AS basis, count(*) FILTER (lon IS NOT NULL)::BIGINT AS located FROM observation GROUP BY 1")
def ag20(spark, d):
    return observation(spark, d).groupBy("entity").agg(F.when(F.count_distinct("sensitivity") > 1, "mixed").otherwise(F.min("sensitivity")).alias("basis"), F.count("lon").alias("located"))


@query("ag21_held_cases", "SELECT event_id, concat_ws(',', CASE WHEN value IS NULL OR value < 0 THEN 'value' END, CASE WHEN event_type = 'error' AND value > 50 THEN 'error_value' END) AS errors FROM events")
def ag21(spark, d):
    rules = [("value", F.col("value").isNull() | (F.col("value") < 0)), ("error_value", (F.col("event_type") == "error") & (F.col("value") > 50))]
    return table(spark, d, "events").select("event_id", F.array_join(policy.reasons(rules), ",").alias("errors"))


@query("tk07_verified_candidates", f"WITH {_BM}, ok AS (SELECT * FROM bm WHERE rank <= 25 AND id % 2 = 0), r AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM ok) SELECT * FROM r WHERE place <= 3")
def tk07(spark, d):
    ok = _bm25(spark, d, 25).filter("id % 2 = 0")
    return ok.select("query", "id", F.row_number().over(Window.partitionBy("query").orderBy("rank")).cast("long").alias("place")).filter("place <= 3")


@query("q33_name_inventory", f"WITH {with_sql('entity')} SELECT name, count(*)::BIGINT AS entities, min(entity) AS first, count(*) > 1 AS duplicate FROM entity GROUP BY 1")
def q33(spark, d):
    return entity(spark, d).groupBy("name").agg(F.count("*").alias("entities"), F.min("entity").alias("first")).withColumn("duplicate", F.col("entities") > 1)
