"""Queries over sources, sinks, the control plane and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import control, digests, policy, reconcile
from tessera.session import persist_table, shared_dir
from tessera.sources import readers
from tessera.streaming import ingest

from .policy_queries import _BAD
from .registry import query
from .stand_ins import chunk, document, observation, table, with_sql


def _path(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("src01_json_lines", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def src01(spark, d):
    p = _path(spark, "json")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.json(p)
    return readers.json_lines(spark, p, "c_custkey long, c_name string, c_acctbal double")


@query("src02_positional_arrays", "SELECT n_nationkey::VARCHAR AS key, n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def src02(spark, d):
    p = _path(spark, "arrays")
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")))).alias("value"))
    rows.select("value").repartition(5).write.option("lineSep", " ").option("maxRecordsPerFile", 1).text(p)
    return readers.positional_arrays(spark, p, ["key", "name", "region"], table(spark, d, "nation").count()).select("key", "name", "region")


@query("src03_single_byte_table", r"SELECT doc_id, lang, regexp_replace(text, '[^\x{0}-\x{FF}]', '?', 'g') AS text FROM documents")
def src03(spark, d):
    """Whole texts: letters that the charset lacks become question marks; backslashes and line ends are escaped, so that lines stay rows."""
    p = _path(spark, "tsv")
    text = F.regexp_replace("text", r"[^\x{0}-\x{FF}]", "?")
    marks = (("\\", "\\b"), ("\n", "\\n"), ("\r", "\\r"))
    for mark, by in marks:
        text = F.replace(text, F.lit(mark), F.lit(by))
    options = {"sep": "\t", "header": True, "encoding": "ISO-8859-1", "nullValue": "\\N", "emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table(spark, d, "documents").select("doc_id", "lang", text.alias("text")).write.options(quoteAll=True, **options).csv(p)
    back = spark.read.schema("doc_id long, lang string, text string").options(**options).csv(p)
    text = F.col("text")
    for mark, by in reversed(marks):
        text = F.replace(text, F.lit(by), F.lit(mark))
    return back.select("doc_id", "lang", text.alias("text"))


@query("src04_numbered_sheet", "SELECT s_suppkey, s_name, s_suppkey + 1 AS row_number FROM supplier")
def src04(spark, d):
    p = _path(spark, "sheet")
    table(spark, d, "supplier").select("s_suppkey", "s_name", (F.col("s_suppkey") + 1).alias("row_number")).write.option("header", True).csv(p)
    return readers.delimited(spark, p, "s_suppkey long, s_name string, row_number long", sep=",")


_LINE = "CASE WHEN o_orderkey % 50 = 7 THEN o_orderkey || chr(9) || o_orderstatus || chr(9) || 'extra' || chr(9) || '' WHEN o_orderkey % 50 = 9 THEN chr(9) || o_orderstatus || chr(9) || o_orderpriority ELSE o_orderkey || chr(9) || o_orderstatus || chr(9) || o_orderpriority END"
_META = """<archive licence="https://creativecommons.org/licenses/by/4.0/"><core location="core.txt" separator="\\t"><id index="0"/><field index="2" term="priority"/><field index="1" term="status"/></core>
<extension location="extension.txt" separator="|"><coreid index="1"/><field index="0" term="line"/></extension></archive>"""


@query("src05_two_file_archive", f"""WITH c AS (SELECT o_orderkey, {_LINE} AS line, CASE WHEN o_orderkey % 50 = 7 THEN 'wrong_width' WHEN o_orderkey % 50 = 9 THEN 'empty_id' END AS reason, o_orderstatus, o_orderpriority FROM orders),
x AS (SELECT l_orderkey, l_linenumber || '|' || l_orderkey || CASE WHEN l_linenumber = 2 AND l_orderkey % 7 = 0 THEN '|' ELSE '' END AS line, l_linenumber = 2 AND l_orderkey % 7 = 0 AS wide, l_linenumber FROM lineitem),
k AS (SELECT o_orderkey FROM c WHERE reason IS NULL)
SELECT 'core' AS part, c.o_orderkey::VARCHAR AS id, o_orderstatus AS a, o_orderpriority AS b, (SELECT count(*) FROM x WHERE NOT wide AND l_orderkey = c.o_orderkey)::BIGINT AS rows_ FROM c WHERE reason IS NULL
UNION ALL SELECT 'issue', line, 'core', reason, NULL FROM c WHERE reason IS NOT NULL UNION ALL SELECT 'issue', line, 'extension', CASE WHEN wide THEN 'wrong_width' ELSE 'orphan' END, NULL FROM x WHERE wide OR l_orderkey NOT IN (SELECT o_orderkey FROM k)""")  # fmt: skip
def src05(spark, d):
    """An archive of orders and their lines, some of which have a wrong width, no id or no order, read by its descriptor."""
    p = _path(spark, "archive")
    table(spark, d, "orders").select(F.expr(_LINE).alias("value")).write.text(f"{p}/core.txt")
    wide = F.when(F.expr("l_linenumber = 2 AND l_orderkey % 7 = 0"), "|").otherwise("")
    table(spark, d, "lineitem").select(F.concat("l_linenumber", F.lit("|"), "l_orderkey", wide).alias("value")).write.text(f"{p}/extension.txt")
    spark.createDataFrame([(_META,)], "value string").coalesce(1).write.text(f"{p}/meta.xml")
    core, extension, issues = readers.described_archive(spark, p, ("https://creativecommons.org/licenses/by/4.0/",))
    n = extension.groupBy("id").agg(F.count("*").alias("rows_"))
    rows = core.join(n, "id", "left").select(F.lit("core").alias("part"), "id", F.col("status").alias("a"), F.col("priority").alias("b"), F.coalesce("rows_", F.lit(0)).alias("rows_"))
    return rows.unionByName(issues.select(F.lit("issue").alias("part"), F.col("line").alias("id"), F.col("part").alias("a"), F.col("reason").alias("b"), F.lit(None).cast("long").alias("rows_")))


def _paged(spark, d):
    p = _path(spark, "pages")
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 50).alias("page"), F.struct("event_id", "user_id", "event_type").alias("r"))
    g = e.groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("results"))
    g.select("page", F.when(F.col("page") % 7 != 3, F.col("results")).alias("results")).write.json(p)
    return readers.pages(spark, p, "event_id long, user_id long, event_type string")


@query("src06_paged_results", "SELECT event_id // 50 AS page, event_id, user_id, event_type FROM events WHERE event_id // 50 % 7 <> 3")
def src06(spark, d):
    return _paged(spark, d)[0].drop("page_hash")


@query("src06_page_errors", "SELECT DISTINCT event_id // 50 AS page FROM events WHERE event_id // 50 % 7 = 3")
def src06_errors(spark, d):
    return _paged(spark, d)[1]


_ENVELOPE = """'{"results":{"bindings":[' || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '{"item":{"value":"' || p_partkey || '"}' || CASE WHEN p_partkey % 6 <> 0 THEN ',"label":{"value":"' || p_name || '"}' ELSE '' END || '}' END || ']}}'"""
_ANSWER = f"CASE p_partkey % 50 WHEN 11 THEN '{{' WHEN 12 THEN '{{\"results\":{{}}}}' WHEN 13 THEN '[]' ELSE {_ENVELOPE} END"


@query("src07_bindings", """SELECT p_partkey, CASE WHEN p_partkey % 50 IN (11, 12, 13) THEN 'malformed' WHEN p_partkey % 7 = 0 THEN 'empty' WHEN p_partkey % 6 = 0 THEN 'unlabelled' ELSE 'bound' END AS status,
  CASE WHEN p_partkey % 50 NOT IN (11, 12, 13) AND p_partkey % 7 <> 0 AND p_partkey % 6 <> 0 THEN p_name END AS label FROM part""")  # fmt: skip
def src07(spark, d):
    """One answer a part: broken JSON, an envelope without bindings, an array, an empty result, a binding without a label, and good ones."""
    p = _path(spark, "bindings")
    table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("\t"), F.expr(_ANSWER)).alias("value")).write.text(p)
    lines = spark.read.text(p).select(F.split("value", "\t", 2).alias("c")).select(F.col("c")[0].cast("long").alias("p_partkey"), F.col("c")[1].alias("answer"))
    b = readers.bindings(lines, "answer", "item struct<value string>, label struct<value string>")
    return b.select("p_partkey", F.when(F.col("status") != "bound", F.col("status")).when(F.col("b.label.value").isNull(), "unlabelled").otherwise("bound").alias("status"), F.col("b.label.value").alias("label"))


@query("src08_paragraph_chunks", "SELECT doc_id AS id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ordinal, l AS text, sha256(l) AS content_hash FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(l) <> ''")
def src08(spark, d):
    return readers.paragraphs(table(spark, d, "documents"), "doc_id", "text")


@query("src09_verified_files", """WITH g AS (SELECT 'g' || (n_nationkey % 5) AS part, string_agg(n_name, ',' ORDER BY n_name) || chr(10) AS content FROM nation GROUP BY 1),
m AS (SELECT part, sha256(CASE WHEN part = 'g1' THEN upper(content) || ' ' ELSE content END) AS sha, strlen(content) + CASE WHEN part = 'g2' THEN 1 WHEN part = 'g1' THEN 0 ELSE 0 END AS bytes FROM g WHERE part <> 'g3' UNION ALL SELECT 'g9', sha256(''), 0)
SELECT coalesce(g.part, m.part) AS part, CASE WHEN g.part IS NULL THEN 'missing' WHEN m.part IS NULL THEN 'unlisted' WHEN m.bytes <> strlen(content) THEN 'bytes' WHEN m.sha <> sha256(content) THEN 'sha256' END AS reason FROM g FULL JOIN m USING (part)""")  # fmt: skip
def src09(spark, d):
    """Files against a manifest with another digest, another size, a file that it does not list and one that is not there."""
    p = _path(spark, "files")
    g = table(spark, d, "nation").groupBy(F.concat(F.lit("g"), (F.col("n_nationkey") % 5).cast("string")).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("value"))
    g.repartition("part").write.partitionBy("part").text(p)
    content = F.concat("value", F.lit("\n"))
    told = F.when(F.col("part") == "g1", F.concat(F.upper(content), F.lit(" "))).otherwise(content)
    manifest = g.filter("part <> 'g3'").select(F.col("part").alias("path"), F.sha2(told, 256).alias("sha256"), (F.octet_length(content) + F.when(F.col("part") == "g2", 1).otherwise(0)).cast("long").alias("bytes"))
    manifest = manifest.unionByName(spark.sql("SELECT 'g9' AS path, sha2('', 256) AS sha256, 0L AS bytes"))
    actual = readers.file_digests(spark, p).filter("path like '%/part=%'").withColumn("path", F.regexp_extract("path", "part=([^/]+)/", 1))
    bad = policy.manifest_mismatch(actual, manifest)
    every = actual.select("path").union(manifest.select("path")).distinct()
    return every.join(bad, "path", "left").select(F.col("path").alias("part"), "reason")


@query("src11_loaded_corpus", f"WITH {with_sql('document', 'chunk')} SELECT (SELECT count(*) FROM document)::BIGINT AS documents, (SELECT count(*) FROM document WHERE policy_status = 'allowed')::BIGINT AS allowed, (SELECT count(*) FROM chunk c JOIN document d ON d.document = c.document AND d.policy_status = 'allowed' WHERE c.policy_status = 'allowed')::BIGINT AS chunks")
def src11(spark, d):
    docs = document(spark, d)
    ok = docs.filter("policy_status = 'allowed'").select("document")
    n = docs.agg(F.count("*").alias("documents"), F.count_if(F.col("policy_status") == "allowed").alias("allowed"))
    return n.crossJoin(chunk(spark, d).filter("policy_status = 'allowed'").join(ok, "document", "left_semi").agg(F.count("*").alias("chunks")))


@query("snk03_checked_bundle", "SELECT count(*)::BIGINT AS row_count, true AS unchanged FROM part")
def snk03(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    written = persist_table(rows.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey"), "bundle")
    return written.agg(F.count("*").alias("row_count")).crossJoin(reconcile.set_difference(written, rows).agg((F.count("*") == 0).alias("unchanged")))


@query("snk04_safe_projection", f"WITH {with_sql('document', 'chunk')} SELECT c.chunk, d.embedding_allowed AS embed, sha256(c.text) AS content_hash FROM chunk c JOIN document d ON d.document = c.document WHERE c.policy_status = 'allowed' AND d.policy_status = 'allowed' AND d.fulltext_allowed AND d.chunk_allowed")
def snk04(spark, d):
    docs = document(spark, d)
    ok = policy.allowed_chunks(chunk(spark, d), docs).join(docs.select("document", "embedding_allowed"), "document")
    return ok.select("chunk", F.col("embedding_allowed").alias("embed"), F.sha2("text", 256).alias("content_hash"))


@query("gate04_loaded_counts", "SELECT o_orderstatus, count(*)::BIGINT AS expected, count(*) FILTER (NOT (o_orderstatus = 'P' AND o_orderkey % 9 = 0))::BIGINT AS loaded, count(*) = count(*) FILTER (NOT (o_orderstatus = 'P' AND o_orderkey % 9 = 0)) AS ok FROM orders GROUP BY 1")
def gate04(spark, d):
    """A load that lost some rows of one status."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    loaded = persist_table(o.filter("NOT (o_orderstatus = 'P' AND o_orderkey % 9 = 0)"), "loaded").groupBy("o_orderstatus").agg(F.count("*").alias("loaded"))
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("expected")).join(loaded, "o_orderstatus", "left").withColumn("ok", F.col("expected") == F.coalesce("loaded", F.lit(0)))


@query("ctl03_quarantine", f"WITH {with_sql('observation')}, q AS (SELECT entity::VARCHAR AS record_key, place AS reason_code, CASE WHEN observation % 2 = 0 THEN 'lon' ELSE '' END AS field_path, observation // 1000 AS run FROM observation WHERE {_BAD}) SELECT record_key, 'validate' AS stage, reason_code, field_path, min(run) AS first_seen, max(run) AS last_seen FROM q GROUP BY 1, 2, 3, 4")
def ctl03(spark, d):
    run = F.floor(F.col("observation") / 1000)
    q = observation(spark, d).filter(_BAD).select(F.col("entity").cast("string").alias("record_key"), F.lit("validate").alias("stage"), F.col("place").alias("reason_code"), F.when(F.col("observation") % 2 == 0, "lon").alias("field_path"), run.alias("first_seen"), run.alias("last_seen"))
    return control.quarantine_upsert(q.filter("first_seen % 2 = 0"), q.filter("first_seen % 2 = 1"))


_RUNS = "runs AS (SELECT 'p' || n_regionkey AS pipeline, n_nationkey AS run, 'rel' || n_nationkey AS release, CASE WHEN n_nationkey % 4 = 3 THEN 'failed' ELSE 'loading' END AS status, n_nationkey % 3 AS expected_version FROM nation), state AS (SELECT 'p' || r_regionkey AS pipeline, 'old' || r_regionkey AS active, r_regionkey * 5 AS active_run, r_regionkey % 3 AS version FROM region WHERE r_regionkey < 4), blk AS (SELECT DISTINCT s_nationkey AS run FROM supplier WHERE s_acctbal < -500)"


def _state(spark, d):
    r = table(spark, d, "region")
    return r.filter("r_regionkey < 4").select(F.concat(F.lit("p"), F.col("r_regionkey").cast("string")).alias("pipeline"), F.concat(F.lit("old"), F.col("r_regionkey").cast("string")).alias("active"), (F.col("r_regionkey") * 5).alias("active_run"), (F.col("r_regionkey") % 3).alias("version"))


@query("ctl04_activation", f"WITH {_RUNS}, j AS (SELECT r.*, s.active, s.version, CASE WHEN s.active_run = r.run THEN 'already_active' WHEN r.status <> 'loading' THEN 'not_loading' WHEN r.run IN (SELECT run FROM blk) THEN 'blocked' WHEN r.expected_version <> coalesce(s.version, 0) THEN 'version_conflict' ELSE 'activated' END AS outcome FROM runs r LEFT JOIN state s USING (pipeline)) SELECT pipeline, CASE WHEN outcome = 'activated' THEN release ELSE active END AS active, (CASE WHEN outcome = 'activated' THEN coalesce(version, 0) + 1 ELSE version END)::INTEGER AS version, outcome FROM j")
def ctl04(spark, d):
    n = F.col("n_nationkey")
    runs = table(spark, d, "nation").select(F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("pipeline"), n.alias("run"), F.concat(F.lit("rel"), n.cast("string")).alias("release"), F.when(n % 4 == 3, "failed").otherwise("loading").alias("status"), (n % 3).alias("expected_version"))
    q = table(spark, d, "supplier").select(F.col("s_nationkey").alias("run"), F.lit("blocked").alias("severity"), F.when(F.col("s_acctbal") < -500, "open").otherwise("closed").alias("resolution"))
    return control.activate(_state(spark, d), runs, q)


@query("ctl05_active_context", f"WITH {_RUNS} SELECT s.pipeline, s.active AS release, 'd' || n.n_nationkey AS dataset FROM state s JOIN nation n ON s.active = 'old' || n.n_regionkey WHERE n.n_nationkey % 2 = 0")
def ctl05(spark, d):
    n = table(spark, d, "nation")
    ds = F.concat(F.lit("d"), F.col("n_nationkey").cast("string"))
    releases = n.select(F.concat(F.lit("old"), F.col("n_regionkey").cast("string")).alias("release"), ds.alias("dataset"))
    datasets = n.select(ds.alias("dataset"), F.when(F.col("n_nationkey") % 2 == 0, "allowed").otherwise("denied").alias("policy_status"))
    return control.active_context(_state(spark, d), releases, datasets)


@query("ctl07_context_agreement", "SELECT count(DISTINCT p_partkey % 11)::BIGINT AS contexts, CASE WHEN count(DISTINCT p_partkey % 11) = 1 THEN min(p_partkey % 11) END AS context FROM part")
def ctl07(spark, d):
    return control.agreed_context(table(spark, d, "part").select((F.col("p_partkey") % 11).alias("context")))


@query("str02_stream_dedupe", "SELECT event_id, count(*)::BIGINT AS n FROM events GROUP BY 1")
def str02(spark, d):
    s = ingest.file_stream(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return ingest.first_seen(spark, s, ["event_id"], "ts", "40 days").groupBy("event_id").agg(F.count("*").alias("n"))


_ROW = "p_partkey || ':' || p_name"


@query("str06_content_addresses", f"""WITH {digests.tree_sql('part', 'p_type', _ROW)}
SELECT p_type, policy, 'ds-' || substr(sha256(digest || ':' || policy), 1, 16) AS dataset FROM root, (VALUES ('review-1'), ('review-2')) v(policy)""")  # fmt: skip
def str06(spark, d):
    """The same parts in two orders of rows have one address under a policy, and another under another one."""
    p, text = table(spark, d, "part"), F.expr(_ROW)
    one = digests.tree_digests(p, ["p_type"], text).select("p_type", F.lit("review-1").alias("policy"), digests.content_address(F.col("digest"), "review-1").alias("dataset"))
    two = digests.tree_digests(p.repartition(7, "p_name").orderBy(F.desc("p_partkey")), ["p_type"], text).select("p_type", F.lit("review-2").alias("policy"), digests.content_address(F.col("digest"), "review-2").alias("dataset"))
    return one.unionByName(two)