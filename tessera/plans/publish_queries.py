"""Queries of snapshots: replace, append and catalog switch run against versions in the shared folder, and the published rows come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import snapshots
from tessera.operators.embedding import embed, hashing_embedder
from tessera.session import dealt, shared_dir

from .registry import query
from .stand_ins import table


def _snapshot(spark, name):
    return snapshots.Snapshot(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}", name)


@query("snk02_stale_rows", """WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders),
new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM o WHERE o_orderkey % 5 <> 0)
SELECT new.*, (SELECT count(*) FROM o WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0)::BIGINT AS removed, (SELECT count(*) FROM new WHERE o_orderkey % 3 = 0)::BIGINT AS added,
  (SELECT count(*) FROM new JOIN o USING (o_orderkey) WHERE o_orderkey % 3 <> 0 AND new.o_orderstatus <> o.o_orderstatus)::BIGINT AS changed, 2 AS seq FROM new""")  # fmt: skip
def snk02(spark, d):
    """Orders of two thirds of the keys are replaced by those of four fifths, some of them changed; the published table and what changed."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    s, k = _snapshot(spark, "orders"), F.col("o_orderkey")
    s.replace(o.filter(k % 3 != 0), "o_orderkey")
    done = s.replace(o.filter(k % 5 != 0).withColumn("o_orderstatus", F.when(k % 9 == 0, "X").otherwise(F.col("o_orderstatus"))), "o_orderkey")
    return s.read().select("o_orderkey", "o_orderstatus", "o_totalprice", *[F.lit(done[c]).alias(c) for c in ("removed", "added", "changed", "seq")])


@query("ctl02_idempotent_append", """WITH b AS (SELECT o_orderkey, o_orderstatus, o_orderkey % 2 = 0 AS first, o_orderkey % 3 = 0 OR o_orderkey % 10 = 1 AS second FROM orders),
t AS (SELECT b.*, o_orderkey % 10 = 4 AS clash, first OR o_orderkey % 3 = 0 AS kept FROM b)
SELECT o_orderkey, CASE WHEN kept THEN o_orderstatus END AS o_orderstatus, CASE WHEN first AND o_orderkey % 3 = 0 THEN 'replay' WHEN o_orderkey % 3 = 0 THEN 'append' END AS second,
  CASE WHEN o_orderkey % 10 = 4 THEN 'conflict' WHEN o_orderkey % 7 = 0 AND kept THEN 'replay' WHEN o_orderkey % 7 = 0 THEN 'append' END AS third, EXISTS (SELECT 1 FROM t WHERE clash) AS refused
FROM t WHERE kept OR o_orderkey % 7 = 0 OR clash""")  # fmt: skip
def ctl02(spark, d):
    """Three batches: new keys; new and replayed ones; and one with conflicts, which is refused as a whole and leaves the table."""
    o, k = table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey")
    s, ident = _snapshot(spark, "records"), ["o_orderkey", "o_orderstatus"]
    s.append(o.filter(k % 2 == 0), "o_orderkey", ident)
    second = snapshots.append_plan(s.read(), o.filter(k % 3 == 0), "o_orderkey", ident)
    s.append(o.filter(k % 3 == 0), "o_orderkey", ident)
    third = o.filter((k % 7 == 0) | (k % 10 == 4)).withColumn("o_orderstatus", F.when(k % 10 == 4, "X").otherwise(F.col("o_orderstatus")))
    try:
        s.append(third, "o_orderkey", ident)
        refused = False
    except ValueError:
        refused = True
    plan = snapshots.append_plan(s.read(), third, "o_orderkey", ident)
    out = s.read().join(second.withColumnRenamed("action", "second"), "o_orderkey", "full").join(plan.withColumnRenamed("action", "third"), "o_orderkey", "full")
    return out.select("o_orderkey", "o_orderstatus", "second", "third", F.lit(refused).alias("refused"))


_CHANGED = "CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END"


@query("txt07_incremental_vectors", f"""WITH o AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id AS id, sha256(coalesce({_CHANGED}, '')) AS h FROM documents WHERE doc_id % 11 <> 0),
a AS (SELECT coalesce(o.id, n.id) AS id, coalesce(n.h, o.h) AS hash, CASE WHEN n.id IS NULL THEN 'retire' WHEN o.h = n.h THEN 'reuse' ELSE 'embed' END AS action, n.id IS NOT NULL AS listed FROM o FULL JOIN n USING (id))
SELECT id, hash, action, listed, true AS as_embedded, (SELECT count(*) FILTER (action = 'embed') FROM a)::BIGINT AS embedded, 2 AS seq FROM a""")  # fmt: skip
def txt07(spark, d):
    """A catalog over most documents is switched to another inventory. Every listed vector must be the one that its text embeds to."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    changed = t.withColumn("text", F.when(F.col("id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).filter("id % 11 <> 0")
    s, e = _snapshot(spark, "vectors"), hashing_embedder(32)
    snapshots.index_catalog(s, t.filter("id % 7 <> 0"), e, 32, "hashing-32")
    first = s.read()
    plan = snapshots.index_plan(first, changed, "hashing-32")
    done = snapshots.index_catalog(s, changed, e, 32, "hashing-32")
    fresh = embed(changed, e).withColumnRenamed("vector", "own")
    got = s.read().join(fresh, "id").select("id", (F.col("vector") == F.col("own")).alias("as_embedded"))
    out = plan.join(got, "id", "left")
    return out.select("id", "hash", "action", F.col("as_embedded").isNotNull().alias("listed"), F.coalesce("as_embedded", F.lit(True)).alias("as_embedded"), F.lit(done["embed"]).alias("embedded"), F.lit(done["seq"]).alias("seq"))


_POLICY = "CASE WHEN source = 'src1' THEN 'denied' ELSE 'allowed' END"
_KNOWN = "source <> 'src4'"


@query("txt08_batch_vectors", f"""WITH b AS (SELECT doc_id AS id, text, source, {_POLICY} AS policy_status, doc_id % 6 <> 1 AS embedding_allowed, sha256(CASE WHEN doc_id % 15 = 2 THEN text || '!' ELSE text END) AS content_hash FROM documents),
r AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE id % 50 = 3), c AS (SELECT id, count(*) AS n FROM r GROUP BY 1),
i AS (SELECT id, unnest(list_filter([CASE WHEN policy_status <> 'allowed' THEN 'policy_denied' END, CASE WHEN NOT embedding_allowed THEN 'embedding_not_allowed' END, CASE WHEN NOT coalesce({_KNOWN}, false) THEN 'source_unknown' END,
  CASE WHEN n > 1 THEN 'duplicate_id' END, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_text' END, CASE WHEN coalesce(sha256(text) <> content_hash, true) THEN 'hash_mismatch' END], lambda x: x IS NOT NULL)) AS issue FROM r JOIN c USING (id))
SELECT DISTINCT id, issue, true AS refused FROM i UNION ALL SELECT DISTINCT id, NULL, true FROM r WHERE id NOT IN (SELECT id FROM i)""")  # fmt: skip
def txt08(spark, d):
    """A batch with every kind of issue is refused as a whole; the rows without issues are embedded when they come alone."""
    i = F.col("doc_id")
    b = table(spark, d, "documents").select(
        i.alias("id"), "text", "source", F.expr(_POLICY).alias("policy_status"), (i % 6 != 1).alias("embedding_allowed"),
        F.sha2(F.when(i % 15 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"),
    )
    rows = b.unionByName(b.filter("id % 50 = 3"))
    sources = b.filter(_KNOWN).select("source").distinct()
    try:
        snapshots.embed_batch(rows, sources, hashing_embedder(32), 32)
        refused = False
    except ValueError:
        refused = True
    issues = snapshots.preflight_issues(rows, sources)
    good = dealt(rows, "id", share=20_000).join(issues.select("id").distinct(), "id", "left_anti")  # texts, so smaller shares
    vectors = snapshots.embed_batch(good, sources, hashing_embedder(32), 32).filter("size(vector) = 32").select("id", F.lit(None).cast("string").alias("issue"))
    return issues.unionByName(vectors).withColumn("refused", F.lit(refused))
