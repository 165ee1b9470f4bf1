"""The knowledge tables of the library, derived from the driver's star-schema tables: Spark builders and the same as SQL text.

entity: parts as leaves under brand groups under types (a three-level hierarchy). claim: traits of parts, one row each.
evidence: a row for each part and supplier. observation: events. chunk: lines of documents. Every derived flag comes
from a key by modulo, so that nulls, denied rows and conflicts occur at all sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ENTITY_SQL = """SELECT p_partkey AS entity, p_name AS name, p_type || '|' || p_brand AS genus, p_type AS "order",
  CASE WHEN p_partkey % 13 = 0 THEN 'denied' ELSE 'allowed' END AS policy_status,
  CASE WHEN p_partkey % 11 = 0 THEN 'r0' ELSE 'r1' END AS release FROM part"""


def entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("entity"),
        F.col("p_name").alias("name"),
        F.concat_ws("|", "p_type", "p_brand").alias("genus"),
        F.col("p_type").alias("order"),
        F.when(F.col("p_partkey") % 13 == 0, "denied").otherwise("allowed").alias("policy_status"),
        F.when(F.col("p_partkey") % 11 == 0, "r0").otherwise("r1").alias("release"),
    )


CLAIM_SQL = """SELECT p_partkey * 4 + t.k AS claim, p_partkey AS entity, t.trait,
  CASE t.k WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_retailprice END AS value_num,
  CASE t.k WHEN 2 THEN p_type WHEN 3 THEN p_brand END AS value_text,
  CASE t.k WHEN 0 THEN 'cm' WHEN 1 THEN CASE WHEN p_partkey % 17 = 0 THEN 'eur' ELSE 'usd' END END AS unit,
  CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS certainty,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 7 = 1 END AS inferred,
  'ds' || (p_partkey % 3) AS dataset, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'r0' ELSE 'r1' END AS taxonomy_release,
  'rec' || p_partkey AS source_record, CASE WHEN p_partkey % 19 = 0 THEN 'denied' ELSE 'allowed' END AS policy_status
  FROM part, (VALUES (0, 'size'), (1, 'price'), (2, 'diet'), (3, 'habitat')) t(k, trait)"""


def claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    trait = lambda i, name, num, text, unit: F.struct(F.lit(i).alias("k"), F.lit(name).alias("trait"), num.cast("double").alias("value_num"), text.cast("string").alias("value_text"), unit.cast("string").alias("unit"))
    none = F.lit(None)
    traits = F.array(
        trait(0, "size", F.col("p_size"), none, F.lit("cm")),
        trait(1, "price", F.col("p_retailprice"), none, F.when(k % 17 == 0, "eur").otherwise("usd")),
        trait(2, "diet", none, F.col("p_type"), none),
        trait(3, "habitat", none, F.col("p_brand"), none),
    )
    return p.select(k.alias("entity"), F.explode(traits).alias("t")).select(
        (F.col("entity") * 4 + F.col("t.k")).alias("claim"),
        "entity",
        "t.trait",
        "t.value_num",
        "t.value_text",
        "t.unit",
        F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("entity") % 4 + 1).cast("int")).alias("certainty"),
        F.when(F.col("entity") % 7 == 0, None).otherwise(F.col("entity") % 7 == 1).alias("inferred"),
        F.concat(F.lit("ds"), (F.col("entity") % 3).cast("string")).alias("dataset"),
        F.when(F.col("entity") % 5 == 0, None).when(F.col("entity") % 11 == 0, "r0").otherwise("r1").alias("taxonomy_release"),
        F.concat(F.lit("rec"), F.col("entity").cast("string")).alias("source_record"),
        F.when(F.col("entity") % 19 == 0, "denied").otherwise("allowed").alias("policy_status"),
    )


EVIDENCE_SQL = """SELECT DISTINCT l_partkey * 100000 + l_suppkey AS evidence, l_partkey AS entity, 'ds' || (l_partkey % 3) AS dataset,
  CASE WHEN l_suppkey % 23 = 0 THEN 'other' ELSE 'rec' || l_partkey END AS source_record,
  CASE WHEN l_suppkey % 10 = 0 THEN 'ftp://files/' ELSE 'https://example.org/' END || l_suppkey AS locator,
  CASE WHEN l_suppkey % 29 = 0 THEN 'denied' ELSE 'allowed' END AS policy_status FROM lineitem"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = dealt(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey").distinct()
    s = F.col("l_suppkey")
    return li.select(
        (F.col("l_partkey") * 100000 + s).alias("evidence"),
        F.col("l_partkey").alias("entity"),
        F.concat(F.lit("ds"), (F.col("l_partkey") % 3).cast("string")).alias("dataset"),
        F.when(s % 23 == 0, "other").otherwise(F.concat(F.lit("rec"), F.col("l_partkey").cast("string"))).alias("source_record"),
        F.concat(F.when(s % 10 == 0, "ftp://files/").otherwise("https://example.org/"), s.cast("string")).alias("locator"),
        F.when(s % 29 == 0, "denied").otherwise("allowed").alias("policy_status"),
    )


OBSERVATION_SQL = """SELECT event_id AS observation, user_id AS entity, event_type AS place, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS event_date_raw,
  value, CASE WHEN event_id % 9 = 0 THEN 'private' ELSE 'public' END AS sensitivity,
  (user_id % 180) - 90.0 + event_id % 5 AS lat, CASE WHEN event_id % 37 = 0 THEN NULL ELSE (event_id % 400) - 190.0 END AS lon,
  CASE event_id % 4 WHEN 0 THEN 'HTTP://creativecommons.org/licenses/by/4.0/legalcode' WHEN 1 THEN 'https://creativecommons.org/publicdomain/zero/1.0/' WHEN 2 THEN 'http://creativecommons.org/licenses/by-nc/4.0/' ELSE 'all rights reserved' END AS licence,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id % 8)::INTEGER - 1 END AS individual_count, event_id // 3 AS external_id, props FROM events"""


def observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    lic = ("HTTP://creativecommons.org/licenses/by/4.0/legalcode", "https://creativecommons.org/publicdomain/zero/1.0/", "http://creativecommons.org/licenses/by-nc/4.0/", "all rights reserved")
    return e.select(
        i.alias("observation"),
        F.col("user_id").alias("entity"),
        F.col("event_type").alias("place"),
        "ts",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("event_date_raw"),
        "value",
        F.when(i % 9 == 0, "private").otherwise("public").alias("sensitivity"),
        (F.col("user_id") % 180 - 90.0 + i % 5).alias("lat"),
        F.when(i % 37 == 0, None).otherwise(i % 400 - 190.0).alias("lon"),
        F.element_at(F.array(*map(F.lit, lic)), (i % 4 + 1).cast("int")).alias("licence"),
        F.when(i % 6 == 0, None).otherwise((i % 8).cast("int") - 1).alias("individual_count"),
        F.floor(i / 3).alias("external_id"),
        "props",
    )


DOCUMENT_SQL = """SELECT doc_id AS document, source, lang, text, CASE WHEN source IN ('src1', 'src7') THEN 'denied' WHEN source = 'src4' THEN 'review_required' ELSE 'allowed' END AS policy_status,
  doc_id % 10 <> 3 AS fulltext_allowed, doc_id % 8 <> 5 AS chunk_allowed, doc_id % 6 <> 1 AS embedding_allowed FROM documents"""


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("document"),
        "source",
        "lang",
        "text",
        F.when(F.col("source").isin("src1", "src7"), "denied").when(F.col("source") == "src4", "review_required").otherwise("allowed").alias("policy_status"),
        (i % 10 != 3).alias("fulltext_allowed"),
        (i % 8 != 5).alias("chunk_allowed"),
        (i % 6 != 1).alias("embedding_allowed"),
    )


CHUNK_SQL = """SELECT doc_id * 100000 + pos AS chunk, CASE WHEN doc_id % 31 = 0 THEN -1 ELSE doc_id END AS document, pos::INTEGER AS ordinal, line AS text,
  CASE WHEN (doc_id + pos) % 12 = 0 THEN 'denied' ELSE 'allowed' END AS policy_status
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"""


def chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.select(
        (F.col("doc_id") * 100000 + F.col("pos")).alias("chunk"),
        F.when(F.col("doc_id") % 31 == 0, F.lit(-1).cast("long")).otherwise(F.col("doc_id")).alias("document"),
        F.col("pos").alias("ordinal"),
        F.col("line").alias("text"),
        F.when((F.col("doc_id") + F.col("pos")) % 12 == 0, "denied").otherwise("allowed").alias("policy_status"),
    )


WITH = {"entity": ENTITY_SQL, "claim": CLAIM_SQL, "evidence": EVIDENCE_SQL, "observation": OBSERVATION_SQL, "document": DOCUMENT_SQL, "chunk": CHUNK_SQL}


def with_sql(*names: str) -> str:
    """`name AS (...)` terms for a WITH clause."""
    return ", ".join(f"{n} AS ({WITH[n]})" for n in names)
