"""Queries of streaming ingest and projection: pages and an outbox derived from events are landed, streamed and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.registry import query
from tessera.plans.stand_ins import table
from tessera.session import persist_table, shared_dir
from tessera.streaming import occurrences, outbox

# Windows of four runs: the third fetches half of its records with a wrong country and fails, the fourth makes up for it.
_RUNS = ((1, "2024-01-12"), (2, "2024-01-20"), (3, "2024-01-25"), (4, "2024-01-30"))

# One raw record an event, as SQL that Spark and DuckDB both read. Each reason of a rejection is given by some rows.
_RAW = """SELECT event_id, CASE WHEN event_id = 83 THEN NULL ELSE 'o' || CAST(event_id AS STRING) END AS external_id,
  CAST(CAST(ts AS DATE) AS STRING) AS day, CASE WHEN event_id % 41 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS STRING) END AS event_date,
  CASE WHEN event_id % 32 = 0 THEN 'all rights reserved' WHEN event_id % 3 = 0 THEN 'https://creativecommons.org/licenses/by/4.0/legalcode' ELSE 'http://creativecommons.org/publicdomain/zero/1.0/' END AS license,
  CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 10 = 0 THEN 9000 + user_id % 30 ELSE 1000 + user_id % 30 END AS taxon_key,
  'Species ' || CAST(user_id % 30 AS STRING) || CASE WHEN event_id % 10 = 0 THEN ' minor' ELSE '' END AS scientific_name,
  CASE WHEN event_id % 10 = 0 THEN 'SUBSPECIES' ELSE 'SPECIES' END AS taxon_rank,
  1 AS kingdom_key, 'Animalia' AS kingdom, 2 AS phylum_key, 'Chordata' AS phylum, 3 AS class_key, 'Aves' AS class, 4 + user_id % 2 AS order_key, 'Order ' || CAST(user_id % 2 AS STRING) AS "order",
  10 + user_id % 6 AS family_key, 'Family ' || CAST(user_id % 6 AS STRING) AS family, CASE WHEN event_id % 19 = 0 THEN NULL ELSE 100 + user_id % 15 END AS genus_key, 'Genus ' || CAST(user_id % 15 AS STRING) AS genus,
  1000 + user_id % 30 AS species_key, 'Species ' || CAST(user_id % 30 AS STRING) AS species,
  CASE WHEN event_id % 5 = 0 THEN 'Author ' || CAST(event_id % 7 AS STRING) END AS authorship, CASE WHEN event_id % 4 = 0 THEN 'ACCEPTED' END AS taxonomic_status,
  CASE WHEN event_id % 3 = 0 THEN event_type || CAST(event_id % 10 AS STRING) END AS vernacular_name,
  CASE WHEN event_id % 47 = 0 THEN 95.0 ELSE user_id % 180 - 89.5 END AS lat, CASE WHEN event_id % 53 = 0 THEN NULL ELSE event_id % 360 - 179.5 END AS lon,
  CASE WHEN event_id % 59 = 0 THEN 'ZERO_COORDINATE' WHEN event_id % 61 = 0 THEN 'COORDINATE_ROUNDED' END AS issue,
  CASE WHEN event_id % 67 = 0 THEN 'ABSENT' ELSE 'present' END AS occurrence_status, CASE WHEN event_id % 71 = 0 THEN 'JP' ELSE 'kr' END AS country_code,
  CASE WHEN event_id % 73 = 0 THEN -1.0 WHEN event_id % 79 = 0 THEN 1.5 WHEN event_id % 2 = 0 THEN event_id % 9 END AS individual_count,
  CASE WHEN event_id % 4 = 0 THEN 'm' || CAST(event_id AS STRING) END AS media_id, event_id % 20 AS page,
  CASE WHEN event_id % 20 = 19 THEN NULL ELSE 'h' || CAST(event_id % 20 AS STRING) END AS raw_sha256 FROM events"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    names = [f.split()[0].strip("`") for f in _RAW_COLUMNS]
    return spark.sql(_RAW.replace('"order"', "`order`").replace("FROM events", "FROM {events}"), events=table(spark, d, "events")).select("event_id", "day", "page", "raw_sha256", "issue", "media_id", *names)


_RAW_COLUMNS = ["external_id", "event_date", "license", "taxon_key", "scientific_name", "taxon_rank", *[c for r in occurrences.RANKS for c in (f"{r}_key", r)], "authorship", "taxonomic_status", "vernacular_name", "lat", "lon", "occurrence_status", "country_code", "individual_count"]


#: Ids that share a set of 23 pages: a page lists at most 500 of them, however many events there are.
_IDS_OF_PAGES = 10_000


def _land(raw: DataFrame, start: str, end: str, folder: str, wrong_country: bool = False) -> None:
    """Write the pages of a window, each of a bounded length, in as many files as their size asks for; every seventh event stands on a second page as well."""
    rows = raw.filter((F.col("day") >= start) & (F.col("day") <= end))
    if wrong_country:
        rows = rows.withColumn("country_code", F.when(F.col("event_id") % 2 == 0, "JP").otherwise(F.col("country_code")))
    twice = (F.col("event_id") % 7 == 0) & (F.col("page") != 19)
    rows = rows.withColumn("page", F.explode(F.when(twice, F.array("page", F.col("event_id") % 3 + 20)).otherwise(F.array("page"))))
    rows = rows.withColumn("page", F.col("page") + 23 * F.floor(F.col("event_id") / _IDS_OF_PAGES))
    asset = lambda i, licence: F.struct(i.alias("identifier"), F.lit(licence).alias("license"), F.lit("StillImage").alias("type"), F.lit(None).cast("string").alias("creator"))
    media = F.when(F.col("media_id").isNotNull(), F.array(asset(F.col("media_id"), "http://creativecommons.org/licenses/by/4.0/"), asset(F.concat("media_id", F.lit("x")), "all rights reserved")))
    more = {"issues": F.array_compact(F.array("issue")), "withheld": F.lit(None), "media": media}
    schema = {f.name: f.dataType for f in raw.sparkSession.createDataFrame([], occurrences.PAGE).schema["results"].dataType.elementType.fields}
    record = F.struct(*[more.get(c, F.col(f"`{c}`")).cast(t).alias(c) for c, t in schema.items()])
    pages = rows.groupBy("page").agg(F.max("raw_sha256").alias("raw_sha256"), F.array_sort(F.collect_list(F.struct("event_id", record.alias("r")))).alias("rs"))
    pages.select(F.col("page").cast("int"), F.lit(200).alias("status"), "raw_sha256", F.lit(True).alias("end_of_records"), F.col("rs.r").alias("results")).write.parquet(folder)


def _ingested(spark: SparkSession, d: str) -> occurrences.Store:
    root = f"{shared_dir(spark)}/occurrences-{uuid.uuid4().hex}"
    store, raw, start = occurrences.Store(spark, f"{root}/store"), _raw(spark, d), "2023-12-13"
    for run, end in _RUNS:
        _land(raw, store.cursor() or start, end, f"{root}/pages{run}", wrong_country=run == 3)
        occurrences.ingest_window(store, f"{root}/pages{run}", run, end, "KR", max_pages=100)
    return store


_REASONED = f"""raw AS ({_RAW.replace('STRING', 'VARCHAR')}),
marked AS (SELECT *, CASE WHEN day > '2024-01-19' THEN 4 WHEN day > '2024-01-11' THEN 2 ELSE 1 END AS run, list_filter([
  CASE WHEN regexp_replace(regexp_replace(lower(license), '^https:', 'http:'), 'legalcode/?$', '') NOT IN ('http://creativecommons.org/publicdomain/zero/1.0/', 'http://creativecommons.org/licenses/by/3.0/', 'http://creativecommons.org/licenses/by/4.0/') THEN 'license_not_allowed' END,
  CASE WHEN external_id IS NULL THEN 'missing_external_id' END, CASE WHEN raw_sha256 IS NULL THEN 'missing_raw_page_sha256' END, CASE WHEN taxon_key IS NULL THEN 'missing_taxon_identity' END,
  CASE WHEN event_date IS NULL THEN 'missing_event_date' END, CASE WHEN coalesce(NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180), true) THEN 'invalid_or_missing_public_coordinate' END,
  CASE WHEN issue = 'ZERO_COORDINATE' THEN 'unsafe_coordinate_issue' END, CASE WHEN upper(occurrence_status) <> 'PRESENT' THEN 'not_present' END, CASE WHEN upper(country_code) <> 'KR' THEN 'country_mismatch' END,
  CASE WHEN individual_count < 0 OR individual_count <> floor(individual_count) THEN 'invalid_individual_count' END], lambda x: x IS NOT NULL) AS reasons FROM raw),
good AS (SELECT *, list_filter([CASE WHEN x.k IS NOT NULL THEN x END FOR x IN [{{'k': kingdom_key::BIGINT, 'r': 'kingdom', 'n': kingdom}}, {{'k': phylum_key, 'r': 'phylum', 'n': phylum}}, {{'k': class_key, 'r': 'class', 'n': class}}, {{'k': order_key, 'r': 'order', 'n': "order"}},
  {{'k': family_key, 'r': 'family', 'n': family}}, {{'k': genus_key, 'r': 'genus', 'n': genus}}, {{'k': species_key, 'r': 'species', 'n': species}}, {{'k': taxon_key, 'r': lower(taxon_rank), 'n': scientific_name}}]], lambda x: x IS NOT NULL) AS chain FROM marked WHERE len(reasons) = 0)"""


@query("str01_stream_ingest", f"""WITH {_REASONED}
SELECT 'observations' AS output, 'observation:' || external_id AS id, event_date || '|taxon:' || taxon_key || '|' || CASE WHEN issue = 'COORDINATE_ROUNDED' THEN 'generalized' ELSE 'public' END AS detail FROM good
UNION ALL SELECT DISTINCT 'taxa', 'taxon:' || x.k, x.r || '|' || x.n FROM (SELECT unnest(chain) AS x FROM good)
UNION ALL SELECT DISTINCT 'links', 'taxon:' || a || '->taxon:' || b, NULL FROM (SELECT unnest([{{'a': chain[i].k, 'b': chain[i + 1].k}} FOR i IN range(1, len(chain))], recursive := true) FROM good) WHERE a <> b
UNION ALL SELECT 'media', 'media:' || media_id, 'observation:' || external_id FROM good WHERE media_id IS NOT NULL
UNION ALL SELECT 'quarantine', coalesce(external_id, 'missing'), array_to_string(reasons, ',') FROM marked WHERE len(reasons) > 0""")  # fmt: skip
def str01(spark, d):
    s = _ingested(spark, d)
    parts = {
        "observations": s.observations().select("id", F.concat_ws("|", "observed_at", "taxon_id", "sensitivity").alias("detail")),
        "taxa": s.taxa().select("id", F.concat_ws("|", "rank", "scientific_name").alias("detail")),
        "links": s.links().select("id", F.lit(None).cast("string").alias("detail")),
        "media": s.media().select("id", F.col("observation_id").alias("detail")),
        "quarantine": s.quarantine().select(F.col("external_id").alias("id"), F.array_join("reasons", ",").alias("detail")),
    }
    rows = [df.select(F.lit(name).alias("output"), "id", "detail") for name, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("str03_derived_details", f"""WITH {_REASONED},
m AS (SELECT run, event_date, external_id, i, len(chain) AS n, chain[i] AS x, authorship, lower(taxonomic_status) AS status, vernacular_name, species FROM (SELECT *, unnest(range(1, len(chain) + 1)) AS i FROM good))
SELECT 'taxon:' || x.k AS id, arg_max(x.r, (run, event_date, external_id, i)) AS rank, arg_max(x.n, (run, event_date, external_id, i)) AS scientific_name, arg_max(CASE WHEN i = n THEN species ELSE x.n END, (run, event_date, external_id, i)) AS canonical_name,
  arg_max(authorship, (run, event_date, external_id, i)) FILTER (i = n AND authorship IS NOT NULL) AS authorship, arg_max(status, (run, event_date, external_id, i)) FILTER (i = n AND status IS NOT NULL) AS taxonomic_status,
  arg_max(vernacular_name, (run, event_date, external_id, i)) FILTER (i = n AND vernacular_name IS NOT NULL) AS vernacular_name FROM m GROUP BY x.k""")  # fmt: skip
def str03(spark, d):
    return _ingested(spark, d).taxa()


@query("str04_verified_cursor", f"""WITH {_REASONED}, w AS (SELECT * FROM (VALUES (1, '2023-12-13', '2024-01-12', true), (2, '2024-01-12', '2024-01-20', true), (3, '2024-01-20', '2024-01-25', false), (4, '2024-01-20', '2024-01-30', true)) t(run, start, "end", fetched))
SELECT w.run::INTEGER AS run, w.start, w."end", count(*) FILTER (rejected) * 4 <= sum(copies) AS ok, sum(copies)::BIGINT AS source_count, count(*) FILTER (NOT rejected)::BIGINT AS observations, count(*) FILTER (rejected)::BIGINT AS quarantine,
  (SELECT max(u."end") FROM w u WHERE u.run <= w.run AND u.fetched) AS cursor
FROM w JOIN (SELECT *, 1 + (event_id % 7 = 0 AND page <> 19)::INTEGER AS copies FROM marked) m ON m.day BETWEEN w.start AND w."end",
LATERAL (SELECT len(m.reasons) > 0 OR (NOT w.fetched AND m.event_id % 2 = 0) AS rejected) GROUP BY w.run, w.start, w."end" """)  # fmt: skip
def str04(spark, d):
    log = _ingested(spark, d).commits()
    upto = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a run
    return log.select("run", "start", "end", "ok", "source_count", "observations", "quarantine", F.max(F.when(F.col("ok"), F.col("end"))).over(upto).alias("cursor"))


_OUTBOX = """o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, CASE WHEN event_id % 17 = 0 THEN event_id % 5 ELSE 0 END AS fails FROM events),
s AS (SELECT user_id, min(seq) FILTER (fails >= 3) AS stop FROM o GROUP BY 1)"""


def _fail_first(event: dict, attempt: int) -> None:
    """A target that refuses an event as often as its column `fails` says."""
    if attempt <= event["fails"]:
        raise RuntimeError(f"refused {attempt}")


@query("str05_ordered_projection", f"""WITH {_OUTBOX}
SELECT user_id::VARCHAR AS aggregate, seq::BIGINT AS seq, event_id, CASE WHEN stop IS NULL OR seq < stop THEN 'applied' WHEN seq = stop THEN 'dead_letter' ELSE 'waiting' END AS status,
  (CASE WHEN stop IS NULL OR seq < stop THEN fails + 1 WHEN seq = stop THEN 3 ELSE 0 END)::INTEGER AS attempts, CASE WHEN seq = stop THEN 'RuntimeError: refused 3' END AS error, (event_id % 4 = 0)::BIGINT AS replays FROM o JOIN s USING (user_id)""")  # fmt: skip
def str05(spark, d):
    """Events land out of order in two batches, every fourth again in a third, whose heartbeat lets all retries come due."""
    root = f"{shared_dir(spark)}/outbox-{uuid.uuid4().hex}"
    i = F.col("event_id")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("aggregate"), seq.alias("seq"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(i % 17 == 0, i % 5).otherwise(0).cast("int").alias("fails"))
    rows = persist_table(rows, "outbox")  # read by three landings and the result
    heartbeat = spark.sql("SELECT '' AS aggregate, 1L AS seq, -1L AS event_id, timestamp '2030-01-01' AS ts, 0 AS fails")
    for part in (rows.filter(i % 3 != 0), rows.filter(i % 3 == 0), rows.filter(i % 4 == 0).unionByName(heartbeat)):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        outbox.project(stream, _fail_first, f"{root}/out", max_attempts=3, delay="60 seconds", late="400 days")
    done = outbox.outcomes(spark, f"{root}/out")
    first = done.filter("status <> 'replayed'").select("aggregate", "seq", "status", "attempts", "error")
    replays = done.filter("status = 'replayed'").groupBy("aggregate", "seq").agg(F.count("*").alias("replays"))
    return rows.select("aggregate", "seq", "event_id").join(first, ["aggregate", "seq"], "left").join(replays, ["aggregate", "seq"], "left").fillna({"status": "waiting", "attempts": 0, "replays": 0})
