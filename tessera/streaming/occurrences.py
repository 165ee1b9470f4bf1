"""Windowed ingest of paged occurrence records: a run reads its window's pages as a stream, and a commit log publishes it.

A run stages five tables epoch by epoch under its own folder. Only when its gates pass and the loaded counts equal the expected
ones is a row with its range, counts and digest added to the commit log; readers see the runs of that log and no others. The
cursor is a fold over the log, so a failed run leaves it, and the next run's window covers what it missed.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S

# Ranks from the top down, licences that may be loaded, issue codes that make a coordinate unsafe.
RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")
LICENCES = ("http://creativecommons.org/publicdomain/zero/1.0/", "http://creativecommons.org/licenses/by/3.0/", "http://creativecommons.org/licenses/by/4.0/")
UNSAFE_COORDINATES = ("ZERO_COORDINATE", "COORDINATE_INVALID", "COORDINATE_OUT_OF_RANGE", "COUNTRY_COORDINATE_MISMATCH", "COORDINATE_REPROJECTION_FAILED")

RECORD = (
    "external_id string, event_date string, license string, taxon_key long, scientific_name string, taxon_rank string, "
    + ", ".join(f"`{r}_key` long, `{r}` string" for r in RANKS)
    + ", authorship string, taxonomic_status string, vernacular_name string, lat double, lon double, issues array<string>, occurrence_status string,"
    " country_code string, individual_count double, withheld string, media array<struct<identifier: string, license: string, type: string, creator: string>>"
)
PAGE = f"page int, status int, raw_sha256 string, end_of_records boolean, results array<struct<{RECORD}>>"
TABLES = ("observations", "taxa", "links", "media", "quarantine")
_COMMIT = "run int, start string, end string, ok boolean, reason string, pages long, source_count long, observations long, taxa long, links long, media long, quarantine long, rejected_ratio double, digest string"


def allowed_licence(c: Column) -> Column:
    uri = F.regexp_replace(F.regexp_replace(F.lower(c), "^https:", "http:"), "legalcode/?$", "")
    return F.coalesce(uri.isin(*LICENCES), F.lit(False))


def occurrence_reasons(r, page_hash: Column, country: str) -> Column:
    """The reasons why a record (r[name] gives its columns) is not loaded, in the order of the checks; empty for a good one."""
    no = lambda c: F.coalesce(c, F.lit("")) == ""
    between = lambda c, most: F.coalesce(~F.isnan(c) & c.between(-most, most), F.lit(False))
    count = r["individual_count"]
    rules = [
        ("license_not_allowed", ~allowed_licence(r["license"])),
        ("missing_external_id", no(r["external_id"]) | (r["external_id"] == "missing")),
        ("missing_raw_page_sha256", no(page_hash)),
        ("missing_taxon_identity", r["taxon_key"].isNull() | no(r["scientific_name"])),
        ("missing_event_date", no(r["event_date"])),
        ("invalid_or_missing_public_coordinate", ~(between(r["lat"], 90) & between(r["lon"], 180))),
        ("unsafe_coordinate_issue", F.coalesce(F.arrays_overlap(r["issues"], F.array(*map(F.lit, UNSAFE_COORDINATES))), F.lit(False))),
        ("not_present", F.upper(F.coalesce(r["occurrence_status"], F.lit(""))) != "PRESENT"),
        ("country_mismatch", F.upper(F.coalesce(r["country_code"], F.lit(""))) != country),
        ("invalid_individual_count", count.isNotNull() & (F.isnan(count) | (count < 0) | (count != F.floor(count)))),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules]))


def records(pages: DataFrame, start: str, end: str) -> DataFrame:
    """The records of good pages whose date lies in the window (or is missing), with page, position and page hash."""
    r = pages.filter("status between 200 and 299 and results is not null").select("page", "raw_sha256", F.posexplode("results").alias("pos", "r"))
    day = F.substring("event_date", 1, 10)
    return r.select("page", "pos", "raw_sha256", "r.*").withColumn("external_id", F.coalesce("external_id", F.lit("missing"))).filter(day.isNull() | day.between(start, end))


def normalized(rows: DataFrame, country: str) -> DataFrame:
    """Records with reasons, hierarchy (ids of their taxa from the top down), taxa and public columns."""
    rows = rows.withColumn("reasons", occurrence_reasons({c: F.col(f"`{c}`") for c in rows.columns}, F.col("raw_sha256"), country))
    taxon = lambda key, rank, name, canonical, *more: F.when(
        key.isNotNull() & (F.coalesce(name, F.lit("")) != ""),
        F.struct(
            F.concat(F.lit("taxon:"), key.cast("string")).alias("id"), F.lower(F.coalesce(rank, F.lit("UNKNOWN"))).alias("rank"), name.alias("scientific_name"), canonical.alias("canonical_name"),
            *[m.alias(a) for m, a in zip(more, ("authorship", "taxonomic_status", "vernacular_name"), strict=True)],
        ),
    )
    none = F.lit(None).cast("string")
    ranks = F.array_compact(F.array(*[taxon(F.col(f"`{r}_key`"), F.lit(r), F.col(f"`{r}`"), F.col(f"`{r}`"), none, none, none) for r in RANKS]))
    accepted = taxon(F.col("taxon_key"), F.col("taxon_rank"), F.col("scientific_name"), F.col("species"), F.col("authorship"), F.lower("taxonomic_status"), F.col("vernacular_name"))
    generalized = (F.coalesce("withheld", F.lit("")) != "") | F.coalesce(F.array_contains("issues", "COORDINATE_ROUNDED"), F.lit(False))
    return rows.withColumn("ranks", ranks).withColumn("accepted", accepted).withColumn("sensitivity", F.when(generalized, "generalized").otherwise("public")).withColumn("precision", S.date_precision(F.col("event_date")))


def outputs(rows: DataFrame) -> dict[str, DataFrame]:
    """The five tables of normalized rows. taxa hold one row for each mention; see Store.taxa."""
    good = rows.filter("size(reasons) = 0")
    chain = F.concat("ranks", F.array("accepted"))
    pairs = F.transform(F.sequence(F.lit(2), F.size("ids")), lambda i: F.struct(F.element_at("ids", i - 1).alias("parent_id"), F.element_at("ids", i).alias("child_id")))
    links = good.select(F.transform(chain, lambda t: t["id"]).alias("ids")).filter("size(ids) > 1").select(F.explode(pairs).alias("l")).select("l.*").filter("parent_id <> child_id").distinct()
    return {
        "observations": good.select(
            F.concat(F.lit("observation:"), "external_id").alias("id"), "external_id", F.col("accepted.id").alias("taxon_id"), F.col("event_date").alias("observed_at"), "precision",
            F.col("individual_count").cast("long").alias("count"), "lat", "lon", "sensitivity", F.col("license").alias("license_uri"), "raw_sha256",
        ),
        "taxa": good.select("event_date", "external_id", F.posexplode(chain).alias("slot", "t")).select("event_date", "external_id", "slot", "t.*"),
        "links": links.select(F.concat_ws("->", "parent_id", "child_id").alias("id"), "parent_id", "child_id"),
        "media": good.select("external_id", F.posexplode("media").alias("n", "m")).filter(allowed_licence(F.col("m.license"))).select(
            F.concat(F.lit("media:"), F.coalesce("m.identifier", F.concat_ws(":", "external_id", F.col("n").cast("string")))).alias("id"), F.concat(F.lit("observation:"), "external_id").alias("observation_id"),
            F.lower(F.coalesce("m.type", F.lit("unknown"))).alias("media_type"), F.col("m.creator").alias("creator"), F.col("m.license").alias("license_uri"),
        ),
        "quarantine": rows.filter("size(reasons) > 0").select("external_id", "reasons", F.lit("validate").alias("stage")),
    }


@dataclass(frozen=True)
class Store:
    """The folders of one pipeline: runs/run=N/<table>/epoch=E, and commits/run=N."""

    spark: SparkSession
    root: str

    def commits(self) -> DataFrame:
        """The commit log: one row a run, failed ones included."""
        try:
            return self.spark.read.schema(_COMMIT).parquet(f"{self.root}/commits/*")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], _COMMIT)
            raise

    def cursor(self) -> str | None:
        """The end of the last window that was loaded and verified."""
        return self.commits().filter("ok").agg(F.max("end")).first()[0]

    def table(self, name: str) -> DataFrame:
        """All rows of a table in committed runs, with the run's number."""
        runs = [r["run"] for r in self.commits().filter("ok").select("run").collect()]  # one number a run
        if not runs:
            raise ValueError("no run is committed yet")
        parts = [self.spark.read.parquet(f"{self.root}/runs/run={n}/{name}").drop("epoch").withColumn("run", F.lit(n)) for n in sorted(runs)]
        return reduce(DataFrame.unionByName, parts)

    def observations(self) -> DataFrame:
        return _last(self.table("observations"), "id", "run")

    def media(self) -> DataFrame:
        return _last(self.table("media"), "id", "run")

    def links(self) -> DataFrame:
        return self.table("links").select("id", "parent_id", "child_id").distinct()

    def quarantine(self) -> DataFrame:
        """The last findings on each record that is not loaded."""
        return _last(self.table("quarantine"), "external_id", "run").join(self.observations().select("external_id"), "external_id", "left_anti")

    def taxa(self) -> DataFrame:
        """Each taxon once: rank and name as last mentioned (by run, date and id of the record, for that does not depend on batches);
        other details as last given, for a null leaves what was there."""
        order = F.struct("run", "event_date", "external_id", "slot")
        kept = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("canonical_name", "authorship", "taxonomic_status", "vernacular_name")]
        return self.table("taxa").groupBy("id").agg(F.max_by("rank", order).alias("rank"), F.max_by("scientific_name", order).alias("scientific_name"), *kept)


def _last(rows: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if not rows.schema[c].dataType.typeName().startswith("map")])).alias("r")).select(key, "r.*")


def ingest_window(store: Store, pages: str, run: int, end: str, country: str, fallback_days: int = 30, max_rejected_ratio: float = 0.25, max_pages: int = 20, tamper=None) -> dict:
    """Load the window from the cursor (or fallback_days before its end) to `end`, both days included, from the Parquet pages (PAGE)
    in the folder `pages`; returns the commit row.

    Within the run, records of one id are kept once, whichever of them comes first in the stream. The run fails, and publishes
    nothing, where a page has an error, the window is cut at max_pages, no record passes, the rejected ratio exceeds its bound or
    loaded counts differ from expected ones. A repeated call of a run that failed writes its folder anew. tamper(folder) is called
    before verification, for tests.
    """
    spark, cursor = store.spark, store.cursor()
    start = cursor or (dt.date.fromisoformat(end) - dt.timedelta(days=fallback_days)).isoformat()
    folder, stage = f"{store.root}/runs/run={run}", f"{store.root}/staging/run={run}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        path = f"{stage}/epoch={epoch}"
        normalized(batch, country).write.mode("overwrite").parquet(path)
        for name, rows in outputs(spark.read.parquet(path)).items():
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/epoch={epoch}")

    stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 64).parquet(pages)
    once = records(stream, start, end).dropDuplicates(["external_id"])
    once.writeStream.foreachBatch(write).option("checkpointLocation", f"{stage}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(PAGE).parquet(pages)
    bad_page = F.coalesce(~F.col("status").between(200, 299) | F.col("results").isNull(), F.lit(True))
    seen = got.agg(F.count_if(~bad_page).alias("pages"), F.count_if(bad_page).alias("errors"), F.max_by("end_of_records", "page").alias("complete"), F.sum(F.when(~bad_page, F.size("results"))).alias("records")).first()
    staged = spark.read.parquet(f"{stage}/epoch=*")
    good = F.size("reasons") == 0
    licensed = F.size(F.filter(F.coalesce("media", F.array()), lambda m: allowed_licence(m["license"])))
    count = lambda c: F.coalesce(F.sum(F.when(good, c)), F.lit(0))
    expected = staged.agg(count(F.lit(1)).alias("observations"), count(F.size("ranks") + 1).alias("taxa"), count(licensed).alias("media"), F.count_if(~good).alias("quarantine"), F.count("*").alias("all")).first()
    if tamper:
        tamper(folder)
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    digest = F.hex(F.bit_xor(F.xxhash64("id", "taxon_id", "observed_at")))
    counts = [read(name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), (digest if name == "observations" else F.lit(None).cast("string")).alias("digest")) for name in TABLES]
    found = {r["name"]: r for r in reduce(DataFrame.unionByName, counts).collect()}  # five rows
    loaded = {name: found[name]["n"] for name in TABLES}
    source = seen["records"] or 0
    ratio = expected["quarantine"] / source if source else 1.0
    differ = any(loaded[n] != expected[n] for n in TABLES if n != "links") or expected["observations"] + expected["quarantine"] != expected["all"]
    reasons = [
        text
        for failed, text in (
            (not seen["pages"], "no valid page"),
            (seen["errors"], f"{seen['errors']} page request(s) failed"),
            (not source, "no records in the window"),
            (not expected["observations"], "no record passed validation"),
            (ratio > max_rejected_ratio, f"rejected ratio {ratio:.3f} exceeds the gate"),
            (seen["pages"] >= max_pages and not seen["complete"], "window cut at the page limit"),
            (differ, "loaded counts differ from expected ones"),
        )
        if failed
    ]
    row = {"run": run, "start": start, "end": end, "ok": not reasons, "reason": "; ".join(reasons), "pages": seen["pages"], "source_count": source, **loaded, "rejected_ratio": ratio, "digest": found["observations"]["digest"]}
    spark.createDataFrame([row], _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{store.root}/commits/run={run}")
    return row
