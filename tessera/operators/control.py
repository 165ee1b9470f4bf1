"""The control plane as tables: quarantine, activation, active context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quarantine_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Items by (record_key, stage, reason_code, field_path or ''): the first run seen stays, the last moves on."""
    ident = ["record_key", "stage", "reason_code", "field_path"]
    both = old.unionByName(new).withColumn("field_path", F.coalesce("field_path", F.lit("")))
    return both.groupBy(*ident).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def activate(state: DataFrame, runs: DataFrame, quarantine: DataFrame) -> DataFrame:
    """The next state of each pipeline: (pipeline, active, version, outcome).

    runs: pipeline, run, release, status, expected_version. A run goes active if it is loading, has no open blocked
    quarantine item and expects the current version; a run that is active already keeps its version.
    """
    blocked = quarantine.filter("severity = 'blocked' AND resolution = 'open'").select("run").distinct().withColumn("blocked", F.lit(True))
    j = runs.join(state, "pipeline", "left").join(blocked, "run", "left")
    outcome = (
        F.when(F.col("active_run") == F.col("run"), "already_active")
        .when(F.col("status") != "loading", "not_loading")
        .when(F.coalesce("blocked", F.lit(False)), "blocked")
        .when(F.col("expected_version") != F.coalesce("version", F.lit(0)), "version_conflict")
        .otherwise("activated")
    )
    done = outcome == "activated"
    return j.select("pipeline", F.when(done, F.col("release")).otherwise(F.col("active")).alias("active"), F.when(done, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")).alias("version"), outcome.alias("outcome"))


def active_context(state: DataFrame, releases: DataFrame, datasets: DataFrame) -> DataFrame:
    """(pipeline, release, dataset) where the active release's dataset is allowed."""
    ok = datasets.filter("policy_status = 'allowed'").select("dataset")
    return state.select("pipeline", F.col("active").alias("release")).join(releases, "release").join(ok, "dataset", "left_semi").select("pipeline", "release", "dataset")


def agreed_context(sources: DataFrame) -> DataFrame:
    """One row: the context that all sources share, else null."""
    return sources.agg(F.count_distinct("context").alias("contexts"), F.when(F.count_distinct("context") == 1, F.min("context")).alias("context"))
