"""Versioned snapshots in the shared folder: a table is staged beside the current one, compared, and published by a pointer row.

root/<name>/parts/<id> hold rows; root/<name>/pointer/seq=N has one row for each published version: the parts it consists of,
its rows and fingerprint. The newest pointer is the table. A pointer is written in one file whose folder must not exist, so of
two writers that start from the same version one fails, and a crash before the pointer leaves the old version readable.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators.embedding import embed
from tessera.operators.rules import require_none

_POINTER = "seq int, parts array<string>, rows long, fingerprint string"


def fingerprint(rows: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table, whatever its order and partitions: repeated rows count, for hashes are summed as well as mixed."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
    r = rows.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 40))).alias("s")).first()
    return r["n"], f"{(r['x'] or 0) & (1 << 64) - 1:016x}-{r['s'] or 0:x}"


@dataclass(frozen=True)
class Snapshot:
    """One table of snapshots."""

    spark: SparkSession
    root: str
    name: str

    def _pointers(self) -> DataFrame:
        try:
            return self.spark.read.schema(_POINTER).parquet(f"{self.root}/{self.name}/pointer/*")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], _POINTER)
            raise

    def current(self) -> dict | None:
        r = self._pointers().orderBy(F.desc("seq")).limit(1).collect()
        return r[0].asDict() if r else None

    def read(self, version: dict | None = None) -> DataFrame:
        """The rows of a version, the current one by default."""
        at = version or self.current()
        if at is None:
            raise ValueError(f"{self.name} has no version yet")
        return self.spark.read.parquet(*at["parts"])

    def stage(self, rows: DataFrame) -> str:
        """Write rows to a new part that no pointer names yet."""
        path = f"{self.root}/{self.name}/parts/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def publish(self, parts: list[str], base: dict | None, expected: tuple[int, str] | None = None) -> dict:
        """Make parts the next version after `base`; they must hold what is expected of them, and base must still be the current version."""
        now = self.current()
        if (now or {}).get("seq") != (base or {}).get("seq"):
            raise ValueError(f"{self.name} moved on to version {now['seq'] if now else None} since it was read")
        got = fingerprint(self.spark.read.parquet(*parts))
        if expected is not None and got != expected:
            raise ValueError(f"{self.name}: staged rows {got} are not the expected ones {expected}")
        seq = base["seq"] + 1 if base else 1
        row = {"seq": seq, "parts": parts, "rows": got[0], "fingerprint": got[1]}
        self.spark.createDataFrame([row], _POINTER).coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/{self.name}/pointer/seq={seq}")
        return row

    def replace(self, rows: DataFrame, key: str) -> dict:
        """Publish exactly `rows` (one row a key): rows of other keys are gone, changed ones are new. Returns what changed."""
        base = self.current()
        require_none(rows.groupBy(key).count().filter(F.col("count") > 1).select(key), f"{self.name}: a key has several rows")
        part = self.stage(rows)
        new = self.spark.read.parquet(part)
        digest = lambda df, name: df.select(key, F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).alias(name))
        old = self.read(base) if base else new.limit(0)
        both = digest(old, "o").join(digest(new, "n"), key, "full")
        change = both.agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.count_if(F.col("o") != F.col("n")).alias("changed"), F.count_if(F.col("o") == F.col("n")).alias("kept")).first().asDict()
        return self.publish([part], base, fingerprint(rows)) | change

    def append(self, batch: DataFrame, key: str, identity: list[str]) -> dict:
        """Add the batch's rows of new keys. A row of a key that is there, or stands twice in the batch, must have the same identity (it is
        a replay); any conflict fails the batch as a whole and leaves the table."""
        base = self.current()
        plan = append_plan(self.read(base) if base else batch.limit(0), batch, key, identity)
        counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
        require_none(plan.filter("action = 'conflict'").select(key), f"{self.name}: conflicting replay")
        if not counts.get("append"):
            return (base or {}) | counts
        fresh = batch.dropDuplicates([key]).join(plan.filter("action = 'append'").select(key), key, "left_semi").select(*batch.columns)
        parts = [*(base["parts"] if base else []), self.stage(fresh)]
        return self.publish(parts, base) | counts


def append_plan(existing: DataFrame, batch: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """(key, action): append, replay (same identity as there) or conflict (another identity there, or two in the batch)."""
    h = F.sha2(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}), 256)
    b = batch.groupBy(key).agg(F.count_distinct(h).alias("ways"), F.min(h).alias("b"))
    j = b.join(existing.select(key, h.alias("e")), key, "left")
    action = F.when(F.col("ways") > 1, "conflict").when(F.col("e").isNull(), "append").when(F.col("e") == F.col("b"), "replay").otherwise("conflict")
    return j.select(key, action.alias("action"))


def preflight_issues(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, issue) of everything that forbids an embedding batch: rows (id, text, source, policy_status, embedding_allowed, content_hash)."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    # What a text tells is told before rows move, so that no text is shuffled or sorted.
    slim = rows.select(
        "id", "source", "policy_status", "embedding_allowed",
        (F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty"), no(F.sha2("text", 256) == F.col("content_hash")).alias("differs"),
    )
    many = rows.groupBy("id").agg(F.count("*").alias("copies"))
    j = slim.join(many, "id").join(sources.select("source", F.lit(True).alias("known")).distinct(), "source", "left")
    issues = [
        ("policy_denied", no(F.col("policy_status") == "allowed")),
        ("embedding_not_allowed", no(F.col("embedding_allowed"))),
        ("source_unknown", F.col("known").isNull()),
        ("duplicate_id", F.col("copies") > 1),
        ("empty_text", F.col("empty")),
        ("hash_mismatch", F.col("differs")),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in issues]))
    return j.select("id", F.explode(found).alias("issue")).distinct()


def embed_batch(rows: DataFrame, sources: DataFrame, embedder: Callable[[list[str]], np.ndarray], dimensions: int, batch: int = 64) -> DataFrame:
    """(id, vector) of a batch that passes its preflight as a whole; nothing is embedded where a single row fails."""
    require_none(preflight_issues(rows, sources).orderBy("id", "issue"), "embedding batch refused")
    return checked_vectors(embed(rows.select("id", "text"), embedder, batch), dimensions)


def checked_vectors(vectors: DataFrame, dimensions: int) -> DataFrame:
    """The vectors; a wrong dimension, a component that is not finite or a wrong norm fails the job."""
    issue = S.vector_issue(F.col("vector"), dimensions)
    return vectors.withColumn("vector", F.when(issue.isNotNull(), F.raise_error(F.concat(F.lit("vector of "), F.col("id").cast("string"), F.lit(": "), issue)).cast("array<float>")).otherwise(F.col("vector")))


def index_plan(current: DataFrame | None, inventory: DataFrame, profile: str) -> DataFrame:
    """(id, hash, action): reuse (same text and profile), embed (new or changed) or retire (no longer in the inventory)."""
    new = inventory.select("id", F.sha2("text", 256).alias("hash"))
    if current is None:
        return new.withColumn("action", F.lit("embed"))
    old = current.select("id", F.col("hash").alias("old"), (F.col("profile") == profile).alias("same"))
    action = F.when(F.col("hash").isNull(), "retire").when(F.col("same") & (F.col("old") == F.col("hash")), "reuse").otherwise("embed")
    return new.join(old, "id", "full").select("id", F.coalesce("hash", "old").alias("hash"), action.alias("action"))


def index_catalog(catalog: Snapshot, inventory: DataFrame, embedder: Callable[[list[str]], np.ndarray], dimensions: int, profile: str, dry_run: bool = False, before_switch: Callable[[], None] | None = None) -> dict:
    """Bring a catalog of vectors (id, hash, profile, vector) up to an inventory (id, text): unchanged texts keep their vectors, others
    are embedded, and the next version is published when it holds each id of the inventory once. A dry run only counts.
    before_switch is called when all is staged, for tests."""
    base = catalog.current()
    require_none(inventory.groupBy("id").count().filter("count > 1").select("id"), "inventory ids repeat")
    now = catalog.read(base) if base else None
    plan = index_plan(now, inventory, profile)
    report = {"embed": 0, "reuse": 0, "retire": 0} | {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
    if dry_run:
        return report
    todo = plan.filter("action = 'embed'").select("id", "hash")
    made = checked_vectors(embed(inventory.join(todo, "id").select("id", "text"), embedder), dimensions).join(todo, "id").select("id", "hash", F.lit(profile).alias("profile"), "vector")
    rows = made if now is None else made.unionByName(now.join(plan.filter("action = 'reuse'").select("id"), "id", "left_semi").select("id", "hash", "profile", "vector"))
    part = catalog.stage(rows)
    if before_switch:
        before_switch()
    want = fingerprint(inventory.select("id", F.sha2("text", 256).alias("hash")))
    got = fingerprint(catalog.spark.read.parquet(part).select("id", "hash"))
    if want != got:
        raise ValueError(f"staged catalog {got} does not hold the inventory {want}")
    return catalog.publish([part], base) | report
