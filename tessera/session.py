"""Session defaults and the shared-folder table helper that long jobs use to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; an existing session is reused as it is."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a new local one in local mode, else an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def persist_table(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write `df` as Parquet under the shared folder and read it back: the lineage ends at files that survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Rows and bytes up to which a checked table is broadcast; beyond either the same join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def broadcast_if_small(rows: DataFrame, most_rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for a broadcast where a count of its rows, and of the bytes of its texts and arrays, shows that it is small."""
    if rows.limit(most_rows + 1).count() > most_rows:
        return rows
    sized = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct", "variant")]
    if sized:
        # JSON text bounds what nested columns hold; plain texts and bytes are measured as they are.
        plain = lambda f: F.octet_length(F.col(f"`{f}`")) if rows.schema[f].dataType.typeName() in ("string", "binary") else F.length(F.to_json(F.struct(F.col(f"`{f}`"))))
        total = rows.agg(F.sum(reduce(lambda a, b: a + b, [F.coalesce(plain(c), F.lit(0)) for c in sized]))).first()[0] or 0
        if total > most_bytes:
            return rows
    return F.broadcast(rows)


#: Rows that a task gets of a table whose rows are dealt by their number.
ROWS_A_TASK = 1_000_000


def dealt(rows: DataFrame, *keys: str, share: int = ROWS_A_TASK) -> DataFrame:
    """Rows of an input table together by `keys`, in as many partitions as their number asks for: a task's share, and so its memory, stays the same however
    large the input is. Groups by these and further keys need no other shuffle."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // share)), *keys)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> Iterator[None]:
    """Jobs within pass their rows to Python in batches of at most so many rows and bytes: rows that hold whole texts or sets are large."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in bounds}
    try:
        for k, v in bounds.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
