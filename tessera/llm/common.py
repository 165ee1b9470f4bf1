"""Helpers that the operators of this subpackage share: byte tokenizing in numpy and shared-folder tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words, and the A-Z to a-z table.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SEP = np.zeros(256, dtype=bool)
IS_SEP[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

U64 = np.uint64
#: Bytes that a broadcast side with columns of no fixed size may have.
BROADCAST_BYTES = 64 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a new local folder in local mode, else an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


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


def persist_table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder as Parquet and read it back, so that lost executors lose nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    schema = df.schema
    with small_batches(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Let the driver drop what finished jobs left: plans, broadcasts, and shuffle files of tables that are written by now, which stay on
    the executors' disks until the driver collects its garbage. For operators of many jobs, between their phases."""
    spark.sparkContext._jvm.java.lang.System.gc()


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32(id as text) mod n; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if not _POW or len(_POW["b"]) < n:
        m = max(n, 1 << 20)
        for k, v in (("b", _BASE), ("i", _INV)):
            p = np.full(m, v, dtype=U64)
            p[0] = 1
            _POW[k] = np.cumprod(p, dtype=U64)
    return _POW["b"], _POW["i"]


def span_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [starts, ends) of a, by differences of one running polynomial; few arrays stand at once."""
    b, inv = powers(len(a) + 1)
    t = a.astype(U64)
    t += U64(1)
    t *= b[: len(a)]
    np.cumsum(t, out=t)
    last = t[ends - 1]
    last -= np.where(starts > 0, t[starts - 1], U64(0))
    return mix(last * inv[starts] + (ends - starts).astype(U64))


def slices(texts: list, max_bytes: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts (null: empty) of about max_bytes together: (index of the first, texts as UTF-8)."""
    start, size, run = 0, 0, []
    for i, t in enumerate(texts):
        b = b"" if t is None else t if isinstance(t, bytes) else t.encode()
        if run and size + len(b) > max_bytes:
            yield start, run
            start, size, run = i, 0, []
        run.append(b)
        size += len(b) + 1
    if run:
        yield start, run


def words(run: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a run of texts, and the number of words before each text (one more entry than texts)."""
    lens = np.fromiter((len(b) + 1 for b in run), dtype=np.int64, count=len(run))
    a = np.frombuffer(b" ".join(run) + b" ", dtype=np.uint8)
    if lower:
        a = LOWER[a]
    sep = IS_SEP[a]
    prev = np.empty_like(sep)
    prev[0] = True
    prev[1:] = sep[:-1]
    starts = np.flatnonzero(~sep & prev)
    ends = np.flatnonzero(sep & ~prev)
    h = span_hashes(a, starts, ends)
    bounds = np.zeros(len(run) + 1, dtype=np.int64)
    np.cumsum(lens, out=bounds[1:])
    return h, np.searchsorted(starts, bounds)


_SHINGLE_MULT = [U64(m) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(run: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct k-word shingles (64-bit hashes) of each text, concatenated, and their bounds.

    A text of 1 to k-1 words has its whole word sequence as the only shingle; one without words has none.
    """
    w, at = words(run)
    n = np.diff(at)
    doc_of = np.repeat(np.arange(len(run)), n)
    m = len(w)
    hashes, docs = [], []
    if m >= k:
        h = np.zeros(m - k + 1, dtype=U64)
        for j in range(k):
            h += w[j : m - k + 1 + j] * _SHINGLE_MULT[j % 5] + U64(j // 5)
        ok = doc_of[: m - k + 1] == doc_of[k - 1 :]
        hashes.append(mix(h[ok]))
        docs.append(doc_of[: m - k + 1][ok])
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        sh = n[short].astype(U64)
        for t in range(k - 1):
            has = n[short] > t
            sh[has] = mix(sh[has] * U64(31) + w[at[short[has]] + t])
        hashes.append(sh)
        docs.append(short)
    if not hashes:
        return np.empty(0, dtype=U64), np.zeros(len(run) + 1, dtype=np.int64)
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.searchsorted(d, np.arange(len(run) + 1))


def small_enough(df: DataFrame, max_rows: int, size: Column | None = None, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a (persisted) table may be broadcast: at most max_rows rows and, where rows have no fixed size, at most max_bytes
    in all by the column size."""
    if df.limit(max_rows + 1).count() > max_rows:
        return False
    return size is None or (df.agg(F.sum(size)).first()[0] or 0) <= max_bytes
