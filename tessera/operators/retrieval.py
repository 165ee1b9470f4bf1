"""Batch retrieval: BM25 and cosine top-k, rank fusion, prototype labels, and metrics over result tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.window import Window

from tessera.functions import scalars as S
from tessera.session import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, persist_table, small_batches

TOKEN = "[a-z0-9]+"


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of an input that comes in fewer splits than there are cores (one small file) are dealt out; larger inputs stay as they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"))


def bm25(chunks: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, id, score, rank) of the k best chunks (id, text) for each query (query, text), by score and then id.

    Texts are split once. Where the queries' tokens are few enough to broadcast, a chunk stays one row, with its length and its counts
    of these tokens, and a batch of chunks leaves the k best of each query alone; else tokens and scores are joined and shuffled.
    Frequencies and the mean length cover all chunks; rows of one id are one chunk.
    """
    q = persist_table(queries.select("query", F.explode(F.array_distinct(_words("text"))).alias("token")).distinct(), "query-tokens")
    if not _small(q, "token"):
        return _joined_bm25(chunks, q, k, k1, b)
    told = q.toArrow()  # at most BROADCAST_ROWS short rows
    tokens, asked = (told[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("token", "query"))
    # Bound to the tasks as a broadcast variable: a task's closure would hold it anew.
    shared = chunks.sparkSession.sparkContext.broadcast([t.encode() for t in tokens.dictionary.to_pylist()])
    kind = chunks.schema["id"].dataType.simpleString()

    def count(batches):
        at = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            yield _token_counts(batch, at)

    with small_batches(chunks.sparkSession):
        t = persist_table(_spread(chunks.select("id", F.lower("text").cast("binary").alias("text"))).mapInArrow(count, f"id {kind}, dl long, terms array<int>, tfs array<long>"), "token-counts")
    again = persist_table(t.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select("id"), "repeated-ids")
    if not again.isEmpty():
        same, some = F.col("id").eqNullSafe(F.col("again")), broadcast_if_small(again).withColumnRenamed("id", "again")
        part = t.join(some, same, "left_semi")
        sums = part.select("id", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy("id", "x.terms").agg(F.sum("x.tfs").alias("tf"))
        sums = sums.groupBy("id").agg(F.collect_list(F.struct("terms", "tf")).alias("x")).select(F.col("id").alias("i"), F.col("x.terms").alias("terms"), F.col("x.tf").alias("tfs"))
        whole = part.groupBy("id").agg(F.sum("dl").alias("dl")).join(sums, F.col("id").eqNullSafe(F.col("i")), "left")
        none = lambda c, of: F.coalesce(c, F.array().cast(of)).alias(c)
        t = persist_table(t.join(some, same, "left_anti").unionByName(whole.select("id", "dl", none("terms", "array<int>"), none("tfs", "array<long>"))), "whole-counts")
    sizes = t.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = sizes["n"], sizes["avgdl"] or 1.0
    df = np.zeros(len(tokens.dictionary))
    for r in t.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow().to_pylist():  # a row a sought token
        df[r["term"]] = r["df"]
    facts = chunks.sparkSession.sparkContext.broadcast((asked.dictionary, np.log(1 + (n - df + 0.5) / (df + 0.5)), _postings(tokens.indices.to_numpy(), asked.indices.to_numpy(), len(tokens.dictionary))))

    def best(batches):
        ids, idf, blocks = facts.value
        floors: dict[int, np.ndarray] = {}
        for batch in batches:
            dl, tf, terms = batch.column(1).to_numpy(), batch.column(3).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())
            w = idf[terms] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / avgdl))
            for i, block in enumerate(blocks):
                query, col, score, floors[i] = _posting_top_k(block, terms, doc, w, batch.column(0), k, floors.get(i))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), batch.column(0).take(pa.array(col)), pa.array(score)], names=["query", "id", "score"])

    with small_batches(chunks.sparkSession, rows=500):
        rows = _spread(t.filter("id is not null and size(terms) > 0"))
        found = persist_table(rows.mapInArrow(best, f"query {queries.schema['query'].dataType.simpleString()}, id {kind}, score double"), "text-best")
    return top_k(found, k)


def _small(rows: DataFrame, *texts: str) -> bool:
    """Whether a written table may be held by every task: by its rows, and the bytes of its texts."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0).cast("long"))
    return rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and (rows.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


#: Bytes of a lower-case text: those of tokens as they are, others as blanks.
_TOKEN_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def _token_counts(batch: pa.RecordBatch, at: dict[bytes, int]) -> pa.RecordBatch:
    """(id, dl, terms, tfs) of a batch of lower-case texts (id, text): the number of all tokens, and the counts of the sought ones."""
    rows, dl, ends, terms, tfs = [], [], [0], [], []
    for i, text in enumerate(batch.column(1).to_pylist()):
        words = (text or b"").translate(_TOKEN_BYTES).split()
        if not words:
            continue
        for word, n in Counter(words).items():
            term = at.get(word)
            if term is not None:
                terms.append(term)
                tfs.append(n)
        rows.append(i)
        dl.append(len(words))
        ends.append(len(terms))
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind)) for v, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(dl, pa.int64()), *lists], names=["id", "dl", "terms", "tfs"])


def _postings(terms: np.ndarray, queries: np.ndarray, n_terms: int, most: int = 8192) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks (first query, queries, starts, members) of about `most` pairs of (term, query): the queries that hold a term."""
    before = np.cumsum(np.bincount(queries)) // most
    out = []
    for block in np.unique(before):
        mine = np.flatnonzero(before == block)
        has = np.flatnonzero((queries >= mine[0]) & (queries <= mine[-1]))
        has = has[np.argsort(terms[has], kind="stable")]
        out.append((int(mine[0]), len(mine), np.concatenate([[0], np.cumsum(np.bincount(terms[has], minlength=n_terms))]), queries[has] - mine[0]))
    return out


def _posting_top_k(block: tuple, terms: np.ndarray, doc: np.ndarray, w: np.ndarray, ids: pa.Array, k: int, floor: np.ndarray | None):
    """(query, row, score) of the k best rows for each query of a block, and each query's k best scores so far, below which none leaves."""
    first, width, starts, members = block
    n = starts[terms + 1] - starts[terms]
    i = np.repeat(np.arange(len(terms)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n - starts[terms], n)
    score = np.bincount(members[j] * len(ids) + doc[i], weights=w[i], minlength=width * len(ids)).reshape(width, len(ids))
    score = np.where(score > 0, np.round(score, 6), -np.inf)
    if floor is None:
        floor = np.full((width, k), -np.inf)
    floor = np.partition(np.concatenate([floor, score], axis=1), -k, axis=1)[:, -k:]
    row, col = _k_best(np.where(score >= floor[:, :1], score, -np.inf), ids, k)
    return first + row, col, score[row, col], floor


def _joined_bm25(chunks: DataFrame, q: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """bm25 for queries (query, token) with too many tokens to broadcast."""
    split = _spread(chunks.select("id", "text")).select("id", _words("text").alias("w")).filter("size(w) > 0")
    lengths = persist_table(split.groupBy("id").agg(F.sum(F.size("w")).alias("dl")), "lengths")
    t = split.select("id", F.explode("w").alias("token")).join(q.select("token").distinct(), "token", "left_semi")
    t = persist_table(t.groupBy("id", "token").agg(F.count("*").alias("tf")), "token-counts")
    sizes = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = sizes["n"], sizes["avgdl"] or 1.0
    df = persist_table(t.groupBy("token").agg(F.count("*").alias("df")), "frequencies")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = t.join(broadcast_if_small(df), "token").join(lengths, "id").select("id", "token", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))).alias("w"))
    return top_k(w.join(q, "token").groupBy("query", "id").agg(F.round(F.sum("w"), 6).alias("score")), k)


def containing(docs: DataFrame, items: DataFrame, run: int = 3) -> DataFrame:
    """(query, id): documents (id, text) that contain the whole text of an item (query, q), letter by letter; empty items are found nowhere.

    The words inside of an item (its first and last may be cut from longer ones) stand as whole words in every text that
    contains it: a hash of its first `run` such words, or of one where it has fewer, finds the candidates, which are
    then searched. Shorter items are found by their first characters among all runs of as many characters.
    """
    words = F.split("q", " ")
    items = persist_table(items.select("query", "q", words.alias("w"), F.when(F.size(words) >= run + 2, run).when(F.size(words) >= 3, 1).otherwise(0).alias("m")).filter("q is not null"), "items")

    def gram(w: Column, at: Column | int, m: int) -> Column:
        return F.xxhash64(*[F.get(w, at + j) for j in range(m)])

    long = items.filter("m > 0")
    if _small(long, "q"):
        out = _held_in(docs, long.select("query", "q", "m").toArrow())  # at most BROADCAST_ROWS rows
    else:
        out = _joined_candidates(docs, items, run, gram)
    # Shorter items may begin and end within words: runs of as many characters as their first six find the candidates.
    short = items.filter("m = 0 and q <> ''").withColumn("k", F.least(F.length("q"), F.lit(6)))
    for k in sorted(r["k"] for r in short.select("k").distinct().collect()):  # one to six
        starts = broadcast_if_small(persist_table(short.filter(F.col("k") == k).select("query", "q", F.substring("q", 1, k).alias("g")), "starts"))
        runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - (k - 1)), lambda i: F.substr("text", i, F.lit(k))))
        hits = _spread(docs).filter(F.length("text") >= k).select("id", "text", F.explode(runs).alias("g")).join(starts, "g")
        out = out.unionByName(hits.filter(F.expr("contains(text, q)")).select("query", "id"))
    return persist_table(out.distinct(), "contained")


def _held_in(docs: DataFrame, items: pa.Table) -> DataFrame:
    """(query, id): the documents that contain an item (query, q, m); its words from the second to the (m + 1)-th find the candidates in one pass."""
    texts = [q.encode() for q in items["q"].to_pylist()]
    starts: dict[int, dict[tuple, list[int]]] = {}
    for i, (q, m) in enumerate(zip(texts, items["m"].to_pylist(), strict=True)):
        starts.setdefault(m, {}).setdefault(tuple(q.split(b" ")[1 : m + 1]), []).append(i)
    shared = docs.sparkSession.sparkContext.broadcast((items["query"].combine_chunks(), texts, starts))

    def search(batches):
        queries, texts, starts = shared.value
        for batch in batches:
            hits, rows = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = text.split(b" ")
                for m, anchors in starts.items():
                    for gram in anchors.keys() & set(zip(*(words[j:] for j in range(m)), strict=False)):
                        for i in anchors[gram]:
                            if texts[i] in text:
                                hits.append(i)
                                rows.append(row)
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(hits, pa.int64())), batch.column(0).take(pa.array(rows, pa.int64()))], names=["query", "id"])

    kind = lambda t: t.simpleString()
    rows = _spread(docs.filter("text is not null").select("id", F.col("text").cast("binary").alias("text")))
    with small_batches(docs.sparkSession):
        return persist_table(rows.mapInArrow(search, f"query {kind(from_arrow_type(items['query'].type))}, id {kind(docs.schema['id'].dataType)}"), "held")


def _joined_candidates(docs: DataFrame, items: DataFrame, run: int, gram) -> DataFrame:
    """The same for items (query, q, w, m) that are too many to broadcast: hashes of words meet in a join."""

    def at_each(m: int):
        return lambda i: gram(F.col("w"), i, m)

    found = None
    for m in (run, 1):
        some = items.filter(F.col("m") == m)
        if some.isEmpty():
            continue
        anchors = broadcast_if_small(persist_table(some.select(gram(F.col("w"), 1, m).alias("h"), "query"), "anchors"))
        grams = _spread(docs).select("id", F.split("text", " ").alias("w")).filter(F.size("w") >= m)
        grams = grams.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - m), at_each(m))).alias("h"))
        hits = grams.join(anchors, "h").select("query", "id").distinct()
        found = hits if found is None else found.unionByName(hits)
    out = items.limit(0).select("query").crossJoin(docs.limit(0).select("id"))
    if found is not None:
        pairs = persist_table(found.distinct(), "candidates")
        pairs = pairs.join(broadcast_if_small(items.select("query", "q")), "query")
        out = docs.join(broadcast_if_small(persist_table(pairs, "sought")), "id").filter(F.expr("contains(text, q)")).select("query", "id")
    return out


def top_k(scored: DataFrame, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")).cast("long")
    return scored.withColumn("rank", r).filter(F.col("rank") <= k)


#: Rows and bytes of a block of vectors.
BLOCK_ROWS, BLOCK_BYTES = 8192, 4 << 20
#: Pairs of blocks that one task multiplies.
BLOCKS_A_TASK = 2_000


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, scope: str | None = None, block: int = 512) -> DataFrame:
    """(query, id, score, rank): exact cosines of a stated query set (query, q) against all vectors (id, v), the k best of each.

    Both sides are packed into blocks, each a row with a matrix, and written; every block of vectors meets every block of queries
    in matrix products of `block` queries. A task keeps the k best of its queries over all blocks it meets, and these alone leave it and are
    merged: what is written grows with the queries and the tasks that share one, not with pairs. No pair becomes a row, and neither side has to
    fit into a task. With `scope`, a column of both sides, only vectors whose value is the query's are met. Zero vectors, those that
    are not finite, and vectors of another length than the query's, have no cosine. Scores have six places; equal ones are ordered by id.
    """
    spark = vectors.sparkSession
    # Written before they meet: within the job below, eight vectors would be a batch, and so a block.
    with small_batches(spark):
        v = persist_table(_packed(_spread(vectors), "id", "v", scope), "vector-blocks")
        # A block of few queries would bring each block of vectors to Python for little work.
        full = max(1, -(-queries.count() // BLOCK_ROWS))
        q = persist_table(_packed(queries.repartition(full), "query", "q", scope), "query-blocks")
    tasks = max(2 * spark.sparkContext.defaultParallelism, v.count() * q.count() // BLOCKS_A_TASK)
    v = v.coalesce(max(1, -(-tasks // max(1, q.rdd.getNumPartitions()))))
    # A plain join would bring all blocks of equal length to one task.
    pairs = v.hint("shuffle_replicate_nl").join(q.withColumnsRenamed({c: f"q_{c}" for c in q.columns}), F.expr("d = q_d"))

    def best(batches):
        held: dict[str, _Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = ({c: batch.column(p + c)[i] for c in ("n", "ids", "scopes", "d", "data")} for p in ("", "q_"))
                n = y["n"].as_py()
                if n not in held:
                    held[n] = _Best(y, k, block)
                held[n].meet(x)
        for some in held.values():
            yield from some.rows()

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    # A row holds two matrices: a batch of Spark's default size would bring a task's whole share of them to Python at once.
    with small_batches(spark, rows=8):
        found = persist_table(pairs.mapInArrow(best, f"query {kind(queries, 'query')}, id {kind(vectors, 'id')}, score double"), "block-best")
    return top_k(found, k)


def _packed(rows: DataFrame, key: str, vector: str, scope: str | None) -> DataFrame:
    """Rows of vectors as blocks of at most BLOCK_ROWS and BLOCK_BYTES: (n, ids, scopes, d, data), n naming the block and data being a matrix of units, doubles with d columns.

    Lengths are taken here: in SQL, `unit_vector` takes a vector's length anew for each of its numbers.
    """
    s = F.col(scope).cast("string") if scope else F.lit(None).cast("string")
    size, most_rows = BLOCK_BYTES, BLOCK_ROWS

    def pack(batches):
        task, n = TaskContext.get().partitionId(), 0
        held: dict[int, pa.Table] = {}

        def blocks(d: int, full: bool):
            """Blocks of a length's held rows, or the full ones alone; what remains stays held."""
            nonlocal n
            some, most = held.pop(d), max(1, min(most_rows, size // (8 * d)))
            while some.num_rows >= (most if full else 1):
                part, some = some.slice(0, most).combine_chunks(), some.slice(most)
                x, ok = _unit_rows(part.column(2).chunk(0), d)
                if not ok.any():
                    continue
                keys = [part.column(i).chunk(0).filter(pa.array(ok)) for i in (0, 1)]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), c) for c in keys]
                yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{n}"]), *lists, pa.array([d], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["n", "ids", "scopes", "d", "data"])
                n += 1
            if some.num_rows:
                held[d] = some

        for batch in batches:
            lengths = pc.fill_null(batch.column(2).value_lengths(), 0).to_numpy()
            for d in np.unique(lengths[lengths > 0]).tolist():
                some = pa.Table.from_batches([batch.filter(pa.array(lengths == d))])
                held[d] = pa.concat_tables([held[d], some]) if d in held else some
                yield from blocks(d, full=True)
            if sum(8 * d * some.num_rows for d, some in held.items()) > 4 * size:  # many lengths
                for d in [*held]:
                    yield from blocks(d, full=False)
        for d in [*held]:
            yield from blocks(d, full=False)

    return rows.select(key, s.alias("s"), F.col(vector).cast("array<double>")).mapInArrow(pack, f"n string, ids array<{rows.schema[key].dataType.simpleString()}>, scopes array<string>, d int, data binary")


def _unit_rows(vectors: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of d numbers divided by their lengths, and which have one: not zero ones, nor those with a null or a number that is not finite."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, d)
    length = np.zeros(len(x))
    with np.errstate(all="ignore"):
        for j in range(d):  # in their order, as SQL adds them up
            length += x[:, j] ** 2
        x = x / np.sqrt(length)[:, None]
    ok = np.isfinite(x).all(axis=1)
    return x[ok], ok


def _matrix(block: dict) -> np.ndarray:
    return np.frombuffer(block["data"].as_buffer(), dtype="<f8").reshape(-1, block["d"].as_py())


class _Best:
    """The k best vectors of each query of a block, over the blocks of vectors it has met.

    Products in single precision, with a bound of their error, tell which pairs may be among the k best; these are computed in double.
    """

    def __init__(self, q: dict, k: int, rows: int) -> None:
        # Copies: slices would keep a whole batch.
        self.queries, self.scopes = (q[c].values.take(pa.array(np.arange(len(q["ids"].values)))) for c in ("ids", "scopes"))
        self.k, self.step = k, rows
        self.y = _matrix(q).copy()
        self.y32 = self.y.astype(np.float32)
        # Units and their products are rounded in single precision, on both sides of a comparison, and scores to six places.
        self.error = (self.y.shape[1] + 8) * 2.0**-23 + 1e-6
        self.floor = np.full((len(self.y), k), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.waiting = 0

    def meet(self, v: dict) -> None:
        x, ids = _matrix(v), v["ids"].values
        x32, place = x.astype(np.float32), _places(ids)
        a, b = _codes(self.scopes, v["scopes"].values) if self.scopes.null_count < len(self.scopes) else (None, None)
        for at in range(0, len(self.y), self.step):
            score = self.y32[at : at + self.step] @ x32.T
            if a is not None:
                mine = a[at : at + self.step, None]
                score[(mine != b[None]) | (mine < 0)] = -np.inf
            most, least = score.max(axis=1), self.floor[at : at + self.step].min(axis=1) - self.error
            rows = np.flatnonzero((most >= least) & (most > -np.inf))
            if not len(rows):
                continue
            score = score[rows] if len(rows) < len(score) else score
            least = np.maximum(least[rows], _kth_at_least(score, self.k) - self.error)
            maybe = score >= np.maximum(least, -4.0).astype(np.float32)[:, None]
            if np.count_nonzero(maybe) > 64 * self.k * len(rows):  # many equal vectors
                exact = np.where(maybe, np.round(self.y[at + rows] @ x.T, 6), -np.inf)
                row, col = _k_best(exact, ids, self.k)
                exact = exact[row, col]
            else:
                row, col = np.divmod(np.flatnonzero(maybe), len(x))
                exact = np.empty(len(row))
                for i in range(0, len(row), len(x)):
                    part = slice(i, i + len(x))
                    exact[part] = np.einsum("ij,ij->i", self.y[at + rows[row[part]]], x[col[part]])
                exact = np.round(exact, 6)
                row, col, exact = _first(row, exact, place[col], self.k, row, col, exact)
            self._hold(at + rows[row], exact, ids.take(pa.array(col)))

    def _hold(self, row: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        """At most k rows a query, those of a query together."""
        some, first = np.unique(row, return_index=True)
        new = np.full((len(some), self.k), -np.inf)
        at = np.searchsorted(some, row)
        new[at, np.arange(len(row)) - first[at]] = score
        both = np.concatenate([self.floor[some], new], axis=1)
        self.floor[some] = np.partition(both, -self.k, axis=1)[:, -self.k :]
        self.found.append((row, score, ids))
        self.waiting += len(row)
        if self.waiting > 4 * self.floor.size:
            self._merge()

    def _merge(self) -> None:
        row, score = (np.concatenate([f[i] for f in self.found]) for i in (0, 1))
        ids = pa.concat_arrays([f[2] for f in self.found])
        row, score, col = _first(row, score, _places(ids), self.k, row, score, np.arange(len(row)))
        self.found, self.waiting = [(row, score, ids.take(pa.array(col)))], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(query, id, score)"""
        if self.found:
            self._merge()
            row, score, ids = self.found[0]
            yield pa.RecordBatch.from_arrays([self.queries.take(pa.array(row)), ids, pa.array(score)], names=["query", "id", "score"])


def _codes(*sides: pa.Array) -> list[np.ndarray]:
    """Numbers of equal values of several arrays; -1 for null."""
    of = {s: i for i, s in enumerate({s for side in sides for s in side.to_pylist()} - {None})}
    return [np.array([of.get(s, -1) for s in side.to_pylist()]) for side in sides]


def _kth_at_least(score: np.ndarray, k: int) -> np.ndarray:
    """A bound that the k-th best of each row reaches: the k-th best of the best of groups of columns."""
    groups = max(64, 2 * k)
    deep = score.shape[1] // groups
    if not deep:
        return np.full(len(score), -np.inf)
    most = score[:, : groups * deep].reshape(len(score), deep, groups).max(axis=1)
    return np.partition(most, -k, axis=1)[:, -k]


def _places(ids: pa.Array) -> np.ndarray:
    """The place of each id in their order."""
    place = np.empty(len(ids), dtype=np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return place


def _first(row: np.ndarray, score: np.ndarray, place: np.ndarray, k: int, *columns: np.ndarray) -> list[np.ndarray]:
    """Columns of the k first of each row by score and then place, ordered so."""
    order = np.lexsort((place, -score, row))
    row = row[order]
    return [c[order][np.arange(len(row)) - np.searchsorted(row, row) < k] for c in columns]


def _k_best(score: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best finite scores of each row, by score and then the column's id."""
    least = np.partition(score, -k, axis=1)[:, -k][:, None] if score.shape[1] > k else -np.inf
    row, col = np.nonzero((score >= least) & (score > -np.inf))
    row, col = _first(row, score[row, col], _places(ids)[col], k, row, col)
    return row, col


def _units(rows: DataFrame, col: str) -> DataFrame:
    return rows.withColumn(col, S.unit_vector(F.col(col))).filter(F.col(col).isNotNull())


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fuse(rankings: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query, channel, id, rank): (query, id, score, channels). A repeated id keeps its first rank in a channel."""
    first = rankings.groupBy("query", "channel", "id").agg(F.min("rank").alias("rank"))
    out = first.groupBy("query", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("s"), F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("channels"))
    return out.select("query", "id", F.round("s", 9).alias("score"), "channels")


def prototype_labels(vectors: DataFrame, prototypes: DataFrame, confidence: float, margin: float) -> DataFrame:
    """(id, label, score, margin): the label of the nearest prototype (label, q); null below a confidence or margin threshold."""
    p = broadcast_if_small(persist_table(_units(prototypes, "q").select("label", "q"), "prototypes"))
    s = _units(vectors, "v").crossJoin(p).select("id", "label", F.round(_dot("v", "q"), 6).alias("score"))
    s = s.groupBy("id", "label").agg(F.max("score").alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "label")
    s = s.withColumns({"n": F.row_number().over(w), "next": F.lead("score").over(w)}).filter("n = 1")
    gap = F.round(F.col("score") - F.col("next"), 6)
    return s.select("id", F.when((F.col("score") >= confidence) & (gap >= margin), F.col("label")).alias("label"), "score", gap.alias("margin"))


def search_metrics(results: DataFrame, relevant: DataFrame, forbidden: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row: micro recall at k, mean reciprocal rank over queries with relevant ids (0 for a miss), and whether no forbidden id came back."""
    hit = results.filter(F.col("rank") <= k).join(relevant, ["query", "id"])
    per = relevant.groupBy("query").agg(F.count("*").alias("rel")).join(hit.groupBy("query").agg(F.count("*").alias("hits"), F.min("rank").alias("first")), "query", "left")
    m = per.agg((F.sum(F.coalesce("hits", F.lit(0))) / F.sum("rel")).alias("recall"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))
    bad = results.join(forbidden, "id", "left_semi").agg((F.count("*") == 0).alias("policy_safe"))
    return m.select(F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr")).crossJoin(bad).crossJoin(queries.agg(F.count("*").alias("queries")))


def percentile_rows(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Nearest-rank median and 95th percentile, and the maximum."""
    return rows.groupBy(*group).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.max(value).alias("most"))


def label_metrics(rows: DataFrame, expected: Column, predicted: Column) -> DataFrame:
    """(label, n, accuracy, f1) for each label that is expected or predicted."""
    p = rows.select(expected.alias("e"), predicted.alias("p"))
    one = p.select(F.explode(F.array_distinct(F.array("e", "p"))).alias("label"), "e", "p").filter("label is not null")
    tp = F.count_if((F.col("e") == F.col("label")) & (F.col("p") == F.col("label")))
    g = one.groupBy("label").agg(F.count_if(F.col("e") == F.col("label")).alias("n"), tp.alias("tp"), F.count_if(F.col("p") == F.col("label")).alias("pp"))
    return g.select("label", "n", F.round(F.when(F.col("n") > 0, F.col("tp") / F.col("n")), 6).alias("accuracy"), F.round(2.0 * F.col("tp") / (F.col("n") + F.col("pp")), 6).alias("f1"))
