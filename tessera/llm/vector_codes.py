"""Codebooks for the parts of vectors: exact Lloyd rounds on integer components over forests of anchors-hierarchy balls.

Blocks of vectors become forests, one metric tree a part position, built middle-out: anchors take their nearest points (points
that the triangle inequality leaves to their anchor are not measured), and balls over anchors are merged pairwise upwards until
one is left; balls of many points are split by anchors of their own. Each ball caches the sum and count of its points. A round
walks down a forest with the codebook: a ball inherits the entries that its parent could not rule out, rules out those beyond
the bisecting plane with the nearest one, and where one is left gives its cached sum and count to it. Only points of balls that
stay shared are measured one by one, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persist_table, small_enough

PARTS = 16
#: Components are held to this size, so that squared distances and sums fit in 64 bits.
MOST = 1 << 26
#: Vectors of a block, at most, and integers of a block; points of a ball that is split no further.
BLOCK_ROWS, BLOCK_INTS, LEAF = 4096, 1 << 20, 48


def _first_of(flag: np.ndarray, seg: np.ndarray, n: int) -> np.ndarray:
    """The first position of each segment (in ascending order) where flag holds; each has one."""
    at = np.flatnonzero(flag)
    return at[np.searchsorted(seg[at], np.arange(n))]


def grow(x: np.ndarray, seg: np.ndarray, n: int, k: int) -> np.ndarray:
    """The anchor (0 to k-1) that owns each point: in every segment, the point furthest from its anchor becomes the next anchor.

    seg is ascending and has every number under n. A point moves to a new anchor that is nearer than its own; it is not measured
    where its own is no further than half the way between both.
    """
    starts = np.searchsorted(seg, np.arange(n))
    anchors = np.empty((n, k, x.shape[1]))
    anchors[:, 0] = x[starts]
    owner = np.zeros(len(x), dtype=np.int64)
    dist = np.sqrt(np.square(x - anchors[seg, 0]).sum(axis=1))
    for j in range(1, k):
        far = np.maximum.reduceat(dist, starts)
        if not far.any():
            break
        anchors[:, j] = x[_first_of(dist == far[seg], seg, n)]
        between = np.sqrt(np.square(anchors[:, :j] - anchors[:, j : j + 1]).sum(axis=2))
        some = np.flatnonzero(2 * dist > between[seg, owner])
        d = np.sqrt(np.square(x[some] - anchors[seg[some], j]).sum(axis=1))
        nearer = d < dist[some]
        some = some[nearer]
        owner[some], dist[some] = j, d[nearer]
    return owner


class Forest:
    """Metric trees over the parts of one block. Node p < PARTS is the root of part p; children come after their parent's number
    was given; leaf[p, i] is the ball of part p of vector i."""

    def __init__(self, points: np.ndarray, leaf: np.ndarray, child: np.ndarray, radius: np.ndarray, count: np.ndarray, total: np.ndarray):
        self.points, self.leaf, self.child, self.radius, self.count, self.total = points, leaf, child, radius, count, total

    @classmethod
    def build(cls, points: np.ndarray, leaf_size: int = LEAF) -> Forest:
        """points: integers of shape (parts, vectors, components)."""
        parts, n, d = points.shape
        x = points.reshape(parts * n, d).astype(np.float64)
        leaf = np.repeat(np.arange(parts), n)
        roots = np.arange(parts)
        total = np.add.reduceat(x, roots * n, axis=0)
        count = np.full(parts, n)
        radius = np.maximum.reduceat(np.sqrt(np.square(x - (total / n)[leaf]).sum(axis=1)), roots * n)
        tree = {"child": [np.full((parts, 2), -1)], "radius": [radius], "count": [count], "total": [total]}
        nodes, split = parts, roots[(count > leaf_size) & (radius > 0)]
        while len(split):
            number = np.full(nodes, -1)
            number[split] = np.arange(len(split))
            at = np.flatnonzero(number[leaf] >= 0)
            at = at[np.argsort(number[leaf[at]], kind="stable")]
            seg = number[leaf[at]]
            s = len(split)
            k = max(2, int(np.ceil(np.sqrt(np.bincount(seg, minlength=s).max()))))
            own = seg * k + grow(x[at], seg, s, k)
            cells = s * k
            c = np.bincount(own, minlength=cells)
            t = np.stack([np.bincount(own, x[at, i], cells) for i in range(d)], axis=1)
            mean = t / np.maximum(c, 1)[:, None]
            r = np.zeros(cells)
            np.maximum.at(r, own, np.sqrt(np.square(x[at] - mean[own]).sum(axis=1)))
            ids, new, pairs = cls._merge(split, k, c.reshape(s, k), t.reshape(s, k, d), mean.reshape(s, k, d), r.reshape(s, k), nodes)
            leaf[at] = ids.ravel()[own]
            for key, rows in zip(("child", "radius", "count", "total"), new, strict=True):
                tree[key].append(rows)
            tree_child = np.concatenate(tree["child"])
            tree_child[split] = pairs
            tree["child"] = [tree_child]
            nodes += len(new[0])
            some = (c > leaf_size) & (r > 0) & (c < np.bincount(seg, minlength=s)[np.arange(cells) // k])
            split = np.sort(ids.ravel()[some])
        child, radius, count, total = (np.concatenate(tree[k]) for k in ("child", "radius", "count", "total"))
        return cls(points, leaf.reshape(parts, n).astype(np.int32), child.astype(np.int32), radius, count.astype(np.int64), np.rint(total).astype(np.int64))

    @staticmethod
    def _merge(split: np.ndarray, k: int, count: np.ndarray, total: np.ndarray, mean: np.ndarray, radius: np.ndarray, nodes: int):
        """Merge the balls of each segment pairwise, those with the smallest common ball first; the last pair are the children of the
        split ball. Returns the numbers of the anchors' balls, the new rows of the tree, and the children of the split balls."""
        s = len(split)
        live = count > 0
        width = live.sum(axis=1)
        ids = np.full((s, k), -1)
        ids[live] = nodes + np.arange(int(width.sum()))
        child = [np.full((int(width.sum()), 2), -1)]
        rads, counts, totals = [radius[live]], [count[live]], [total[live]]
        nodes += int(width.sum())
        anchor_ids, now = ids.copy(), ids
        count, total, mean, radius = count.copy(), total.copy(), mean.copy(), radius.copy()

        def cost(a_mean, a_rad, b_mean, b_rad):
            gap = np.sqrt(np.square(a_mean - b_mean).sum(axis=-1))
            return np.maximum((gap + a_rad + b_rad) / 2, np.maximum(a_rad, b_rad))

        c = cost(mean[:, :, None], radius[:, :, None], mean[:, None], radius[:, None])
        c[~(live[:, :, None] & live[:, None]) | (np.arange(k)[:, None] >= np.arange(k))[None]] = np.inf
        last = np.full((s, 2), -1)
        while True:
            left = live.sum(axis=1)
            go = np.flatnonzero(left > 1)
            if not len(go):
                break
            best = c[go].reshape(len(go), -1).argmin(axis=1)
            i, j = best // k, best % k
            pair = np.stack([now[go, i], now[go, j]], axis=1)
            t, n = total[go, i] + total[go, j], count[go, i] + count[go, j]
            m = t / n[:, None]
            r = np.maximum(np.sqrt(np.square(m - mean[go, i]).sum(axis=1)) + radius[go, i], np.sqrt(np.square(m - mean[go, j]).sum(axis=1)) + radius[go, j])
            total[go, i], count[go, i], mean[go, i], radius[go, i] = t, n, m, r
            live[go, j] = False
            end = left[go] == 2
            last[go[end]] = pair[end]
            on = ~end
            now[go[on], i[on]] = nodes + np.arange(int(on.sum()))
            child.append(pair[on])
            rads.append(r[on])
            counts.append(n[on])
            totals.append(t[on])
            nodes += int(on.sum())
            c[go, j], c[go, :, j] = np.inf, np.inf
            fresh = cost(m[:, None], r[:, None], mean[go], radius[go])
            fresh[~live[go]] = np.inf
            order = np.arange(k)[None]
            c[go, i] = np.where(order > i[:, None], fresh, np.inf)
            c[go, :, i] = np.where(order < i[:, None], fresh, np.inf)
        return anchor_ids, (np.concatenate(child), np.concatenate(rads), np.concatenate(counts), np.concatenate(totals)), last

    def walk(self, books: np.ndarray):
        """(node, entry) of balls wholly owned by an entry, and (node, candidate entries) of the leaves that stay shared.

        books: integers of shape (parts, entries, components). An entry equal to one of lower index can own nothing.
        """
        parts, k, _ = books.shape
        b = books.astype(np.float64)
        size = np.square(b).sum(axis=2)
        same = (books[:, :, None] == books[:, None]).all(axis=3)
        part, node = np.arange(parts), np.arange(parts)
        open_ = ~(same & (np.arange(k)[:, None] > np.arange(k))[None]).any(axis=2)
        apart = np.sqrt(np.square(b[:, :, None] - b[:, None]).sum(axis=3))
        owned, shared = [], []
        while len(node):
            mean = self.total[node] / self.count[node][:, None]
            d2 = np.empty((len(node), k))
            for p in range(parts):
                at = part == p
                d2[at] = size[p] - 2 * mean[at] @ b[p].T
            own = np.square(mean).sum(axis=1)
            d2[~open_] = np.inf
            best = d2.argmin(axis=1)
            low = d2[np.arange(len(node)), best]
            # Squared distances differ by more than 2 R times the entries' distance where the ball lies on one side of their plane.
            slack = 1e-9 * (own[:, None] + size[part] + 1)
            open_ = open_ & (d2 - low[:, None] <= 2 * self.radius[node][:, None] * apart[part, best] * (1 + 1e-9) + slack)
            one = open_.sum(axis=1) == 1
            owned.append((node[one], best[one]))
            end = ~one & (self.child[node, 0] < 0)
            shared.append((node[end], open_[end]))
            down = ~one & ~end
            node, part, open_ = self.child[node[down]].ravel().astype(np.int64), np.repeat(part[down], 2), np.repeat(open_[down], 2, axis=0)
        return tuple(np.concatenate([o[i] for o in owned]) for i in (0, 1)), tuple(np.concatenate([o[i] for o in shared]) for i in (0, 1))

    def _measured(self, books: np.ndarray, shared) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each part: the vectors in shared leaves and the nearest of their candidate entries, ties to the lower index."""
        nodes, open_ = shared
        place = np.full(len(self.count), -1)
        place[nodes] = np.arange(len(nodes))
        for p in range(len(books)):
            mine = place[self.leaf[p]]
            at = np.flatnonzero(mine >= 0)
            if not len(at):
                continue
            row, entry = np.nonzero(open_[mine[at]])
            d2 = np.square(self.points[p][at[row]].astype(np.int64) - books[p][entry]).sum(axis=1)
            starts = np.searchsorted(row, np.arange(len(at)))
            low = np.minimum.reduceat(d2, starts)
            yield p, at, entry[_first_of(d2 == low[row], row, len(at))]

    def sums(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, counts) of the parts that each entry takes."""
        parts, k, d = books.shape
        total, count = np.zeros((parts, k, d), dtype=np.int64), np.zeros((parts, k), dtype=np.int64)
        part = self._parts()
        (node, entry), shared = self.walk(books)
        np.add.at(total, (part[node], entry), self.total[node])
        np.add.at(count, (part[node], entry), self.count[node])
        for p, at, e in self._measured(books, shared):
            np.add.at(total[p], e, self.points[p][at].astype(np.int64))
            count[p] += np.bincount(e, minlength=k)
        return total, count

    def _parts(self) -> np.ndarray:
        """The part of each node, from the roots down."""
        part = np.full(len(self.count), -1)
        node = np.arange(len(self.points))
        part[node] = node
        while len(node):
            node = node[self.child[node, 0] >= 0]
            down = self.child[node].astype(np.int64)
            part[down] = part[node][:, None]
            node = down.ravel()
        return part

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each part of each vector, squared distances summed over parts)."""
        parts, n = self.leaf.shape
        (node, entry), shared = self.walk(books)
        own = np.full(len(self.count), -1)
        own[node] = entry
        while len(node):  # balls under an owned one
            node = node[self.child[node, 0] >= 0]
            down = self.child[node].astype(np.int64)
            own[down] = own[node][:, None]
            node = down.ravel()
        code = own[self.leaf].astype(np.int64)
        for p, at, e in self._measured(books, shared):
            code[p, at] = e
        error = np.zeros(n, dtype=np.int64)
        for p in range(parts):
            error += np.square(self.points[p].astype(np.int64) - books[p][code[p]]).sum(axis=1)
        return code.T.astype(np.uint8), error

    _KINDS = {"points": None, "leaf": "<i4", "child": "<i4", "radius": "<f8", "count": "<i8", "total": "<i8"}

    def pack(self) -> dict[str, bytes]:
        """The arrays as bytes; points in the narrowest type that holds them (its name goes before them)."""
        most = int(np.abs(self.points).max(initial=0))
        kind = "<i1" if most <= 127 else "<i2" if most <= 32767 else "<i4"
        out = {"points": kind.encode() + self.points.astype(kind).tobytes()}
        return out | {k: getattr(self, k).astype(t).tobytes() for k, t in self._KINDS.items() if t}

    @classmethod
    def unpack(cls, row: dict[str, bytes], parts: int, d: int) -> Forest:
        a = {k: np.frombuffer(row[k], dtype=t) for k, t in cls._KINDS.items() if t}
        points = np.frombuffer(row["points"][3:], dtype=row["points"][:3].decode())
        return cls(points.reshape(parts, -1, d), a["leaf"].reshape(parts, -1), a["child"].reshape(-1, 2), a["radius"], a["count"], a["total"].reshape(-1, d))


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component, held to MOST."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * 256, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))


_TREE = "points binary, leaf binary, child binary, radius binary, count binary, total binary"


def _forests(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """One row for each block of rows (vec_id, label, v): ids, labels and the forest."""
    size = max(1, min(BLOCK_ROWS, BLOCK_INTS // width))
    d = width // parts

    def block(part):
        n = part.num_rows
        x = part.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, parts, d).transpose(1, 0, 2)
        packed = Forest.build(x).pack()
        ends = pa.array([0, n], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, part.column(i).combine_chunks()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*lists, *[pa.array([v], pa.binary()) for v in packed.values()]], names=["ids", "labels", *packed])

    def build(batches):
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= size:
                rows_ = pa.Table.from_batches(held)
                yield block(rows_.slice(0, size))
                held, count = rows_.slice(size).to_batches(), count - size
        if count:
            yield block(pa.Table.from_batches(held))

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(build, f"ids array<{kind['vec_id']}>, labels array<{kind['label']}>, {_TREE}")


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, list]:
    """((vec_id, label, code, error) of every kept row, the codebooks as [part][entry][component]).

    Rows whose vector is null, or holds a null or a component that is not finite, are not kept. Of the lengths that are positive
    multiples of `parts`, the one that most rows have counts (ties: the longest): rows of other lengths come back with null code
    and error. Components beyond 2^18 count as 2^18. Codebooks start as the first `entries` vectors by id (null ids last, equal
    ids by their integers); with fewer rows they are smaller. Repeated rows count as often as they stand there; an empty table
    gives an empty result. Other columns are not read. At most 256 entries, so that a code is a byte.
    """
    assert 0 < entries <= 256
    v = F.col("vector")
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).filter(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & v.isNotNull()
    )
    lengths = [(r["n"], r["size"]) for r in kept.groupBy(F.size(v).alias("size")).agg(F.count("*").alias("n")).filter(f"size > 0 and size % {parts} = 0").orderBy(F.desc("n"), F.desc("size")).limit(1).collect()]
    rows = kept.withColumn("v", integers(v))
    if not lengths:
        return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), []
    width = lengths[0][1]
    d = width // parts
    fit = rows.filter(F.size("v") == width)
    # Ids alone find where the first ones end; only rows up to there are sorted with their vectors.
    ids = persist_table(fit.select("vec_id").filter("vec_id is not null").orderBy("vec_id").limit(entries), "first-ids").agg(F.count("*"), F.max("vec_id")).first()
    near = fit.filter(F.col("vec_id") <= F.lit(ids[1])) if ids[0] == entries else fit
    first = near.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts, d).transpose(1, 0, 2)
    forests = persist_table(_forests(fit.select("vec_id", "label", "v"), width, parts), "forests")

    def trees(batch):
        names = [c.split()[0] for c in _TREE.split(", ")]
        for i in range(batch.num_rows):
            yield i, Forest.unpack({k: batch.column(k)[i].as_py() for k in names}, parts, d)

    for _ in range(rounds):
        now = books

        def sums(batches, now=now):
            total, count = np.zeros(now.shape, dtype=np.int64), np.zeros(now.shape[:2], dtype=np.int64)
            for batch in batches:
                for _, tree in trees(batch):
                    t, c = tree.sums(now)
                    total += t
                    count += c
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()), *[pa.array(total[p, e, i], pa.int64()) for i in range(d)]], names=["p", "e", "n", *[f"s{i}" for i in range(d)]])

        schema = "p int, e int, n long, " + ", ".join(f"s{i} long" for i in range(d))
        got = forests.select(*[c.split()[0] for c in _TREE.split(", ")]).mapInArrow(sums, schema).groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(d)])
        books = now.copy()
        for r in got.collect():  # a row an entry at most
            books[r["p"], r["e"]] = [r[f"s{i}"] // r["n"] for i in range(d)]
    last = books

    def code(batches):
        for batch in batches:
            for i, tree in trees(batch):
                codes, error = tree.codes(last)
                text = codes.tobytes().hex()
                step = 2 * parts
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[j : j + step] for j in range(0, len(text), step)], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    coded = forests.mapInArrow(code, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")
    other = rows.filter(F.size("v") != width).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return persist_table(coded.unionByName(other), "codes"), books.tolist()


def books_sha256(books: list) -> str:
    """SHA-256 of all components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()


def with_label_error(coded: DataFrame, salts: int = 32) -> DataFrame:
    """Adds label_error: error summed over the rows of an equal label, null labels together. Labels too many to broadcast are joined
    by shuffle, each in `salts` copies, so that rows of a hot label meet in as many tasks."""
    totals = persist_table(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    if small_enough(totals, 100_000, F.length(F.col("of").cast("string")) if totals.schema["of"].dataType.typeName() == "string" else None):
        return coded.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return coded.withColumn("at", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int")).join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("at") == F.col("salt")), "left").drop("of", "at", "salt")
