"""The prefix trie of conversations, built by range-partitioned shards under a skeleton of splitter paths.

A conversation is a path of turn keys (MD5 of role and text, 16 bytes). Splitters are drawn from the paths, and the trie of their
paths, the skeleton, is broadcast: a node that is no prefix of a splitter lies within one range. Each range is a sorted shard
that finishes its own nodes; for the skeleton's nodes it sends partial aggregates, which are sums and minima but for what the
skeleton itself tells (its nodes' children, and the turn of each that is kept once).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import persist_table

KEY = 16
#: Conversations of a shard and bytes of its paths, about; shards and skeleton nodes, at most; rows drawn for a splitter.
SHARD_ROWS, SHARD_BYTES, MOST_SHARDS, MOST_NODES, DRAWN = 20_000, 32 << 20, 4096, 500_000, 16


def unsigned_crc32(value: Column) -> Column:
    return F.crc32(value.cast("string").cast("binary"))


def conversation_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, lens) of every conversation as it stands: its turns' keys one after the other, and code points of their texts.

    Turns are ordered by turn (null first); equal turns by their keys. Null role or text is empty. Rows without conv_id are of no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary")))
    rows = turns.filter("conv_id is not null").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), "turn", key.alias("key"), F.length(text).alias("len"))
    of = rows.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "key", "len")), _by_turn).alias("t"))
    return of.select("base", "conv_id", F.col("t.key").alias("keys"), F.col("t.len").alias("lens"))


def _by_turn(a: Column, b: Column) -> Column:
    less = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    turn = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1).otherwise(less(a["turn"], b["turn"]))
    return F.coalesce(turn, less(a["key"], b["key"]), less(a["len"], b["len"]), F.lit(0))


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, lens) of conversations rebuilt: the first h turns of conversation c - c % 100 (h: crc32(decimal c) % 6), then c's
    own after its first h. A base and the at most 100 conversations that take turns from it lie together by one shuffle of keys."""
    h = (unsigned_crc32(F.col("conv_id")) % 6).cast("int")
    mates = Window.partitionBy("base")
    own = lambda c: F.when(F.size(c) > F.col("h"), F.slice(c, F.col("h") + 1, F.size(c) - F.col("h"))).otherwise(F.slice(c, 1, 0))
    first = lambda c: F.first(F.when(F.col("conv_id") == F.col("base"), F.slice(c, 1, 5)), ignorenulls=True).over(mates)
    led = lambda c, of: F.concat(F.when(F.col(of).isNull(), F.slice(c, 1, 0)).otherwise(F.slice(of, F.lit(1), F.col("h"))), own(c))
    d = conversation_paths(turns).withColumn("h", h).withColumn("first_keys", first("keys")).withColumn("first_lens", first("lens"))
    return d.select("conv_id", F.array_join(F.transform(led(F.col("keys"), "first_keys"), lambda k: F.hex(k)), "").alias("path"), led(F.col("lens"), "first_lens").alias("lens")).select("conv_id", F.unhex("path").alias("path"), "lens")


class Skeleton:
    """The trie of splitter paths. Node 0 is the root; a node's number is its order of birth, so parents come before children."""

    def __init__(self, splitters: list[tuple[bytes, int, list[int]]]):
        self.splitters = [s[:2] for s in splitters]
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.len = [-1], [0], [0]
        for path, _, lens in splitters:
            node = 0
            for d, n in enumerate(lens):
                at = (node, path[d * KEY : d * KEY + KEY])
                if at not in self.child:
                    self.child[at] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(d + 1)
                    self.len.append(n)
                node = self.child[at]

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.splitters, (path, conv))


def choose_splitters(paths: DataFrame, rows: int, size: int) -> Skeleton:
    """Splitters at even steps of a bounded sample (by hash) of paths. Where their trie is larger than MOST_NODES, every second is left out."""
    spark = paths.sparkSession
    shards = max(-(-rows // SHARD_ROWS), -(-size // SHARD_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = max(1, min(shards, MOST_SHARDS, rows))
    # The sample holds at most some 256 MB of keys: longer paths, fewer rows.
    want = int(min(DRAWN * shards, max(shards, (256 << 20) * rows // max(size, 1))))
    share = min(1.0, 1.5 * want / rows)
    drawn = paths.filter(F.pmod(F.xxhash64("conv_id", F.lit("split")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(4 * want)
    got = sorted((bytes(r["path"]), r["conv_id"], r["lens"]) for r in drawn.collect())
    cuts = sorted({len(got) * i // shards for i in range(1, shards)} - {0}) if got else []
    chosen = [got[i] for i in cuts]
    while sum(len(s[2]) for s in chosen) > MOST_NODES:
        chosen = chosen[1::2]
    return Skeleton(chosen)


_LOCAL = "node int, shard int, conv_id long, depth long, parent_conv_id long, parent_node int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends binary"
_NAMES = [c.split()[0] for c in _LOCAL.split(", ")]


def shard_nodes(rows: list[tuple[bytes, int, list[int]]], skeleton: Skeleton, shard: int) -> list[tuple]:
    """Rows of _LOCAL for one shard: rows (path, conv_id, lens) are sorted. Nodes of the skeleton give partial aggregates: children and
    leaves that are not of the skeleton, and each skeleton turn counted for every member (kept once, it is taken off in the reduction)."""
    conv, depth, up, mark, n, children, leaves, saved, size, ends = ([] for _ in range(10))
    stack: list[int] = []
    last = b""
    for path, c, lens in rows:
        d = len(lens)
        common = 0
        if stack:
            top = min(len(path), len(last)) // KEY
            while common < top and path[common * KEY : common * KEY + KEY] == last[common * KEY : common * KEY + KEY]:
                common += 1
            del stack[common + 1 :]
        for k in range(len(stack), d + 1):
            over = stack[-1] if stack else -1
            stack.append(len(conv))
            conv.append(c)
            depth.append(k)
            up.append(over)
            mark.append(0 if k == 0 else skeleton.child.get((mark[over], path[(k - 1) * KEY : k * KEY]), -1) if mark[over] >= 0 else -1)
            size.append(lens[k - 1] if k else 0)
            n.append(0)
            children.append(0)
            leaves.append(0)
            saved.append(0)
            ends.append([])
        n[stack[d]] += 1
        ends[stack[d]].append(c)
        conv[stack[d]] = min(conv[stack[d]], c)
        last = path
    for i in range(len(conv) - 1, -1, -1):
        local = mark[i] < 0
        saved[i] += (n[i] - local) * size[i]
        if local and not children[i]:
            leaves[i] = 1
        over = up[i]
        if over >= 0:
            n[over] += n[i]
            saved[over] += saved[i]
            leaves[over] += leaves[i]
            children[over] += local
            conv[over] = min(conv[over], conv[i])
    out = []
    for i in range(len(conv)):
        local, over = mark[i] < 0, up[i]
        joined = ",".join(map(str, ends[i])).encode()
        out.append(
            (
                None if local else mark[i], shard, conv[i], depth[i], conv[over] if local and mark[over] < 0 else None, mark[over] if local and mark[over] >= 0 else None,
                n[i], children[i], leaves[i], saved[i], hashlib.sha256(joined).hexdigest() if local else None, None if local or not joined else joined,
            )
        )
    return out


def _reduce(nodes: DataFrame, skeleton: Skeleton) -> list[tuple]:
    """Final rows of the skeleton's nodes, with their numbers: at most MOST_NODES, and no member but the least."""
    partial = nodes.filter("node is not null")
    sums = partial.groupBy("node").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]).collect()

    def digest(batches):
        # A node's members that end there, in ranges of ascending ids: SHA-256 reads them in turn, so one task streams a node's ranges.
        node, sha = None, None
        done: list[tuple[int, str]] = []
        for batch in batches:
            for at, joined in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at != node:
                    if sha is not None:
                        done.append((node, sha.hexdigest()))
                    node, sha = at, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(joined.as_buffer())
        if sha is not None:
            done.append((node, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.int32()), pa.array([h for _, h in done], pa.string())], names=["node", "sha"])

    chunks = partial.filter("ends is not null").select("node", "shard", "ends").repartition("node").sortWithinPartitions("node", "shard").select("node", "ends")
    shas = {r["node"]: r["sha"] for r in chunks.mapInArrow(digest, "node int, sha string").collect()}
    rows = {r["node"]: r.asDict() for r in sums}
    count = len(skeleton.parent)
    children, leaves, once = [0] * count, [0] * count, [0] * count
    for i in range(count - 1, -1, -1):
        over = skeleton.parent[i]
        if not children[i] and not rows[i]["n_children"]:
            leaves[i] = 1
        once[i] += skeleton.len[i]
        if over >= 0:
            children[over] += 1
            leaves[over] += leaves[i]
            once[over] += once[i]
    nothing = hashlib.sha256(b"").hexdigest()
    return [
        (i, rows[i]["conv_id"], skeleton.depth[i], rows[skeleton.parent[i]]["conv_id"] if i else None, rows[i]["n_convs"], rows[i]["n_children"] + children[i], rows[i]["n_leaves"] + leaves[i], rows[i]["saved_tokens"] - once[i], shas.get(i, nothing))
        for i in range(count)
    ]


def trie_of_paths(paths: DataFrame) -> DataFrame:
    """One row a node of the trie of paths (conv_id, path, lens): see conversation_trie."""
    spark = paths.sparkSession
    paths = persist_table(paths, "paths")
    rows, size = paths.agg(F.count("*"), F.coalesce(F.sum(F.length("path")), F.lit(0))).first()
    out = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not rows:
        return spark.createDataFrame([], out)
    skeleton = choose_splitters(paths, rows, size)
    share = spark.sparkContext.broadcast(skeleton)

    def place(batches):
        find = share.value.shard
        for batch in batches:
            shard = [find(p, c) for p, c in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], names=["conv_id", "path", "lens", "shard"])

    def finish(batches):
        trie, held, shard = share.value, [], None

        def table(nodes):
            for lo in range(0, len(nodes), 20_000):
                cols = zip(*nodes[lo : lo + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=_NAMES)

        kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in _LOCAL.split(", ")]
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[0] != shard:
                    if held:
                        yield from table(shard_nodes(held, trie, shard))
                    shard, held = row[0], []
                held.append(row[1:])
        if held:
            yield from table(shard_nodes(held, trie, shard))

    # A shard is sorted in one task; ids of copies of a path are parted as well, so a hot path is many shards.
    sharded = paths.mapInArrow(place, "conv_id long, path binary, lens array<int>, shard int").repartition(len(skeleton.splitters) + 1, "shard")
    nodes = persist_table(sharded.sortWithinPartitions("shard", "path", "conv_id").select("shard", "path", "conv_id", "lens").mapInArrow(finish, _LOCAL), "trie")
    final = _reduce(nodes, skeleton)
    top = spark.createDataFrame([r[1:] for r in final], out)
    parents = spark.createDataFrame([(r[0], r[1]) for r in final], "number int, of long")
    names = [c.split()[0] for c in out.split(", ")]
    # The skeleton has at most MOST_NODES rows of two numbers: a bound of some megabytes.
    local = nodes.filter("node is null").join(F.broadcast(parents), F.col("parent_node") == F.col("number"), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "of"))
    return local.select(*names).unionByName(top)


def conversation_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the trie of rebuilt
    conversations (rebuilt_paths): a node is a distinct sequence of first turns, the root the empty one.

    conv_id: least member; parent_conv_id: the parent's (root: null); n_leaves: childless nodes in the subtree; saved_tokens: over
    the subtree, (n_convs - 1) times the code points of each node's last text; ends_sha256: of the ids of members that end at the
    node, ascending, joined by commas. turns needs conv_id, turn, role, text; other columns are not read. Null roles and texts are
    empty, null turns come first, equal turns are ordered by key, repeated rows are turns of their own, rows without conv_id are
    left out; an empty table has no root. A conversation's keys (16 bytes a turn) are one row, however long its texts are.
    """
    return trie_of_paths(rebuilt_paths(turns.withColumn("conv_id", F.col("conv_id").cast("long"))))
