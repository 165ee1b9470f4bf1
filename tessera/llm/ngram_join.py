"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity at or over a threshold.

Exact, by a size-aware heavy-light scheme. A set of n shingles that links with another shares at least
c = ceil(t*n) shingles with it, so both share at least k shingles within their first n - c + k shingles under any
common order. Sets of up to `boundary` shingles enumerate the k-subsets (k = 2) of that prefix as keys; larger
ones put the single shingles of their prefix (k = 1) into inverted lists that are then scanned. Sets just under
the boundary do both, for partners beyond it. The boundary is the size class at which enumerating subsets stops
being cheaper than scanning lists, from counts over the whole corpus. In the common order, shingles that several
documents hold come last, the most frequent ones at the very end, so that a line or passage on a third of all pages
makes no long list.

Long lists are not expanded into pairs: first each set is compared with one leader of its lists and joined with
it into components; then only pairs of different components are compared, and these only after a bitmap bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, let_go, mix, persist_table, shingle_sets, slices, small_enough
from .components import components

#: Rows up to which a checked table is broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 100_000
#: A shingle is common if it was counted in at least this many documents. Common shingles (the MAX_COMMON most frequent
#: ones at most) only order the prefixes: any choice of them gives the same links.
COMMON_DOCS = 6
MAX_COMMON = 400_000
#: One in so many shingles is counted by size class; parts of long lists hold about so many sets.
SEEN, LIST_PART = 512, 2_000
#: Shingles that are counted together in a task; those that come once among them are not counted.
_COUNTED = 3_000_000
_SUBSET_TAG = U64(0x5851F42D4C957F2D)


def _common_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
    """Common shingles (sorted), their ranks by frequency, and by size class the numbers of shingles and of list entries that they would scan.

    The latter are counts over all documents, of one in SEEN shingles chosen by their hashes: they set a boundary, no result.
    """

    def count(batches):
        held, size = [], 0

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            top = c >= 2
            return pd.DataFrame({"kind": 0, "key": u[top].view(np.int64), "n": c[top].astype(np.int64)})

        for pdf in batches:
            for _, run in slices(pdf["text"].tolist()):
                h, at = shingle_sets(run, k)
                n = np.diff(at)
                some = h % U64(SEEN) == 0
                per = np.repeat(np.log2(np.maximum(n, 1)).astype(np.int64), n)[some]
                pairs, c = np.unique(np.stack([per, h[some].view(np.int64)]), axis=1, return_counts=True)
                yield pd.DataFrame({"kind": 1 + pairs[0], "key": pairs[1], "n": c.astype(np.int64)})
                held.append(h)
                size += len(h)
                if size > _COUNTED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    found = persist_table(docs.select("text").mapInPandas(count, "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).filter(f"kind > 0 or n >= {COMMON_DOCS}"), "common")
    top = found.filter("kind = 0").orderBy(F.desc("n"), "key").limit(MAX_COMMON).select("key", "n").toPandas()
    # Shingles that are ordered by frequency end up behind the prefixes; the lists of all others are scanned.
    least = int(top["n"].min()) if len(top) == MAX_COMMON else COMMON_DOCS
    seen = found.filter("kind > 0")
    lists = seen.groupBy("key").agg(F.sum("n").alias("length")).filter(F.col("length") < least)
    of = seen.join(lists, "key").groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("length")).alias("scan"))
    stats = {r["kind"] - 1: (r["n"], r["scan"]) for r in of.collect()}  # at most 64 rows
    top = top.sort_values(["n", "key"])
    common = top["key"].to_numpy(dtype=np.int64).view(U64)
    by = np.argsort(common)
    return common[by], by.astype(np.int32), stats


def _boundary(stats: dict[int, tuple[int, int]], num: int, den: int) -> int:
    """The largest set size at which two-element subsets cost no more keys than the single keys and the list entries they scan."""
    best = 0
    for n in range(3, 1 << 12):
        keys, scan = stats.get(int(np.log2(n)), (0, 0))
        length = scan / keys if keys else 1.0
        p = n - -(-num * n // den) + 1
        if (p + 1) * p // 2 > p * (1 + length):
            break
        best = n
    return best


def _bitmap(h: np.ndarray) -> bytes:
    """A bitmap of 2 to 4 bits for each shingle, by the hash's high bits: bits of one set alone bound the difference from below."""
    m = max(64, 1 << int(2 * len(h) - 1).bit_length())
    bits = np.zeros(m, dtype=np.uint8)
    bits[(h >> U64(64 - (m.bit_length() - 1))).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _fold(b: np.ndarray, size: int) -> np.ndarray:
    while len(b) * 8 > size:  # neighbours under high-bit addressing share a bucket of the smaller map
        bits = np.unpackbits(b)
        b = np.packbits(bits[0::2] | bits[1::2])
    return b


def _keys(h: np.ndarray, common: np.ndarray, rank: np.ndarray, boundary: int, num: int, den: int) -> np.ndarray:
    """The keys of one set (its shingles are sorted by hash)."""
    n = len(h)
    if n <= 2:  # sets of one or two shingles link with equal sets alone
        return np.empty(0, dtype=U64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        hot = common[at] == h
        h = np.concatenate([h[~hot], h[hot][np.argsort(rank[at[hot]])]])
    p = n - -(-num * n // den) + 1
    out = []
    if den * n > num * boundary:  # its largest partner, n * den / num, may be over the boundary
        out.append(h[:p])
    if n <= boundary:
        x = h[: p + 1]
        i, j = np.triu_indices(len(x), 1)
        lo, hi = np.minimum(x[i], x[j]), np.maximum(x[i], x[j])
        out.append(mix(lo * _SUBSET_TAG + mix(hi)))
    return np.concatenate(out) if out else np.empty(0, dtype=U64)


def _signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set, from two order-free sums; 0 for an empty set."""
    n = np.diff(at)
    out = np.zeros(len(n), dtype=U64)
    some = np.flatnonzero(n)
    if len(some):
        x, y = mix(h + np.repeat(n, n).astype(U64)), mix(h ^ _SUBSET_TAG)
        out[some] = mix(np.bitwise_xor.reduceat(x, at[some]) * U64(3) + np.add.reduceat(y, at[some]))
    return out.view(np.int64)


def _entries(docs: DataFrame, common: np.ndarray, rank: np.ndarray, boundary: int, num: int, den: int, k: int) -> DataFrame:
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((common, rank))

    def emit(batches):
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy(dtype=object)
            for start, run in slices(pdf["text"].tolist()):
                h, at = shingle_sets(run, k)
                rows = [h[at[i] : at[i + 1]] for i in range(len(run))]
                yield pd.DataFrame(
                    {
                        "doc_id": ids[start : start + len(run)],
                        "sid": _signatures(h, at),
                        "n": np.diff(at),
                        "bits": [_bitmap(x) if len(x) else b"" for x in rows],
                        "keys": [_keys(x, *held.value, boundary, num, den).view(np.int64) for x in rows],
                    }
                )

    # Ids pass through Python as text: numbers next to nulls would become floats.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(emit, "doc_id string, sid long, n long, bits binary, keys array<long>")
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _near(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose bitmaps do not prove too large a difference."""

    def keep(batches):
        for pdf in batches:
            ok = np.zeros(len(pdf), dtype=bool)
            for i, (na, nb, ba, bb) in enumerate(zip(pdf["na"], pdf["nb"], pdf["bits_a"], pdf["bits_b"], strict=True)):
                x, y = np.frombuffer(ba, dtype=np.uint8), np.frombuffer(bb, dtype=np.uint8)
                size = 8 * min(len(x), len(y))
                x, y = _fold(x, size), _fold(y, size)
                only_a, only_b = int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())
                shared = min(na - only_a, nb - only_b)
                ok[i] = den * shared >= num * (na + nb - shared)
            yield pdf.loc[ok, ["a", "b"]]

    return pairs.mapInPandas(keep, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """The pairs (a < b of set ids) that link: first by the bitmaps' bound, then by the sets, made again from the texts of their first documents."""
    # Bitmaps of the sets that stand in a pair alone are moved.
    pairs = persist_table(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    side = sets.join(F.broadcast(ends) if small_enough(ends, BROADCAST_ROWS) else ends, "sid", "left_semi").select("sid", "n", "bits")
    # A bitmap has half to one byte for each shingle of its set.
    small = small_enough(side, BROADCAST_ROWS, 24 + F.octet_length("bits"))
    a = side.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    b = side.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    left = persist_table(_near(pairs.join(F.broadcast(a) if small else a, "a").join(F.broadcast(b) if small else b, "b"), num, den), "near")
    wanted = left.select(F.col("a").alias("sid")).unionByName(left.select(F.col("b").alias("sid"))).distinct()
    reps = persist_table(sets.join(wanted, "sid", "left_semi").select("sid", F.col("rep").alias("doc_id")), "wanted")
    texts = docs.join(F.broadcast(reps) if small_enough(reps, BROADCAST_ROWS) else reps, "doc_id")

    def shingled(batches):
        for pdf in batches:
            sid = pdf["sid"].to_numpy()
            for start, run in slices(pdf["text"].tolist()):
                h, at = shingle_sets(run, k)
                own = np.flatnonzero(_signatures(h, at) == sid[start : start + len(run)])  # another row with the same id may have another text
                yield pd.DataFrame({"sid": sid[start + own], "h": [h[at[i] : at[i + 1]].view(np.int64) for i in own]})

    full = texts.select("sid", "text").mapInPandas(shingled, "sid long, h array<long>").dropDuplicates(["sid"])
    full = persist_table(full, "sets", "none")
    let_go(docs.sparkSession)

    def linked(batches):
        for pdf in batches:
            ok = np.zeros(len(pdf), dtype=bool)
            for i, (x, y) in enumerate(zip(pdf["ha"], pdf["hb"], strict=True)):
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                ok[i] = den * shared >= num * (len(both) - shared)
            yield pdf.loc[ok, ["a", "b"]]

    rows = left.join(full.select(F.col("sid").alias("a"), F.col("h").alias("ha")), "a").join(full.select(F.col("sid").alias("b"), F.col("h").alias("hb")), "b")
    return rows.select("a", "b", "ha", "hb").mapInPandas(linked, "a long, b long")


def _may_link(n: Column, left: Column, n2: Column, left2: Column, num: int, den: int) -> Column:
    """Whether sets of n and n2 shingles can link if a key is the first that they share: their sizes are near enough, and the
    shingles from the key on (left, left2) are enough for the overlap. Every link passes at its first shared key."""
    return (n * num <= n2 * den) & (n2 * num <= n * den) & (F.least(left, left2) * (num + den) >= (n + n2) * num)


def link_sets(entries: DataFrame, docs: DataFrame, boundary: int, num: int, den: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(sets: sid, n, rep, bits; components: node, component, both structs of rep and sid) of persisted entries."""
    sets = persist_table(entries.filter("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("rep"), F.min("bits").alias("bits")), "classes")
    # List keys come first, in the common order: what is left of a set from such a key on bounds an overlap that begins there.
    prefix = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    left = F.when((F.col("n") * den > num * boundary) & (F.col("pos") < prefix), F.col("n") - F.col("pos")).otherwise(F.col("n")).alias("left")
    lists = entries.select("sid", "n", F.posexplode("keys").alias("pos", "key"))
    # A key of one set alone (with any number of copies) is no meeting place; counts combine before the shuffle.
    meet = lists.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo != hi").select("key")
    meeting = persist_table(lists.select("key", "sid", "n", left).join(meet, "key").distinct(), "meeting")

    let_go(docs.sparkSession)
    # Two leaders for each set: the least set id that it meets, and the one with most meeting places, which tends to be
    # the text that a group of edited copies comes from.
    degree = meeting.groupBy("sid").agg(F.count("*").alias("degree"))
    leaders = meeting.join(degree, "sid").groupBy("key").agg(F.min(F.struct("sid", "n", "left")).alias("lo"), F.max(F.struct("degree", "sid", "n", "left")).alias("top"))
    star = meeting.join(leaders, "key")

    def led(x: str) -> Column:
        return (F.col("sid") != F.col(f"{x}.sid")) & _may_link(F.col("n"), F.col("left"), F.col(f"{x}.n"), F.col(f"{x}.left"), num, den)

    star = star.groupBy("sid").agg(F.min(F.when(led("lo"), F.col("lo.sid"))).alias("lead"), F.max(F.when(led("top"), F.struct("top.degree", "top.sid"))).alias("top"))
    star = star.select("sid", F.explode(F.array("lead", "top.sid")).alias("leader")).filter("leader is not null")
    pairs = star.select(F.least("sid", "leader").alias("a"), F.greatest("sid", "leader").alias("b")).distinct()
    first = persist_table(_verify(pairs, sets, docs, num, den, k), "stars-linked")
    let_go(docs.sparkSession)
    comp = persist_table(components(first), "first-components")
    let_go(docs.sparkSession)

    own = meeting.join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    own = persist_table(own, "own")
    sizes = own.groupBy("key", "component").agg(F.count("*").alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "component")).alias("x"), F.count("*").alias("components"), F.sum("m").alias("length")).filter("components > 1")
    main = main.select("key", F.col("x.component").alias("main"), F.ceil(F.col("length") / LIST_PART).cast("int").alias("parts"))
    open_ = own.join(main, "key")
    # A long list is dealt into parts; all of it meets each part in a task of its own.
    x = open_.filter("component != main").select("key", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("part"), "sid", "n", "left", "component", "main")
    y = open_.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("sid").alias("sid2"), F.col("n").alias("n2"), F.col("left").alias("left2"), F.col("component").alias("component2"))
    # Members of a list's largest component meet its other members alone; two of the latter meet once.
    cross = x.join(y, ["key", "part"]).filter("component != component2 and (component2 = main or sid < sid2)").filter(_may_link(F.col("n"), F.col("left"), F.col("n2"), F.col("left2"), num, den))
    pairs = cross.select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")).distinct()
    second = persist_table(_verify(pairs, sets, docs, num, den, k), "cross-linked")
    let_go(docs.sparkSession)
    # Links of the second kind join components; the first round's stars stand for the links within one, and settle sooner.
    stars = comp.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    links = stars.unionByName(second)
    # From here nodes are led by the least ids of the classes, so that a component's least node has its id and no join meets all of a component.
    for end in ("a", "b"):
        links = links.join(sets.select(F.col("sid").alias(end), F.struct("rep", "sid").alias("_node")), end).drop(end).withColumnRenamed("_node", end)
    return sets, components(links)


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, k: int = 5, signatures: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs; signatures=True adds set_id, a number for the row's set (see
    signature()), and component_set, that of the document which names the component.

    Words are runs of non-separator bytes after A-Z are lowered. Null and empty texts, and texts without words, have
    no shingles and link with nothing: their component is their own id. Equal sets (copies, repeated rows) are one
    class and are compared once. Rows with a null id take part in no link and have a null component; rows with one id but
    different texts are different documents, each with the component of its own text. Ids may be of any orderable type.
    Other columns of docs, whatever their names, are not read. An empty table gives an empty result.
    """
    num, den = percent, 100
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    common, rank, stats = _common_shingles(d, k)
    boundary = _boundary(stats, num, den)
    entries = persist_table(_entries(d, common, rank, boundary, num, den, k), "entries", "none")
    let_go(docs.sparkSession)
    known = entries.filter("doc_id is not null")
    sets, comp = link_sets(known, d.filter("doc_id is not null"), boundary, num, den, k)
    of_class = sets.withColumn("node", F.struct("rep", "sid")).join(comp, "node", "left").select("sid", "n", F.coalesce("component.rep", "rep").alias("component_id"), F.coalesce("component.sid", "sid").alias("component_set"))
    of_class = persist_table(of_class, "class-components")
    let_go(docs.sparkSession)
    rows = entries.select("doc_id", "sid", "n")
    out = rows.join(F.broadcast(of_class) if small_enough(of_class, BROADCAST_ROWS) else of_class, ["sid", "n"], "left")
    more = [F.col("sid").alias("set_id"), F.coalesce("component_set", "sid").alias("component_set")] if signatures else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).alias("component_id"), *more)


def signature(text: Column, k: int = 5) -> Column:
    """The number of a text's set of shingles: equal sets have equal numbers, 0 is the empty set."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        parts = [_signatures(*shingle_sets(run, k)) for _, run in slices(texts.tolist())]
        return pd.Series(np.concatenate(parts) if parts else np.empty(0, dtype=np.int64))

    return of(text)
