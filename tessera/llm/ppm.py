"""LM scoring by prediction by partial matching: a byte-context trie with escapes and symbol exclusion, as a keyed exchange.

The trie of all training texts (contexts of up to `order` bytes) grows with the corpus, so it is never held in one
place. Documents are written once in blocks. Each block sends its distinct (order+1)-byte grams, with their training
counts, to the range that the three context bytes next to the predicted one name; there all contexts of 3 to `order`
bytes that a gram's chain of escapes can visit are together. The range sums the counts, walks the chains (method D
escapes; symbols seen in a longer context are excluded from the shorter ones) and gives each block the code length of
its own grams. Contexts of 0 to 2 bytes are one table of at most 2^24 counts, whatever the input. Word counts for the
base score take the same road, by word hash. A block then scores its texts by lookup.

A range meets at most `fan_in` blocks in one task: where there are more, blocks are dealt into parts whose sums are
made first, and the range's table (which its contexts bound) then answers each part in a task of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, persist_table, slices, words

#: 0xFF is no byte of UTF-8: it stands before a text (as context) and after it (as its end, which is predicted).
EDGE = b"\xff"
MAX_ORDER = 5
_END_WORD = int(mix(np.array([0x5EED], dtype=U64))[0])
_RANGE_KEYS = 4_000_000


def grams(run: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every predicted byte (text bytes and the end) of a run of texts, and the texts' bounds."""
    lens = np.fromiter((len(b) for b in run), dtype=np.int64, count=len(run))
    edge = EDGE * order
    a = np.frombuffer(b"".join(edge + b + EDGE for b in run), dtype=np.uint8)
    g = np.zeros(len(a) - order, dtype=U64)
    for k in range(order + 1):
        g = (g << U64(8)) | a[k : len(a) - order + k]
    ends = np.cumsum(lens + 1 + order)
    ok = np.ones(len(a), dtype=bool)
    for k in range(order):
        ok[ends - 1 - k] = False
    at = np.zeros(len(run) + 1, dtype=np.int64)
    np.cumsum(lens + 1, out=at[1:])
    return g[ok[: len(g)]], at


def word_tokens(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a run of lowered texts, one end token after each text, and the texts' bounds."""
    h, at = words(run, lower=False)
    return np.insert(h, at[1:], U64(_END_WORD)), at + np.arange(len(at))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of sorted runs and the sums of their counts."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    if not len(keys):
        return keys, counts
    by = np.argsort(keys, kind="stable")  # merges runs that are sorted already
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Table:
    """A hash table from distinct 64-bit keys to numbers, filled and read by whole arrays (linear probing, at most half full)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.at = np.full(1 << bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]
            lost = self.at[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask
        self.keys, self.values = keys[self.at], values[self.at] if len(keys) else np.zeros(1 << bits, dtype=values.dtype)
        if not len(keys):
            self.keys = np.zeros(1 << bits, dtype=U64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, all of which are in the table."""
        slot = self._slot(keys)
        wrong = np.flatnonzero(self.keys[slot] != keys)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            wrong = wrong[self.keys[slot[wrong]] != keys[wrong]]
        return self.values[slot]


class Low:
    """Training counts of contexts of 0 to 2 bytes, from the sorted distinct grams of three bytes and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys.astype(np.int64), counts.astype(np.float64)
        ctx, pair = self.keys >> 8, self.keys & 0xFFFF
        self.total2 = np.bincount(ctx, weights=self.counts, minlength=1 << 16)
        self.kinds2 = np.bincount(ctx, minlength=1 << 16).astype(np.float64)
        one = np.bincount(pair, weights=self.counts, minlength=1 << 16)
        #: What the symbols of a two-byte context count in the one-byte context within it, and so on down.
        self.gone1 = np.bincount(ctx, weights=one[pair], minlength=1 << 16)
        self.one = one.reshape(256, 256)
        self.zero = self.one.sum(axis=0)
        self.gone0 = ((self.one > 0) * self.zero[None, :]).sum(axis=1)

    def two(self, keys: np.ndarray) -> np.ndarray:
        """Counts of three-byte grams, 0 where there are none."""
        if not len(self.keys):
            return np.zeros(len(keys))
        keys = keys.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0.0)


def chain(g: np.ndarray, counts: np.ndarray, order: int, low: Low) -> np.ndarray:
    """log10 of the probability of each gram's last byte after its context.

    g: all grams (sorted, distinct) of whole three-byte context suffixes, counts: their training counts (0 for grams
    that only other texts have); low: the counts of shorter contexts.
    """
    lp, alive = np.zeros(len(g)), np.ones(len(g), dtype=bool)
    symbol, child = (g & U64(255)).astype(np.int64), None
    two, ctx1 = ((g >> U64(8)) & U64(0xFFFF)).astype(np.int64), ((g >> U64(8)) & U64(255)).astype(np.int64)
    for j in range(order, -1, -1):
        mask = U64((1 << (8 * (j + 1))) - 1)
        if j >= 3:
            keys, inv = np.unique(g & mask, return_inverse=True)
            ck = np.bincount(inv, weights=counts, minlength=len(keys))
            cu, ci = np.unique(keys >> U64(8), return_inverse=True)
            total, kinds = np.bincount(ci, weights=ck), np.bincount(ci, weights=ck > 0)
            ctx, cnt = ci[inv], ck[inv]
            n, d = total[ctx], kinds[ctx]
        elif j == 2:
            cnt, n, d = low.two(g & mask), low.total2[two], low.kinds2[two]
        elif j == 1:
            cnt, n, d = low.one[ctx1, symbol], low.one.sum(axis=1)[ctx1], (low.one > 0).sum(axis=1).astype(float)[ctx1]
        else:
            cnt = low.zero[symbol]
            n, d = np.full(len(g), low.zero.sum()), np.full(len(g), float((low.zero > 0).sum()))
        # The symbols of the next longer context are excluded.
        if child is not None and j >= 2:
            kc, ctx_of_key, counted, pctx, kinds_c = child
            short = kc & mask
            here = ck[np.searchsorted(keys, short)] if j >= 3 else low.two(short)
            n = n - np.bincount(ctx_of_key, weights=np.where(counted > 0, here, 0.0), minlength=len(kinds_c))[pctx]
            d = d - kinds_c[pctx]
        elif j == 1:
            n, d = n - low.gone1[two], d - low.kinds2[two]
        elif j == 0:
            n, d = n - low.gone0[ctx1], d - (low.one > 0).sum(axis=1)[ctx1]
        live = alive & (d > 0)
        hit, esc = live & (cnt > 0), live & (cnt == 0)
        lp[hit] += np.log10((cnt[hit] - 0.5) / n[hit])
        lp[esc] += np.log10(0.5 * d[esc] / n[esc])
        alive &= ~hit
        child = (keys, ci, ck, ctx, kinds) if j >= 3 else None
    lp[alive] -= np.log10(256.0 - float((low.zero > 0).sum()))
    return lp


def _requests(blocks: DataFrame, order: int, ranges: int) -> DataFrame:
    """(kind, range, block, keys, counts): distinct grams (kind 0) and words (kind 1) of each block, packed, with training counts."""

    def emit(batches):
        held: dict[tuple[int, int], list] = {}

        def flush(key):
            keys, counts = _merge(held.pop(key))
            kind, block = key
            r = (mix((keys >> U64(8)) & U64(0xFFFFFF)) if kind == 0 else mix(keys)) % U64(ranges)
            by = np.argsort(r, kind="stable")
            cut = np.searchsorted(r[by], np.arange(ranges + 1, dtype=U64))
            rows = [(kind, i, block, keys[by[cut[i] : cut[i + 1]]].tobytes(), counts[by[cut[i] : cut[i + 1]]].astype(np.uint32).tobytes()) for i in range(ranges) if cut[i] < cut[i + 1]]
            return pd.DataFrame(rows, columns=["kind", "range", "block", "keys", "counts"])

        for pdf in batches:
            for block, part in pdf.groupby("block"):
                train = ~part["held_out"].to_numpy(dtype=bool)
                for start, run in slices(part["text"].tolist()):
                    learn = train[start : start + len(run)]
                    for some, weight in ((np.flatnonzero(learn), 1), (np.flatnonzero(~learn), 0)):
                        if not len(some):
                            continue
                        chosen = [run[i] for i in some]
                        for kind, (k, _) in enumerate((grams(chosen, order), word_tokens(chosen))):
                            u, n = np.unique(k, return_counts=True)
                            parts = held.setdefault((kind, block), [])
                            parts.append((u, n * weight))
                            if len(parts) >= 16:
                                held[(kind, block)] = [_merge(parts)]
            if len(held) > 8:  # blocks are contiguous; an early flush only repeats keys
                for key in list(held)[:-2]:
                    yield flush(key)
        for key in list(held):
            yield flush(key)

    return blocks.select("block", "held_out", "text").mapInPandas(emit, "kind int, range int, block long, keys binary, counts binary")


def _low(blocks: DataFrame) -> Low:
    """The training counts of three-byte grams: at most 2^24 rows whatever the input, some 100,000 of common texts."""

    def count(batches):
        keys, counts = np.empty(0, dtype=U64), np.empty(0, dtype=np.int64)
        for pdf in batches:
            parts = [(keys, counts)]
            for _, run in slices(pdf.loc[~pdf["held_out"].astype(bool), "text"].tolist()):
                parts.append(np.unique(grams(run, 2)[0], return_counts=True))
            keys, counts = _merge(parts)
        yield pd.DataFrame({"gram": keys.astype(np.int64), "n": counts})

    rows = blocks.select("held_out", "text").mapInPandas(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas().sort_values("gram")
    return Low(rows["gram"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.float64))


def _unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of packed rows and the sums of their counts."""
    keys = [np.frombuffer(b, dtype=U64) for b in pdf["keys"]]
    counts = [np.frombuffer(b, dtype=np.uint32 if 2 * len(b) == len(k) * 8 else np.uint64).astype(np.int64) for b, k in zip(pdf["counts"], keys, strict=True)]
    return _merge(list(zip(keys, counts, strict=True)))


def _answers(asked: DataFrame, order: int, low, blocks: int, fan_in: int) -> DataFrame:
    """(kind, block, keys, values, kinds, total): values of each block's keys; rows with null keys carry the numbers of training words."""

    def table(u: np.ndarray, c: np.ndarray, kind: int) -> np.ndarray:
        return chain(u, c, order, low.value) if kind == 0 else c.astype(np.float64)

    def reply(pdf: pd.DataFrame, u: np.ndarray, value: np.ndarray) -> pd.DataFrame:
        values = [value[np.searchsorted(u, np.frombuffer(b, dtype=U64))].tobytes() for b in pdf["keys"]]
        return pd.DataFrame({"kind": pdf["kind"], "block": pdf["block"], "keys": pdf["keys"], "values": values, "kinds": 0, "total": 0})

    def words_of(u: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"kind": [2], "block": [-1], "keys": [None], "values": [None], "kinds": [int((c > 0).sum())], "total": [int(c.sum())]})

    schema = "kind int, block long, keys binary, values binary, kinds long, total long"
    parts = -(-blocks // fan_in)
    if parts <= 1:

        def answer(key, pdf):
            u, c = _unpack(pdf)
            out = reply(pdf, u, table(u, c, int(key[0])))
            return pd.concat([out, words_of(u, c)]) if key[0] else out

        return asked.groupBy("kind", "range").applyInPandas(answer, schema)

    def add(key, pdf):
        u, c = _unpack(pdf)
        return pd.DataFrame({"kind": [key[0]], "range": [key[1]], "part": [key[2]], "keys": [u.tobytes()], "counts": [c.astype(np.uint64).tobytes()]})

    def tables(key, pdf):
        u, c = _unpack(pdf)
        return pd.DataFrame({"kind": [key[0]], "range": [key[1]], "keys": [u.tobytes()], "values": [table(u, c, int(key[0])).tobytes()], "kinds": [int((c > 0).sum())], "total": [int(c.sum())]})

    def answer_part(key, pdf, of):
        if not len(pdf):
            return pd.DataFrame(columns=["kind", "block", "keys", "values", "kinds", "total"])
        return reply(pdf, np.frombuffer(of["keys"].iloc[0], dtype=U64), np.frombuffer(of["values"].iloc[0]))

    asked = persist_table(asked.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")), "asked")
    sums, left = asked, parts * fan_in
    while left > fan_in:  # sums of fan_in rows, and of as many sums, until fan_in are left of a range
        left = -(-left // fan_in)
        sums = sums.groupBy("kind", "range", "part").applyInPandas(add, "kind int, range int, part int, keys binary, counts binary").withColumn("part", F.pmod("part", F.lit(-(-left // fan_in))))
    of = persist_table(sums.groupBy("kind", "range").applyInPandas(tables, "kind int, range int, keys binary, values binary, kinds long, total long"), "ranges")
    spread = of.select("kind", "range", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "keys", "values")
    keys = ("kind", "range", "part")
    answers = asked.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(answer_part, schema)
    none = F.lit(None).cast("binary")
    return answers.unionByName(of.filter("kind = 1").select(F.lit(2).alias("kind"), F.lit(-1).cast("long").alias("block"), none.alias("keys"), none.alias("values"), "kinds", "total"))


def ppm_score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", order: int = MAX_ORDER, block_bytes: int = 32 << 20, fan_in: int = 512) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    held_out is a boolean column over docs: rows where it is true teach nothing (null counts as false). Texts are
    lowered (A-Z), null ones are empty: an empty text is one end token. score is log10 of the trie's probability of all
    bytes of the text and its end, base_score the add-one word model's. Without any training row V and N are 0 and all
    bytes are equally likely. Repeated rows are scored (and, in training, counted) as often as they stand there. Ids may be of
    any type, and null. An empty table gives an empty result. A range's task meets about fan_in blocks of block_bytes at most.
    """
    if not 2 <= order <= 7:
        raise ValueError("order must be from 2 to 7")
    spark = docs.sparkSession
    lowered = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), lowered.alias("text"))
    # Blocks are runs of a partition's rows: a new one begins with every block_bytes of text.
    rows = rows.select(F.spark_partition_id().alias("part"), F.octet_length("text").alias("size"), "doc_id", "held_out", "text")
    rows = rows.mapInPandas(_numbered(block_bytes), "block long, doc_id string, held_out boolean, text string")
    blocks = persist_table(rows, "blocks")
    size = blocks.agg(F.sum(F.octet_length("text")).alias("b"), F.count_distinct("block").alias("n")).first()
    # About a tenth of a gram and a fiftieth of a word for each byte come from a block; ranges hold a few million keys.
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size["b"] or 0) // 10 // _RANGE_KEYS, 1)
    low = spark.sparkContext.broadcast(_low(blocks))
    answers = persist_table(_answers(_requests(blocks, order, ranges), order, low, size["n"], fan_in), "answers")
    words_seen = answers.filter("kind = 2").agg(F.coalesce(F.sum("kinds"), F.lit(0)).alias("v"), F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()
    n = words_seen["n"]
    floor = float(np.log10(max(n + words_seen["v"] + 1, 1)))

    def score(key, texts, got):
        tables = []
        for kind in (0, 1):
            part = got[got["kind"] == kind]
            k = np.concatenate([np.frombuffer(b, dtype=U64) for b in part["keys"]]) if len(part) else np.empty(0, dtype=U64)
            x = np.concatenate([np.frombuffer(b) for b in part["values"]]) if len(part) else np.empty(0)
            k, first = np.unique(k, return_index=True)  # a block that was split sends a key more than once
            tables.append(Table(k, x[first]))
        out = []
        for start, run in slices(texts["text"].tolist()):
            g, at = grams(run, order)
            lp = tables[0].get(g)
            t, wat = word_tokens(run)
            c = tables[1].get(t)
            part = texts.iloc[start : start + len(run)][["doc_id", "held_out"]].copy()
            part["n_tokens"] = np.diff(wat)
            part["n_known"] = np.add.reduceat((c > 0).astype(np.int64), wat[:-1])
            part["base_score"] = np.add.reduceat(np.log10(c + 1.0), wat[:-1]) - np.diff(wat) * floor
            part["score"] = np.add.reduceat(lp, at[:-1])
            out.append(part)
        cols = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        return pd.concat(out)[cols] if out else pd.DataFrame(columns=cols)

    scored = blocks.groupBy("block").cogroup(answers.filter("kind < 2").groupBy("block")).applyInPandas(score, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")


def _numbered(block_bytes: int):
    """Partition and a running number in it as one block number."""

    def number(batches):
        done = 0
        for pdf in batches:
            size = pdf["size"].to_numpy(dtype=np.int64)
            at = np.cumsum(size) + done
            done = int(at[-1]) if len(at) else done
            block = (pdf["part"].to_numpy(dtype=np.int64) << 32) + (at - size) // block_bytes
            yield pd.DataFrame({"block": block, "doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "text": pdf["text"]})

    return number
