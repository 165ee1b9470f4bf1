"""Files of token ids: one zstandard frame a document, all with one shared dictionary, in blocks with an offset index.

A folder of token files holds two Parquet tables. `dictionary` has one row: the dictionary's SHA-256, its bytes, the width of an
id and the end id. `blocks` has a row for each run of documents in the order of their ids: the shard and the ids before the block
in it, the documents' ids, the dictionary's hash, `ends` (the offset index: where each document's frame ends in `data`) and `data`.
A single document is read by its block's least and greatest id, one slice of `data` and one small frame.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents and compressed bytes of a block, at most (a longer document has a block of its own).
BLOCK_DOCS, BLOCK_BYTES = 2048, 1 << 20
#: A single space between two characters that are no white space: the byte-level pre-tokenizer always cuts before it.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Pieces of these characters alone are split here as the byte-level pre-tokenizer splits them: contractions, letters, digits, marks.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ɏ]+")
RUNS = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+")
_ENCODERS: dict[str, Encoder] = {}


def byte_alphabet() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: visible Latin-1 ones for themselves, the others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """A tokenizer of the library that encodes each distinct piece of a text once.

    With a byte-level pre-tokenizer, texts are cut before single spaces, where it cuts whatever stands around them. Pieces are
    numbered; the library's model encodes the runs of those not met before (the whole library does where they hold other characters),
    and the ids of a text are gathered from its pieces' numbers. Other tokenizers encode whole texts. Beyond `most` pieces and runs
    all are forgotten.
    """

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.kind = "<u2" if max(self.library.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4"
        how = json.loads(self.library.to_str())
        pre = how["pre_tokenizer"] or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not how["normalizer"] and how["model"]["type"] == "BPE" and not how["model"]["dropout"]
        self.added = re.compile("|".join(re.escape(t["content"]) for t in how["added_tokens"]) or "(?!)")
        self.cuts = self.cuts and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in how["added_tokens"])
        self.alphabet = byte_alphabet()
        self.code = {"<u2": "H", "<u4": "I"}[self.kind]
        self.line_end = self._bytes([self.library.token_to_id(self.alphabet[10])]) if self.cuts else b""
        self._forget()

    def _forget(self) -> None:
        self.first, self.rest, self.words = {}, {}, {}
        self.store, self.start, self.size = np.zeros(0, dtype=self.kind), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _ids(self, piece: str) -> bytes:
        """The ids of a piece, its leading space included. Single line ends within it are cut out: they are runs of their own."""
        if "\n" in piece:
            lines = piece.split("\n")
            if all(t and not t[0].isspace() and not t[-1].isspace() for t in [lines[0].removeprefix(" "), *lines[1:]]):
                return self.line_end.join([self._ids(t) for t in lines])
        if not PLAIN.fullmatch(piece, piece[0] == " ") or self.added.search(piece):
            return self._bytes(self.library.encode(piece, add_special_tokens=False).ids)
        words, out = self.words, b""
        for run in RUNS.findall(piece):
            ids = words.get(run)
            if ids is None:
                text = run.replace(" ", "Ġ") if run.isascii() else run.encode().decode("latin-1").translate(self.alphabet)
                words[run] = ids = self._bytes([t.id for t in self.library.model.tokenize(text)])
            out += ids
        return out

    def _learn(self, pieces: list[str], memo: dict[str, int], lead: str) -> None:
        if not pieces:
            return
        ids = [self._ids(lead + p) if lead + p else b"" for p in pieces]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // self.store.itemsize
        memo.update(zip(pieces, range(len(self.size), len(self.size) + len(pieces)), strict=True))
        self.start = np.append(self.start, len(self.store) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.store = np.append(self.store, np.frombuffer(b"".join(ids), dtype=self.kind))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's ids); null texts are empty."""
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            ids = [e.ids for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([x for i in ids for x in i], dtype=self.kind), np.cumsum([0, *map(len, ids)])
        if len(self.rest) + len(self.words) > self.most:
            self._forget()
        cut = pc.split_pattern(texts, " ")
        at = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        # Pieces with white space at an edge do not lie between two cuts: their texts are cut with care.
        edge = np.fromiter((not w or w[0].isspace() or w[-1].isspace() for w in names), dtype=bool, count=len(names))
        odd = np.logical_or.reduceat(edge[code], at[:-1]) if len(code) else np.zeros(0, dtype=bool)
        pieces = {int(i): CUT.split(texts[int(i)].as_py()) for i in np.flatnonzero(odd)}
        self._learn([w for w, e in zip(names, edge, strict=True) if not e and w not in self.rest], self.rest, " ")
        self._learn(sorted({w for p in pieces.values() for w in p[1:]} - self.rest.keys()), self.rest, " ")
        firsts = [pieces[i][0] if i in pieces else names[code[at[i]]] for i in range(len(texts))]
        self._learn(sorted(set(firsts) - self.first.keys()), self.first, "")
        number = np.fromiter((-1 if e else self.rest[w] for w, e in zip(names, edge, strict=True)), dtype=np.int64, count=len(names))[code]
        number[at[:-1]] = [self.first[w] for w in firsts]
        if pieces:
            own = np.split(number, at[1:-1])
            for i, p in pieces.items():
                own[i] = np.array([self.first[p[0]], *map(self.rest.__getitem__, p[1:])], dtype=np.int64)
            at = np.cumsum([0, *map(len, own)])
            number = np.concatenate(own)
        n = self.size[number]
        ends = np.cumsum(n)
        ids = self.store[np.repeat(self.start[number] - ends + n, n) + np.arange(int(n.sum()))]
        return ids, np.append(0, ends)[at]


def encoder(path: str) -> Encoder:
    """The process's encoder for a tokenizer file; it stays over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _runs(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole texts of about `most` bytes together, with the place of the first."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(size) - size) // most
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        if hi > lo:
            yield lo, texts.slice(lo, hi - lo)


def train_dictionary(docs: DataFrame, path: str, samples: int = 512, window: int = 4096, size: int = 32 << 10, text_col: str = "text") -> bytes:
    """A zstandard dictionary for id arrays, from windows of at most `window` characters at hashed places of `samples` texts chosen by
    hash: bounds of what the driver sees, for a dictionary has a fixed size. Where the samples are too few to train one, their ids are
    the dictionary as they are; without any text it is empty. It only changes how small frames get."""
    t = F.col(text_col).cast("string")
    at = F.pmod(F.xxhash64(t), F.greatest(F.length(t) - window, F.lit(0)) + 1) + 1
    # Twice as many as are wanted pass the filter, so no task sends more than its share of them.
    share = min(1.0, 2 * samples / max(docs.count(), 1))
    h = F.xxhash64(F.lit("sample"), t)
    some = docs.filter((F.length(t) > 0) & (F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)) + 1))
    rows = some.select(t.substr(at.cast("int"), F.lit(window)).alias("t"), h.alias("h")).orderBy("h", "t").limit(samples).collect()
    flat, at = encoder(path)(pa.array([r["t"] for r in rows], pa.string()))
    ids = [flat[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
    try:
        return zstandard.train_dictionary(size, ids).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(ids)[-size:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> None:
    """Encode every whole text (null: empty), append end_id, and write the documents in ascending order of their ids.

    Null ids come first; equal ids follow each other in the order in which the input holds them, and share a range of documents
    between tasks where they are many. An empty table gives empty token files. Ids may be of any type that Spark orders; other
    columns are not read.
    """
    spark = docs.sparkSession
    raw = train_dictionary(docs, tokenizer, text_col=text_col)
    sha = hashlib.sha256(raw).hexdigest()
    kind = encoder(tokenizer).kind
    id_type = docs.schema[id_col].dataType.simpleString()
    spark.createDataFrame([(sha, bytearray(raw), int(kind[-1]), end_id, tokenizer)], "sha256 string, data binary, width int, end_id int, tokenizer string").coalesce(1).write.parquet(f"{path}/dictionary")
    share = spark.sparkContext.broadcast(raw)
    end = np.array([end_id], dtype=kind).tobytes()

    def write(batches):
        shard, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        press = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(share.value), write_dict_id=False)
        before, number, size = 0, 0, 0
        ids, frames, tokens = [], [], []

        def block():
            nonlocal before, number, size, ids, frames, tokens
            doc_ids = pa.concat_arrays(ids)
            n = sum(tokens)
            ends = np.cumsum([len(f) for f in frames])
            out = [
                pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), doc_ids.slice(0, 1), doc_ids.slice(len(doc_ids) - 1, 1),
                pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), pa.array([sha]), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([b"".join(frames)], pa.binary()),
            ]
            before, number, size, ids, frames, tokens = before + n, number + 1, 0, [], [], []
            return pa.RecordBatch.from_arrays(out, names=["shard", "block", "before", "tokens", "low", "high", "ids", "dictionary", "ends", "data"])

        for batch in batches:
            for lo, texts in _runs(batch.column(1)):
                start = lo
                flat, at = encode(texts)
                for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False), lo):
                    frame = press.compress(flat[a:b].tobytes() + end)
                    if frames and (size + len(frame) > BLOCK_BYTES or len(frames) >= BLOCK_DOCS):
                        if i > start:
                            ids.append(batch.column(0).slice(start, i - start))
                        start = i
                        yield block()
                    frames.append(frame)
                    size += len(frame)
                    tokens.append(b - a + 1)
                ids.append(batch.column(0).slice(start, lo + len(texts) - start))
        if frames:
            yield block()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange("id", "place").sortWithinPartitions("id", "place").select("id", "text")
    schema = f"shard int, block int, before long, tokens long, low {id_type}, high {id_type}, ids array<{id_type}>, dictionary string, ends array<long>, data binary"
    rows.mapInArrow(write, schema).write.option("compression", "none").parquet(f"{path}/blocks")


class _Reader:
    """Frames of a block, decoded after a check of the dictionary's hash."""

    def __init__(self, sha: str, raw: bytes, kind: str):
        self.sha, self.kind = sha, kind
        self.press = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))

    def ids(self, sha: str, data: bytes, start: int, end: int) -> np.ndarray:
        if sha != self.sha:
            raise ValueError(f"block was written with dictionary {sha}, the folder holds {self.sha}")
        return np.frombuffer(self.press.decompress(data[start:end]), dtype=self.kind)


def _open(spark: SparkSession, path: str):
    row = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(row["data"])
    if hashlib.sha256(raw).hexdigest() != row["sha256"]:
        raise ValueError(f"the dictionary of {path} does not have its hash")
    share = spark.sparkContext.broadcast((row["sha256"], raw, f"<u{row['width']}"))
    return spark.read.parquet(f"{path}/blocks"), share


def _shard_starts(blocks: DataFrame) -> dict[int, int]:
    """Ids before each shard: one number a file."""
    sums = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("tokens").alias("n")).collect())
    starts = np.cumsum([0, *[n for _, n in sums]]).tolist()
    return {s: at for (s, _), at in zip(sums, starts, strict=False)}


def _each(batch: pa.RecordBatch, reader: _Reader):
    """(row of the batch, ids of the whole block as a list of arrays)."""
    for i in range(batch.num_rows):
        sha, data = batch.column("dictionary")[i].as_py(), batch.column("data")[i].as_py()
        ends = [0, *batch.column("ends")[i].as_py()]
        yield i, [reader.ids(sha, data, a, b) for a, b in zip(ends, ends[1:], strict=False)]


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids as array<int>) of every document, ends included; start: ids of all documents before it."""
    blocks, share = _open(spark, path)
    id_type, starts = blocks.schema["low"].dataType.simpleString(), _shard_starts(blocks)

    def read(batches):
        reader = _Reader(*share.value)
        for batch in batches:
            for i, docs in _each(batch, reader):
                n = np.array([len(d) for d in docs])
                first = starts[batch.column("shard")[i].as_py()] + batch.column("before")[i].as_py() + np.cumsum(n) - n
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.concatenate(docs).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(first, pa.int64()), pa.array(n, pa.int64()), ids], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids array<int>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document read back; the crc32 is of the ids as little-endian unsigned 32-bit integers."""
    blocks, share = _open(spark, path)
    id_type, starts = blocks.schema["low"].dataType.simpleString(), _shard_starts(blocks)

    def digest(batches):
        reader = _Reader(*share.value)
        for batch in batches:
            for i, docs in _each(batch, reader):
                n = np.array([len(d) for d in docs])
                first = starts[batch.column("shard")[i].as_py()] + batch.column("before")[i].as_py() + np.cumsum(n) - n
                crc = [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(digest, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_documents(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """(doc_id, ids) of the documents with the given ids: blocks are found by their least and greatest ids, which Parquet's statistics
    rule out by row group, and no frame but those asked for is decoded."""
    blocks, share = _open(spark, path)
    id_type, want = blocks.schema["low"].dataType.simpleString(), set(doc_ids)
    meets = F.lit(False)
    for i in sorted(want):
        meets = meets | ((F.col("low").isNull() | (F.col("low") <= i)) & (F.col("high") >= i))  # null ids stand first

    def read(batches):
        reader = _Reader(*share.value)
        for batch in batches:
            for i in range(batch.num_rows):
                data, ends = batch.column("data")[i].as_py(), [0, *batch.column("ends")[i].as_py()]
                at = [j for j, d in enumerate(batch.column("ids")[i].as_py()) if d in want]
                got = [reader.ids(batch.column("dictionary")[i].as_py(), data, ends[j], ends[j + 1]).tolist() for j in at]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values.take(pa.array(at, pa.int64())), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return blocks.filter(meets).mapInArrow(read, f"doc_id {id_type}, ids array<int>")
