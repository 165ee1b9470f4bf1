"""Prefix trie, vector codes and token files against brute force, and their odd inputs."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie, token_files, vector_codes
from tessera.llm.common import new_path

from tests.llm.conftest import prose

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    """{(path): values} of rebuilt conversations, node by node."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        leaves = sum(not kids[q] for q in under)
        saved = sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in under)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves, saved, sha))
    return sorted(out, key=repr)


def trie_rows(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def talk(seed, n):
    """Conversations with shared beginnings, exact copies of one, a long one, nulls, repeated rows and ids below zero."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        c = i * 7 - 300
        for t in range(r.randrange(1, 7)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["hi", "é👍", "what now", None, ""])))
    rows += [(10_000 + i, t, "user", f"copy {t}") for i in range(120) for t in range(7)]
    rows += [(5_000, t, "user", f"long {t}") for t in range(200)]
    rows += [(5_001, None, None, None), (5_001, None, "user", None), (5_001, 0, "user", "x"), (5_001, 0, "user", "x"), (None, 0, "user", "lost")]
    return rows


@pytest.mark.parametrize("shards", [1, 4, 60])
def test_trie_equals_brute_force(spark, monkeypatch, shards):
    """With one shard, a few, and so many that the copies of one conversation are parted."""
    rows = talk(3, 90)
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", max(1, 211 // shards))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(shards, 4)))
    try:
        assert trie_rows(prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS).withColumn("node", F.lit("clash")))) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_halves_a_skeleton_that_is_too_large(spark, monkeypatch):
    rows = talk(5, 60)
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", 4)
    monkeypatch.setattr(prefix_trie, "MOST_NODES", 20)
    assert trie_rows(prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS))) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(c, 0, "user", "only") for c in range(1, 30)]  # those with h > 0 lose their turn and have no base
    assert trie_rows(prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS))) == brute_trie(rows)


def brute_codes(vectors, entries=64, rounds=2, parts=16):
    x = np.floor(np.asarray(vectors, dtype=np.float64) * 256).astype(np.int64).reshape(len(vectors), parts, -1).transpose(1, 0, 2)
    books = x[:, :entries].copy()
    for k in range(rounds + 1):
        d2 = np.square(x[:, :, None] - books[:, None]).sum(axis=3)
        own = d2.argmin(axis=2)
        if k < rounds:
            for p in range(parts):
                for e in np.unique(own[p]):
                    at = x[p][own[p] == e]
                    books[p, e] = at.sum(axis=0) // len(at)
    return own.T, np.take_along_axis(d2, own[:, :, None], 2)[:, :, 0].sum(axis=0), books


@pytest.mark.parametrize("width, spread", [(32, 1.0), (64, 0.02), (16, 100.0)])
def test_vector_codes_equal_brute_force(spark, width, spread):
    """With copies of vectors, and so little spread that entries and distances tie."""
    r = np.random.default_rng(width)
    x = r.normal(0, spread, (700, width)).astype(np.float32)
    x[100:300] = x[100]
    x[3] = x[1]
    x[350:360, : width // 2] = x[2, : width // 2]
    rows = [(i, [float(v) for v in x[i]], None if i % 5 == 0 else i % 5) for i in r.permutation(len(x)).tolist()]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    coded, books = vector_codes.encode_vectors(d)
    code, error, want = brute_codes(x)
    assert books == want.tolist()
    out = {r["vec_id"]: r for r in vector_codes.with_label_error(coded).collect()}
    assert len(out) == 700
    for i in range(700):
        assert (out[i]["code"], out[i]["error"]) == (bytes(code[i].astype(np.uint8)).hex(), error[i])
        assert out[i]["label_error"] == error[[j for j in range(700) if (j % 5 == 0) == (i % 5 == 0) and j % 5 == i % 5]].sum()


def test_forest_covers_its_points_and_walks_exactly():
    """Every ball holds its points, sums add up, and any codebook gets what a scan of all entries gives, also far from the points."""
    r = np.random.default_rng(1)
    for n, d, scale in ((1, 1, 5), (2, 3, 0), (300, 2, 4), (3000, 4, 200), (500, 5, vector_codes.MOST)):
        x = r.integers(-scale, scale + 1, (16, n, d))
        f = vector_codes.Forest.build(x, 16)
        again = vector_codes.Forest.unpack(f.pack(), 16, d)
        assert (again.points == x).all() and (again.leaf == f.leaf).all() and (f.count[:16] == n).all() and (f.total[:16] == x.sum(axis=1)).all()
        up = np.full(len(f.count), -1)
        inner = np.flatnonzero(f.child[:, 0] >= 0)
        up[f.child[inner].ravel()] = np.repeat(inner, 2)
        assert (f.count[f.child[inner]].sum(axis=1) == f.count[inner]).all() and (f.total[f.child[inner]].sum(axis=1) == f.total[inner]).all()
        for p in range(16):
            node = f.leaf[p].astype(int)
            while (node >= 0).any():
                at = np.flatnonzero(node >= 0)
                mean = f.total[node[at]] / f.count[node[at]][:, None]
                assert (np.sqrt(np.square(x[p][at] - mean).sum(axis=1)) <= f.radius[node[at]] * (1 + 1e-9) + 1e-6).all()
                node[at] = up[node[at]]
        for k in (1, 2, 70):
            books = r.integers(-2 * scale - 1, 2 * scale + 2, (16, k, d)).clip(-vector_codes.MOST, vector_codes.MOST)
            d2 = np.square(x[:, :, None] - books[:, None]).sum(axis=3)
            code, error = f.codes(books)
            assert (code == d2.argmin(axis=2).T).all() and (error == d2.min(axis=2).sum(axis=0)).all()
            total, count = f.sums(books)
            assert count.sum() == 16 * n and all((count[p] == np.bincount(d2[p].argmin(axis=1), minlength=k)).all() for p in range(16)) and (total.sum(axis=1) == x.sum(axis=1)).all()


def test_balls_are_owned_whole():
    """Points in few tight bunches: most are given to an entry with their ball, unmeasured."""
    r = np.random.default_rng(2)
    x = (r.integers(-4000, 4000, (16, 30, 4))[:, r.integers(0, 30, 4000)] + r.integers(-3, 4, (16, 4000, 4))).astype(np.int64)
    f = vector_codes.Forest.build(x)
    (node, _), _ = f.walk(x[:, :64])
    assert f.count[node].sum() + 0 <= 16 * 4000
    far = r.integers(-4000, 4000, (16, 8, 4))
    (node, _), _ = f.walk(far)
    assert f.count[node].sum() > 0.8 * 16 * 4000


def test_vector_codes_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [0.5] * 16, 1, "x"), (1, [0.5] * 16, 1, "x"), (2, None, 1, "x"), (3, [0.1] * 15 + [None], 1, "y"), (4, [nan] * 16, 2, "y"), (5, [inf] * 16, 2, None), (6, [], None, None),
        (7, [1.0] * 3, None, "z"), (None, [0.25] * 16, None, "z"), (8, [3e38] * 16, 3, "z"),
    ]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string")
    coded, books = vector_codes.encode_vectors(d)
    out = vector_codes.with_label_error(coded).orderBy("vec_id", "code").collect()
    assert [r["vec_id"] for r in out] == [None, 1, 1, 6, 7, 8] and [r["code"] is None for r in out] == [False, False, False, True, True, False]
    assert all(r["error"] == 0 for r in out if r["code"]) and np.array(books).shape == (16, 4, 1)
    coded, books = vector_codes.encode_vectors(d.filter("vec_id > 5 and vec_id < 8"))
    assert coded.count() == 2 and books == []
    assert vector_codes.encode_vectors(d.limit(0))[0].count() == 0


def test_label_errors_by_shuffle(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"{i:02x}", i, None if i % 3 == 0 else f"l{i % 3}") for i in range(90)], "vec_id long, code string, error long, label string")
    want = {(r["vec_id"], r["label_error"]) for r in vector_codes.with_label_error(d).collect()}
    monkeypatch.setattr(vector_codes, "small_enough", lambda *a: False)
    assert {(r["vec_id"], r["label_error"]) for r in vector_codes.with_label_error(d, salts=4).collect()} == want and len(want) == 90


ODD_TEXTS = ["a  b", "  x y ", "a \n b c d e", "it's 's <|endoftext|> x<|endoftext|>y", "日本 語 é ", "\x1c a", "a \x1cb", "tab\t b c", "", None, " ", "a ", "é\xa0 b 　c", "naïve Straße, ὅς! x?!", "I'll don't 's x'sy a\n\nb a\nb \nc d.\nE12f|g", "\n", "x\n", "\nx y", "a\x00b c", "é f 1,000.5% ½", "''s 'LL we're"]


def test_encoder_equals_the_library():
    """Pieces give the ids of whole texts, before and after all is forgotten."""
    r = random.Random(4)
    parts = [" ", " ", " ", "\n", "  ", "'s", "'", ".", "don't", "Ünï", "x1", "12", "|", "<|endoftext|>", " ", "日本", "\t", "The", "zz"]
    texts = ODD_TEXTS + [prose(i, 40) for i in range(20)] + ["".join(r.choice(parts) for _ in range(r.randrange(1, 30))) for _ in range(1500)]
    for most in (800_000, 50):
        e = token_files.Encoder(BPE, most)
        assert e.cuts
        for lo in range(0, len(texts), 300):
            some = texts[lo : lo + 300]
            ids, at = e(pa.array(some, pa.string()))
            want = e.library.encode_batch([t or "" for t in some], add_special_tokens=False)
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [w.ids for w in want]
    lower = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    ids, at = lower(pa.array(["Some Text", None]))
    assert not lower.cuts and ids.tolist() == lower.library.encode("Some Text", add_special_tokens=False).ids and at.tolist() == [0, len(ids), len(ids)]


@pytest.mark.parametrize("block", [3, 2048])
def test_token_files_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK_DOCS", block)
    texts = [*ODD_TEXTS, prose(9, 20_000), *[prose(i, 30) for i in range(200)]]
    rows = [(i * 3 - 50, t, "clash") for i, t in enumerate(texts)]
    random.Random(2).shuffle(rows)
    rows += [(None, "null id", None), (1, "same id", "s"), (1, "same id", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    path = new_path(spark, "tokens")
    token_files.write_token_files(d, path, BPE, end_id=2)
    lib = token_files.encoder(BPE).library
    ids_of = lambda t: [*lib.encode(t or "", add_special_tokens=False).ids, 2]
    want, at = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.token_digests(spark, path).orderBy("start").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    same = lambda rows: sorted((r for r in rows if r[0] != 1), key=key)  # noqa: E731  # equal ids follow each other in stored order
    assert same(got) == same(want) and Counter3(got) == Counter3(want)
    read = {r["doc_id"]: (r["start"], r["ids"]) for r in token_files.read_token_files(spark, path).filter("doc_id != 1").collect()}
    text = {i: t for i, t, _ in rows}
    assert all(v[1] == ids_of(text[i]) for i, v in read.items())
    one = token_files.token_documents(spark, path, [-50, 13, 400, 10**9]).collect()
    assert {r["doc_id"]: r["ids"] for r in one} == {i: ids_of(text[i]) for i in (-50, 13, 400)}


def Counter3(rows):
    return sorted((r[2], r[3]) for r in rows)


def test_token_files_of_nothing_and_of_a_changed_dictionary(spark):
    path = new_path(spark, "tokens")
    token_files.write_token_files(spark.createDataFrame([], "doc_id string, text string"), path, BPE, end_id=2)
    assert token_files.token_digests(spark, path).count() == 0 and token_files.token_documents(spark, path, ["x"]).count() == 0
    path = new_path(spark, "tokens")
    token_files.write_token_files(spark.createDataFrame([("b", "two words"), ("a", None)], "doc_id string, text string"), path, BPE, end_id=2)
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in token_files.token_digests(spark, path).orderBy("start").collect()] == [("a", 0, 1), ("b", 1, 3)]
    other = new_path(spark, "tokens")
    spark.read.parquet(f"{path}/blocks").withColumn("dictionary", F.lit("0" * 64)).write.parquet(f"{other}/blocks")
    spark.read.parquet(f"{path}/dictionary").write.parquet(f"{other}/dictionary")
    with pytest.raises(Exception, match="dictionary"):
        token_files.token_digests(spark, other).collect()


def test_token_files_share_their_dictionary(spark):
    """Short documents are smaller with the shared dictionary than alone."""
    import zstandard

    d = spark.createDataFrame([(i, prose(i, 25)) for i in range(900)], "doc_id long, text string")
    path = new_path(spark, "tokens")
    token_files.write_token_files(d, path, BPE, end_id=2)
    packed = spark.read.parquet(f"{path}/blocks").agg(F.sum(F.length("data"))).first()[0]
    alone = 0
    for r in token_files.read_token_files(spark, path).collect():
        alone += len(zstandard.compress(np.array(r["ids"], dtype="<u2").tobytes(), 3))
    assert packed < 0.85 * alone
