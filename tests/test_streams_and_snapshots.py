"""Streams with state, the commit log, snapshots, mentions, suggestions, vector blocks and record rules, on small tables."""

import datetime as dt
import json
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import digests, mentions, questions, retrieval, snapshots, suggestions, validation
from tessera.operators.embedding import hashing_embedder
from tessera.session import broadcast_if_small, persist_table, shared_dir
from tessera.sources import readers
from tessera.streaming import occurrences, outbox

EVENT = "aggregate string, seq long, event_id long, ts timestamp, fails int"


def refuser():
    """A target that refuses an event as often as its column `fails` says; made here, so that it is sent to workers by value."""

    def refuse(event, attempt):
        if attempt <= event["fails"]:
            raise RuntimeError(f"refused {attempt}")

    return refuse


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def land(spark, path, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def run(spark, root, **how):
    stream = spark.readStream.schema(EVENT).parquet(f"{root}/in")
    outbox.project(stream, refuser(), f"{root}/out", **({"max_attempts": 3, "delay": "60 seconds", "late": "1 day"} | how))


LATER = ("~", 1, -1, dt.datetime(2024, 6, 1), 0)
EVENTS = [("a", 1, 10, at(0), 0), ("a", 2, 11, at(1), 2), ("a", 3, 12, at(2), 0), ("b", 1, 20, at(0), 0), ("b", 2, 21, at(1), 3), ("b", 3, 22, at(2), 0), ("c", 2, 31, at(1), 0), ("d", 1, 40, at(1), 1)]
DONE = {("a", 1, "applied", 1), ("a", 2, "applied", 3), ("a", 3, "applied", 1), ("b", 1, "applied", 1), ("b", 2, "dead_letter", 3), ("d", 1, "applied", 2), ("~", 1, "applied", 1)}


def told(spark, root):
    return {(r["aggregate"], r["seq"], r["status"], r["attempts"]) for r in outbox.outcomes(spark, f"{root}/out").collect() if r["status"] != "replayed"}


def test_projection_does_not_depend_on_batches(spark):
    """All at once, or out of order in five runs that restart from the checkpoint: the same outcomes, and replays change nothing."""
    one, many = folder(spark, "one"), folder(spark, "many")
    land(spark, f"{one}/in", EVENTS)
    run(spark, one)
    land(spark, f"{one}/in", [LATER])
    run(spark, one)
    assert told(spark, one) == DONE
    for part in (EVENTS[2:3] + EVENTS[5:6], EVENTS[1:2] + EVENTS[3:4], EVENTS[:1] + EVENTS[6:], [*EVENTS[4:5], *EVENTS[:2]], [LATER]):
        land(spark, f"{many}/in", part)
        run(spark, many)
    assert told(spark, many) == DONE
    assert {(r["aggregate"], r["seq"]) for r in outbox.outcomes(spark, f"{many}/out").filter("status = 'replayed'").collect()} == {("a", 1), ("a", 2)}
    dead = outbox.quarantine_items(outbox.outcomes(spark, f"{many}/out"), "run-1").collect()
    assert [(r["record_key"], r["reason_code"], json.loads(r["raw_value_redacted"])) for r in dead] == [("b", "projection_retry_exhausted", {"outbox_event_id": 21, "error": "RuntimeError: refused 3"})]


def test_retries_wait_for_their_delay_and_gaps_for_their_event(spark):
    root = folder(spark, "wait")
    land(spark, f"{root}/in", EVENTS)
    run(spark, root)
    assert told(spark, root) == {d for d in DONE if d[:2] not in (("a", 2), ("a", 3), ("b", 2), ("d", 1), ("~", 1))}
    land(spark, f"{root}/in", [("c", 1, 30, at(9), 0), LATER])
    run(spark, root)
    assert told(spark, root) == DONE | {("c", 1, "applied", 1), ("c", 2, "applied", 1)}
    with pytest.raises(ValueError):
        outbox.OrderedProjector(refuser(), 0, 0)


def record(i, **other):
    base = {"external_id": f"o{i}", "event_date": "2024-01-10", "license": "http://creativecommons.org/licenses/by/4.0/", "taxon_key": 7, "scientific_name": "Aa bb", "taxon_rank": "SPECIES", "lat": 1.0, "lon": 2.0, "occurrence_status": "PRESENT", "country_code": "KR", "genus_key": 3, "genus": "Aa", "species_key": 7, "species": "Aa bb"}
    return base | other


def pages(spark, path, *pages_):
    rows = [(i, status, digest, True, rs) for i, (status, digest, rs) in enumerate(pages_)]
    spark.createDataFrame(rows, occurrences.PAGE).write.parquet(path)


def test_windows_overlap_and_failed_runs_publish_nothing(spark):
    root = folder(spark, "ingest")
    store = occurrences.Store(spark, f"{root}/store")
    assert store.cursor() is None
    pages(spark, f"{root}/p1", (200, "h", [record(1, authorship="X"), record(2), record(1, authorship="X")]), (200, "h", [record(2), record(3, event_date="2023-01-01")]))
    one = occurrences.ingest_window(store, f"{root}/p1", 1, "2024-01-10", "KR")
    assert one["ok"] and (one["start"], one["source_count"], one["observations"], one["quarantine"]) == ("2023-12-11", 5, 2, 0) and store.cursor() == "2024-01-10"
    # The next window begins at the cursor: record 2 comes again, changed, and a record without a date is refused.
    again = [record(2, individual_count=4.0, vernacular_name="v"), record(4, event_date="2024-01-12"), record(6, event_date="2024-01-11"), record(7, event_date="2024-01-11"), record(5, event_date=None)]
    pages(spark, f"{root}/p2", (200, "h", again))
    # A lost file, a failed page and too many rejects each leave the cursor and the tables.
    broken = occurrences.ingest_window(store, f"{root}/p2", 2, "2024-01-12", "KR", tamper=lambda f: drop_rows(spark, f))
    assert not broken["ok"] and "loaded counts" in broken["reason"] and store.cursor() == "2024-01-10" and store.observations().count() == 2
    pages(spark, f"{root}/p3", (500, None, None), (200, "h", again))
    assert "page request" in occurrences.ingest_window(store, f"{root}/p3", 3, "2024-01-12", "KR")["reason"]
    pages(spark, f"{root}/p4", (200, "h", [record(8, country_code="JP", event_date="2024-01-11"), record(9, event_date="2024-01-11")]))
    assert "rejected ratio" in occurrences.ingest_window(store, f"{root}/p4", 4, "2024-01-12", "KR")["reason"]
    assert store.cursor() == "2024-01-10"
    good = occurrences.ingest_window(store, f"{root}/p2", 5, "2024-01-12", "KR")
    assert good["ok"] and store.cursor() == "2024-01-12"
    assert {(r["external_id"], r["count"]) for r in store.observations().collect()} == {("o1", None), ("o2", 4), ("o4", None), ("o6", None), ("o7", None)}
    assert [(r["external_id"], r["reasons"]) for r in store.quarantine().collect()] == [("o5", ["missing_event_date"])]
    taxa = {r["id"]: r for r in store.taxa().collect()}
    assert (taxa["taxon:7"]["authorship"], taxa["taxon:7"]["vernacular_name"], taxa["taxon:7"]["rank"]) == ("X", "v", "species") and set(taxa) == {"taxon:3", "taxon:7"}
    assert [(r["parent_id"], r["child_id"]) for r in store.links().collect()] == [("taxon:3", "taxon:7")]
    assert store.commits().count() == 5


def drop_rows(spark, f):
    kept = persist_table(spark.read.parquet(f"{f}/observations").drop("epoch").limit(1), "kept")
    kept.coalesce(1).write.mode("overwrite").parquet(f"{f}/observations/epoch=0")


def test_reasons_of_occurrences(spark):
    bad = [{}, {"license": "x"}, {"external_id": None}, {"taxon_key": None}, {"event_date": ""}, {"lat": float("nan")}, {"lon": None}, {"issues": ["ZERO_COORDINATE"]}, {"occurrence_status": None}, {"country_code": "JP"}, {"individual_count": 1.5}, {"individual_count": -1.0}]
    rows = spark.createDataFrame([record(i, **b) for i, b in enumerate(bad)], occurrences.RECORD)
    got = [r[0] for r in rows.select(occurrences.occurrence_reasons({c: F.col(f"`{c}`") for c in rows.columns}, F.lit("h"), "KR")).collect()]
    coordinate = ["invalid_or_missing_public_coordinate"]
    assert got == [[], ["license_not_allowed"], ["missing_external_id"], ["missing_taxon_identity"], ["missing_event_date"], coordinate, coordinate, ["unsafe_coordinate_issue"], ["not_present"], ["country_mismatch"], ["invalid_individual_count"], ["invalid_individual_count"]]


def table_of(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, text string")


def ids(s):
    return sorted(r["id"] for r in s.read().collect())


def test_snapshots_switch_or_fail_as_a_whole(spark):
    s = snapshots.Snapshot(spark, folder(spark, "snap"), "t")
    with pytest.raises(ValueError):
        s.read()
    first = s.replace(table_of(spark, (1, "a"), (2, "b"), (3, None)), "id")
    assert (first["seq"], first["added"]) == (1, 3)
    done = s.replace(table_of(spark, (2, "b"), (3, "c"), (4, "d")), "id")
    assert {k: done[k] for k in ("added", "removed", "changed", "kept")} == {"added": 1, "removed": 1, "changed": 1, "kept": 1} and ids(s) == [2, 3, 4]
    with pytest.raises(ValueError, match="several rows"):
        s.replace(table_of(spark, (1, "a"), (1, "b")), "id")
    # Rows that are staged but not published, a writer that read an older version, and other rows than expected change nothing.
    part = s.stage(table_of(spark, (9, "z")))
    with pytest.raises(ValueError, match="moved on"):
        s.publish([part], first)
    with pytest.raises(ValueError, match="not the expected"):
        s.publish([part], s.current(), snapshots.fingerprint(table_of(spark, (8, "z"))))
    assert ids(s) == [2, 3, 4] and [r["id"] for r in s.read(first).orderBy("id").collect()] == [1, 2, 3]


def test_appends_replay_and_conflict(spark):
    s = snapshots.Snapshot(spark, folder(spark, "snap"), "t")
    one = s.append(table_of(spark, (1, "a"), (2, None), (1, "a")), "id", ["id", "text"])
    assert one["append"] == 2 and ids(s) == [1, 2]
    again = s.append(table_of(spark, (1, "a"), (2, None)), "id", ["id", "text"])
    assert again["seq"] == 1 and again["replay"] == 2
    for bad in ([(1, "x"), (3, "c")], [(2, "null"), (3, "c")], [(3, "c"), (3, "d")]):
        with pytest.raises(ValueError, match="conflicting"):
            s.append(table_of(spark, *bad), "id", ["id", "text"])
    assert ids(s) == [1, 2]
    assert s.append(table_of(spark, (2, None), (3, "c")), "id", ["id", "text"])["rows"] == 3 and ids(s) == [1, 2, 3]


def test_catalog_survives_a_crash_before_its_switch(spark):
    s, e = snapshots.Snapshot(spark, folder(spark, "snap"), "v"), hashing_embedder(8)
    old, new = table_of(spark, (1, "red bird"), (2, "blue"), (3, "gone")), table_of(spark, (1, "red bird"), (2, "green"), (4, "new"))
    assert snapshots.index_catalog(s, old, e, 8, "p1", dry_run=True) == {"embed": 3, "reuse": 0, "retire": 0} and s.current() is None
    snapshots.index_catalog(s, old, e, 8, "p1")

    def crash():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        snapshots.index_catalog(s, new, e, 8, "p1", before_switch=crash)
    assert ids(s) == [1, 2, 3]
    calls = []

    def counting(texts):
        return e(texts)

    done = snapshots.index_catalog(s, new, counting, 8, "p1")
    assert {k: done[k] for k in ("embed", "reuse", "retire", "seq")} == {"embed": 2, "reuse": 1, "retire": 1, "seq": 2} and ids(s) == [1, 2, 4] and not calls
    assert snapshots.index_catalog(s, new, e, 8, "p2", dry_run=True) == {"embed": 3, "reuse": 0, "retire": 0}
    with pytest.raises(Exception, match="wrong_length"):
        snapshots.index_catalog(s, table_of(spark, (9, "x")), hashing_embedder(4), 8, "p1")
    assert ids(s) == [1, 2, 4]


def test_embedding_batches_are_refused_as_a_whole(spark):
    import hashlib

    good = {"id": 1, "text": "a b", "source": "s", "policy_status": "allowed", "embedding_allowed": True, "content_hash": hashlib.sha256(b"a b").hexdigest()}
    bad = [{"policy_status": None}, {"embedding_allowed": False}, {"source": "x"}, {"text": " "}, {"content_hash": None}]
    rows = [good, *[good | {"id": 2 + i} | b for i, b in enumerate(bad)], good | {"id": 9}, good | {"id": 9}]
    schema = "id long, text string, source string, policy_status string, embedding_allowed boolean, content_hash string"
    d, sources = spark.createDataFrame(rows, schema), spark.createDataFrame([("s",), ("s",)], "source string")
    issues = {(r["id"], r["issue"]) for r in snapshots.preflight_issues(d, sources).collect()}
    assert issues == {(2, "policy_denied"), (3, "embedding_not_allowed"), (4, "source_unknown"), (5, "empty_text"), (5, "hash_mismatch"), (6, "hash_mismatch"), (9, "duplicate_id")}
    with pytest.raises(ValueError, match="refused"):
        snapshots.embed_batch(d, sources, hashing_embedder(8), 8)
    assert snapshots.embed_batch(d.filter("id = 1"), sources, hashing_embedder(8), 8).count() == 1


def brute_mentions(texts, names):
    import re

    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = {}
    for e, n in names:
        if words(n):
            grams.setdefault(" ".join(words(n)), set()).add(e)
    out = set()
    for i, t in texts:
        w = words(t)
        spans = {(a, b, " ".join(w[a:b])) for a in range(len(w)) for b in range(a + 1, len(w) + 1) if " ".join(w[a:b]) in grams}
        for a, b, g in spans:
            if not any(c <= a and b <= d and (c, d) != (a, b) for c, d, _ in spans):
                out |= {(i, a, b, g, e, len(grams[g])) for e in grams[g]}
    return out


def test_mentions_equal_brute_force(spark):
    """Nested, overlapping, repeated and shared names in any case, and 5,000 names of one word."""
    r = random.Random(5)
    w = "red blue tit great spotted wood pecker king fisher".split()
    names = [(i, " ".join(r.choice(w) for _ in range(r.choice((1, 2, 2, 3, 5))))) for i in range(40)] + [(100 + i, f"n{i}x") for i in range(5000)] + [(7, "Great  TIT!"), (8, "great-tit"), (9, ""), (10, None), (11, "--")]
    texts = [(i, " ".join(r.choice([*w, "the", "n17x", "N4999X", "Great Tit,"]) for _ in range(r.randrange(1, 40)))) for i in range(80)] + [(90, None), (91, ""), (92, "GREAT TIT")]
    got = mentions.mention_spans(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names, "entity long, name string"))
    assert {tuple(x) for x in got.select("id", "start", "stop", "gram", "entity", "entities").collect()} == brute_mentions(texts, names)


def test_short_items_have_no_cap(spark):
    items = [(i, f"w{i}") for i in range(1500)] + [(2000, "a b"), (2001, "x"), (2002, None), (2003, "")]
    docs = [(1, "say w7, xw1499y and a b"), (2, "w70"), (3, None), (4, "A B")]
    got = retrieval.containing(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "query long, q string"))
    want = {(i, d) for i, q in items if q for d, t in docs if t and q in t}
    assert {tuple(x) for x in got.collect()} == want and len(want) > 6


def test_suggestions_take_each_branch(spark):
    inv = spark.createDataFrame([(1, "red widget", True), (2, "red widgets", True), (3, "blue bolt", False), (4, "redwing", True), (5, "abcdefgh", True), (6, "red wiggle", True)], "entity long, name string, active boolean")
    asked = ["red widget", "red wing", "red widg1t", "blue bolt", "what is red widget?", "zzzz", None, "a b c d e", "q" * 41]
    rows = spark.createDataFrame(list(enumerate(asked)), "id long, mention string")
    out = suggestions.suggest_names(rows, inv).collect()
    of = lambda i: [(r["status"], r["method"], r["entity"]) for r in sorted(out, key=lambda r: r["rank"] or 0) if r["id"] == i]
    assert of(0) == [("matched", "exact", 1)] and of(1) == [("matched", "compact", 4)]
    assert of(2) == [("candidates", "letters", 1), ("candidates", "letters", 2), ("candidates", "letters", 6)]
    assert all(of(i) == [("not_found", "none", None)] for i in (4, 5, 6, 7, 8)) and all(r["entity"] != 3 for r in out)
    assert {r["status"] for r in suggestions.suggest_names(rows, inv.limit(0)).collect()} == {"unavailable", "not_found"}
    # No name reaches this cosine, so one edit decides; without it nothing is suggested.
    near = suggestions.suggest_names(spark.createDataFrame([(1, "abcdxfgh"), (2, "abcxxfgh")], "id long, mention string"), inv, cosine=0.99, spelling=0.2).collect()
    assert {(r["id"], r["status"], r["entity"]) for r in near} == {(1, "candidates", 5), (2, "not_found", None)}


def test_letter_neighbours_lose_no_pair(spark):
    r = random.Random(1)
    names = sorted({"".join(r.choice("abcd ") for _ in range(r.randrange(2, 12))) for _ in range(150)})
    asked = sorted({"".join(r.choice("abcd ") for _ in range(r.randrange(1, 12))) for _ in range(60)})

    def grams(t):
        from collections import Counter

        p = f" {t} "
        return Counter(p[i : i + 3] for i in range(max(len(p) - 2, 1)))

    def cosine(a, b):
        x, y = grams(a), grams(b)
        return round(sum(v * y[k] for k, v in x.items()) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5, 6)

    got = suggestions.letter_neighbours(spark.createDataFrame([(a,) for a in asked], "mention string"), spark.createDataFrame([(n,) for n in names], "name string"), 0.2)
    assert {(x["mention"], x["name"], x["score"]) for x in got.collect()} == {(a, n, cosine(a, n)) for a in asked for n in names if cosine(a, n) >= 0.2}


@pytest.mark.parametrize("scope", [None, "label"])
def test_vector_blocks_equal_brute_force(spark, scope):
    """Ties, zero vectors, other lengths and null scopes; small blocks."""
    g = np.random.default_rng(3)
    x = np.round(g.normal(size=(300, 6)), 1)
    x[50:90] = x[50]
    x[7] = 0
    rows = [(i, x[i].tolist() if i != 8 else [1.0, 2.0], None if i % 11 == 0 else i % 4) for i in range(300)]
    v = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(3)
    q = v.filter("id % 20 < 3").select(F.col("id").alias("query"), F.col("v").alias("q"), "label")
    got = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in retrieval.cosine_top_k(v, q, 4, scope=scope, block=7).collect()}
    want = {}
    for i in (r[0] for r in rows if r[0] % 20 < 3):
        if i in (7, 8):
            continue
        near = [(-round(float(x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j])), 6), j) for j in range(300) if j not in (7, 8) and (scope is None or (rows[i][2] is not None and rows[i][2] == rows[j][2]))]
        for n, (s, j) in enumerate(sorted(near)[:4], 1):
            want[i, n] = (j, -s)
    want_8 = {k: val for k, val in got.items() if k[0] == 8}
    got = {k: val for k, val in got.items() if k[0] != 8}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    assert want_8 in ({}, {(8, 1): (8, 1.0)})


def test_cells_rank_as_pairs_do(spark):
    """Similarity from cells equals scores of all pairs, with unknown depths, an order of one, and k beyond the pool."""
    r = random.Random(2)
    rows = [(i, f"o{r.randrange(3)}", f"g{r.randrange(4)}", r.choice([None, 1, 2]), r.randrange(2), r.choice([None, 1, 3, 9])) for i in range(120)] + [(500, "alone", "g", 1, 1, 1)]
    e = spark.createDataFrame(rows, "entity long, `order` string, genus string, habitat int, diet int, depth int")
    got = {}
    for x in questions.similarity(e, e.filter("entity % 10 = 0"), 5).collect():
        got.setdefault(x["origin"], []).append((x["rank"], x["peer"], x["score"]))
    for o in rows:
        if o[0] % 10:
            continue
        pool = [p for p in rows if p[1] == o[1] and p[0] != o[0]]
        levels = sorted({p[5] for p in pool if p[5] is not None})

        def score(p, o=o, levels=levels):
            base = 10 + 20 * (p[2] == o[2]) + 10 * (p[3] == o[3]) + 10 * (p[4] == o[4])
            return base * 2.0 if p[5] is None else base + round(50.0 * (levels.index(p[5]) + 1) / len(levels), 1)

        want = sorted((-score(p), p[0]) for p in pool)[:5]
        assert [(x[1], x[2]) for x in sorted(got.get(o[0], []))] == [(i, pytest.approx(-s)) for s, i in want]


def test_related_lists_are_whole(spark):
    r = random.Random(4)
    rows = [(i, f"o{r.randrange(2)}", r.choice(["big", "big", "big", "g1", "g2"])) for i in range(90)]
    e = spark.createDataFrame(rows, "entity long, `order` string, genus string")
    got = questions.related(e, e.filter("entity % 3 = 0"), 4).collect()
    for o in (x for x in rows if x[0] % 3 == 0):
        for relation, same in (("genus", True), ("order", False)):
            pool = sorted(x[0] for x in rows if x[1] == o[1] and x[0] != o[0] and (x[2] == o[2]) == same)
            mine = sorted((x["rank"], x["peer"], x["has_more"]) for x in got if x["origin"] == o[0] and x["relation"] == relation)
            assert mine == [(n, p, len(pool) > 4) for n, p in enumerate(pool[:4], 1)]


def test_broadcast_counts_bytes(spark):
    long = persist_table(spark.createDataFrame([(i, "x" * 1000, ["y" * 100]) for i in range(50)], "id int, t string, a array<string>"), "long")
    hint = lambda df: "Broadcast" in df._jdf.queryExecution().logical().toString() or "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(broadcast_if_small(long)) and not hint(broadcast_if_small(long, most_bytes=20_000)) and not hint(broadcast_if_small(long, most_rows=10))


def test_records_are_validated_by_type(spark):
    common = {f: "x" for f in ("record_key", "source_id", "source_release", "external_id", "raw_object_uri", "raw_sha256", "retrieved_at", "parser_version", "ingestion_run_id")} | {"license_policy_status": "denied"}
    seen = {"occurrence_id": "o", "scientific_name_raw": "s", "event_date_raw": "2024-02-29", "event_date_precision": "day", "basis_of_record": "b", "sensitivity_class": "public", "occurrence_status": "present"}
    rows = [("observation", common | seen), ("observation", common | seen | {"count": True, "latitude_public": 90, "longitude_public": 180.5}), ("observation", common | seen | {"event_date_raw": "2023-02-29"}), ("chunk", common | {"ordinal": 0}), ("nothing", common), (None, {}), ("document", common | {"document_id": "d", "title": "t", "language": "l", "fulltext_storage_allowed": True, "chunk_storage_allowed": False, "embedding_allowed": None})]
    d = spark.createDataFrame([(t, json.dumps(r | {"record_key": f"k{i}"} if r else r)) for i, (t, r) in enumerate(rows)], "record_type string, r string").select("record_type", F.parse_json("r").alias("record"))
    got = {}
    for x in validation.staging_issues(d).collect():
        got.setdefault(x["record_key"], []).append((x["reason_code"], x["field_path"]))
    assert "k0" not in got and got["k1"] == [("invalid_longitude", "longitude_public"), ("invalid_count", "count")] and got["k2"] == [("invalid_date", "event_date_raw")]
    assert got["k3"][-1] == ("invalid_chunk_ordinal", "ordinal") and len(got["k3"]) == 7 and got["k4"] == [("unknown_record_type", "record_type")] and got["k6"] == [("invalid_document_policy_flag", "embedding_allowed")]
    assert len(got["<missing-record-key>"]) == 12


CC = ("https://creativecommons.org/licenses/by/4.0/",)


def archive(spark, meta, core, extension):
    p = folder(spark, "archive")
    for name, lines in (("meta.xml", [meta]), ("core.txt", core), ("extension.txt", extension)):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{p}/{name}")
    return p


META = '<archive licence="{licence}"><core location="core.txt" separator="\\t"><id index="{id}"/><field index="1" term="name"/></core><extension location="extension.txt" separator="|"><coreid index="0"/><field index="1" term="{term}"/></extension></archive>'
GOOD = {"licence": CC[0], "id": 0, "term": "line"}


def test_archives_hold_to_their_descriptor(spark):
    p = archive(spark, META.format(**GOOD), ["1\ta", "2\tb\tc", "\td", "1\tz", "3\t"], ["1|x", "1|y", "9|z", "3|x|y"])
    core, extension, issues = readers.described_archive(spark, p, CC)
    assert sorted(map(tuple, core.select("id", "name").collect())) == [("1", "a"), ("3", "")] and sorted(map(tuple, extension.select("id", "line").collect())) == [("1", "x"), ("1", "y")]
    assert {tuple(r) for r in issues.collect()} == {("core", "2\tb\tc", "wrong_width"), ("core", "\td", "empty_id"), ("core", "1\tz", "duplicate_id"), ("extension", "9|z", "orphan"), ("extension", "3|x|y", "wrong_width")}
    for wrong in ({"licence": "x"}, {"id": 1}, {"id": 2}, {"term": "id"}):
        with pytest.raises(ValueError):
            readers.described_archive(spark, archive(spark, META.format(**(GOOD | wrong)), ["1\ta"], ["1|x"]), CC)


def test_tree_digests_depend_on_rows_alone(spark):
    rows = [(i % 3, f"row {i}" if i % 50 else None) for i in range(3000)] + [(7, ""), (7, ""), (8, None)]
    d = spark.createDataFrame(rows, "k long, t string")
    of = lambda df: {r["k"]: r["digest"] for r in digests.tree_digests(df, ["k"], F.col("t")).collect()}
    one = of(d)
    assert one == of(d.repartition(5, "t").orderBy(F.desc("t"))) and len(set(one.values())) == 5
    assert of(d.filter("t is null or t <> 'row 1'"))[1] != one[1] and of(d.dropDuplicates())[7] != one[7]
    ids_ = spark.createDataFrame([(1,)], "x int").select(digests.content_address(F.lit(one[0]), "p1"), digests.content_address(F.lit(one[0]), "p2")).first()
    assert ids_[0] != ids_[1] and ids_[0].startswith("ds-")
