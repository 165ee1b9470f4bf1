"""Operators of the library on small tables: null logic, ambiguity, order of reasons, and equality with the SQL oracles."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import scalars as S
from tessera.operators import control, filters, hierarchy, policy, questions, reconcile, retrieval

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return "NULL" if x != x else repr(round(x, 6) + 0.0)
    return "NULL" if x is None else str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE) if os.path.isdir(SF) else [])
def test_query_equals_its_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    rel = duck.sql(plans.ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(tuple(value(r[c]) for c in cols) for r in df.collect())
    at = [list(rel.columns).index(c) for c in cols]
    assert got == sorted(tuple(value(r[i]) for i in at) for r in rel.fetchall())


def one(spark, *cols, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(*cols).first()


def test_claim_guard_keeps_three_valued_logic(spark):
    rows = [(False, "size", "D", None), (None, "size", "A", None), (None, "diet", "A", "r1"), (None, "diet", "D", "r1"), (True, "diet", "A", None), (False, "size", "A", "r0")]
    d = spark.createDataFrame(rows, "inferred boolean, trait string, certainty string, taxonomy_release string").withColumn("policy_status", F.lit("allowed"))
    assert [r[0] for r in d.select(F.coalesce(filters.claim_guard(), F.lit(False))).collect()] == [True, False, True, False, False, False]


def test_unknown_scope_is_the_complement_of_pairs(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "entity int, name string")
    k = spark.createDataFrame([(1, "a", True), (2, "x", True), (3, "c", False)], "entity int, name string, in_region boolean")
    assert [sorted(r.entity for r in filters.in_scope(e, k, s).collect()) for s in ("all", "inside", "outside", "unknown")] == [[1, 2, 3], [1], [3], [2]]


def test_units_must_match(spark):
    d = spark.createDataFrame([("gte", 5.0, "cm", 4.0, "cm"), ("gte", 5.0, "mm", 4.0, "cm"), ("lt", None, "cm", 4.0, "cm")], "op string, value_num double, unit string, threshold double, want_unit string").withColumn("value_text", F.lit("x")).withColumn("value", F.lit("y"))
    assert [r[0] for r in d.select(filters.condition_holds()).collect()] == [True, False, False]


def test_conditions_tell_no_data_from_no_match(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "entity long, name string")
    c = spark.createDataFrame([(10, 1, "size", 9.0, None, "cm"), (20, 2, "size", 1.0, None, "cm")], "claim long, entity long, trait string, value_num double, value_text string, unit string")
    k = spark.createDataFrame([(1, "size", "gte", None, 5.0, "cm")], "cond int, trait string, op string, value string, threshold double, want_unit string")
    cov = questions.coverage(questions.evaluate_conditions(e, c, k)).first()
    assert (cov.scoped, cov.evaluable, cov.matched, cov.status) == (3, 2, 1, "answer")
    assert questions.coverage(questions.evaluate_conditions(e, c.limit(0), k)).first().status == "insufficient_data"
    assert questions.coverage(questions.evaluate_conditions(e, c.filter("entity = 2"), k)).first().status == "empty"


def test_exact_match_never_chooses(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "sid int, k string")
    t = spark.createDataFrame([(7, "a"), (8, "b"), (9, "b"), (7, "a")], "tid int, k string")
    got = {r.sid: (r.tid, r.status) for r in reconcile.exact_match(s, t, "k", "sid", "tid").collect()}
    assert got == {1: (7, "matched"), 2: (None, "ambiguous"), 3: (None, "not_found"), 4: (None, "not_found")}


def test_label_conflicts_in_both_directions(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (3, "c"), (4, "d")], "entity int, label string")
    assert {(r.entity, r.label): r.kind for r in reconcile.label_conflicts(d).collect()} == {(1, "a"): "many_labels", (1, "b"): "many_labels", (2, "c"): "many_entities", (3, "c"): "many_entities"}


def test_forward_fill_resets(spark):
    d = spark.createDataFrame([(1, "order", None), (2, "genus", "g1"), (3, "sp", None), (4, "order", None), (5, "sp", None), (6, "genus", "g2"), (7, "sp", None)], "pos int, rank string, g string").withColumn("f", F.lit(1))
    got = d.select("pos", hierarchy.forward_fill(d, ["f"], "pos", F.col("g"), F.col("rank") == "order").alias("g")).orderBy("pos").collect()
    assert [r.g for r in got] == [None, "g1", "g1", None, None, "g2", "g2"]


def test_fusion_keeps_the_first_rank_of_a_repeated_id(spark):
    d = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 2), (1, "a", "x", 3), (1, "b", "y", 1)], "query int, channel string, id string, rank int")
    got = {r.id: (r.score, r.channels) for r in retrieval.fuse(d).collect()}
    assert got == {"x": (round(1 / 61, 9), "a"), "y": (round(1 / 62 + 1 / 61, 9), "a+b")}


def test_containing_equals_a_plain_search(spark):
    docs = [(1, "the red fox runs far away today"), (2, "xthe red fox runs far awayx"), (3, "the red fox\nruns far"), (4, None), (5, ""), (6, "fox"), (7, "a red  fox"), (7, "a red  fox"), (8, "ed fox ru")]
    items = [(10, "he red fox runs far awa"), (11, "ed fox ru"), (12, "fox"), (13, "red fox"), (14, None), (15, "fox\nruns"), (16, "red  fox"), (17, "not there at all is it")]
    got = {tuple(r) for r in retrieval.containing(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "query long, q string")).collect()}
    assert got == {(q, i) for q, x in items for i, t in docs if x is not None and t is not None and x in t}
    assert retrieval.containing(spark.createDataFrame(docs, "id long, text string").limit(0), spark.createDataFrame(items, "query long, q string")).count() == 0


def test_activation_outcomes(spark):
    state = spark.createDataFrame([("p", "r0", 5, 3)], "pipeline string, active string, active_run int, version int")
    runs = spark.createDataFrame([("p", 5, "r0", "loading", 3), ("p", 6, "r1", "failed", 3), ("p", 7, "r2", "loading", 3), ("p", 8, "r3", "loading", 2), ("p", 9, "r4", "loading", 3), ("n", 1, "r9", "loading", 0)], "pipeline string, run int, release string, status string, expected_version int")
    q = spark.createDataFrame([(7, "blocked", "open"), (9, "blocked", "resolved")], "run int, severity string, resolution string")
    got = [(r.pipeline, r.active, r.version, r.outcome) for r in control.activate(state, runs, q).collect()]
    assert sorted(got) == sorted([("p", "r0", 3, "already_active"), ("p", "r0", 3, "not_loading"), ("p", "r0", 3, "blocked"), ("p", "r0", 3, "version_conflict"), ("p", "r4", 4, "activated"), ("n", "r9", 1, "activated")])


def test_quarantine_identity_treats_null_paths_as_empty(spark):
    schema = "record_key string, stage string, reason_code string, field_path string, first_seen int, last_seen int"
    a, b = spark.createDataFrame([("k", "s", "r", None, 1, 1)], schema), spark.createDataFrame([("k", "s", "r", "", 4, 4), ("k", "s", "r", "f", 4, 4)], schema)
    assert {(r.field_path, r.first_seen, r.last_seen) for r in control.quarantine_upsert(a, b).collect()} == {("", 1, 4), ("f", 4, 4)}


def test_scalars(spark):
    assert one(spark, S.one_edit(F.col("a"), F.col("b")), a=("string", "abcd"), b=("string", "abdc"))[0]
    assert not one(spark, S.one_edit(F.col("a"), F.col("b")), a=("string", "abcd"), b=("string", "abcd"))[0]
    assert not one(spark, S.one_edit(F.col("a"), F.col("b")), a=("string", "abcd"), b=("string", "dbca"))[0]
    assert [one(spark, S.date_precision(F.col("a")), a=("string", x))[0] for x in ("2024-01-02T03", "2024-01-02", "2024-01", "2024", "2024/2025", "soon")] == ["instant", "day", "month", "year", "range", "unknown"]
    assert [one(spark, S.web_url(F.col("a")), a=("string", x))[0] for x in ("https://a.b/c", "ftp://a", "http://u:p@h/", "", None)] == [True, False, False, False, False]
    assert one(spark, S.share(F.col("m"), ["a", "a", "b", "c"]), m=("map<string,double>", {"a": 10.0, "b": 101.0, "c": 5.0}))[0] == 15.0
    assert [one(spark, S.positive_number(F.col("a")), a=("string", x))[0] for x in ("1.5", "NA", "-1", "inf", "nan", "x", None)] == [1.5, None, None, None, None, None, None]
    assert one(spark, S.normalize_name(F.col("a")), a=("string", "  é  a "))[0] == "é a" and one(spark, S.fold(F.col("a")), a=("string", "Ça’É"))[0] == "cae"


def test_gate_reports_reasons_in_order(spark):
    d = spark.createDataFrame([(1,), (1,)], "k int")
    r = policy.gate(d, {"n": F.count("*"), "ids": F.count_distinct("k")}, [("empty", F.col("n") == 0), ("duplicates", F.col("n") != F.col("ids"))]).first()
    assert (r.reasons, r.ready) == ("duplicates", False)
    assert policy.gate(d.limit(0), {"n": F.count("*"), "ids": F.count_distinct("k")}, [("empty", F.col("n") == 0)]).first().reasons == "empty"


def test_single_byte_table_holds_whole_texts(spark, tmp_path):
    texts = ["é" * 100 + "\nß end\r\n", 'a\t"q" \\n \\b \\N', "  日本👍 x ", "", None, "\\N", '"', "word " * 20000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in plans.QUERIES["src03_single_byte_table"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == [None if t is None else t.encode("latin-1", "replace").decode("latin-1") for t in texts]


def test_queries_leave_no_row_out(spark):
    n = lambda t, c: spark.read.parquet(f"{SF}/{t}.parquet").select(c).distinct().count()
    run = lambda q: plans.QUERIES[q](spark, SF)
    assert run("q01_common_taxonomy").count() == n("part", "p_partkey") and run("ag21_held_cases").count() == n("events", "event_id")
    assert run("src03_single_byte_table").count() == n("documents", "doc_id")
    asked = spark.read.parquet(f"{SF}/part.parquet").filter("p_partkey % 20 = 0").select("p_partkey").collect()
    for q in ("q07_related_species", "q09_similar_species", "jn20_category_peers", "wn03_ordinal_closeness"):
        assert {r.origin for r in run(q).select("origin").collect()} <= {r[0] for r in asked}
        assert run(q).count() > 0
    assert run("jn13_family_without_genus").count() > len(asked) and run("q02_same_genus").select("origin").distinct().count() > len(asked)
