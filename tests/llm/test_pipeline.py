"""Each stage of the corpus pipeline against brute force, each on the rows that its predecessor kept."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.common import persist_table
from tests.llm.conftest import prose
from tests.llm.test_llm_operators import brute_components, brute_contained

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    """documents with two rows that must go, and the output of every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(10**6, "123 456 !!", None, "src0", 10), (10**6 + 1, None, "en", None, None)], docs.schema)
    out = [persist_table(docs.unionByName(more), "in")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(persist_table(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_columns_stay(staged):
    assert all(df.columns == staged[0].columns for df in staged[1:-1]) and set(staged[-1].columns) == {*staged[0].columns, "replica", "shuffle_key"}


def test_language_stage(staged):
    before, after = rows(staged[0]), rows(staged[1])
    assert set(before) - set(after) == {10**6, 10**6 + 1} and all(before[i] == r for i, r in after.items())


def test_line_stage(staged):
    before, after = rows(staged[1]), rows(staged[2])
    pages, total = Counter(), Counter(r["source"] for r in before.values())
    for r in before.values():
        pages.update({(r["source"], x.strip(" ")) for x in r["text"].split("\n")})
    for i, r in before.items():
        kept = [x for x in r["text"].split("\n") if not (x.strip(" ") and pages[r["source"], x.strip(" ")] >= 2 and pages[r["source"], x.strip(" ")] > 0.1 * total[r["source"]])]
        assert after[i]["text"] == "\n".join(kept) and after[i]["n_chars"] == len(after[i]["text"])


def test_near_duplicate_stage(staged):
    before, after = rows(staged[2]), rows(staged[3])
    comp = brute_components([(i, r["text"]) for i, r in before.items()])
    assert set(after) == {i for i, (_, c) in comp.items() if i == c} and len(after) < len(before)


def test_near_duplicate_stage_with_repeated_ids_and_clashing_columns(spark):
    """Rows of one id with different texts are documents of their own; repeated rows count once; internal names may be columns."""
    base, other = prose(70, 80), prose(71, 80)
    texts = [(1, base), (5, base + " end"), (5, other), (6, other + " end"), (7, prose(72, 50)), (7, prose(73, 50)), (7, prose(73, 50) + " x"), (8, "same"), (8, "same"), (9, ""), (9, None), (None, base), (None, base)]
    names = ["_gone", "id", "r", "set_id", "component_id", "_contaminated", "n", "of"]
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in texts], "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    out = persist_table(corpus_pipeline.near_duplicates(spark, docs, SF), "near")
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    seven = [k for k in got if k[0] == 7]
    assert {k: n for k, n in got.items() if k[0] not in (7, 9)} == {(1, base): 1, (5, other): 1, (8, "same"): 1, (None, base): 2}
    assert len(seven) == 2 and {t for _, t in seven} >= {prose(72, 50)} and sum(n for (i, _), n in got.items() if i == 9) == 1
    docs = docs.withColumns({"source": F.lit("s"), "lang": F.lit("en"), "n_chars": F.lit(1).cast("long")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert persist_table(stage(spark, docs, SF), "clash").columns == docs.columns


def test_decontamination_stage(spark, staged):
    before, after = rows(staged[3]), rows(staged[4])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {x[0] for x in brute_contained([(i, r["text"]) for i, r in before.items()], items)}
    assert set(after) == set(before) - bad


def test_mixing_stage(staged):
    before = rows(staged[4])
    mass = Counter()
    for r in before.values():
        mass[r["source"]] += len(r["text"])
    total, weights = sum(mass.values()), sum(math.sqrt(m) for m in mass.values())
    want = {}
    for i, r in before.items():
        rate = total * (math.sqrt(mass[r["source"]]) / weights) / mass[r["source"]]
        u = int(hashlib.md5(f"mix:{i}:1".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        cdf = p
        while cdf <= u:
            k += 1
            p *= rate / k
            cdf += p
        want[i] = k
    got = Counter(r["doc_id"] for r in staged[5].collect())
    assert all(got[i] == k for i, k in want.items()) and sum(got.values()) == sum(want.values())


def test_run_gives_the_same_rows(spark, staged):
    plain = corpus_pipeline.run(spark, SF)
    assert plain.select("doc_id").distinct().count() > 100 and plain.filter(F.col("text").isNull()).count() == 0


def test_stages_take_odd_and_empty_tables(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", F.col("n").cast("long").alias("n_chars"))
    for d in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            d = persist_table(stage(spark, d, SF), "odd")
    assert d.count() == 0
