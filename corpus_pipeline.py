"""A corpus pipeline in five stages: language ID, line dedup, near-duplicate removal, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder
and reads it again for the next stage. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, line_dedup, mixing, ngram_join
from tessera.llm.common import persist_table, small_enough

#: Documents whose language is less sure than this go; clean prose of a learned language is above 0.5.
MIN_LANGUAGE_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without a letter, or in none that the network knows, go."""
    net, langs = langid.train(docs, F.lit(True))
    found = langid.identify(docs, net, langs)
    return found.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("r.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; n_chars follows the text."""
    cut = line_dedup.drop_boilerplate(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays, and all without an id; of rows with one id and linked texts, one stays.

    Two documents are near copies where their sets of 5-word shingles have a Jaccard similarity of 0.75 or more.
    """
    group = persist_table(ngram_join.ngram_jaccard_components(docs, signatures=True), "groups")
    group = group.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "set_id", "component_id", "component_set")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    repeated = persist_table(group.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated")
    few = small_enough(repeated, ngram_join.BROADCAST_ROWS)
    alone = group.join(F.broadcast(repeated) if few else repeated, "id", "left_anti")
    gone = persist_table(alone.filter("id != component_id").select("id").unionByName(repeated), "gone")
    kept = rows.join(F.broadcast(gone) if small_enough(gone, ngram_join.BROADCAST_ROWS) else gone, F.col("r.doc_id") == F.col("id"), "left_anti").select("r.*")
    if repeated.isEmpty():
        return kept
    # Rows that share an id are told apart by their texts' sets: that which names its component stays.
    own = rows.join(F.broadcast(repeated) if few else repeated, F.col("r.doc_id") == F.col("id"), "left_semi")
    own = own.select("r", F.col("r.doc_id").alias("id"), ngram_join.signature(F.col("r.text")).alias("set_id"))
    names = group.join(repeated, "id", "left_semi").filter("id = component_id and set_id = component_set").select("id", "set_id").distinct()
    return kept.unionByName(own.join(names, ["id", "set_id"], "left_semi").dropDuplicates(["id", "set_id"]).select("r.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat by their source's rate, in one random order."""
    return mixing.poisson_mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: SQL cannot express the network of the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = persist_table(stage(spark, docs, sf_dir), f"stage-{name}", "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
