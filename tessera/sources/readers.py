"""Readers with explicit schemas: JSON Lines, positional arrays, delimited text, two-file archives, paged and bound results, paragraphs, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def positional_arrays(spark: SparkSession, path: str, names: list[str], expected_rows: int | None = None) -> DataFrame:
    """Files that each hold a JSON array of equally long arrays: columns by position, pos keeps the order; another width fails, and so does
    another number of rows than expected_rows, where it is given."""
    if expected_rows is not None:
        got = spark.read.text(path, wholetext=True).agg(F.sum(F.size(F.from_json("value", "array<array<string>>")))).first()[0] or 0
        if got != expected_rows:
            raise ValueError(f"{got} rows instead of {expected_rows}")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("pos", "r"))
    checked = F.when(F.size("r") == len(names), F.col("r")).otherwise(F.raise_error(F.lit("row width differs from the header")).cast("array<string>"))
    return rows.select("pos", checked.alias("r")).select("pos", *[F.col("r")[i].alias(n) for i, n in enumerate(names)])


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with a header and a declared schema; a row that does not fit fails the read."""
    return spark.read.schema(schema).option("sep", sep).option("encoding", encoding).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


#: The column of a whole line.
_RAW = "the whole line"
_FILE = "_location string, _separator string, id struct<_index int>, coreid struct<_index int>, field array<struct<_index int, _term string>>"


def described_archive(spark: SparkSession, folder: str, licences: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(core, extension, issues) of an archive that its descriptor, folder/meta.xml, declares: an `archive` element with a licence, a core
    and an extension, each with a location, a separator, its id column and its fields (index, term).

    The columns are the declared terms, as text, in the order of their indexes. A licence that is not among `licences`, fields that
    do not count from 0 on without gaps or repeats, or a term that stands twice, fail. Rows that do not hold to the declaration
    are no rows of the tables but issues: (part, line, reason) with wrong_width, empty_id, duplicate_id (of core ids all but
    the first text) and orphan (an extension row without a core row).
    """
    meta = spark.read.schema(f"_licence string, core struct<{_FILE}>, extension struct<{_FILE}>").option("rowTag", "archive").xml(f"{folder}/meta.xml").first()  # one declaration
    if meta is None or meta["core"] is None or meta["extension"] is None:
        raise ValueError("meta.xml declares no core and extension")
    if meta["_licence"] not in licences:
        raise ValueError(f"licence {meta['_licence']} is not allowed")
    parts, issues = {}, []
    for part, key in (("core", "id"), ("extension", "coreid")):
        f = meta[part]
        at = {r["_index"]: r["_term"] for r in f["field"]} | {f[key]["_index"]: "id"}
        if sorted(at) != list(range(len(f["field"]) + 1)) or len(set(at.values())) != len(at):
            raise ValueError(f"fields of the {part} do not count from 0 to {len(f['field'])} with terms of their own: {sorted(at.items())}")
        sep = (f["_separator"] or "\t").replace("\\t", "\t")
        # The line's own column has a name that no term has.
        lines = spark.read.text(f"{folder}/{f['_location']}").select(F.col("value").alias(_RAW), F.split("value", rf"\Q{sep}\E", -1).alias("c"))
        reason = F.when(F.size("c") != len(at), "wrong_width").when(F.col("c")[f[key]["_index"]] == "", "empty_id")
        told = lines.withColumn("reason", reason)
        issues.append(told.filter("reason is not null").select(F.lit(part).alias("part"), F.col(_RAW).alias("line"), "reason"))
        parts[part] = told.filter("reason is null").select(_RAW, *[F.col("c")[i].alias(at[i]) for i in sorted(at)])
    core, extension = parts["core"], parts["extension"]
    first = core.groupBy("id").agg(F.min(_RAW).alias("_first"), F.count("*").alias("_copies"))
    again = core.join(first.filter("_copies > 1"), "id").filter(F.col(_RAW) != F.col("_first"))
    orphans = extension.join(first, "id", "left_anti")
    for part, rows, reason in (("core", again, "duplicate_id"), ("extension", orphans, "orphan")):
        issues.append(rows.select(F.lit(part).alias("part"), F.col(_RAW).alias("line"), F.lit(reason).alias("reason")))
    core = core.dropDuplicates([_RAW]).join(first, "id").filter(F.col(_RAW) == F.col("_first")).drop(_RAW, "_first", "_copies")
    return core, extension.join(first.select("id"), "id", "left_semi").drop(_RAW), reduce(DataFrame.unionByName, issues)


def pages(spark: SparkSession, path: str, result_schema: str) -> tuple[DataFrame, DataFrame]:
    """(results with their page's hash, pages without a results array)."""
    p = spark.read.schema(f"page long, results array<struct<{result_schema}>>").json(path)
    p = p.withColumn("page_hash", F.sha2(F.to_json(F.struct("page", "results")), 256))
    return p.filter("results is not null").select("page", "page_hash", F.explode("results").alias("r")).select("page", "page_hash", "r.*"), p.filter("results is null").select("page")


def bindings(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """rows with status and b, one for each binding of a query-result envelope in `column` (JSON text): bound; empty (a good envelope
    without results) and malformed (no JSON, or no array at results.bindings) come once and have no b."""
    parsed = F.from_json(column, f"results struct<bindings array<struct<{schema}>>>", {"mode": "PERMISSIVE"})
    found = parsed["results"]["bindings"]
    status = F.when(found.isNull(), "malformed").when(F.size(found) == 0, "empty").otherwise("bound")
    return rows.withColumn("status", status).withColumn("b", F.explode_outer(found))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ordinal, text, content_hash): non-blank lines in order."""
    t = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "text")).filter(F.trim("text") != "")
    return t.select("id", F.row_number().over(Window.partitionBy("id").orderBy("pos")).cast("long").alias("ordinal"), "text", F.sha2("text", 256).alias("content_hash"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
