"""Line dedup by site-relative frequency: lines that stand on more than a given share of a site's pages are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist_table, small_enough

BROADCAST_ROWS = 200_000
#: Where lists are not broadcast, sites with more pages are dealt into parts of about so many; there are few of them (all pages / HOT_PAGES).
HOT_PAGES = 1_000_000


def boilerplate_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = 0.1, min_pages: int = 2) -> DataFrame:
    """(host, line_hash, pages, total): lines on more than `ratio` of a host's pages and on at least `min_pages` of them: with 2, a line that
    one page alone has is never boilerplate, however few pages its site has; 1 lifts that.

    A page counts once for a line, however often the line stands on it; lines are compared without outer blanks, and
    blank lines never count. Pages without text count for the host's total. A host has at most (its mean number of
    distinct lines / ratio) of them. Counts combine before the shuffle, so a host with a third of all pages is no hot spot.
    """
    pages = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("t"))
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    hashes = F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))
    counts = pages.select("host", F.explode(hashes).alias("line_hash")).groupBy("host", "line_hash").agg(F.count("*").alias("pages"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    return counts.filter(F.col("pages") >= min_pages).join(totals, "host").filter(F.col("pages") > F.lit(ratio) * F.col("total"))


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = 0.1, min_pages: int = 2, counts: bool = False) -> DataFrame:
    """docs with boilerplate lines cut out of `text_col`; all other columns stay as they are.

    A null text stays null; a text without such lines stays byte for byte. A null host is the site with the empty
    name. counts=True adds n_lines (of the text, blank ones too; 0 for null) and n_dropped, and replaces columns of
    those names. Repeated rows are pages like any other. An empty table gives an empty result.
    """
    found = boilerplate_lines(docs, text_col, host_col, ratio, min_pages)
    by_host = persist_table(found.groupBy("host").agg(F.collect_list("line_hash").alias("bad"), F.max("total").alias("total")), "boilerplate")
    small = small_enough(by_host, BROADCAST_ROWS, 8 * F.size("bad") + F.octet_length("host"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.split(F.col(text_col), "\n").alias("lines"))
    if small:
        row = row.join(F.broadcast(by_host.select("host", "bad")), "host", "left")
    else:
        parts = F.ceil(F.col("total") / HOT_PAGES).cast("int")
        hot = by_host.filter(F.col("total") > HOT_PAGES).select("host", parts.alias("parts"))
        of = by_host.select("host", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "bad")
        part = F.pmod(F.hash("r"), F.coalesce("parts", F.lit(1)))
        row = row.join(F.broadcast(hot), "host", "left").withColumn("part", part).drop("parts").join(of, ["host", "part"], "left")
    kept = F.when(F.col("bad").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("bad"), F.xxhash64(F.trim(x))) | (F.trim(x) == "")))
    row = row.select("r", F.coalesce(F.size("lines"), F.lit(0)).alias("n"), kept.alias("kept"))
    n = F.when(F.col("kept").isNull(), 0).otherwise(F.col("n"))
    out = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col(f"r.`{c}`").alias(c) for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    if counts:
        out += [n.cast("long").alias("n_lines"), (n - F.when(F.col("kept").isNull(), 0).otherwise(F.size("kept"))).cast("long").alias("n_dropped")]
    return row.select(*out)
