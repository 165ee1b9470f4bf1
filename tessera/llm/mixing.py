"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persist_table, small_enough

BROADCAST_ROWS = 100_000
#: The largest rate that one inversion takes; beyond it a rate is the sum of equal parts with hashes of their own.
PART_RATE = 100.0


def source_rates(docs: DataFrame, text_col: str = "text", source_col: str = "source", alpha: float = 0.5, budget: float = 1.0, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, n_docs, mass, rate): the mean number of times that each source's documents repeat.

    The mass of a source is its number of characters, at least 1. Its target weight is weights[source] (0 where it
    is not named), or else mass ** alpha; rate = budget * total mass * (weight / sum of weights) / mass.
    """
    mass = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n_docs"), F.greatest(F.coalesce(F.sum(F.length(text_col)), F.lit(0)), F.lit(1)).cast("double").alias("mass"))
    if weights is None:
        w = F.pow("mass", F.lit(alpha))
    else:
        w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.coalesce("source", F.lit(""))], F.lit(0.0)).cast("double") if weights else F.lit(0.0)
    mass = persist_table(mass.withColumn("weight", w), "mass")
    total = mass.agg(F.sum("mass"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(total[1] or 1.0)
    return mass.select("source", "n_docs", "mass", (F.lit(budget * (total[0] or 0.0)) * share / F.col("mass")).alias("rate"))


def _uniform(*parts: Column) -> Column:
    """52 bits of an MD5 hash as a number from 0 to below 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _distribution(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of a Poisson distribution, so far that the rest is below a hash's resolution."""
    last = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(20.0)).cast("int")
    p = F.exp(-rate)
    end = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(p.alias("p"), F.array(p).alias("cdf")),
        lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * rate / k)).alias("cdf")),
    )
    return end["cdf"]


def poisson_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", alpha: float = 0.5, budget: float = 1.0, weights: dict[str, float] | None = None, seed: str = "mix") -> DataFrame:
    """Each row of docs as often as a Poisson number with its source's rate says, in one global random order.

    The number comes from inverting the distribution at a hash of seed and id, so that it does not depend on
    partitions or retries. Adds replica (1, 2, ...) and shuffle_key, by which the result is sorted, and replaces
    columns of those names. A null source is a source of its own; a null id hashes as the empty text; null texts have
    no mass but are replicated as others of their source. Repeated rows get equal numbers. Rows with number 0 go.
    """
    rates = source_rates(docs, text_col, source_col, alpha, budget, weights)
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(PART_RATE)), F.lit(1)).cast("int")
    rates = persist_table(rates.select("source", parts.alias("parts"), _distribution(F.col("rate") / parts).alias("cdf")), "rates")
    names = [c for c in docs.columns if c not in ("replica", "shuffle_key")]
    key = F.coalesce(F.col(f"r.`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    small = small_enough(rates, BROADCAST_ROWS)
    rows = rows.join(F.broadcast(rates) if small else rates, F.col(f"r.`{source_col}`").cast("string").eqNullSafe(F.col("source")))

    def drawn(i: Column) -> Column:
        u = _uniform(F.lit(seed), key, i.cast("string"))
        return F.size(F.filter("cdf", lambda c: c <= u))

    number = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda s, i: s + drawn(i))
    rows = rows.select("r", number.alias("number")).filter("number > 0").select("r", F.explode(F.sequence(F.lit(1), F.col("number"))).alias("replica"))
    rows = rows.select(*[F.col(f"r.`{c}`").alias(c) for c in names], "replica", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), key, F.col("replica").cast("string"))).alias("shuffle_key"))
    return rows.orderBy("shuffle_key")
