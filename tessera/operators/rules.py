"""Ordered rules over columns: the first reason that holds, or all of them; and gates that fail a job."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: Mapping[str, Column] | Iterable[tuple[str, Column]]) -> Column:
    """The name of the first rule (name, condition) that holds, in order; null where none does. A rule that is null does not hold."""
    pairs = rules.items() if isinstance(rules, Mapping) else rules
    return F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in pairs])


def all_reasons(rules: Mapping[str, Column]) -> Column:
    """The sorted names of all rules that hold; an empty array where none does."""
    return F.array_sort(F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules.items()])))


def require_none(rows: DataFrame, message: str, show: int = 3) -> None:
    """Fails where rows is not empty, naming the first few."""
    some = rows.limit(show).collect()
    if some:
        raise ValueError(f"{message}: " + "; ".join(str(r.asDict()) for r in some))
