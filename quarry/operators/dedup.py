"""Item deduplication that keeps the first, in an order that the caller states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keep_first(items: DataFrame, key: list[Column], order: Sequence[str]) -> DataFrame:
    """The row with the smallest order of each key: a pre-aggregated minimum, so that a key with many rows needs no task of its own."""
    names = items.columns
    first = F.min_by(F.struct(*(F.col(f"`{c}`") for c in names)), F.struct(*(F.col(f"`{c}`") for c in order)))
    return items.groupBy(*(k.alias(f"__k{i}") for i, k in enumerate(key))).agg(first.alias("__row")).select("__row.*")


def by_key(items: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row a key; rows with a null key count as one key, "" ."""
    return _keep_first(items, [F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))], order)


def by_content(items: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of those that are equal in all the columns, nulls included."""
    return _keep_first(items, [F.col(f"`{c}`") for c in columns], order)
