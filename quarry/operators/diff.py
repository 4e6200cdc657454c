"""Comparison of two JSON-Lines snapshots by a key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.structured import load_json


def render(value) -> str:
    """A JSON value as a key: strings as they are, numbers as written, True and False, compact JSON for the rest."""
    import json

    if isinstance(value, bool):
        return str(value)
    if isinstance(value, str):
        return str(value)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def keyed_lines(lines: DataFrame, key: str, line_col: str = "line", order_col: str = "line_no") -> DataFrame:
    """(key, line, line_no, first_no): the last line of each key, and where the key came first; lines without the key, or that are no objects, are skipped."""
    kind = lines.schema[order_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for line in b.column(1).to_pylist():
                found = None
                if line and line.strip():
                    try:
                        value = load_json(line)
                        if isinstance(value, dict) and value.get(key) is not None:
                            found = render(value[key]) or None
                    except (ValueError, RecursionError):
                        pass
                keys.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.string())], ["line_no", "line", "key"])

    rows = lines.select(F.col(order_col).alias("line_no"), F.col(line_col).alias("line")).mapInArrow(run, f"line_no {kind}, line string, key string")
    return rows.where("key is not null").groupBy("key").agg(F.max_by("line", "line_no").alias("line"), F.max("line_no").alias("line_no"), F.min("line_no").alias("first_no"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, **how) -> DataFrame:
    """(key, status, old_line, new_line, first_no): added, removed, changed (the text of the line differs) or unchanged."""
    a = keyed_lines(old, key, **how).select("key", F.col("line").alias("old_line"), F.col("first_no").alias("old_no"))
    b = keyed_lines(new, key, **how).select("key", F.col("line").alias("new_line"), F.col("first_no").alias("new_no"))
    both = a.join(b, "key", "full_outer")
    status = F.when(F.col("old_line").isNull(), "added").when(F.col("new_line").isNull(), "removed").when(F.col("old_line") != F.col("new_line"), "changed").otherwise("unchanged")
    return both.select("key", status.alias("status"), "old_line", "new_line", F.coalesce("new_no", "old_no").alias("first_no"))


def counts(diffed: DataFrame) -> DataFrame:
    return diffed.groupBy("status").agg(F.count("*").alias("n"))


def sample(diffed: DataFrame, status: str, n: int = 20) -> DataFrame:
    """The first n keys of a status, by where they came first."""
    return diffed.where(F.col("status") == status).orderBy("first_no", "key").limit(n).select("key")


def except_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").distinct().join(b.select("key"), "key", "left_anti")


def intersect_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").distinct().join(b.select("key"), "key", "left_semi")
