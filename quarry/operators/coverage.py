"""Run counters, field coverage, and statistics of JSON-Lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.structured import load_json


def run_summary(pages: DataFrame, items: DataFrame) -> DataFrame:
    """One row: pages_fetched, pages_failed, items_extracted."""
    p = pages.agg(F.count("*").alias("pages_fetched"), F.count_if(~F.col("success")).alias("pages_failed"))
    return p.crossJoin(items.agg(F.count("*").alias("items_extracted")))  # one row by one row


def field_coverage(items: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, n_present, coverage), by name: the share of items with a value that is neither null nor empty; fields that never are present are absent."""
    counts = [F.count_if(F.col(f"`{f}`").isNotNull() & (F.col(f"`{f}`").cast("string") != "")).alias(f"c{i}") for i, f in enumerate(fields)]
    total = items.agg(F.count("*").alias("n"), *counts)
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"c{i}").alias("n_present")) for i, f in enumerate(fields)))
    rows = total.select("n", F.explode(pairs).alias("x")).select("x.field", "x.n_present", (F.col("x.n_present") / F.col("n")).alias("coverage"))
    return rows.where("n_present > 0").orderBy("field")


def _parsed(lines: DataFrame, line_col: str) -> DataFrame:
    """(kind, present): item with the names of its present fields, malformed, or blank, of every line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, present = [], []
            for line in b.column(0).to_pylist():
                kind, names = "malformed", []
                if line is None or not line.strip():
                    kind = "blank"
                else:
                    try:
                        value = load_json(line)
                        if isinstance(value, dict):
                            kind, names = "item", [k for k, v in value.items() if v is not None and v != ""]
                    except (ValueError, RecursionError):
                        pass
                kinds.append(kind)
                present.append(names)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(present, pa.list_(pa.string()))], ["kind", "present"])

    return lines.select(line_col).mapInArrow(run, "kind string, present array<string>")


def jsonl_stats(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """(metric, name, n): ("items", null), ("malformed", null), and ("field", name) for each property present in an item."""
    parsed = _parsed(lines, line_col)
    metric = F.when(F.col("kind") == "item", F.lit("items")).otherwise(F.col("kind"))
    tags = F.concat(
        F.array(F.struct(metric.alias("metric"), F.lit(None).cast("string").alias("name"))),
        F.transform("present", lambda f: F.struct(F.lit("field").alias("metric"), f.alias("name"))),
    )
    rows = parsed.where("kind <> 'blank'").select(F.explode(tags).alias("t")).groupBy("t.metric", "t.name").agg(F.count("*").alias("n"))
    return rows.select("metric", "name", "n").orderBy("metric", "name")


def print_summary(summary: dict, coverage: list[tuple[str, float]]) -> str:
    """The console report of a run."""
    out = [f"Pages fetched: {summary['pages_fetched']}", f"Pages failed: {summary['pages_failed']}", f"Items: {summary['items_extracted']}"]
    return "\n".join([*out, *(f"  {f}: {100 * c:.0f}%" for f, c in sorted(coverage))])
