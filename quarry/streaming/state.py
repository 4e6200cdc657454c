"""Keyed state on streams.

Deduplication, coverage and robots rules are plain streaming plans; a host's
rate limit and adaptive delay are arbitrary state, kept by host.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.functions.urls import visited_key
from quarry.operators import diff
from quarry.operators.politeness import GROW, LONGEST_MS, MOST, RELAX, with_robots


def unvisited(requests: DataFrame, normalize: bool = True, watermark: str | None = None) -> DataFrame:
    """Each URL once, by its visited key; with a watermark (of the column ``ts``) the state forgets what is older."""
    keyed = requests.withColumn("key", visited_key(F.col("url"), normalize))
    if watermark:
        return keyed.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["key"])
    return keyed.dropDuplicates(["key"])


def unseen_items(items: DataFrame, key: str | None = None, watermark: str | None = None) -> DataFrame:
    """Each item once, by a key (null counts as "") or by all its columns."""
    if watermark:
        items = items.withWatermark("ts", watermark)
    if key is None:
        names = [c for c in items.columns if c != "ts"]
        return items.dropDuplicatesWithinWatermark(names) if watermark else items.dropDuplicates(names)
    keyed = items.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit("")))
    return (keyed.dropDuplicatesWithinWatermark(["__key"]) if watermark else keyed.dropDuplicates(["__key"])).drop("__key")


def field_presence(items: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_present) so far, for output modes update and complete."""
    present = F.array_compact(F.array(*(F.when(F.col(f).isNotNull() & (F.col(f) != ""), F.lit(f)) for f in fields)))
    return items.select(F.explode(present).alias("field")).groupBy("field").agg(F.count("*").alias("n_present"))


def checked(requests: DataFrame, robots: Callable[[], DataFrame], on_batch: Callable[[DataFrame, int], None]):
    """A writer that joins each batch of (url, ...) with the robots table (origin, content) as it stands then and hands it on with allowed and crawl_delay."""
    return requests.writeStream.foreachBatch(lambda batch, number: on_batch(with_robots(batch, robots()), number))


def rate_limited(requests: DataFrame, delay_ms: float) -> DataFrame:
    """(host, seq, arrival_ms, start_ms) of a stream of (host, seq, arrival_ms): a request starts a delay after its host's last one at the earliest."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for rows in [pd.concat(list(frames)).sort_values(["arrival_ms", "seq"])]:
            starts = []
            for arrival in rows["arrival_ms"]:
                last = float(arrival) if last is None else max(float(arrival), last + delay_ms)
                starts.append(last)
            state.update((last,))
            yield pd.DataFrame({"host": key[0], "seq": rows["seq"].to_numpy(), "arrival_ms": rows["arrival_ms"].to_numpy(), "start_ms": starts})

    return requests.groupBy("host").applyInPandasWithState(step, "host string, seq long, arrival_ms double, start_ms double", "last double", "append", GroupStateTimeout.NoTimeout)


def adaptive_delays(outcomes: DataFrame, base_ms: float) -> DataFrame:
    """(host, multiplier, delay_ms) after each batch of a stream of (host, seq, ok)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = state.get[0] if state.exists else None
        for ok in pd.concat(list(frames)).sort_values("seq")["ok"]:
            if ok is None or pd.isna(ok):
                continue
            if ok:
                m = max(1.0, (1.0 if m is None else m) * RELAX)
            else:
                m = GROW if m is None else min(MOST, m * GROW)
        if m is not None:
            state.update((m,))
        m = 1.0 if m is None else m
        yield pd.DataFrame({"host": [key[0]], "multiplier": [m], "delay_ms": [min(LONGEST_MS, base_ms * m)]})

    return outcomes.groupBy("host").applyInPandasWithState(step, "host string, multiplier double, delay_ms double", "m double", "update", GroupStateTimeout.NoTimeout)


def watch_snapshots(lines: DataFrame, key: str, folder: str, on_diff: Callable[[DataFrame, int], None]):
    """A writer that keeps each batch of (line_no, line) as a table in ``folder``, compares it with the one before and hands the differences on."""

    def each(batch: DataFrame, number: int) -> None:
        spark, schema = batch.sparkSession, f"line_no {lines.schema['line_no'].dataType.simpleString()}, line string"
        path = f"{folder.rstrip('/')}/snapshot-{number}"
        batch.select("line_no", "line").write.mode("overwrite").parquet(path)
        before = spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/snapshot-{number - 1}") if number else spark.createDataFrame([], schema)
        on_diff(diff.snapshot_diff(before, spark.read.schema(schema).parquet(path), key), number)

    return lines.writeStream.foreachBatch(each)
