"""Robots rules, rate limits, retries and rotation as folds and windows.

A host's requests are at most a few a second, so what a fold gathers for one
host is bounded by its crawl time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.urls import path_and_query

# Fixed values of the adaptive delay.
GROW, RELAX, MOST, LONGEST_MS = 2.0, 0.85, 16.0, 30_000.0


def robots_rules(content: Column) -> Column:
    """struct(disallow array<string>, crawl_delay double) of a robots.txt: the groups for every agent ("*"); the last User-agent line decides, the last valid delay counts."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    lines = F.filter(lines, lambda x: (F.length(x) > 0) & ~F.startswith(x, F.lit("#")) & (F.instr(x, ":") > 0))
    tidy = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    pairs = F.transform(
        lines,
        lambda x: F.struct(F.lower(tidy(F.substring_index(x, ":", 1))).alias("k"), tidy(F.substr(x, F.instr(x, ":") + 1)).alias("v")),
    )
    start = F.struct(F.lit(False).alias("every"), F.array().cast("array<string>").alias("disallow"), F.lit(None).cast("double").alias("crawl_delay"))

    def step(a: Column, x: Column) -> Column:
        key, value = x["k"], x["v"]
        delay = value.try_cast("double")
        return F.struct(
            F.when(key == "user-agent", value == "*").otherwise(a["every"]).alias("every"),
            F.when((key == "disallow") & a["every"] & (value != ""), F.concat(a["disallow"], F.array(value))).otherwise(a["disallow"]).alias("disallow"),
            F.when((key == "crawl-delay") & a["every"] & (delay >= 0), delay).otherwise(a["crawl_delay"]).alias("crawl_delay"),
        )

    return F.aggregate(pairs, start, step, lambda a: F.struct(a["disallow"].alias("disallow"), a["crawl_delay"].alias("crawl_delay")))


def is_allowed(path: Column, disallow: Column) -> Column:
    """No rule is a prefix of the path and query, case ignored; without rules everything is allowed."""
    return ~F.coalesce(F.exists(disallow, lambda p: F.startswith(F.lower(path), F.lower(p))), F.lit(False))


def with_robots(requests: DataFrame, robots: DataFrame, url_col: str = "url") -> DataFrame:
    """Requests with ``allowed`` and ``crawl_delay`` from the table (origin, content) of their origins; an origin without a file allows all."""
    from quarry.functions.urls import origin

    rules = robots.select("origin", robots_rules(F.col("content")).alias("rules"))
    joined = requests.withColumn("origin", origin(F.col(url_col))).join(rules, "origin", "left")
    allowed = is_allowed(path_and_query(F.col(url_col)), F.col("rules.disallow"))
    return joined.withColumn("allowed", allowed).withColumn("crawl_delay", F.col("rules.crawl_delay")).drop("rules", "origin")


def effective_delay_ms(base_ms: Column, crawl_delay_s: Column) -> Column:
    return F.greatest(base_ms, F.coalesce(crawl_delay_s * 1000, F.lit(0.0)))


def schedule(requests: DataFrame, delay_ms: float | Column, key: str = "host", arrival_ms: str = "arrival_ms", order: str = "seq") -> DataFrame:
    """``start_ms`` of each request: not before it arrives, and a delay after the start of the key's request before it.

    With a constant delay the recurrence has a closed form: with n requests
    before this one, n * delay + the largest of (arrival - its own n * delay) so far.
    """
    delay = delay_ms if isinstance(delay_ms, Column) else F.lit(delay_ms)
    w = Window.partitionBy(key).orderBy(arrival_ms, order)
    before = (F.row_number().over(w) - 1) * delay
    numbered = requests.withColumn("__before", before)
    high = F.max(F.col(arrival_ms) - F.col("__before")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return numbered.withColumn("start_ms", F.col("__before") + high).drop("__before")


def multiplier(outcomes: Column) -> Column:
    """The delay multiplier after an ordered array of outcomes: true success, false failure, null neither."""
    start = F.struct(F.lit(1.0).alias("m"), F.lit(False).alias("seen"))

    def step(a: Column, ok: Column) -> Column:
        grown = F.when(a["seen"], F.least(F.lit(MOST), a["m"] * GROW)).otherwise(F.lit(GROW))
        eased = F.greatest(F.lit(1.0), a["m"] * RELAX)
        return F.struct(F.when(ok.isNull(), a["m"]).when(ok, eased).otherwise(grown).alias("m"), (a["seen"] | ok.isNotNull()).alias("seen"))

    return F.aggregate(outcomes, start, step, lambda a: a["m"])


def adaptive_delay(events: DataFrame, base_ms: float, key: str = "host", order: str = "seq", ok: str = "ok") -> DataFrame:
    """(key, multiplier, delay_ms) after each key's events in order; the delay is at most 30 s."""
    line = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ok).alias("ok"))))
    m = multiplier(F.transform(F.col("line"), lambda x: x["ok"]))
    return events.groupBy(key).agg(line.alias("line")).select(key, m.alias("multiplier")).withColumn("delay_ms", F.least(F.lit(LONGEST_MS), F.col("multiplier") * base_ms))


def is_retryable(status: Column) -> Column:
    return (status == 429) | (status >= 500)


def backoff_ms(attempt: Column, base_ms: float) -> Column:
    return F.lit(float(base_ms)) * F.pow(F.lit(2.0), attempt)


def retry_delay_ms(attempt: Column, base_ms: float, retry_after_s: Column | None = None, retry_date: Column | None = None, now: Column | None = None) -> Column:
    """Retry-After in seconds if positive, else its date if that is ahead, else the exponential backoff."""
    options = []
    if retry_after_s is not None:
        options.append(F.when(retry_after_s > 0, retry_after_s * 1000.0))
    if retry_date is not None and now is not None:
        ahead = (F.unix_millis(retry_date) - F.unix_millis(now)).cast("double")
        options.append(F.when(ahead > 0, ahead))
    return F.coalesce(*options, backoff_ms(attempt, base_ms))


def retry_schedule(failures: DataFrame, base_ms: float = 1000, max_retries: int = 3) -> DataFrame:
    """One row an attempt 0..max_retries - 1 of each failing request, with the wait after it."""
    attempts = failures.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(max_retries - 1)))) if max_retries > 0 else failures.withColumn("attempt", F.lit(0)).limit(0)
    return attempts.withColumn("wait_ms", backoff_ms(F.col("attempt"), base_ms))


def rotate(pool: list[str], position: Column) -> Column:
    """Round robin: the pool's member for a position from 0."""
    if not pool:
        raise ValueError("the pool is empty")
    return F.element_at(F.array(*map(F.lit, pool)), (F.pmod(position, F.lit(len(pool))) + 1).cast("int"))


def with_rotation(requests: DataFrame, pool: list[str], name: str, order: str = "seq") -> DataFrame:
    """A dense ``order`` is the position; the rows are not numbered in one task."""
    return requests.withColumn(name, rotate(pool, F.col(order)))


def with_slots(requests: DataFrame, per_host: int, key: str = "host", order: str = "seq") -> DataFrame:
    """``slot`` of each request among its host's ``per_host`` concurrent ones; without a limit (0) a slot each."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return requests.withColumn("slot", F.pmod(n, F.lit(per_host)) if per_host > 0 else n)
