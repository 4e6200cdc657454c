"""A breadth-first crawl as a loop over levels; each level is one plan over tables.

The state between levels (requests, pages with their items and links, robots
files, hosts) is written as tables under one folder, so plans stay short,
executors may be lost, and a stopped crawl goes on from its last finished level.
A level is two tables at least: its requests, which are the links of the level
before that no level asked for, and its pages.  Where robots or a cache take part
a third one deals the requests to what the cache answers, what robots deny and
what is fetched.  Counts are observed while the tables are written.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.functions.urls import origin, visited_key
from quarry.operators import coverage, dedup
from quarry.operators.extract import LinkFinder, harvest, items_of
from quarry.operators.heal import HealingCache, Provider, heal
from quarry.operators.politeness import with_robots
from quarry.plans.spec import Fields
from quarry.sources.fetch import CachedFetcher, Fetcher, HttpFetcher, as_pages, hosts_after, with_hosts

ORDER = ["depth", "seq", "item_seq"]


@dataclass
class Plan:
    """What a crawl does; see ``quarry.plans.spider.Spider`` for a builder."""

    fields: Fields
    fetcher: Fetcher
    item_selector: str | None = None
    link_selector: str | None = None
    auto_pagination: bool = False
    link_finder: LinkFinder | None = None
    max_depth: int = 0
    max_pages: int = 1000
    normalize_urls: bool = True
    robots: DataFrame | Callable[[DataFrame], DataFrame] | None = None  # (origin, content), or what finds it for origins; each origin is asked once a crawl
    deduplicate_by: str | None = None  # a field, or "*" for the whole item
    healing_cache: HealingCache | None = None
    provider: Provider | None = None
    checkpoint: str | None = None
    progress: Callable[[dict], None] | None = None


@dataclass
class State:
    level: int = 0
    fetched: int = 0
    failed: int = 0
    extracted: int = 0
    levels: list[int] = field(default_factory=list)
    links: int = 0  # of the last level's pages


class Folder:
    """Tables and a state file in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.tables = spark, {}
        if path is None:
            base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
            if base is None:
                if not spark.sparkContext.master.startswith("local"):
                    raise ValueError("set spark.checkpoint.dir to a shared folder, or give the crawl a checkpoint path")
                base = f"file://{tempfile.gettempdir()}"
            path = f"{base.rstrip('/')}/quarry-crawl-{uuid.uuid4().hex}"
            atexit.register(self._quietly_delete)
        self.path = path.rstrip("/")

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, name: str, df: DataFrame, by: str | None = None, **metrics: Column) -> DataFrame | tuple[DataFrame, dict]:
        """df as a table, in folders by a column if one is given; with metrics also these, observed as it is written."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}") if metrics else None
        writer = (df.observe(seen, *(c.alias(k) for k, c in metrics.items())) if seen else df).write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}")
        out = self.tables[name] = self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
        return (out, seen.get) if seen else out

    def get(self, name: str) -> DataFrame:
        """A table that was put here, now or before the crawl was stopped."""
        return self.tables.get(name) or self.spark.read.parquet(f"{self.path}/{name}")

    def visited(self, levels: list[int]) -> DataFrame | None:
        """(key, part) of all that the levels asked for: their request tables, which are never written again."""
        if not levels:
            return None
        paths = [f"{self.path}/{asked(n)}" for n in levels]
        return self.spark.read.option("basePath", f"{self.path}/requests").schema("key string, level int, part int").parquet(*paths).select("key", "part")

    def save(self, state: State) -> None:
        """Under a name of its own, by a rename: readers find the states before until the new one is whole."""
        part, fs = self._fs(f"part-{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(state.__dict__).encode()))
        out.close()
        at, _ = self._fs(f"state-{state.level:06}.json")
        fs.rename(part, at)

    def _states(self) -> list:
        at, fs = self._fs("state-*.json")
        return sorted((f.getPath() for f in fs.globStatus(at) or []), key=lambda p: p.getName(), reverse=True)

    def load(self) -> State | None:
        """The newest state that can be read."""
        for at in self._states():
            try:
                return State(**json.loads("\n".join(r[0] for r in self.spark.read.text(at.toString()).collect())))
            except (ValueError, TypeError):
                continue
        return None

    def finish(self) -> None:
        """Drops the states: the next crawl starts anew; the tables stay, as results read them."""
        for at in self._states():
            self._fs("")[1].delete(at, False)

    def delete(self) -> None:
        at, fs = self._fs("")
        fs.delete(at, True)

    def _quietly_delete(self) -> None:
        try:
            self.delete()
        except Exception:  # the session is gone
            pass


PARTS = 8  # folders of a level's requests, by their keys


def asked(level: int) -> str:
    """The table of a level's requests."""
    return f"requests/level={level}"


def _unseen(first: DataFrame, visited: DataFrame | None, few: bool) -> DataFrame:
    """What has a key that wasn't visited, with the part that the key falls in.

    Keys that are few beside what was visited meet it in a semi join, so it is
    scanned and not shuffled, in the parts that they fall in, and only what they
    have in common is taken from them.  That computes them twice; keys that are
    many are computed once and meet it in one join by key, in which it moves as
    they do: over all levels no more of it than there are links.
    """
    first = first.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))
    if visited is None:
        return first
    if not few:
        return first.join(visited.select("key"), "key", "left_anti")
    seen = visited.join(first.select("part", "key"), ["part", "key"], "left_semi")
    return first.join(seen.select("key"), "key", "left_anti")


def next_requests(frontier: DataFrame, visited: DataFrame | None, normalize: bool, few: bool = True) -> DataFrame:
    """The first request of each key that wasn't visited."""
    keyed = frontier.withColumn("key", visited_key(F.col("url"), normalize))
    return _unseen(dedup.by_key(keyed, "key", ["seq"]), visited, few)


def discovered(pages: DataFrame, visited: DataFrame | None, normalize: bool, depth: int, few: bool = True) -> DataFrame:
    """The requests of the next level: of the links of pages (seq, links) the first with each key that wasn't visited, in the order of pages and links."""
    found = pages.select(F.col("seq").alias("s"), F.posexplode("links").alias("p", "url"))
    first = found.groupBy(visited_key(F.col("url"), normalize).alias("key")).agg(F.min(F.struct("s", "p", "url")).alias("at"))
    new = _unseen(first, visited, few).orderBy("at.s", "at.p")
    return new.select("at.url", F.lit(depth).alias("depth"), F.lit("GET").alias("method"), F.lit(None).cast("map<string,string>").alias("form"), F.monotonically_increasing_id().alias("seq"), "key", "part")


@dataclass
class Result:
    pages: DataFrame  # url, depth, seq, status, success, error, elapsed_ms
    items: DataFrame  # url, depth, seq, item_seq and the fields
    fields: Fields

    def summary(self) -> DataFrame:
        return coverage.run_summary(self.pages, self.items)

    def field_coverage(self) -> DataFrame:
        return coverage.field_coverage(self.items, list(self.fields))


def dealt(folder: Folder, n: int, requests: DataFrame, plan: Plan, levels: list[int]) -> tuple[DataFrame, DataFrame]:
    """(what is to be fetched, with crawl_delay; pages of the rest): the cache comes first, then robots, whose files are asked for once an origin."""
    cached = isinstance(plan.fetcher, CachedFetcher)
    work = requests.withColumn("html", F.lit(None).cast("string"))
    if cached:
        named = plan.fetcher.named(requests)
        hits = plan.fetcher.cache.join(named.select("__name").distinct(), "__name").groupBy("__name").agg(F.min("__html").alias("html"))
        work = named.join(hits, "__name", "left").drop("__name")
    if plan.robots is None:
        work = work.withColumn("allowed", F.lit(True)).withColumn("crawl_delay", F.lit(None).cast("double"))
    elif callable(plan.robots):
        known = [folder.get(f"robots-{k}") for k in levels]
        asked = work.where("html is null").select(origin(F.col("url")).alias("origin")).where("origin <> '://'").distinct()
        for k in known:
            asked = asked.join(k, "origin", "left_anti")
        asked = folder.put(f"origins-{n}", asked)
        found = plan.robots(asked).groupBy("origin").agg(F.max("content").alias("content"))
        new = folder.put(f"robots-{n}", asked.join(found, "origin", "left"))
        work = with_robots(work, reduce(DataFrame.union, [*known, new]))
    else:
        work = with_robots(work, plan.robots)
    fate = F.when(F.col("html").isNotNull(), "cached").when(F.col("allowed"), "fetched").otherwise("denied")
    work = folder.put(f"dealt-{n}", work.withColumn("fate", fate).drop("allowed"), by="fate")
    denied = as_pages(work.where("fate = 'denied'"), F.lit(0), F.lit(None), F.lit("disallowed by robots.txt"))
    rest = as_pages(work.where("fate = 'cached'"), F.lit(200), F.col("html"), F.lit(None)).unionByName(denied) if cached else denied
    return work.where("fate = 'fetched'").drop("fate", "html"), rest


def crawl(spark: SparkSession, seeds: DataFrame, plan: Plan) -> Result:
    folder = Folder(spark, plan.checkpoint)
    state = folder.load() if plan.checkpoint else None
    if state is None:
        state = State()
        folder.put("seeds", seeds)
        folder.save(state)
    fetcher = plan.fetcher.inner if isinstance(plan.fetcher, CachedFetcher) else plan.fetcher
    live = isinstance(fetcher, HttpFetcher)
    while state.level <= plan.max_depth and state.fetched < plan.max_pages:
        n = state.level
        known = folder.visited(state.levels)
        new = discovered(folder.get(f"pages-{n - 1}").where("success"), known, plan.normalize_urls, n, state.links < state.fetched) if n else next_requests(folder.get("seeds"), known, plan.normalize_urls)
        requests, seen = folder.put(asked(n), new, by="part", found=F.count("*"))
        room = plan.max_pages - state.fetched
        if not seen["found"]:
            break
        if seen["found"] > room:  # only then are they put in order
            requests = folder.put(f"cut-{n}", requests.orderBy("seq").limit(room))
        ask, rest = requests.drop("key", "part"), None
        if plan.robots is not None or fetcher is not plan.fetcher:
            ask, rest = dealt(folder, n, ask, plan, state.levels)
        if live and n:
            ask = with_hosts(ask, folder.get(f"hosts-{n - 1}"))
        pages = fetcher.fetch(ask)
        healing = plan.provider is not None or plan.healing_cache is not None
        if healing or fetcher is not plan.fetcher:
            pages = folder.put(f"fetched-{n}", pages)
        if fetcher is not plan.fetcher:
            plan.fetcher.remember(pages, ask)
        if rest is not None:
            pages = pages.unionByName(rest)
        how = {"link_selector": plan.link_selector, "auto_pagination": plan.auto_pagination, "link_finder": plan.link_finder} if n < plan.max_depth else {}
        got = heal(pages, plan.fields, plan.item_selector, plan.healing_cache or HealingCache(), plan.provider, **how) if healing else harvest(pages, plan.fields, plan.item_selector, **how)
        sums = {"fetched": F.count("*"), "failed": F.count_if(~F.col("success")), "items": F.coalesce(F.sum(F.size(F.coalesce("items", F.array()))), F.lit(0)), "links": F.coalesce(F.sum(F.size(F.coalesce("links", F.array()))), F.lit(0)), "last": F.max_by("url", "seq")}
        level, seen = folder.put(f"pages-{n}", got, **sums)
        if live:
            folder.put(f"hosts-{n}", hosts_after(folder.get(f"hosts-{n - 1}") if n else None, level))
        state = State(n + 1, state.fetched + seen["fetched"], state.failed + seen["failed"], state.extracted + seen["items"], [*state.levels, n], seen["links"])
        folder.save(state)
        if plan.progress:
            plan.progress({"level": n, "pages_fetched": state.fetched, "pages_failed": state.failed, "items_extracted": state.extracted, "last_url": seen["last"]})
    folder.finish()
    levels = [folder.get(f"pages-{n}") for n in state.levels]
    if not levels:
        levels = [harvest(fetcher.fetch(seeds.limit(0)), plan.fields, plan.item_selector)]
    every = reduce(DataFrame.unionByName, levels)
    meta = ["url", "depth", "seq"]
    pages = every.select(*meta, "status", "success", "error", "elapsed_ms")
    items = items_of(every.where(F.col("success") & F.col("items").isNotNull()), plan.fields, meta)
    return Result(pages, deduplicated(items, list(plan.fields), plan.deduplicate_by), plan.fields)


def deduplicated(items: DataFrame, fields: Sequence[str], by: str | None) -> DataFrame:
    if not by:
        return items
    if by == "*":
        return dedup.by_content(items, fields, ORDER)
    return dedup.by_key(items.withColumn("__key", F.col(f"`{by}`") if by in fields else F.lit(None).cast("string")), "__key", ORDER).drop("__key")
