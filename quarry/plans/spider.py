"""A fluent builder of crawls."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.crawl import Plan, Result, crawl
from quarry.operators.extract import LinkFinder, bind
from quarry.operators.heal import HealingCache, Provider
from quarry.plans.spec import Fields, FieldSpec, fields_of
from quarry.sources.fetch import Fetcher, TableFetcher
from quarry.sources.readers import seeds
from quarry.sources.sinks import Sink, fan_out


class Spider:
    """``Spider(spark).seed(...).fetch_from(pages).select(...).follow(...).run()``; every method returns the spider."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._urls: list[str] = []
        self._requests: list[tuple[str, str, dict[str, str] | None]] = []
        self._plan: dict = {}
        self._fields: Fields = {}
        self._sinks: list[Sink] = []
        self._login: tuple[str, dict[str, str]] | None = None
        self._typed = False

    def _set(self, **values) -> Spider:
        self._plan |= values
        return self

    def seed(self, *urls: str) -> Spider:
        self._urls += urls
        return self

    def seed_all(self, urls: Iterable[str]) -> Spider:
        return self.seed(*urls)

    def seed_request(self, url: str, method: str = "GET", form: dict[str, str] | None = None) -> Spider:
        self._requests.append((url, method, form))
        return self

    def seed_post(self, url: str, form: dict[str, str]) -> Spider:
        return self.seed_request(url, "POST", form)

    def fetch_with(self, fetcher: Fetcher) -> Spider:
        return self._set(fetcher=fetcher)

    def fetch_from(self, pages: DataFrame) -> Spider:
        return self.fetch_with(TableFetcher(pages))

    def login(self, url: str, form: dict[str, str]) -> Spider:
        self._login = url, form
        return self

    def select(self, fields: Fields | type | None = None, item_selector: str | None = None, **more: FieldSpec | str) -> Spider:
        """Fields by name (a string is a CSS selector), or a dataclass of ``harvest_field``s, whose items are then typed."""
        if isinstance(fields, type):
            self._fields, self._typed = fields_of(fields), True
        else:
            self._fields |= fields or {}
        self._fields |= {k: FieldSpec(v) if isinstance(v, str) else v for k, v in more.items()}
        return self._set(item_selector=item_selector) if item_selector else self

    def follow(self, selector: str, max_depth: int = 2) -> Spider:
        return self._set(link_selector=selector, max_depth=max_depth)

    def follow_next(self, max_depth: int = 2) -> Spider:
        return self._set(auto_pagination=True, max_depth=max_depth)

    def follow_with(self, finder: LinkFinder, max_depth: int = 2) -> Spider:
        return self._set(link_finder=finder, max_depth=max_depth)

    def limit(self, max_pages: int) -> Spider:
        return self._set(max_pages=max_pages)

    def respect(self, robots: DataFrame) -> Spider:
        return self._set(robots=robots)

    def keep_urls(self) -> Spider:
        return self._set(normalize_urls=False)

    def deduplicate(self, by: str = "*") -> Spider:
        return self._set(deduplicate_by=by)

    def heal_with(self, provider: Provider | None, cache: HealingCache | None = None) -> Spider:
        return self._set(provider=provider, healing_cache=cache or HealingCache())

    def checkpoint(self, path: str) -> Spider:
        return self._set(checkpoint=path)

    def on_progress(self, f: Callable[[dict], None]) -> Spider:
        return self._set(progress=f)

    def to(self, *sinks: Sink) -> Spider:
        self._sinks += sinks
        return self

    def run(self) -> Result:
        """Crawls, writes to the sinks, and returns pages and items."""
        plan = Plan(fields=self._fields, **self._plan)
        if self._login:
            plan.fetcher.login(*self._login)
        result = crawl(self.spark, seeds(self.spark, self._urls, self._requests), plan)
        if self._typed:
            result.items = bind(result.items, self._fields)
        if self._sinks:
            fan_out(result.items.select(*self._fields), self._sinks)
        return result
