"""Recipes: crawls declared in JSON; names of members are read without regard to case."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from functools import reduce
from pathlib import Path
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.transforms import parse_names
from quarry.operators import coverage, heal
from quarry.operators.crawl import Plan, Result, crawl
from quarry.plans.spec import Fields, FieldSpec, Kind
from quarry.sources import readers, sinks
from quarry.sources.fetch import CachedFetcher, Fetcher, HttpFetcher, HttpOptions, PageRenderer, TableFetcher, cache_at, plainly, robots_by

Message = tuple[str, str]  # severity (error or warning), text


class RecipeError(ValueError):
    pass


@dataclass
class Field:
    selector: str
    attribute: str | None = None
    regex: str | None = None
    xpath: bool = False
    jsonLd: bool = False
    mainContent: bool = False
    fallbackSelectors: list[str] | None = None
    transforms: list[str] | None = None
    description: str | None = None
    required: bool = False

    def spec(self) -> FieldSpec:
        kinds = ((self.jsonLd, Kind.JSON_LD), (self.mainContent, Kind.MAIN_CONTENT), (self.xpath, Kind.XPATH), (self.regex, Kind.REGEX))
        kind = next((k for on, k in kinds if on), Kind.CSS)
        return FieldSpec(self.selector, kind, self.regex or self.attribute, self.description, self.required, tuple(self.fallbackSelectors or ()), tuple(parse_names(self.transforms)))


@dataclass
class SeedRequest:
    url: str
    method: str = "POST"
    formData: dict[str, str] | None = None


@dataclass
class Login:
    url: str
    formData: dict[str, str] = field(default_factory=dict)


@dataclass
class Output:
    format: str = "json"
    path: str = "output.jsonl"


@dataclass
class Healing:
    provider: str = "none"
    apiKey: str | None = None
    model: str | None = None
    baseUrl: str | None = None


@dataclass
class Recipe:
    seedUrls: list[str] = field(default_factory=list)
    sitemapUrl: str | None = None
    seedUrlsFile: str | None = None
    seedRequest: SeedRequest | None = None
    login: Login | None = None
    itemSelector: str | None = None
    fields: dict[str, Field] = field(default_factory=dict)
    linkSelector: str | None = None
    autoPagination: bool = False
    maxDepth: int = 1
    maxPages: int = 100
    maxConcurrency: int = 4
    maxConcurrencyPerHost: int | None = None
    delayMilliseconds: int = 500
    respectRobotsTxt: bool = True
    adaptiveThrottling: bool = False
    proxyPool: list[str] = field(default_factory=list)
    proxyUsername: str | None = None
    proxyPassword: str | None = None
    useBrowserRendering: bool = False
    screenshotDirectory: str | None = None
    checkpointPath: str | None = None
    cacheDirectory: str | None = None
    userAgentPool: list[str] = field(default_factory=list)
    normalizeUrls: bool = True
    deduplicateBy: str | None = None
    webhookUrl: str | None = None
    output: Output = field(default_factory=Output)
    healing: Healing = field(default_factory=Healing)

    def specs(self) -> Fields:
        return {name: f.spec() for name, f in self.fields.items()}


_PARTS = {"seedRequest": SeedRequest, "login": Login, "output": Output, "healing": Healing}


def _read(cls: type, value: object):
    if not isinstance(value, dict):
        raise RecipeError(f"{cls.__name__} must be an object")
    names = {f.name.lower(): f.name for f in fields(cls)}
    own = {}
    for k, v in value.items():
        name = names.get(k.lower())
        if name is None:
            continue
        if cls is Recipe and name == "fields" and isinstance(v, dict):
            v = {n: _read(Field, x) for n, x in v.items()}
        elif cls is Recipe and name in _PARTS and v is not None:
            v = _read(_PARTS[name], v)
        own[name] = v
    try:
        return cls(**own)
    except TypeError as e:
        raise RecipeError(f"{cls.__name__}: {e}") from None


def parse(text: str) -> Recipe | None:
    """A recipe, or None for JSON null; RecipeError where it isn't one."""
    try:
        value = json.loads(text)
    except ValueError as e:
        raise RecipeError(f"not JSON: {e}") from None
    return None if value is None else _read(Recipe, value)


def load(path: str) -> Recipe | None:
    try:
        return parse(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise RecipeError(f"can't read {path}: {e.strerror}") from None


def _is_absolute(url: str) -> bool:
    try:
        p = urlsplit(url)
    except ValueError:
        return False
    return bool(p.scheme and (p.netloc or p.path))


# The names that a recipe's file may use.
PROVIDERS = ("none", "groq", "gemini", "ollama", "openai-compatible")
FORMATS = ("json", "csv", "sqlite")


def validate(recipe: Recipe | None) -> list[Message]:
    """What is wrong (error) or odd (warning) with a recipe, in a fixed order."""
    out: list[Message] = []
    error = lambda text: out.append(("error", text))
    warn = lambda text: out.append(("warning", text))
    if recipe is None:
        return [("error", "the recipe is null")]
    if not (recipe.seedUrls or recipe.sitemapUrl or recipe.seedUrlsFile or recipe.seedRequest):
        error("no seeds: give seedUrls, sitemapUrl, seedUrlsFile or seedRequest")
    for u in recipe.seedUrls:
        if not _is_absolute(u):
            error(f"seed URL is not absolute: {u}")
    if not recipe.fields:
        warn("no fields: nothing will be extracted")
    for name, f in recipe.fields.items():
        if not (f.selector or "").strip() and not f.mainContent:
            error(f"field {name}: empty selector")
        if sum((f.xpath, f.jsonLd, f.mainContent)) > 1:
            warn(f"field {name}: more than one of xpath, jsonLd and mainContent; jsonLd comes first, then mainContent, then xpath")
    if recipe.fields and not recipe.itemSelector:
        warn("no itemSelector: each page is one item")
    if recipe.linkSelector and recipe.autoPagination:
        warn("autoPagination is ignored, as there is a linkSelector")
    if recipe.useBrowserRendering and (recipe.proxyPool or recipe.userAgentPool):
        warn("a rendering browser doesn't use the proxy or user agent pool")
    h = recipe.healing
    names = [n.strip().lower() for n in (h.provider or "").split(",") if n.strip()] if h.provider != "none" else ["none"]
    if not names:
        warn("healing: the list of providers is empty")
    for n in names:
        if n not in PROVIDERS or (n == "none" and h.provider != "none"):
            error(f"healing: unknown provider {n}")
        elif n in ("groq", "gemini") and not h.apiKey:
            warn(f"healing: {n} needs an apiKey")
        elif n == "openai-compatible" and not h.baseUrl:
            error("healing: openai-compatible needs a baseUrl")
    if (recipe.output.format or "").lower() not in FORMATS:
        error(f"unknown output format {recipe.output.format}")
    return out


def validate_table(recipes: DataFrame, name_col: str = "name", text_col: str = "recipe") -> DataFrame:
    """(name, place, severity, message) of many recipes; one that can't be read is one error."""
    @F.udf("array<struct<severity:string,message:string>>", useArrow=True)
    def check(text: str) -> list[tuple[str, str]]:
        try:
            return validate(parse(text))
        except RecipeError as e:
            return [("error", str(e))]

    rows = recipes.select(name_col, F.posexplode(check(text_col)).alias("place", "m"))
    return rows.select(name_col, "place", "m.severity", "m.message")


def sink_of(recipe: Recipe, append: bool = False) -> sinks.Sink:
    """An unknown format means JSON Lines.  A path that ends in a slash, or has a scheme, is a folder that the executors write to; others are files of the driver."""
    kind, path = recipe.output.format.lower(), recipe.output.path
    if kind == "sqlite":
        return sinks.Sqlite(path)
    if path.endswith("/") or "://" in path:
        return (sinks.Csv if kind == "csv" else sinks.JsonLines)(path, append)
    return sinks.OneFile(path, "csv" if kind == "csv" else "json", append)


def seed_frame(spark: SparkSession, recipe: Recipe, fetcher: Fetcher | None = None) -> DataFrame:
    """seedUrls, then the sitemap's URLs (at most maxPages) as the fetcher finds them, then the file's, then the request; neither passes through the driver."""
    s = recipe.seedRequest
    form = {k: heal.resolve_secret(v) or "" for k, v in (s.formData or {}).items()} if s else None
    own = readers.seeds(spark, recipe.seedUrls, [(s.url, s.method, form)] if s else [])
    parts = [own.withColumn("seq", F.when(F.col("seq") >= len(recipe.seedUrls), F.lit(1 << 62)).otherwise(F.col("seq")))]
    if recipe.sitemapUrl:
        found = readers.sitemap_crawl(spark, plainly(fetcher), recipe.sitemapUrl, recipe.maxPages)
        parts.append(readers.as_requests(found.select(F.col("loc").alias("url"), (F.col("place") + (1 << 40)).alias("seq"))))
    if recipe.seedUrlsFile:
        lines = readers.seed_file(spark, recipe.seedUrlsFile)
        parts.append(readers.as_requests(lines.select("url", (F.monotonically_increasing_id() + (2 << 40)).alias("seq"))))
    return reduce(DataFrame.unionByName, parts)


def fetcher_of(spark: SparkSession, recipe: Recipe, renderer: Callable[[], PageRenderer] | None = None) -> Fetcher:
    """Live fetching by the recipe; useBrowserRendering needs a renderer's maker, as no browser is part of this."""
    if recipe.useBrowserRendering and renderer is None:
        raise RecipeError("useBrowserRendering needs a renderer")
    proxies = recipe.proxyPool
    if recipe.proxyUsername:
        user = f"{quote(recipe.proxyUsername, safe='')}:{quote(recipe.proxyPassword or '', safe='')}"
        proxies = [p.replace("://", f"://{user}@", 1) for p in proxies]
    options = HttpOptions(delay_ms=recipe.delayMilliseconds, adaptive=recipe.adaptiveThrottling, proxies=proxies, concurrency=max(1, recipe.maxConcurrency), per_host=recipe.maxConcurrencyPerHost)
    if recipe.userAgentPool:
        options.user_agents = recipe.userAgentPool
    options.screenshots = recipe.screenshotDirectory
    live = HttpFetcher(options, renderer if recipe.useBrowserRendering else None)
    if recipe.cacheDirectory:
        cache = cache_at(spark, recipe.cacheDirectory)
        return CachedFetcher(spark.createDataFrame([], "name string, html string") if cache is None else cache, live)
    return live


def run(spark: SparkSession, recipe: Recipe, fetcher: Fetcher | None = None, robots: DataFrame | None = None, sitemaps: DataFrame | None = None, name: str = "recipe", renderer: Callable[[], PageRenderer] | None = None) -> Result:
    """Crawls by the recipe, writes its output and calls its webhook; a stopped run goes on from its checkpoint.  ``sitemaps`` (url, xml) stands in for the network where sitemaps are asked for."""
    fetcher = fetcher or fetcher_of(spark, recipe, renderer)
    if isinstance(fetcher, CachedFetcher):
        fetcher.path = recipe.cacheDirectory
    if recipe.login:
        fetcher.login(recipe.login.url, {k: heal.resolve_secret(v) or "" for k, v in recipe.login.formData.items()})
    h, beside = recipe.healing, recipe.output.path.rstrip("/")
    provider = heal.build_provider(h.provider, h.apiKey, h.model, h.baseUrl)
    plan = Plan(
        fields=recipe.specs(), fetcher=fetcher, item_selector=recipe.itemSelector, link_selector=recipe.linkSelector, auto_pagination=recipe.autoPagination and not recipe.linkSelector,
        max_depth=recipe.maxDepth if recipe.linkSelector or recipe.autoPagination else 0, max_pages=recipe.maxPages, normalize_urls=recipe.normalizeUrls,
        robots=(robots if robots is not None else robots_by(fetcher)) if recipe.respectRobotsTxt else None, deduplicate_by=recipe.deduplicateBy, provider=provider,
        healing_cache=heal.HealingCache(f"{beside}.healing.json") if provider else None, checkpoint=recipe.checkpointPath or f"{beside}.checkpoint",
    )
    maps = fetcher if sitemaps is None else TableFetcher(sitemaps.select("url", F.col("xml").alias("html")))
    result = crawl(spark, seed_frame(spark, recipe, maps), plan)
    sinks.fan_out(result.items.select(*recipe.fields), [sink_of(recipe)])
    if recipe.webhookUrl:
        sinks.notify(recipe.webhookUrl, sinks.webhook_payload(name, result.summary().first().asDict()))
    return result


def report(result: Result) -> str:
    return coverage.print_summary(result.summary().first().asDict(), [(r["field"], r["coverage"]) for r in result.field_coverage().collect()])


STARTER = {
    "seedUrls": ["https://example.com/"], "itemSelector": ".item", "fields": {"title": {"selector": ".title"}, "author": {"selector": ".author"}},
    "linkSelector": "a[rel='next']", "maxDepth": 3, "maxPages": 20, "output": {"format": "json", "path": "output.jsonl"},
}
