"""Repair of broken selectors: a table of known repairs, joined by host; providers, asked by the executors for what is missing; and a second extraction of the failing pages."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import TYPE_CHECKING, Protocol
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.css import SelectorError, compile_selector
from quarry.functions.urls import host
from quarry.operators.extract import CONTAINER, HEALABLE, Page, harvest
from quarry.plans.spec import Fields, FieldSpec

if TYPE_CHECKING:
    from quarry.operators.crawl import Folder

SNIPPET = 6000


@dataclass(frozen=True)
class HealingRequest:
    html: str  # at most SNIPPET characters
    field: str
    old_selector: str
    page_url: str
    description: str | None = None


class Provider(Protocol):
    def suggest(self, request: HealingRequest) -> str | None: ...


class Chain:
    """Asks providers in order; one that fails or has no answer passes the request on."""

    def __init__(self, providers: Iterable[Provider]):
        self.providers = list(providers)
        if not self.providers:
            raise ValueError("a chain needs a provider")

    def suggest(self, request: HealingRequest) -> str | None:
        for p in self.providers:
            try:
                if (found := p.suggest(request)) is not None:
                    return found
            except Exception:  # whatever a provider does wrong, the next one may do right
                continue
        return None


class HealingCache:
    """host -> field -> selector, kept in a JSON file if a path is given; a file that can't be read is empty."""

    def __init__(self, path: str | None = None):
        self.path, self.known = path, {}
        if path and os.path.exists(path):
            try:
                found = json.loads(Path(path).read_text())
                self.known = {h: dict(v) for h, v in found.items()}
            except (ValueError, AttributeError, TypeError, OSError):
                self.known = {}

    def get(self, host: str, field: str) -> str | None:
        return self.known.get(host.lower(), {}).get(field)

    def set(self, host: str, field: str, selector: str) -> None:
        self.known.setdefault(host.lower(), {})[field] = selector
        if self.path:
            part = Path(f"{self.path}.part")
            part.write_text(json.dumps(self.known, indent=2))
            part.replace(self.path)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(h, f, s) for h, own in self.known.items() for f, s in own.items()]
        return spark.createDataFrame(rows, "host string, field string, selector string")

    def repairs(self, spark: SparkSession) -> DataFrame | None:
        """(host, repairs): a map from fields to selectors; None if nothing is known."""
        if not self.known:
            return None
        return self.table(spark).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("field", "selector"))).alias("repairs"))  # a host's fields


# The object that is asked for and the limit of an answer's length are fixed values: parse_reply and the providers go by them.
INSTRUCTIONS = (
    'Find a CSS selector. You get a fragment of a page and the name of the value that is read from it; the old selector matches nothing there any more. '
    'Reply with {"selector": "<css>", "confidence": <0 to 1>} as bare JSON. Say {"selector": null, "confidence": 0} rather than guess.'
)
ANSWER_TOKENS = 200


def prompt(request: HealingRequest) -> str:
    about = (request.description or "").strip()
    wanted = f"{request.field} ({about})" if about else request.field
    return f"Wanted: {wanted}\nOld selector: {request.old_selector}\nFragment of {request.page_url}:\n{request.html[:SNIPPET]}"


def parse_reply(raw: str | None) -> str | None:
    """The selector of a reply: JSON, perhaps in a code fence; else the first quoted selector in the text."""
    text = re.sub(r"^```\w*\s*|\s*```$", "", (raw or "").strip()).strip()
    if not text:
        return None
    try:
        found = json.loads(text)
        value = found.get("selector") if isinstance(found, dict) else None
        return value if isinstance(value, str) and value.strip() else None
    except ValueError:
        m = re.search(r'"selector"\s*:\s*"([^"]+)"', text)
        return m[1] if m else None


def reply_column(raw: Column) -> Column:
    """``parse_reply`` as a native expression."""
    text = F.regexp_replace(F.regexp_replace(raw, r"^\s*```\w*\s*", ""), r"\s*```\s*$", "")
    value = F.try_parse_json(text)
    inside = F.try_variant_get(value, "$.selector", "variant")
    text_only = F.when(F.schema_of_variant(inside) == "STRING", F.try_variant_get(value, "$.selector", "string"))
    selector = F.when(F.regexp_replace(text_only, r"(?U)\s+", "") != "", text_only)
    other = F.nullif(F.regexp_extract(text, r'"selector"\s*:\s*"([^"]+)"', 1), F.lit(""))
    return F.when(value.isNotNull(), selector).otherwise(other)


class HttpProvider:
    """A provider behind an HTTP endpoint; ``payload`` and ``answer`` are usable without a network."""

    def __init__(self, url: str, model: str, api_key: str | None = None, style: str = "openai", timeout: float = 30):
        self.url, self.model, self.api_key, self.style, self.timeout = url, model, api_key, style, timeout

    def payload(self, request: HealingRequest) -> dict:
        if self.style == "gemini":
            return {
                "systemInstruction": {"parts": [{"text": INSTRUCTIONS}]},
                "contents": [{"parts": [{"text": prompt(request)}]}],
                "generationConfig": {"temperature": 0, "maxOutputTokens": ANSWER_TOKENS, "responseMimeType": "application/json"},
            }
        out = {"model": self.model, "messages": [{"role": "system", "content": INSTRUCTIONS}, {"role": "user", "content": prompt(request)}]}
        return out | ({"stream": False, "format": "json"} if self.style == "ollama" else {"temperature": 0, "max_tokens": ANSWER_TOKENS})

    def answer(self, body: dict) -> str | None:
        try:
            if self.style == "gemini":
                return parse_reply(body["candidates"][0]["content"]["parts"][0]["text"])
            message = body["message"] if self.style == "ollama" else body["choices"][0]["message"]
            return parse_reply(message["content"])
        except (KeyError, IndexError, TypeError):
            return None

    def suggest(self, request: HealingRequest) -> str | None:
        headers = {"Content-Type": "application/json"}
        if self.api_key:
            headers |= {"x-goog-api-key": self.api_key} if self.style == "gemini" else {"Authorization": f"Bearer {self.api_key}"}
        try:
            with urlopen(Request(self.url, json.dumps(self.payload(request)).encode(), headers), timeout=self.timeout) as r:
                return self.answer(json.load(r))
        except (OSError, ValueError):
            return None


def resolve_secret(value: str | None) -> str | None:
    """``env:NAME`` is the value of an environment variable, null if it isn't set."""
    return os.environ.get(value[4:]) if value and value.startswith("env:") else value


# Default endpoints and models of the hosted providers.
ENDPOINTS = {
    "groq": ("https://api.groq.com/openai/v1/chat/completions", "llama-3.3-70b-versatile"),
    "gemini": ("https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", "gemini-2.0-flash"),
    "ollama": ("http://localhost:11434/api/chat", "llama3.1"),
}


def build_provider(names: str | None, api_key: str | None = None, model: str | None = None, base_url: str | None = None) -> Provider | None:
    """The provider(s) of a comma-separated list; those that lack a key or an address are left out; null if none is left."""
    found: list[Provider] = []
    for name in (n.strip().lower() for n in (names or "").split(",")):
        key = resolve_secret(api_key)
        if name in ("groq", "gemini") and key:
            url, usual = ENDPOINTS[name]
            found.append(HttpProvider(url.replace("{model}", model or usual), model or usual, key, "gemini" if name == "gemini" else "openai"))
        elif name == "ollama":
            url, usual = ENDPOINTS[name]
            found.append(HttpProvider(f"{base_url.rstrip('/')}/api/chat" if base_url else url, model or usual, None, "ollama"))
        elif name == "openai-compatible" and base_url:
            found.append(HttpProvider(f"{base_url.rstrip('/')}/chat/completions", model or "gpt-4o-mini", key))
    return Chain(found) if len(found) > 1 else found[0] if found else None


def _some_item(i: int, test) -> Column:
    return F.exists("items", lambda x: test(x[f"f{i}"]))


def _shown(page: Page, name: str, spec: FieldSpec | None, item_selector: str | None, known: dict[str, str]) -> str:
    """The HTML that a provider sees: of the first item that lacks the field, else of the whole page."""
    lacking = (s for s in _scopes(page, item_selector, known) if page.field(s, spec) is None) if spec else ()
    return next(iter(lacking), page.document).html()[:SNIPPET]


def _scopes(page: Page, item_selector: str | None, known: dict[str, str]) -> list:
    scopes = page.scopes(item_selector)
    if not scopes and item_selector and known.get(CONTAINER):
        scopes = page.scopes(known[CONTAINER])
    return scopes


def _finds(page: Page, name: str, spec: FieldSpec | None, item_selector: str | None, known: dict[str, str], answer: str) -> bool:
    """Whether an answer finds something that the page lacks."""
    if spec is None:
        return bool(page.scopes(answer))
    return any(page.field(s, spec) is None and page.value(s, spec, answer) is not None for s in _scopes(page, item_selector, known))


def _learn(ranked: DataFrame, html: DataFrame, fields: Fields, item_selector: str | None, cache: HealingCache, provider: Provider, folder: Folder, name: str) -> bool:
    """Asks for every (host, field) of ``ranked`` (host, field, nth, url), one page after another until an answer finds something there.

    Round k shows the next 2**k pages of each pair that is still open, so few
    rounds reach a pair's last page.  The executors ask: a pair's pages come to
    one task in their order and stream through it, which passes over the rest of
    them once an answer is good.  Only what was learnt reaches the driver.
    """
    spark, learnt, low = ranked.sparkSession, False, 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled = None
        for b in batches:
            found = []
            for r in b.to_pylist():
                if (r["host"], r["field"]) == settled:
                    continue
                spec, known = fields.get(r["field"]), dict(r["repairs"] or [])
                old = spec.selector if spec else item_selector
                try:
                    page = Page(r["url"], r["html"])
                    answer = provider.suggest(HealingRequest(_shown(page, r["field"], spec, item_selector, known), r["field"], old or "", r["url"], spec.description if spec else None))
                    if not answer:
                        continue
                    if spec is None or spec.kind in HEALABLE[:2]:
                        compile_selector(answer)
                    if _finds(page, r["field"], spec, item_selector, known, answer):
                        settled = r["host"], r["field"]
                        found.append((*settled, answer))
                except (SelectorError, OSError, RuntimeError, ValueError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(3)], ["host", "field", "selector"])

    while True:
        shown = ranked.where((F.col("nth") >= low) & (F.col("nth") < 2 * low)).join(cache.table(spark).select("host", "field"), ["host", "field"], "left_anti")
        known = cache.repairs(spark)
        shown = shown.withColumn("repairs", F.lit(None).cast("map<string,string>")) if known is None else shown.join(known, "host", "left")
        asked = shown.join(html, "url").repartition("host", "field").sortWithinPartitions("host", "field", "nth")
        rows = folder.put(f"{name}-{low}", asked.select("host", "field", "url", "html", "repairs").mapInArrow(ask, "host string, field string, selector string"))
        for r in rows.toLocalIterator():
            cache.set(r["host"], r["field"], r["selector"])
            learnt = True
        low *= 2
        if ranked.where(F.col("nth") >= low).isEmpty():
            return learnt


def heal(pages: DataFrame, fields: Fields, item_selector: str | None, cache: HealingCache, provider: Provider | None, enabled: bool = True, **how) -> DataFrame:
    """``harvest`` with repairs.

    Known repairs take part in the first pass.  For each host's container and
    then its fields that are still missing, pages that lack them are shown to
    the provider one by one until an answer finds something, and only that
    answer is remembered; the pages with something missing are extracted again
    with it.  The passes are tables, as what was asked for must not be asked for
    again when an executor is lost.
    """
    from quarry.operators.crawl import Folder

    spark = pages.sparkSession
    run = lambda some: harvest(some, fields, item_selector, healed=cache.repairs(spark), **how)
    if provider is None or not enabled:
        return run(pages)
    folder = Folder(spark, None)
    got, html = folder.put("first", run(pages)), pages.where("html is not null").select("url", "html")
    container = [F.when(F.size("items") == 0, F.lit(CONTAINER))] if item_selector else []
    able = [F.when(_some_item(i, lambda v: v.isNull()), F.lit(n)) for i, (n, s) in enumerate(fields.items()) if s.kind in HEALABLE]
    nth = F.row_number().over(Window.partitionBy("host", "field").orderBy("url"))
    for name, lacks in (("container", container), ("fields", able)):
        if not lacks:
            continue
        missing = got.withColumn("lacking", F.array_compact(F.array(*lacks))).where(F.size("lacking") > 0)
        pairs = missing.join(html.select("url").distinct(), "url", "left_semi").select(host(F.col("url")).alias("host"), "url", F.explode("lacking").alias("field")).distinct()
        ranked = folder.put(f"{name}-pairs", pairs.join(cache.table(spark).select("host", "field"), ["host", "field"], "left_anti").withColumn("nth", nth))
        if _learn(ranked, html, fields, item_selector, cache, provider, folder, name):
            again = missing.select("url").distinct()
            second = folder.put(f"{name}-again", run(pages.join(again, "url", "left_semi")))
            got = got.join(again, "url", "left_anti").unionByName(second)
    return got
