"""Extraction: pages become items (and links) in one Arrow stage a page; all else is native columns.

Each page is parsed once, its JSON-LD is read once, and only the requested
fields are evaluated.  Only strings leave the stage; cleaning, typing and
dropping are projections and filters after it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import structured, transforms
from quarry.functions.css import compile_selector
from quarry.functions.dom import Element, parse
from quarry.functions.urls import host, is_absolute
from quarry.functions.xpath import first_value
from quarry.plans.spec import Fields, FieldSpec, Kind

HEALABLE = (Kind.CSS, Kind.REGEX, Kind.XPATH)
CONTAINER = "__container__"


class Page:
    """One parsed page; what several fields share is read once."""

    def __init__(self, url: str, html: str | None):
        self.url, self.document, self._blocks = url, parse(html), None

    @property
    def blocks(self) -> list:
        if self._blocks is None:
            self._blocks = structured.json_ld(self.document)
        return self._blocks

    def scopes(self, item_selector: str | None) -> list[Element]:
        return [self.document] if not item_selector else list(compile_selector(item_selector).iter(self.document))

    def value(self, scope: Element, spec: FieldSpec, selector: str) -> str | None:
        """What one selector finds for a field, before transforms."""
        if spec.kind is Kind.JSON_LD:
            return structured.json_ld_value(self.blocks, selector)
        if spec.kind is Kind.MAIN_CONTENT:
            return structured.main_content(self._element(scope))
        if spec.kind is Kind.XPATH:
            return first_value(selector, self._element(scope), spec.attribute)
        found = compile_selector(selector).first(scope)
        if found is None:
            return None
        if spec.kind is Kind.REGEX and spec.attribute:
            m = re.search(spec.attribute, found.text())
            return m[0] if m else None
        if spec.kind is Kind.CSS and spec.attribute:
            return found.attrs.get(spec.attribute.lower())
        return found.text().strip() or None

    @staticmethod
    def _element(scope: Element) -> Element:
        return scope.elements()[0] if scope.tag == "#document" else scope

    def field(self, scope: Element, spec: FieldSpec, healed: str | None = None) -> str | None:
        for selector in (spec.selector, *spec.fallbacks):
            if (v := self.value(scope, spec, selector)) is not None:
                return v
        if healed and spec.kind in HEALABLE:
            try:
                return self.value(scope, spec, healed)
            except ValueError:
                return None
        return None


def _item_type(fields: Fields) -> pa.DataType:
    return pa.list_(pa.struct([(f"f{i}", pa.string()) for i in range(len(fields))]))


LinkFinder = Callable[[str, str], list[str]]


def harvest(
    pages: DataFrame, fields: Fields, item_selector: str | None = None, url_col: str = "url", html_col: str = "html",
    link_selector: str | None = None, auto_pagination: bool = False, link_finder: LinkFinder | None = None, healed: DataFrame | None = None,
) -> DataFrame:
    """The pages' other columns, plus ``items`` (an array of structs of the fields) and ``links`` (absolute URLs).

    A page with a null html has no items and no links.  ``healed`` (host, repairs)
    has the repairs of each host, by field.
    """
    for spec in fields.values():
        spec.check()
    for s in (item_selector, link_selector):
        if s:
            compile_selector(s)
    carry = [c for c in pages.columns if c != html_col]
    specs = list(fields.items())
    whole = pages if healed is None else pages.join(healed.select(F.col("host").alias("__host"), F.col("repairs").alias("__repairs")), host(F.col(url_col)) == F.col("__host"), "left").drop("__host")
    told = [] if healed is None else ["__repairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, links = [], []
            known = b.column(len(carry) + 1).to_pylist() if told else [None] * b.num_rows
            for url, html, repairs in zip(b.column(carry.index(url_col)).to_pylist(), b.column(len(carry)).to_pylist(), known, strict=True):
                if html is None:
                    items.append([])
                    links.append([])
                    continue
                url = url or ""
                page = Page(url, html)
                own = dict(repairs or ())
                scopes = page.scopes(item_selector)
                if not scopes and item_selector and own.get(CONTAINER):
                    scopes = page.scopes(own[CONTAINER])
                items.append([{f"f{i}": page.field(s, spec, own.get(name)) for i, (name, spec) in enumerate(specs)} for s in scopes])
                if link_selector:
                    links.append(structured.links(page.document, url, link_selector))
                elif auto_pagination:
                    links.append([u for u in [structured.next_page(page.document, url)] if u])
                elif link_finder:
                    links.append([u for x in link_finder(url, html) if (u := structured.absolute(url, x))])
                else:
                    links.append([])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(carry))), pa.array(items, _item_type(fields)), pa.array(links, pa.list_(pa.string()))], [*carry, "items", "links"]
            )

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in carry)
    struct = "array<struct<" + ",".join(f"f{i}:string" for i in range(len(fields))) + ">>"
    return whole.select(*carry, html_col, *told).mapInArrow(run, f"{kinds}, items {struct}, links array<string>")


def items_of(harvested: DataFrame, fields: Fields, keep: list[str] | None = None) -> DataFrame:
    """One row an item: the kept columns, ``item_seq`` (from 0, in document order) and the fields, cleaned by their transforms."""
    keep = [c for c in harvested.columns if c not in ("items", "links")] if keep is None else keep
    rows = harvested.select(*keep, F.posexplode("items").alias("item_seq", "item"))
    return rows.select(*keep, "item_seq", *(transforms.apply(F.col(f"item.f{i}"), spec.transforms).alias(name) for i, (name, spec) in enumerate(fields.items())))


SPLIT = 128 << 20  # bytes of a file that a task reads


def spread(pages: DataFrame) -> DataFrame:
    """Pages of less than a split a core, in fewer files than cores, dealt to all cores: a page takes much longer to parse than to move.  Others stay where they are read."""
    spark = pages.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, len(pages.inputFiles())
    if not 0 < files < cores or int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * SPLIT:
        return pages
    return pages.repartition(cores)


def extract(pages: DataFrame, fields: Fields, item_selector: str | None = None, **how) -> DataFrame:
    """Items of the pages; every value is a nullable string."""
    return items_of(harvest(spread(pages), fields, item_selector, **how), fields)


def typed(value: Column, kind: str) -> Column:
    """A string as ``kind``; what can't be read is null."""
    if kind == "string":
        return value
    if kind in ("decimal", "double", "float", "int", "long"):
        digits = F.nullif(transforms.strip_non_digits(value), F.lit(""))
        return digits.try_cast({"decimal": "decimal(38,10)", "long": "bigint"}.get(kind, kind))
    if kind == "datetime":
        text = transforms.trim(value)
        formats = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "d MMMM yyyy", "MMMM d, yyyy"]
        return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats), text.try_cast("timestamp_ntz"))
    if kind == "url":
        return F.when(is_absolute(transforms.trim(value)), transforms.trim(value))
    options = kind.split("|")
    known = F.create_map(*[F.lit(x) for o in options for x in (o.lower(), o)])
    return F.try_element_at(known, F.lower(transforms.trim(value)))


def bind(items: DataFrame, fields: Fields, enforce_required: bool = True) -> DataFrame:
    """Typed items: values as their fields' types; items without any value go, and (unless told otherwise) those without a required one."""
    names = list(fields)
    found = items.where(F.coalesce(*(F.col(f"`{n}`") for n in names)).isNotNull())
    out = found.select(*(c for c in items.columns if c not in fields), *(typed(F.col(f"`{n}`"), s.type).alias(n) for n, s in fields.items()))
    for n, s in fields.items():
        if s.required and enforce_required:
            out = out.where(F.col(f"`{n}`").isNotNull())
    return out


def page_function(f: Callable[[Element, str], object], kind: str) -> Callable[[str | Column, str | Column], Column]:
    """A column (url, html) -> f(document, url), evaluated by Arrow batches."""
    @F.pandas_udf(kind)
    def run(url: pd.Series, html: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else f(parse(h), u or "") for u, h in zip(url, html, strict=True)], dtype=object)

    return run


def links(selector: str) -> Callable[..., Column]:
    compile_selector(selector)
    return page_function(lambda d, u: structured.links(d, u, selector), "array<string>")


def next_page(*custom: str) -> Callable[..., Column]:
    return page_function(lambda d, u: structured.next_page(d, u, *custom), "string")


def main_content() -> Callable[..., Column]:
    return page_function(lambda d, u: structured.main_content(d.elements()[0]), "string")


def open_graph() -> Callable[..., Column]:
    return page_function(lambda d, u: structured.open_graph(d), "map<string,string>")


def meta_tags() -> Callable[..., Column]:
    return page_function(lambda d, u: structured.meta_tags(d), "map<string,string>")
