"""Command line: init, validate, run, watch, diff, stats, test-selector, version."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
import time
from collections.abc import Sequence
from pathlib import Path

from quarry.plans import recipe as recipes

VERSION = "0.1.0"


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def init(name: str = "recipe") -> int:
    path = Path(name if name.lower().endswith(".json") else f"{name}.json")
    path.write_text(json.dumps(recipes.STARTER, indent=2))
    print(f"Wrote {path}.")
    return 0


def validate(path: str) -> int:
    try:
        found = recipes.validate(recipes.load(path))
    except recipes.RecipeError as e:
        print(f"error: {e}")
        return 1
    for severity, text in found:
        print(f"{severity}: {text}")
    errors = sum(s == "error" for s, _ in found)
    if not errors:
        print(f"The recipe can run, with {len(found)} warning(s)." if found else "The recipe is good.")
    return int(errors > 0)


def run(path: str, pages: str | None = None) -> int:
    """``pages``: a Parquet table (url, html) to crawl instead of the network."""
    from quarry.sources.fetch import TableFetcher

    recipe = recipes.load(path)
    if recipe is None:
        print("error: the recipe is null")
        return 1
    spark = _session()
    fetcher = TableFetcher(spark.read.parquet(pages)) if pages else None
    print(recipes.report(recipes.run(spark, recipe, fetcher, name=Path(path).stem)))
    return 0


def watch(path: str, interval: float, key: str | None, max_runs: int | None = None, pages: str | None = None) -> int:
    """Runs again and again, and compares each output with the one before."""
    recipe, n = recipes.load(path), 0
    out = Path(recipe.output.path)
    while max_runs is None or n < max_runs:
        before = Path(f"{out}.previous")
        if out.exists():
            shutil.copyfile(out, before)
        run(path, pages)
        if key and before.exists() and recipe.output.format.lower() == "json":
            diff(str(before), str(out), key)
        n += 1
        if max_runs is None or n < max_runs:
            time.sleep(interval)
    return 0


def diff(old: str, new: str, key: str) -> int:
    from quarry.operators import diff as d
    from quarry.sources.readers import PLACE, json_lines

    spark = _session()
    read = lambda p: json_lines(spark, p) if Path(p).exists() else spark.createDataFrame([], f"line_no {PLACE}, line string")
    found = d.snapshot_diff(read(old), read(new), key).cache()
    n = {r["status"]: r["n"] for r in d.counts(found).collect()}
    for status in ("added", "removed", "changed", "unchanged"):
        print(f"{status}: {n.get(status, 0)}")
        if status != "unchanged":
            for r in d.sample(found, status).collect():
                print(f"  {r['key']}")
            if n.get(status, 0) > 20:
                print(f"  ... and {n[status] - 20} more")
    return 0


def stats(path: str) -> int:
    from quarry.operators.coverage import jsonl_stats

    if not Path(path).exists():
        print(f"error: no file {path}")
        return 1
    rows = jsonl_stats(_session().read.text(path)).collect()
    n = {r["metric"]: r["n"] for r in rows if r["metric"] != "field"}
    print(f"items: {n.get('items', 0)}\nmalformed lines: {n.get('malformed', 0)}")
    for r in rows:
        if r["metric"] == "field":
            print(f"  {r['name']}: {100 * r['n'] / max(1, n.get('items', 0)):.0f}%")
    return 0


def test_selector(url: str, selector: str, attribute: str | None = None, xpath: bool = False) -> int:
    """``url`` may be a local file."""
    from urllib.request import urlopen

    from quarry.operators.extract import Page
    from quarry.plans.spec import FieldSpec, Kind

    if Path(url).exists():
        html = Path(url).read_text(encoding="utf-8")
    else:
        with urlopen(url, timeout=30) as r:
            html = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    page = Page(url, html)
    found = page.field(page.document, FieldSpec(selector, Kind.XPATH if xpath else Kind.CSS, attribute))
    print(found if found is not None else "no match")
    return int(found is None)


def main(args: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    add = sub.add_parser
    add("init").add_argument("name", nargs="?", default="recipe")
    add("validate").add_argument("recipe")
    x = add("run")
    x.add_argument("recipe")
    x.add_argument("--pages")
    x = add("watch")
    x.add_argument("recipe")
    x.add_argument("--interval", type=float, default=3600)
    x.add_argument("--key")
    x.add_argument("--max-runs", type=int)
    x.add_argument("--pages")
    x = add("diff")
    x.add_argument("old")
    x.add_argument("new")
    x.add_argument("--key", required=True)
    add("stats").add_argument("path")
    x = add("test-selector")
    x.add_argument("url")
    x.add_argument("selector")
    x.add_argument("--attribute")
    x.add_argument("--xpath", action="store_true")
    add("version")
    a = p.parse_args(args)
    calls = {
        "init": lambda: init(a.name), "validate": lambda: validate(a.recipe), "run": lambda: run(a.recipe, a.pages), "watch": lambda: watch(a.recipe, a.interval, a.key, a.max_runs, a.pages),
        "diff": lambda: diff(a.old, a.new, a.key), "stats": lambda: stats(a.path), "test-selector": lambda: test_selector(a.url, a.selector, a.attribute, a.xpath), "version": lambda: print(VERSION) or 0,
    }
    try:
        return calls[a.command]()
    except Exception as e:  # a command's failure is its exit code
        print(f"error: {e}", file=sys.stderr)
        return 1
