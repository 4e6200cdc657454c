"""Sinks of items.  A sink is anything with ``write(items)``."""

from __future__ import annotations

import json
import shutil
import sqlite3
from collections.abc import Iterable
from contextlib import closing
from datetime import UTC, datetime
from pathlib import Path
from typing import Protocol
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sink(Protocol):
    def write(self, items: DataFrame) -> None: ...


def _mode(append: bool) -> str:
    return "append" if append else "overwrite"


class JsonLines:
    """A folder of JSON-Lines files, written by the executors; null fields are written."""

    def __init__(self, path: str, append: bool = False):
        self.path, self.append = path, append

    def write(self, items: DataFrame) -> None:
        items.write.mode(_mode(self.append)).option("ignoreNullFields", False).json(self.path)


class Csv:
    """A folder of CSV files with headers; a value is quoted only where it must be, quotes are doubled, null is empty."""

    def __init__(self, path: str, append: bool = False):
        self.path, self.append = path, append

    def write(self, items: DataFrame) -> None:
        options = {"header": True, "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        items.write.mode(_mode(self.append)).options(**options).csv(self.path)


class OneFile:
    """One local file, JSON-Lines or CSV, streamed through the driver: for results that a person opens."""

    def __init__(self, path: str, kind: str = "json", append: bool = False):
        self.path, self.kind, self.append = path, kind, append

    @staticmethod
    def cell(value) -> str:
        text = "" if value is None else str(value)
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') else text

    def write(self, items: DataFrame) -> None:
        """Into a file beside it, which takes its place when it is whole: a job that fails leaves the old one."""
        path, part = Path(self.path), Path(f"{self.path}.part")
        path.parent.mkdir(parents=True, exist_ok=True)
        old = self.append and path.exists() and path.stat().st_size > 0
        if old:
            shutil.copyfile(path, part)
        with open(part, "a" if old else "w", encoding="utf-8", newline="") as f:
            if self.kind == "csv" and not old:
                f.write(",".join(map(self.cell, items.columns)) + "\n")
            for r in items.toLocalIterator():
                f.write((",".join(map(self.cell, r)) if self.kind == "csv" else json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str)) + "\n")
        part.replace(path)


class Sqlite:
    """A table of text columns in a SQLite file; rows are appended, null is empty; the driver streams them in, all of them or, where the job fails, none."""

    def __init__(self, path: str, table: str = "item"):
        self.path, self.table = path, table

    def write(self, items: DataFrame) -> None:
        quoted = lambda s: '"' + s.replace('"', '""') + '"'
        names = items.columns
        rows = items.select(*(F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")).alias(n) for n in names))
        with closing(sqlite3.connect(self.path)) as db, db:
            db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(self.table)} ({', '.join(f'{quoted(n)} TEXT' for n in names)})")
            db.executemany(f"INSERT INTO {quoted(self.table)} ({', '.join(map(quoted, names))}) VALUES ({', '.join('?' * len(names))})", rows.toLocalIterator())


def fan_out(items: DataFrame, sinks: Iterable[Sink]) -> None:
    """Every item to every sink, in order; the items are computed once."""
    kept = items.persist()
    try:
        for s in sinks:
            s.write(kept)
    finally:
        kept.unpersist()


def webhook_payload(recipe: str, summary: dict, now: datetime | None = None) -> dict:
    return {
        "recipe": recipe, "pagesFetched": summary["pages_fetched"], "pagesFailed": summary["pages_failed"], "itemsExtracted": summary["items_extracted"],
        "finishedAtUtc": (now or datetime.now(UTC)).isoformat(),
    }


def notify(url: str, payload: dict, timeout: float = 10) -> bool:
    """Posts the payload; a failure is reported, never raised."""
    try:
        with urlopen(Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"}), timeout=timeout) as r:
            return 200 <= r.status < 300
    except (OSError, ValueError):
        return False
