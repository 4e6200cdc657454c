"""Fetchers: how requests become pages.  The default reads an archive table; live fetching is one Arrow stage in which each host has one task."""

from __future__ import annotations

import hashlib
import http.client
import http.cookiejar
import json
import os
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from email.utils import parsedate_to_datetime
from typing import Protocol

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.urls import cache_name, host, origin
from quarry.operators.politeness import GROW, LONGEST_MS, MOST, RELAX

TRACE = "struct<host:string,started:double,multiplier:double,cookies:string>"
PAGE = f"url string, status int, html string, success boolean, error string, depth int, elapsed_ms long, seq long, trace {TRACE}"
REQUEST = "url string, depth int, method string, form map<string,string>, seq long"


class Fetcher(Protocol):
    def fetch(self, requests: DataFrame) -> DataFrame:
        """Pages (see PAGE) of requests (see REQUEST).

        Where robots are asked for, requests also have crawl_delay (seconds or
        null), and where the crawl has met hosts before, ``before``, a struct
        like ``trace``: when the host's last request started, its delay
        multiplier and its cookies.
        """

    def login(self, url: str, form: dict[str, str]) -> bool: ...


def as_pages(requests: DataFrame, status, html, error) -> DataFrame:
    """Requests with an answer that no host was asked for."""
    return requests.select(
        "url", status.cast("int").alias("status"), html.cast("string").alias("html"), ((status >= 200) & (status < 300)).alias("success"), error.cast("string").alias("error"),
        F.col("depth").cast("int").alias("depth"), F.lit(0).cast("long").alias("elapsed_ms"), "seq", F.lit(None).cast(TRACE).alias("trace"),
    )


class TableFetcher:
    """Looks requests up in a table (url, html[, status]), one page a URL; what isn't there fails with status 0.

    The table meets the requests in an inner join, of which Spark broadcasts the
    requests as long as they are small, so the table is then scanned and not
    shuffled; only what is asked for is joined back.  Frontiers beyond that limit
    shuffle the table once a level, unless it is stored by ``stored_archive``.
    """

    def __init__(self, pages: DataFrame):
        status = F.col("status") if "status" in pages.columns else F.lit(200)
        self.pages = pages.select(F.col("url"), F.col("html").alias("__html"), status.alias("__status"), F.lit(True).alias("__there"))

    def fetch(self, requests: DataFrame) -> DataFrame:
        hits = self.pages.join(requests.select("url").distinct(), "url")
        hits = hits.groupBy("url").agg(F.min(F.struct("__status", "__html", "__there")).alias("p")).select("url", "p.*")
        found = requests.join(hits, "url", "left")
        status = F.coalesce("__status", F.lit(0))
        return as_pages(found, status, F.col("__html"), F.when(F.col("__there").isNull(), F.lit("not found")))

    def login(self, url: str, form: dict[str, str]) -> bool:
        return True


def stored_archive(pages: DataFrame, name: str, buckets: int, path: str | None = None) -> BucketedFetcher:
    """A fetcher over ``pages`` (url, html[, status]) stored as table ``name``, one page a URL, in buckets by URL: however many requests meet it, only they are shuffled."""
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    one = pages.select("url", status.cast("int").alias("status"), "html").groupBy("url").agg(F.min(F.struct("status", "html")).alias("p")).select("url", "p.*")
    writer = one.repartition(buckets, "url").write.bucketBy(buckets, "url").sortBy("url").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return BucketedFetcher(pages.sparkSession.table(name))


class BucketedFetcher(TableFetcher):
    """A ``TableFetcher`` over a table that is bucketed by URL and has one page a URL: nothing is grouped, and in a join of shuffles the table keeps its place."""

    def fetch(self, requests: DataFrame) -> DataFrame:
        hits = self.pages.join(requests.select("url").distinct(), "url")
        found = requests.join(hits, "url", "left")
        return as_pages(found, F.coalesce("__status", F.lit(0)), F.col("__html"), F.when(F.col("__there").isNull(), F.lit("not found")))


def robots_by(fetcher: Fetcher) -> Callable[[DataFrame], DataFrame]:
    """A function from origins (origin) to the table (origin, content) of their robots.txt; content is null where the file can't be had, which allows all.

    The files are asked for plainly: without a renderer, a cache or retries.
    """
    ask = plainly(fetcher)

    def find(origins: DataFrame) -> DataFrame:
        names = origins.select(F.concat("origin", F.lit("/robots.txt")).alias("url"), F.lit(0).alias("depth"), F.lit("GET").alias("method"), F.lit(None).cast("map<string,string>").alias("form"), F.lit(0).cast("long").alias("seq"))
        return ask.fetch(names).select(origin(F.col("url")).alias("origin"), F.when(F.col("success"), F.col("html")).alias("content"))

    return find


def plainly(fetcher: Fetcher) -> Fetcher:
    """The same fetcher as far as it gets documents that are no pages."""
    if isinstance(fetcher, CachedFetcher):
        return plainly(fetcher.inner)
    if isinstance(fetcher, HttpFetcher):
        out = HttpFetcher(replace(fetcher.options, max_retries=0, delay_ms=0, screenshots=None))
        out.cookies = fetcher.cookies
        return out
    return fetcher


class CachedFetcher:
    """Serves GET requests from a table (name, html) by cache name and passes the others on; a hit has status 200.

    ``missed`` lists what the last call fetched.  With ``path``, successful GET
    pages of a crawl are appended to the cache there, each name once.
    """

    path: str | None = None

    def __init__(self, cache: DataFrame, inner: Fetcher):
        self.cache, self.inner, self.missed = cache.select(F.col("name").alias("__name"), F.col("html").alias("__html")), inner, None

    def named(self, requests: DataFrame) -> DataFrame:
        return requests.withColumn("__name", F.when(F.col("method") == "GET", cache_name(F.col("url"))))

    def fetch(self, requests: DataFrame) -> DataFrame:
        named = self.named(requests)
        hits = named.join(self.cache, "__name")
        fresh = self.inner.fetch(named.join(self.cache, "__name", "left_anti").drop("__name"))
        self.missed = fresh.where("success").select(cache_name(F.col("url")).alias("name"), "html")
        return as_pages(hits, F.lit(200), F.col("__html"), F.lit(None)).unionByName(fresh)

    def remember(self, pages: DataFrame, requests: DataFrame) -> None:
        """Appends the successful ``pages`` of GET requests to the cache's folder, if it has one."""
        if self.path is None:
            return
        got = pages.where("success").join(requests.where("method = 'GET'").select("url", "seq"), ["url", "seq"], "left_semi")
        new = got.select(cache_name(F.col("url")).alias("name"), "html").groupBy("name").agg(F.min("html").alias("html"))
        if (old := cache_at(pages.sparkSession, self.path)) is not None:
            new = new.join(old.select("name"), "name", "left_anti")
        new.write.mode("append").parquet(self.path)

    def login(self, url: str, form: dict[str, str]) -> bool:
        return self.inner.login(url, form)


def cache_at(spark, path: str) -> DataFrame | None:
    """The table of a cache's folder; None where there is no folder, or nothing in it, yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class PageRenderer(Protocol):
    """A browser or the like, made on the executor that uses it."""

    def render(self, url: str) -> str: ...

    # A renderer may also have screenshot(url) -> bytes, of the page that it has rendered last.


@dataclass
class HttpOptions:
    timeout_s: float = 30
    delay_ms: float = 500
    max_retries: int = 3
    retry_base_ms: float = 1000
    follow_redirects: bool = True
    user_agents: list[str] = field(default_factory=lambda: ["quarry/1.0"])
    proxies: list[str] = field(default_factory=list)
    adaptive: bool = False
    concurrency: int = 4  # requests on their way at a time, in all
    per_host: int | None = None  # and to one host
    threads: int = 8  # of a task, at most
    screenshots: str | None = None  # folder for the renderer's pictures, one a page

    def shape(self) -> tuple[int, int]:
        """(tasks, threads of a task): their product is at most ``concurrency``."""
        threads = max(1, min(self.concurrency, self.threads))
        return max(1, self.concurrency // threads), threads


def _save_picture(renderer, folder: str, url: str) -> None:
    fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{hashlib.sha256(url.encode()).hexdigest()[:32]}.png") as f:
        f.write(renderer.screenshot(url))


class Host:
    """What a task knows of a host: when its last request started, by how much its delay is stretched, and its gate."""

    def __init__(self, before: dict | None, per_host: int | None):
        before = before or {}
        self.started, self.multiplier = before.get("started") or 0.0, before.get("multiplier")
        self.turn, self.lock = threading.Lock(), threading.Lock()
        self.gate = threading.BoundedSemaphore(per_host) if per_host else None

    def start(self, o: HttpOptions, crawl_delay: float | None) -> float:
        """Waits for this request's turn, holding back those behind it, and tells when it came."""
        with self.turn:
            wait = self.started + wait_s(o.delay_ms, crawl_delay, self.multiplier or 1.0 if o.adaptive else None) - time.time()
            if wait > 0:
                time.sleep(wait)
            self.started = time.time()
            return self.started

    def report(self, ok: bool) -> None:
        with self.lock:
            if ok:
                self.multiplier = max(1.0, (1.0 if self.multiplier is None else self.multiplier) * RELAX)
            else:
                self.multiplier = GROW if self.multiplier is None else min(MOST, self.multiplier * GROW)


def _packed(cookies) -> str | None:
    return json.dumps([vars(c) | {"_rest": dict(c._rest)} for c in cookies]) if cookies else None


def _unpacked(text: str | None) -> list[http.cookiejar.Cookie]:
    out = []
    for own in json.loads(text) if text else []:
        rest = own.pop("_rest")
        out.append(http.cookiejar.Cookie(rest=rest, **own))
    return out


class HttpFetcher:
    """Live HTTP.

    Requests are dealt to tasks by host, so a host's delay, gate, rotation and
    cookies are kept by one task; the threads of a task have requests of several
    hosts, or of one, on their way at a time, and what a task starts first is the
    first request of each of its hosts.  Cookies go where their domain allows;
    those that answers set are used at once, and a crawl hands them, the delay
    multipliers and the last starts on to its next level through ``trace``.
    """

    def __init__(self, options: HttpOptions | None = None, renderer=None):
        self.options, self.renderer, self.cookies = options or HttpOptions(), renderer, None

    def login(self, url: str, form: dict[str, str]) -> bool:
        jar = http.cookiejar.CookieJar()
        opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(jar))
        try:
            with opener.open(urllib.request.Request(url, urllib.parse.urlencode(form).encode()), timeout=self.options.timeout_s) as r:
                good = 200 <= r.status < 400
        except OSError:
            return False
        self.cookies = _packed(list(jar))
        return good

    def fetch(self, requests: DataFrame) -> DataFrame:
        o, cookies, make_renderer = self.options, self.cookies, self.renderer
        tasks, threads = o.shape()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = _Task(o, cookies, make_renderer)
            with ThreadPoolExecutor(threads) as pool:
                for b in batches:
                    rows = list(pool.map(task.page, b.to_pylist()))
                    kinds = [("url", pa.string()), ("status", pa.int32()), ("html", pa.string()), ("success", pa.bool_()), ("error", pa.string()), ("depth", pa.int32()), ("elapsed_ms", pa.int64()), ("seq", pa.int64())]
                    trace = pa.array([r[8] for r in rows], pa.struct([("host", pa.string()), ("started", pa.float64()), ("multiplier", pa.float64()), ("cookies", pa.string())]))
                    yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)), trace], [*(n for n, _ in kinds), "trace"])

        named = requests.withColumn("__host", F.coalesce(host(F.col("url")), F.lit("")))
        dealt = named.repartition(tasks, "__host").withColumn("__turn", F.row_number().over(Window.partitionBy("__host").orderBy("seq")))
        return dealt.sortWithinPartitions("__turn", "seq").drop("__host", "__turn").mapInArrow(run, PAGE)


class _Task:
    """The requests of one task."""

    def __init__(self, options: HttpOptions, cookies: str | None, make_renderer):
        self.o, self.hosts, self.n, self.lock = options, {}, 0, threading.Lock()
        self.jar = http.cookiejar.CookieJar()
        for c in _unpacked(cookies):
            self.jar.set_cookie(c)
        self.make_renderer, self.own = make_renderer, threading.local()

    def page(self, r: dict) -> tuple:
        name = (urllib.parse.urlsplit(r["url"]).hostname or "").lower()
        with self.lock:
            if name not in self.hosts:
                before = r.get("before")
                self.hosts[name] = Host(before, self.o.per_host)
                for c in _unpacked(before and before["cookies"]):
                    self.jar.set_cookie(c)
            known, n = self.hosts[name], self.n
            self.n += 1
        began = known.start(self.o, r.get("crawl_delay"))
        if known.gate:
            known.gate.acquire()
        try:
            status, html, error, set_cookies = self.rendered(r) if self.make_renderer else self.answered(r, n, known)
        finally:
            if known.gate:
                known.gate.release()
        kept = _packed([c for c in list(self.jar) if name.endswith(c.domain.lstrip("."))]) if set_cookies else None
        trace = {"host": name, "started": began, "multiplier": known.multiplier, "cookies": kept}
        return r["url"], status, html, 200 <= status < 300, error, r["depth"], int(1000 * (time.time() - began)), r["seq"], trace

    def rendered(self, r: dict) -> tuple[int, str | None, str | None, bool]:
        """A renderer of the thread; one that fails is tried again, and its failures don't stretch the delay."""
        error = None
        for attempt in range(self.o.max_retries + 1):
            try:
                if not hasattr(self.own, "renderer"):
                    self.own.renderer = self.make_renderer()
                html = self.own.renderer.render(r["url"])
                if self.o.screenshots and hasattr(self.own.renderer, "screenshot"):
                    _save_picture(self.own.renderer, self.o.screenshots, r["url"])
                return 200, html, None, False
            except Exception as e:  # whatever a renderer raises is a failed attempt
                error = str(e) or type(e).__name__
                if attempt < self.o.max_retries:
                    time.sleep(retry_wait_s(attempt, None, self.o.retry_base_ms, time.time()))
        return 0, None, error, False

    def answered(self, r: dict, n: int, known: Host) -> tuple[int, str | None, str | None, bool]:
        """Every attempt's outcome is reported; the last answer's body counts, whatever its status."""
        o, data = self.o, urllib.parse.urlencode(dict(r["form"])).encode() if r["form"] else None
        status, html, error, had = 0, None, None, len(self.jar)
        changed = False
        for attempt in range(o.max_retries + 1):
            handlers: list = [urllib.request.HTTPCookieProcessor(self.jar)] + ([] if o.follow_redirects else [_Stay()])
            if o.proxies:
                p = o.proxies[(n + attempt) % len(o.proxies)]
                handlers.append(urllib.request.ProxyHandler({"http": p, "https": p}))
            after = None
            try:
                request = urllib.request.Request(r["url"], data, {"User-Agent": o.user_agents[(n + attempt) % len(o.user_agents)]}, method=r["method"])
                try:
                    answer = urllib.request.build_opener(*handlers).open(request, timeout=o.timeout_s)
                except urllib.error.HTTPError as e:
                    answer = e
                with answer:
                    status, html, after = answer.status, _decoded(answer), answer.headers.get("Retry-After")
                    changed = changed or bool(answer.headers.get_all("Set-Cookie")) or len(self.jar) != had
                error = None if 200 <= status < 300 else f"HTTP {status}"
            except (OSError, ValueError, http.client.HTTPException) as e:
                status, html, error = 0, None, str(e) or type(e).__name__
            again = status == 0 or status == 429 or status >= 500
            if o.adaptive and (again or 200 <= status < 300):
                known.report(not again)
            if not again:
                break
            if attempt < o.max_retries:
                time.sleep(retry_wait_s(attempt, after, o.retry_base_ms, time.time()))
        return status, html, error, changed


def _decoded(answer) -> str:
    body = answer.read()
    try:
        return body.decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except LookupError:  # no such charset
        return body.decode("utf-8", "replace")


def wait_s(delay_ms: float, crawl_delay_s: float | None, multiplier: float | None = None) -> float:
    """Seconds between a host's requests: the configured delay or, with a multiplier, the adaptive one (30 s at most); the robots' Crawl-delay if that is longer."""
    delay = delay_ms if multiplier is None else min(delay_ms * multiplier, LONGEST_MS)
    return max(delay / 1000, crawl_delay_s or 0.0)


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def retry_wait_s(attempt: int, retry_after: str | None, base_ms: float, now: float) -> float:
    """Seconds before the next attempt: a Retry-After header, else the exponential backoff."""
    if retry_after:
        if retry_after.strip().isdigit():
            if int(retry_after) > 0:
                return float(retry_after)
        else:
            try:
                ahead = parsedate_to_datetime(retry_after).timestamp() - now
                if ahead > 0:
                    return ahead
            except (TypeError, ValueError):
                pass
    return base_ms * 2**attempt / 1000


def hosts_after(before: DataFrame | None, pages: DataFrame) -> DataFrame:
    """(host, started, multiplier, cookies) of all hosts met: of a host met again, the latest of each that is known."""
    met = pages.where("trace is not null").select("trace.*")
    every = met if before is None else before.unionByName(met)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("started"))).alias(c)
    return every.groupBy("host").agg(F.max("started").alias("at"), last("multiplier"), last("cookies")).withColumnRenamed("at", "started").select("host", "started", "multiplier", "cookies")


def with_hosts(requests: DataFrame, known: DataFrame) -> DataFrame:
    """requests with ``before``, what is known of their hosts."""
    rows = known.select("host", F.struct("host", "started", "multiplier", "cookies").alias("before"))
    return requests.withColumn("host", F.lower(host(F.col("url")))).join(rows, "host", "left").drop("host")
