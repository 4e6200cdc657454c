"""Crawls against a server of this machine: sitemaps, robots and the cache, cookies, delays and gates."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quarry.functions.urls import cache_name
from quarry.operators.crawl import Plan, crawl
from quarry.plans import recipe as recipes
from quarry.plans.spec import FieldSpec
from quarry.sources import fetch, readers
from quarry.sources.fetch import CachedFetcher, HttpFetcher, HttpOptions, hosts_after, robots_by, with_hosts

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


class Site(BaseHTTPRequestHandler):
    def answer(self, status, body="", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(body.encode())))
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        own, host = self.server, self.headers["Host"]
        with own.lock:
            own.seen.append((self.path, host, self.headers["Cookie"], time.time()))
            own.now += 1
            own.most = max(own.most, own.now)
            times = sum(p == self.path for p, *_ in own.seen)
        if self.path.startswith("/slow"):
            time.sleep(0.3)
        with own.lock:
            own.now -= 1
        code, body = own.pages.get(self.path, (404, "nothing here"))
        if isinstance(code, list):
            code = code[min(times, len(code)) - 1]
        self.answer(code, body.replace("BASE", f"http://{host}"), **({"Set_Cookie": f"seen={self.path[1:]}; Path=/"} if self.path.startswith("/set") else {}))

    def do_POST(self):
        self.rfile.read(int(self.headers["Content-Length"]))
        self.answer(200, "in", Set_Cookie="session=7; Path=/")

    def log_message(self, *args):
        pass


@pytest.fixture
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    server.seen, server.pages, server.lock, server.now, server.most = [], {}, threading.Lock(), 0, 0
    server.base, server.other = f"http://127.0.0.1:{server.server_port}", f"http://localhost:{server.server_port}"
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def ask(spark, *urls):
    return readers.seeds(spark, urls)


def recipe(tmp_path, **more):
    text = {"fields": {"title": {"selector": "h1"}}, "delayMilliseconds": 1, "output": {"path": f"{tmp_path}/out.jsonl"}} | more
    return recipes.parse(json.dumps(text))


def titles(result):
    return [r["title"] for r in result.items.orderBy("seq").collect()]


def test_a_recipe_with_a_sitemap_alone(spark, site, tmp_path):
    """An index of three levels; one part is missing, one isn't XML, one lists itself."""
    page = lambda n: (200, f"<h1>{n}</h1>")
    index = lambda *to: (200, f"<sitemapindex {NS}>" + "".join(f"<sitemap><loc> BASE{x} </loc></sitemap>" for x in to) + "</sitemapindex>")
    urls = lambda *to: (200, f"<?xml version='1.0'?>\n<urlset {NS}>" + "".join(f"<url><loc>BASE/{x}</loc></url>" for x in to) + "<url><loc>/rel</loc></url></urlset>")
    site.pages |= {str(f"/{n}"): page(n) for n in range(12)}
    site.pages |= {"/top.xml": index("/one.xml", "/two.xml", "/gone.xml", "/words.xml"), "/one.xml": index("/deep.xml", "/one.xml"), "/deep.xml": urls(3, 1), "/two.xml": urls(4, 5, 6), "/words.xml": (200, "words <b>")}
    r = recipe(tmp_path, sitemapUrl=f"{site.base}/top.xml", respectRobotsTxt=False)
    assert titles(recipes.run(spark, r)) == ["3", "1", "4", "5", "6"]
    assert {r["title"] for r in map(json.loads, (tmp_path / "out.jsonl").read_text().splitlines())} == set("13456")
    r.maxPages, r.output.path = 5, f"{tmp_path}/few.jsonl"  # what is read twice counts twice here
    assert titles(recipes.run(spark, r)) == ["3", "1", "4"]
    r.seedUrls, r.maxPages, r.output.path = [f"{site.base}/9"], 100, f"{tmp_path}/more.jsonl"
    (tmp_path / "seeds.txt").write_text(f"# more\n{site.base}/8\n{site.base}/7\n")
    r.seedUrlsFile, r.seedRequest = str(tmp_path / "seeds.txt"), recipes.SeedRequest(f"{site.base}/10", "GET")
    assert titles(recipes.run(spark, r)) == ["9", "3", "1", "4", "5", "6", "8", "7", "10"]
    r.sitemapUrl, r.seedUrls, r.seedUrlsFile, r.seedRequest, r.output.path = f"{site.base}/none.xml", [], None, None, f"{tmp_path}/none.jsonl"
    assert titles(recipes.run(spark, r)) == []


def test_sitemap_columns_need_no_python(spark):
    plan = readers.sitemap_urls(spark.createDataFrame([(1, "<a/>")], "id int, xml string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_cache_comes_before_robots_and_an_origin_is_asked_once(spark, site, tmp_path):
    links = "".join(f"<a href='/{x}'>x</a>" for x in ("open", "shut/1", "shut/cached"))
    site.pages |= {"/robots.txt": (200, "User-agent: *\nDisallow: /shut"), "/start": (200, f"<h1>start</h1>{links}"), "/open": (200, "<h1>open</h1><a href='/more'>x</a>"), "/more": (200, "<h1>more</h1>"), "/shut/1": (200, "<h1>no</h1>")}
    cache = spark.createDataFrame([(f"{site.base}/shut/cached", "<h1>kept</h1>")], "u string, html string").select(cache_name("u").alias("name"), "html")
    http = HttpFetcher(HttpOptions(delay_ms=0))
    plan = Plan({"title": FieldSpec("h1")}, CachedFetcher(cache, http), link_selector="a", max_depth=3, robots=robots_by(http))
    got = crawl(spark, ask(spark, f"{site.base}/start", f"{site.other}/start"), plan)
    pages = {r["url"]: (r["status"], r["error"]) for r in got.pages.collect()}
    assert pages[f"{site.base}/shut/cached"] == (200, None) and pages[f"{site.base}/shut/1"] == (0, "disallowed by robots.txt")
    assert pages[f"{site.other}/shut/cached"] == (0, "disallowed by robots.txt") and pages[f"{site.other}/more"] == (200, None)
    asked = [(p, h) for p, h, *_ in site.seen]
    assert sorted(h.split(":")[0] for p, h in asked if p == "/robots.txt") == ["127.0.0.1", "localhost"]
    assert not any(p.startswith("/shut") for p, _ in asked) and len(asked) == len(set(asked))


def test_a_missing_robots_file_is_asked_for_once_and_allows_all(spark, site):
    site.pages |= {"/a": (200, "<h1>a</h1><a href='/b'>x</a>"), "/b": (200, "<h1>b</h1><a href='/c'>x</a>"), "/c": (500, "<h1>c</h1>")}
    http = HttpFetcher(HttpOptions(delay_ms=0, max_retries=0))
    got = crawl(spark, ask(spark, f"{site.base}/a"), Plan({"title": FieldSpec("h1")}, http, link_selector="a", max_depth=5, robots=robots_by(http)))
    assert [(r["status"], r["error"]) for r in got.pages.orderBy("depth").collect()] == [(200, None), (200, None), (500, "HTTP 500")]
    assert [p for p, *_ in site.seen] == ["/robots.txt", "/a", "/b", "/c"]


def test_a_session_stays_with_its_host(spark, site):
    site.pages |= {p: (200, "<h1>x</h1>") for p in ("/1", "/set2", "/3")}
    http = HttpFetcher(HttpOptions(delay_ms=0, concurrency=1))
    assert http.login(f"{site.base}/login", {"user": "x"})
    http.fetch(ask(spark, f"{site.base}/1", f"{site.other}/1", f"{site.base}/set2", f"{site.base}/3")).collect()
    sent = {(p, h.split(":")[0]): c for p, h, c, _ in site.seen}
    assert sent == {("/1", "127.0.0.1"): "session=7", ("/1", "localhost"): None, ("/set2", "127.0.0.1"): "session=7", ("/3", "127.0.0.1"): sent["/3", "127.0.0.1"]}
    assert sorted(sent["/3", "127.0.0.1"].split("; ")) == ["seen=set2", "session=7"]


def test_cookies_and_delays_go_on_from_level_to_level(spark, site):
    site.pages |= {"/set1": (200, "<h1>1</h1><a href='/2'>x</a>"), "/2": (200, "<h1>2</h1><a href='/3'>x</a>"), "/3": (200, "<h1>3</h1>")}
    http = HttpFetcher(HttpOptions(delay_ms=4000))
    plan = Plan({"title": FieldSpec("h1")}, http, link_selector="a", max_depth=2, robots=spark.createDataFrame([], "origin string, content string"))
    crawl(spark, ask(spark, f"{site.base}/set1"), plan)
    at = [t for *_, t in site.seen]
    assert [c for _, _, c, _ in site.seen] == [None, "seen=set1", "seen=set1"] and min(b - a for a, b in zip(at, at[1:], strict=False)) > 3.5


def test_every_attempt_stretches_the_delay(spark, site):
    site.pages |= {"/busy": ([503, 503, 200], "<h1>x</h1>"), "/gone": (404, "<h1>sorry</h1>"), "/bad": (500, "<h1>bad</h1>")}
    http = HttpFetcher(HttpOptions(delay_ms=0, adaptive=True, retry_base_ms=1, max_retries=2, concurrency=1))
    got = {r["url"].rpartition("/")[2]: r for r in http.fetch(ask(spark, f"{site.base}/busy", f"{site.other}/gone", f"{site.other}/bad")).collect()}
    assert got["busy"]["trace"]["multiplier"] == pytest.approx(4 * 0.85) and got["gone"]["trace"]["multiplier"] is None and got["bad"]["trace"]["multiplier"] == 8.0
    assert (got["gone"]["status"], got["gone"]["html"], got["gone"]["error"]) == (404, "<h1>sorry</h1>", "HTTP 404") and got["bad"]["html"] == "<h1>bad</h1>"
    hosts = hosts_after(None, http.fetch(ask(spark, f"{site.base}/busy", f"{site.other}/bad")))
    again = {r["trace"]["host"]: r["trace"]["multiplier"] for r in http.fetch(with_hosts(ask(spark, f"{site.base}/busy", f"{site.other}/gone"), hosts)).collect()}
    assert again == {"127.0.0.1": 1.0, "localhost": 8.0}


def test_what_is_known_of_a_host_is_the_latest(spark):
    rows = [("a", 1.0, 2.0, "x"), ("a", 3.0, None, None), ("b", 5.0, None, None), ("a", 2.0, 4.0, None)]
    pages = spark.createDataFrame([(r,) for r in rows] + [(None,)], f"trace {fetch.TRACE}")
    before = spark.createDataFrame([("b", 9.0, 1.5, "y"), ("c", 1.0, None, None)], "host string, started double, multiplier double, cookies string")
    assert sorted(map(tuple, hosts_after(before, pages).collect())) == [("a", 3.0, 4.0, "x"), ("b", 9.0, 1.5, "y"), ("c", 1.0, None, None)]


class Shaky:
    tries = 0

    def render(self, url):
        Shaky.tries += 1
        if Shaky.tries % 3:
            raise RuntimeError(f"try {Shaky.tries}")
        return f"<h1>{Shaky.tries}</h1>"


def test_a_renderer_is_tried_again_and_stretches_nothing(spark):
    one = HttpFetcher(HttpOptions(delay_ms=0, adaptive=True, retry_base_ms=1, max_retries=2), Shaky).fetch(ask(spark, "http://a.example/1")).first()
    assert (one["status"], one["html"], one["trace"]["multiplier"]) == (200, "<h1>3</h1>", None)
    Shaky.tries = 0
    two = HttpFetcher(HttpOptions(delay_ms=0, retry_base_ms=1, max_retries=1), Shaky).fetch(ask(spark, "http://a.example/1")).first()
    assert (two["status"], two["success"], two["error"]) == (0, False, "try 2")


@pytest.mark.parametrize(("limit", "most"), [(None, 4), (2, 2), (1, 1)])
def test_requests_on_their_way_to_a_host(spark, site, limit, most):
    site.pages |= {f"/slow{i}": (200, "x") for i in range(8)}
    got = HttpFetcher(HttpOptions(delay_ms=0, concurrency=4, per_host=limit)).fetch(ask(spark, *(f"{site.base}/slow{i}" for i in range(8)))).collect()
    assert [r["status"] for r in got] == [200] * 8 and site.most == most


def test_requests_on_their_way_in_all(spark, site):
    site.pages |= {f"/slow{i}": (200, "x") for i in range(6)}
    assert [HttpOptions(concurrency=c).shape() for c in (1, 4, 8, 20, 64)] == [(1, 1), (1, 4), (1, 8), (2, 8), (8, 8)]
    HttpFetcher(HttpOptions(delay_ms=0, concurrency=3, threads=1)).fetch(ask(spark, *(f"{h}/slow{i}" for h in (site.base, site.other) for i in range(6)))).collect()
    assert len(site.seen) == 12 and site.most <= 3


def test_a_recipe_sets_gates_delays_and_quotes_proxies(spark, tmp_path):
    r = recipe(tmp_path, seedUrls=["http://a.example/"], maxConcurrency=6, maxConcurrencyPerHost=2, delayMilliseconds=60_000, proxyPool=["http://p.example:1"], proxyUsername="a@b", proxyPassword="c:d/e")
    o = recipes.fetcher_of(spark, r).options
    assert (o.concurrency, o.per_host, o.delay_ms, o.proxies) == (6, 2, 60_000, ["http://a%40b:c%3Ad%2Fe@p.example:1"])


def test_a_broken_cache_is_no_empty_cache(spark, tmp_path):
    (tmp_path / "c").mkdir()
    assert fetch.cache_at(spark, f"{tmp_path}/none") is None and fetch.cache_at(spark, f"{tmp_path}/c") is None
    (tmp_path / "c" / "part-0.parquet").write_text("no table")
    with pytest.raises(Exception, match="(?i)parquet"):
        recipes.fetcher_of(spark, recipe(tmp_path, seedUrls=["http://a.example/"], cacheDirectory=f"{tmp_path}/c"))


def test_a_folder_as_output_is_written_by_the_executors(spark, site, tmp_path):
    site.pages |= {"/1": (200, "<h1>one</h1>"), "/2": (200, "<h1>two, 2</h1>")}
    for kind in ("json", "csv"):
        out = f"file://{tmp_path}/{kind}/"
        recipes.run(spark, recipe(tmp_path, seedUrls=[f"{site.base}/1", f"{site.base}/2"], respectRobotsTxt=False, output={"path": out, "format": kind}))
        got = spark.read.json(out) if kind == "json" else spark.read.csv(out, header=True)
        assert sorted(r["title"] for r in got.collect()) == ["one", "two, 2"]
