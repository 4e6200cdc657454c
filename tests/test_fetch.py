"""Fetchers: the archive's plan, and live HTTP against a server of this machine."""

import re
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quarry.functions.dom import parse
from quarry.operators import heal
from quarry.plans import recipe
from quarry.plans.spec import FieldSpec
from quarry.sources.fetch import HttpFetcher, HttpOptions, TableFetcher, stored_archive

REQUEST = "url string, depth int, method string, form map<string,string>, seq long, crawl_delay double"


class Site(BaseHTTPRequestHandler):
    seen: list = []

    def answer(self, status, body="", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(body.encode())))
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        Site.seen.append((self.path, self.headers["User-Agent"], self.headers["Cookie"], time.time()))
        times = sum(p == self.path for p, *_ in Site.seen)
        if self.path == "/moved":
            self.answer(302, Location="/home")
        elif self.path == "/busy" and times < 3:
            self.answer(503, "busy")
        elif self.path == "/later" and times < 2:
            self.answer(429, "later", Retry_After="1")
        elif self.path == "/gone":
            self.answer(404, "gone")
        else:
            self.answer(200, f"<h1>{self.path}</h1>")

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        self.answer(200, f"<p>{body}</p>", Set_Cookie="session=7; Path=/")

    def log_message(self, *args):
        pass


@pytest.fixture
def base():
    Site.seen = []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def ask(spark, base, *paths, delay=None):
    return spark.createDataFrame([(base + p, 0, "GET", None, i, delay) for i, p in enumerate(paths)], REQUEST)


def test_live_fetching(spark, base):
    fetcher = HttpFetcher(HttpOptions(delay_ms=0, retry_base_ms=10, user_agents=["a", "b"], concurrency=1))
    assert fetcher.login(base + "/login", {"user": "x"})
    got = {r["url"].removeprefix(base): r for r in fetcher.fetch(ask(spark, base, "/home", "/moved", "/busy", "/later", "/gone")).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"/home": 200, "/moved": 200, "/busy": 200, "/later": 200, "/gone": 404}
    assert got["/moved"]["html"] == "<h1>/home</h1>" and not got["/gone"]["success"] and got["/later"]["elapsed_ms"] >= 1000
    assert {c for _, _, c, _ in Site.seen} == {"session=7"} and {u for p, u, *_ in Site.seen if p == "/busy"} == {"a", "b"}
    assert sum(p == "/gone" for p, *_ in Site.seen) == 1
    form = spark.createDataFrame([(base + "/form", 0, "POST", {"q": "1 2"}, 0, None)], REQUEST)
    assert fetcher.fetch(form).first()["html"] == "<p>q=1+2</p>"
    stays = HttpFetcher(HttpOptions(delay_ms=0, follow_redirects=False, max_retries=0))
    assert stays.fetch(ask(spark, base, "/moved")).first()["status"] == 302


def test_the_longer_delay_is_kept(spark, base):
    got = HttpFetcher(HttpOptions(delay_ms=50)).fetch(ask(spark, base, "/1", "/2", "/3", delay=0.4)).collect()
    at = sorted(r["trace"]["started"] for r in got)  # the starts that the delay lies between; arrivals at the server vary
    assert len(Site.seen) == 3 and all(b - a >= 0.4 - 1e-6 for a, b in zip(at[:-1], at[1:], strict=True))


def test_nobody_there(spark):
    got = HttpFetcher(HttpOptions(delay_ms=0, max_retries=1, retry_base_ms=1)).fetch(ask(spark, "http://127.0.0.1:9", "/")).first()
    assert (got["status"], got["success"], got["html"]) == (0, False, None) and got["error"]


class Browser:
    def render(self, url):
        return f"<h1>seen {url[-1]}</h1>"

    def screenshot(self, url):
        return b"png of " + url.encode()


def test_rendering_and_pictures(spark, tmp_path):
    options = HttpOptions(delay_ms=0, screenshots=str(tmp_path / "shots"))
    got = HttpFetcher(options, Browser).fetch(ask(spark, "http://a.example", "/1", "/2")).collect()
    assert sorted(r["html"] for r in got) == ["<h1>seen 1</h1>", "<h1>seen 2</h1>"]
    assert sorted(p.read_bytes() for p in (tmp_path / "shots").glob("*.png")) == [b"png of http://a.example/1", b"png of http://a.example/2"]
    wanted = recipe.parse('{"seedUrls": ["http://a.example/1"], "useBrowserRendering": true, "fields": {"t": {"selector": "h1"}}}')
    with pytest.raises(recipe.RecipeError):
        recipe.fetcher_of(spark, wanted)
    assert recipe.fetcher_of(spark, wanted, Browser).renderer is Browser


def test_an_archive_is_scanned_and_not_shuffled(spark, tmp_path):
    spark.range(2000).select(F.concat(F.lit("http://a.example/"), "id").alias("url"), F.concat(F.lit("<p>"), "id").alias("html")).union(spark.createDataFrame([("http://a.example/7", "<p>0")], "url string, html string")).write.parquet(f"file://{tmp_path}/archive")
    spark.createDataFrame([("http://a.example/7", 0, "GET", None, 0), ("http://a.example/9", 0, "GET", None, 1), ("http://a.example/x", 0, "GET", None, 2)], REQUEST.removesuffix(", crawl_delay double")).write.parquet(f"file://{tmp_path}/requests")
    pages = TableFetcher(spark.read.parquet(f"file://{tmp_path}/archive")).fetch(spark.read.parquet(f"file://{tmp_path}/requests"))
    assert [(r["url"][-1], r["status"], r["html"]) for r in pages.orderBy("seq").collect()] == [("7", 200, "<p>0"), ("9", 200, "<p>9"), ("x", 0, None)]
    text = pages._jdf.queryExecution().executedPlan().toString()
    above = text[: text.index("archive")].splitlines()
    scan = next(i for i in range(len(above) - 1, -1, -1) if "FileScan" in above[i])
    join = next(i for i in range(scan, -1, -1) if "BroadcastHashJoin" in above[i])
    assert not any(re.search("Exchange", x) and not re.search("BroadcastExchange", x) for x in above[join:scan])


def test_a_provider_sees_the_item_that_lacks_a_field(spark, tmp_path):
    seen = tmp_path / "seen"

    class Looks:
        def suggest(self, request):
            with open(seen, "a") as f:
                f.write(request.html)
            return "em"

    html = f"<p>{'x' * 9000}</p><ul><li class=r><b>1</b></li><li class=r><em id='a&quot;'>2 &lt; 3</em></li></ul>"
    pages = spark.createDataFrame([("http://a.example/", html)], "url string, html string")
    got = heal.heal(pages, {"t": FieldSpec("b")}, "li.r", heal.HealingCache(), Looks()).first()
    assert seen.read_text() == '<li class="r"><em id="a&quot;">2 &lt; 3</em></li>' and [i["f0"] for i in got["items"]] == ["1", "2 < 3"]
    assert parse("<p>a<br>b<script>1 < 2</script>").html() == "<html><head></head><body><p>a<br>b<script>1 < 2</script></p></body></html>"


def test_replies_that_are_no_selectors(spark):
    rows = ['{"selector": 5}', '{"selector": {"a": 1}}', '{"selector": "\\t\\u2003"}', '{"selector": ["b"]}', '{"selector": true}', '{"selector": " b "}', '["selector"]', None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, raw string")
    got = [r[0] for r in df.orderBy("i").select(heal.reply_column(F.col("raw"))).collect()]
    assert got == [heal.parse_reply(x) for x in rows] == [None, None, None, None, None, " b ", None, None]


def test_none_among_providers_is_an_error():
    of = lambda p: [m for s, m in recipe.validate(recipe.parse('{"seedUrls": ["http://a.example/"], "healing": {"provider": "%s"}}' % p)) if s == "error"]
    assert of("none") == [] and of("ollama, none") == ["healing: unknown provider none"]


def test_a_stored_archive_keeps_its_place_in_joins_of_shuffles(spark, tmp_path):
    pages = spark.range(2000).select(F.concat(F.lit("http://a.example/"), F.col("id") % 1500).alias("url"), F.concat(F.lit("<p>"), "id").alias("html"))
    archive = stored_archive(pages, "kept_archive", 4, f"file://{tmp_path}/archive")
    spark.createDataFrame([(f"http://a.example/{i}", 0, "GET", None, i) for i in (7, 9, 5000, 7)], REQUEST.removesuffix(", crawl_delay double")).write.parquet(f"file://{tmp_path}/requests")
    asked = spark.read.parquet(f"file://{tmp_path}/requests")
    want = [(7, 200, "<p>1507"), (7, 200, "<p>1507"), (9, 200, "<p>1509"), (5000, 0, None)]
    assert [(r["seq"], r["status"], r["html"]) for r in archive.fetch(asked).orderBy("seq").collect()] == want
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = archive.fetch(asked)
        assert [(r["seq"], r["status"], r["html"]) for r in got.orderBy("seq").collect()] == want
        text = got._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop table kept_archive")
    scan = next(i for i, x in enumerate(text) if "kept_archive" in x)
    join = next(i for i in range(scan, -1, -1) if "SortMergeJoin" in text[i])
    assert "Bucketed: true" in text[scan] and not any("Exchange" in x for x in text[join:scan])


def test_what_was_visited_is_scanned_and_not_shuffled(spark, tmp_path):
    from quarry.operators import crawl

    folder = crawl.Folder(spark, f"file://{tmp_path}/c")
    ask = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("http://a.example/"), "id").alias("url"), F.col("id").alias("seq"))
    for n in range(3):
        folder.put(crawl.asked(n), crawl.next_requests(ask(1000 * n, 1000 * n + 1000), folder.visited(list(range(n))), True), by="part")
    spark.createDataFrame([("http://A.example/5",  1), ("http://a.example/2500?utm_source=x", 2), ("http://a.example/7777", 3)], "url string, seq long").write.parquet(f"file://{tmp_path}/f")
    found = crawl.next_requests(spark.read.parquet(f"file://{tmp_path}/f"), folder.visited([0, 1, 2]), True)
    assert [r["url"] for r in found.collect()] == ["http://a.example/7777"]
    lines = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    joins = [i for i, x in enumerate(lines) if "LeftSemi" in x]
    for i in joins:  # the first child of the join is what the levels asked for as it is scanned
        scan = next(k for k in range(i, len(lines)) if "FileScan" in lines[k])
        assert "BroadcastHashJoin" in lines[i] and "[key#" in lines[scan] and not any("Exchange" in x for x in lines[i:scan])
    assert len(joins) == 1
