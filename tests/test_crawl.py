import json
import os
import pathlib
import pickle
import sqlite3
import tempfile
import time
import uuid

import pytest

from quarry import cli
from quarry.operators import crawl, heal
from quarry.plans import recipe as recipes
from quarry.plans.spec import FieldSpec
from quarry.plans.spider import Spider
from quarry.sources import readers, sinks
from quarry.sources.fetch import CachedFetcher, HttpFetcher, HttpOptions, TableFetcher, wait_s

LINKS = {0: [1, 2], 1: [3, 0], 2: [3, 4], 3: [5], 4: [], 5: [0]}


@pytest.fixture
def site(spark):
    page = lambda n, to: f"<h1 class=t>page {n}</h1><i>{n % 2}</i>" + "".join(f"<a href='/{x}?utm_source=y'>x</a>" for x in to)
    return spark.createDataFrame([(f"http://s.example/{n}?utm_source=y" if n else "http://s.example/0", page(n, to)) for n, to in LINKS.items()], "url string, html string")


def spider(spark, site):
    return Spider(spark).seed("http://s.example/0").fetch_from(site).select(title="h1", parity=FieldSpec("i"))


def test_breadth_first(spark, site, tmp_path):
    seen = []
    out = sinks.OneFile(str(tmp_path / "o.jsonl"))
    r = spider(spark, site).follow("a", 2).on_progress(seen.append).to(out).run()
    assert sorted((x["depth"], x["title"]) for x in r.items.collect()) == [(0, "page 0"), (1, "page 1"), (1, "page 2"), (2, "page 3"), (2, "page 4")]
    assert r.summary().first().asDict() == {"pages_fetched": 5, "pages_failed": 0, "items_extracted": 5}
    assert [p["pages_fetched"] for p in seen] == [1, 3, 5] and [p["last_url"][-1] for p in seen][:1] == ["0"] and seen[1]["last_url"] == "http://s.example/2?utm_source=y"
    assert len((tmp_path / "o.jsonl").read_text().splitlines()) == 5
    assert {f["field"] for f in r.field_coverage().collect()} == {"title", "parity"}


def test_limits_and_failures(spark, site):
    r = spider(spark, site).seed("http://s.example/none").follow("a", 5).limit(3).run()
    assert r.pages.count() == 3 and r.pages.where("not success").count() == 1
    assert spider(spark, site).limit(0).run().items.count() == 0


def test_robots_and_dedup(spark, site):
    robots = spark.createDataFrame([("http://s.example", "User-agent: *\nDisallow: /2")], "origin string, content string")
    r = spider(spark, site).follow("a", 2).respect(robots).deduplicate("parity").run()
    assert sorted(x["title"] for x in r.items.collect()) == ["page 0", "page 1"]
    assert r.pages.where("error like 'disallowed%'").count() == 1


def test_a_crawl_keeps_the_crawl_delay_of_robots(spark):
    class Clock:
        def render(self, url):
            import time

            return f"<h1>{time.time()}</h1>"

    robots = spark.createDataFrame([("http://d.example", "User-agent: *\nCrawl-delay: 0.8")], "origin string, content string")
    plan = crawl.Plan({"at": FieldSpec("h1")}, HttpFetcher(HttpOptions(delay_ms=50), Clock), robots=robots)
    seeds = readers.seeds(spark, [f"http://{h}.example/{i}" for h in "de" for i in range(3)])
    at = {h: sorted(float(r["at"]) for r in crawl.crawl(spark, seeds, plan).items.collect() if f"//{h}." in r["url"]) for h in "de"}
    assert [len(x) for x in at.values()] == [3, 3] and at["d"][2] - at["d"][0] >= 1.59 and 0.09 <= at["e"][2] - at["e"][0] < 1.5
    assert (wait_s(60_000, None), wait_s(500, 45.0), wait_s(500, 0.1)) == (60.0, 45.0, 0.5)  # only the adaptive delay has a limit
    assert (wait_s(60_000, None, 1.0), wait_s(500, None, 3.4), wait_s(500, 45.0, 16.0)) == (30.0, 1.7, 45.0)


def test_custom_links(spark, site):
    r = spider(spark, site).follow_with(lambda url, html: ["/4?utm_source=y"], 1).run()
    assert sorted(x["title"] for x in r.items.collect()) == ["page 0", "page 4"]


def test_a_stopped_crawl_goes_on(spark, site, tmp_path):
    path = f"file://{tmp_path}/state"

    def stop(p):
        if p["level"] == 1:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        spider(spark, site).follow("a", 3).checkpoint(path).on_progress(stop).run()
    seen = []
    r = spider(spark, site).follow("a", 3).checkpoint(path).on_progress(seen.append).run()
    assert [(p["level"], p["pages_fetched"]) for p in seen] == [(2, 5), (3, 6)]
    assert r.pages.count() == 6 and r.items.count() == 6
    seen.clear()
    spider(spark, site).follow("a", 0).checkpoint(path).on_progress(seen.append).run()
    assert [p["level"] for p in seen] == [0]


def test_cache(spark, site):
    from pyspark.sql import functions as F

    from quarry.functions.urls import cache_name

    cache = spark.createDataFrame([("http://s.example/0", "<h1>cached</h1>")], "u string, html string").select(cache_name(F.col("u")).alias("name"), "html")
    f = CachedFetcher(cache, TableFetcher(site))
    got = f.fetch(readers.seeds(spark, ["http://s.example/0", "http://s.example/1?utm_source=y"], [("http://s.example/0", "POST", {"a": "b"})]))
    assert sorted((r["seq"], "cached" in r["html"]) for r in got.collect()) == [(0, True), (1, False), (2, False)]
    assert f.missed.count() == 2


def test_every_fetched_get_page_reaches_the_cache(spark, site, tmp_path):
    robots = spark.createDataFrame([("http://s.example/robots.txt", "User-agent: *")], site.schema)
    recipe = recipes.parse(json.dumps({
        "seedUrls": ["http://s.example/0"], "seedRequest": {"url": "http://s.example/4?utm_source=y", "method": "POST"}, "fields": {"title": {"selector": "h1"}}, "linkSelector": "a", "maxDepth": 2,
        "cacheDirectory": f"{tmp_path}/cache", "output": {"format": "json", "path": f"{tmp_path}/o.jsonl"},
    }))
    for _ in range(2):
        empty = spark.createDataFrame([], "name string, html string")
        recipes.run(spark, recipe, CachedFetcher(empty, TableFetcher(site.union(robots))))
        got = spark.read.parquet(f"{tmp_path}/cache").collect()
        assert sorted(r["html"][:18] for r in got) == ["<h1 class=t>page 0", "<h1 class=t>page 1", "<h1 class=t>page 2", "<h1 class=t>page 3"]
        assert len({r["name"] for r in got}) == 4  # robots files are no pages


class Answers:
    """A provider that notes, in files of a folder, what it is asked wherever that happens."""

    def __init__(self, answer):
        self.answer, self.folder = answer, tempfile.mkdtemp()

    def suggest(self, request):
        with open(f"{self.folder}/{time.time_ns()}-{uuid.uuid4().hex}", "wb") as f:
            pickle.dump((os.getpid(), request), f)
        if isinstance(self.answer, Exception):
            raise self.answer
        return self.answer

    @property
    def calls(self):
        return [pickle.loads((pathlib.Path(self.folder) / n).read_bytes()) for n in sorted(os.listdir(self.folder))]

    @property
    def asked(self):
        return [r for _, r in self.calls]


def test_repair(spark, site, tmp_path):
    path = str(tmp_path / "h.json")
    cache, fields = heal.HealingCache(path), {"title": FieldSpec("h2.gone"), "parity": FieldSpec("i")}
    provider = Answers("h1.t")
    got = heal.heal(site, fields, None, cache, provider)
    assert got.count() == 6 and all(r["items"][0]["f0"].startswith("page") for r in got.collect())
    assert len(provider.asked) == 1 and heal.HealingCache(path).get("S.example", "title") == "h1.t"
    again = Answers("x")
    heal.heal(site, fields, None, heal.HealingCache(path), again).count()
    assert again.asked == []
    wrong = heal.HealingCache()
    assert heal.heal(site, fields, None, wrong, Answers("h5")).where("items[0].f0 is null").count() == 6 and wrong.known == {}
    box = heal.heal(site, {"t": FieldSpec("a")}, ".gone", heal.HealingCache(), Answers("h1"))
    assert box.where("size(items) = 1").count() == 6


def test_healing_can_be_switched_off(spark, site):
    provider = Answers("h1")
    got = heal.heal(site, {"t": FieldSpec("h2")}, None, heal.HealingCache(), provider, enabled=False)
    assert got.where("items[0].f0 is null").count() == 6 and provider.asked == []


def test_every_broken_pair_is_asked_for(spark):
    rows = [(f"http://h{i:03}.example/a", f"<h1>{i}</h1>") for i in range(230)]
    cache, provider = heal.HealingCache(), Answers("h1")
    got = heal.heal(spark.createDataFrame(rows, "url string, html string"), {"t": FieldSpec("h2")}, None, cache, provider).collect()
    assert len(provider.asked) == len(cache.known) == 230 and all(r["items"][0]["f0"] for r in got)
    assert os.getpid() not in {pid for pid, _ in provider.calls}  # executors ask, and no page reaches the driver


def test_the_pages_of_a_pair_are_shown_until_one_answer_is_good(spark):
    rows = [(f"http://h{i % 2}.example/{i:03}", f"<i class=c{i}>{i}</i>") for i in range(100)]
    class Last(Answers):
        def suggest(self, request):
            Answers.suggest(self, request)
            return "i.c98" if "h0" in request.page_url else "["

    cache, provider = heal.HealingCache(), Last(None)
    got = heal.heal(spark.createDataFrame(rows, "url string, html string").repartition(7), {"t": FieldSpec("b")}, None, cache, provider)
    assert cache.known == {"h0.example": {"t": "i.c98"}} and [r["url"][-3:] for r in got.where("items[0].f0 is not null").collect()] == ["098"]
    assert sorted(r.page_url for r in provider.asked) == sorted(u for u, _ in rows)


def test_other_pages_of_a_pair_are_asked_for(spark):
    class Last(Answers):
        def suggest(self, request):
            Answers.suggest(self, request)
            return "i.x" if request.page_url.endswith("/4") else "b.none"

    rows = [(f"http://h.example/{i}", None if i == 0 else f"<ul><li class=x><i class=x>{i}</i></li></ul>") for i in range(8)]
    pages, provider = spark.createDataFrame(rows, "url string, html string"), Last(None)
    got = {r["url"][-1]: r["items"][0]["f0"] for r in heal.heal(pages, {"t": FieldSpec("b")}, None, heal.HealingCache(), provider).collect() if r["items"]}
    assert got == {str(i): str(i) for i in range(1, 8)} and [r.page_url[-1] for r in provider.asked] == ["1", "2", "3", "4"]
    both = heal.HealingCache()
    both.set("h.example", "t", "i.x")
    box = heal.heal(pages, {"t": FieldSpec("b")}, "p", both, Answers("li.x")).where("get(items, 0).f0 is not null")
    assert box.count() == 7


def test_providers(spark):
    q = heal.HealingRequest("<b>" * 9000, "f", "i", "http://x.example", "what")
    assert heal.Chain([Answers(ValueError()), Answers(None), Answers(".a")]).suggest(q) == ".a"
    assert heal.Chain([Answers(None)]).suggest(q) is None
    with pytest.raises(ValueError):
        heal.Chain([])
    assert len(heal.prompt(q)) < 6200 and "what" in heal.prompt(q)
    replies = {'{"selector":".f"}': ".f", '```json\n{"selector": ".g"}\n```': ".g", '{"selector":null}': None, 'maybe "selector": ".h" or so': ".h", "": None, "[]": None}
    assert {k: heal.parse_reply(k) for k in replies} == replies
    df = spark.createDataFrame([(k,) for k in replies], "r string")
    from pyspark.sql import functions as F

    assert {r[0]: r[1] for r in df.select("r", heal.reply_column(F.col("r"))).collect()} == replies
    assert heal.build_provider("none") is None and heal.build_provider("groq,gemini") is None
    assert isinstance(heal.build_provider("groq, ollama", "k"), heal.Chain)
    g = heal.build_provider("gemini", "k")
    assert "contents" in g.payload(q) and g.answer({"candidates": [{"content": {"parts": [{"text": '{"selector":"x"}'}]}}]}) == "x"
    assert heal.build_provider("openai-compatible", "k", base_url="http://h/v1/").url == "http://h/v1/chat/completions"
    assert heal.build_provider("ollama").answer({"message": {"content": '{"selector":"y"}'}}) == "y" and heal.build_provider("ollama").answer({}) is None


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([("Kettle, small", "7.25"), ('a "q"', None)], "Product string, Cost string")
    p = str(tmp_path / "o.csv")
    sinks.OneFile(p, "csv").write(items)
    sinks.OneFile(p, "csv", append=True).write(items.limit(1))
    assert open(p).read() == 'Product,Cost\n"Kettle, small",7.25\n"a ""q""",\n"Kettle, small",7.25\n'
    sinks.OneFile(str(tmp_path / "o.jsonl")).write(items)
    assert [json.loads(x)["Cost"] for x in open(tmp_path / "o.jsonl")] == ["7.25", None]
    sinks.fan_out(items, [sinks.JsonLines(str(tmp_path / "j")), sinks.Csv(str(tmp_path / "c")), sinks.Sqlite(str(tmp_path / "d.sqlite")), sinks.Sqlite(str(tmp_path / "d.sqlite"))])
    assert '"Cost":null' in "".join(r[0] for r in spark.read.text(str(tmp_path / "j")).collect())
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "c")).distinct().collect()) == ['"Kettle, small",7.25', '"a ""q""",', "Product,Cost"]
    with sqlite3.connect(tmp_path / "d.sqlite") as db:
        assert sorted(db.execute("select * from item")) == sorted([("Kettle, small", "7.25"), ('a "q"', "")] * 2)
    assert set(sinks.webhook_payload("r", {"pages_fetched": 1, "pages_failed": 0, "items_extracted": 2})) == {"recipe", "pagesFetched", "pagesFailed", "itemsExtracted", "finishedAtUtc"}
    assert sinks.notify("http://127.0.0.1:9/", {}, 1) is False


def test_sitemaps_and_seed_files(spark, tmp_path):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    rows = [
        (1, f"<urlset {ns}><url><loc> http://x.example/a </loc></url><url><loc>/rel</loc></url><url><loc>http://x.example/b</loc></url></urlset>"),
        (2, "plain words, no markup"), (3, None), (5, "<urlset><url><loc>http://x.example/d</loc></url></urlset> more"), (6, "<urlset><url><loc>http://x.example/d</loc>"), (7, "<a/><b/>"), (8, "&x;"), (9, ""),
        (10, f"<?xml version='1.0'?><!-- c --><!DOCTYPE urlset [<!ENTITY e 'x'>]>\n<urlset {ns}><url><loc><![CDATA[http://x.example/e]]></loc><i:image xmlns:i='urn:i'><i:loc>http://x.example/no</i:loc></i:image></url><g><url><loc>http://x.example/f&amp;g</loc><loc> </loc></url></g></urlset>"),
        (11, "<urlset><url><loc>http://x.example/&e;</loc></url></urlset>"), (12, "</q7w1-all><q7w1-all>"), (13, "<urlset><url><loc>http://x.example/\x01</loc></url></urlset>"), (4, '<s:urlset xmlns:s="urn:x"><s:url><s:loc>http://x.example/c</s:loc></s:url></s:urlset>'),
    ]
    df = spark.createDataFrame(rows, "id int, xml string")
    assert [(r["id"], r["loc"]) for r in readers.sitemap_urls(df).orderBy("id", "pos").collect()] == [(1, "http://x.example/a"), (1, "http://x.example/b"), (4, "http://x.example/c"), (10, "http://x.example/e"), (10, "http://x.example/f&g")]
    assert readers.sitemap_urls(df, cap=1).count() == 3
    (tmp_path / "s.txt").write_text("# c\n\n https://a.example \nwords, no address\nhttps://b.example/x\n")
    assert sorted(r[0] for r in readers.seed_file(spark, str(tmp_path / "s.txt")).collect()) == ["https://a.example", "https://b.example/x"]


def test_recipes(spark, site, tmp_path, capsys):
    out = tmp_path / "out.jsonl"
    text = json.dumps({"SeedUrls": ["http://s.example/0"], "Fields": {"title": {"Selector": "h1", "transforms": ["Uppercase"]}}, "linkSelector": "a", "maxDepth": 1, "respectRobotsTxt": False, "deduplicateBy": "*", "output": {"path": str(out)}})
    (tmp_path / "r.json").write_text(text)
    site.write.parquet(str(tmp_path / "pages"))
    assert cli.main(["validate", str(tmp_path / "r.json")]) == 0
    assert cli.main(["run", str(tmp_path / "r.json"), "--pages", str(tmp_path / "pages")]) == 0
    assert sorted(json.loads(x)["title"] for x in out.read_text().splitlines()) == ["PAGE 0", "PAGE 1", "PAGE 2"]
    assert cli.main(["watch", str(tmp_path / "r.json"), "--pages", str(tmp_path / "pages"), "--key", "title", "--max-runs", "1", "--interval", "0"]) == 0
    assert "unchanged: 3" in capsys.readouterr().out
    assert cli.main(["stats", str(out)]) == 0 and "title: 100%" in capsys.readouterr().out
    assert cli.main(["stats", str(tmp_path / "none")]) == 1
    (tmp_path / "p.html").write_text("<h1 id=a>x</h1>")
    assert cli.main(["test-selector", str(tmp_path / "p.html"), "h1", "--attribute", "id"]) == 0
    assert cli.main(["test-selector", str(tmp_path / "p.html"), "//h2", "--xpath"]) == 1
    assert cli.main(["init", str(tmp_path / "new")]) == 0 and cli.main(["validate", str(tmp_path / "new.json")]) == 0
    assert cli.main(["validate", str(tmp_path / "none.json")]) == 1 and cli.main(["version"]) == 0


def test_recipe_rules(monkeypatch):
    r = recipes.parse('{"seedUrls":["/x"],"fields":{"a":{"selector":""},"b":{"selector":"x","regex":"y","attribute":"z"},"c":{"selector":"","mainContent":true}},"output":{"format":"CSV"}}')
    assert [s for s, _ in recipes.validate(r)] == ["error", "error", "warning"]
    assert r.specs()["b"].attribute == "y" and r.specs()["b"].kind.value == "regex"
    assert recipes.validate(None)[0][0] == "error" and recipes.parse("null") is None
    with pytest.raises(recipes.RecipeError):
        recipes.parse('{"fields":{"a":{}}}')
    monkeypatch.setenv("SECRET_X", "s")
    assert [heal.resolve_secret(x) for x in ("env:SECRET_X", "env:NONE_X", "k", None)] == ["s", None, "k", None]


def test_links_that_are_many_are_read_once(spark, site, monkeypatch):
    rows = [(s, [f"http://s.example/{(s * k) % 97}" for k in range(1, 6)] + ["http://s.example/A?ref=x#t"]) for s in range(40)]
    pages = spark.createDataFrame(rows, "seq long, links array<string>")
    visited = spark.createDataFrame([(f"http://s.example/{k}", k % crawl.PARTS) for k in range(0, 97, 2)], "key string, part int")
    visited = visited.selectExpr("key", f"cast(pmod(xxhash64(key), {crawl.PARTS}) as int) part")
    few, many = (crawl.discovered(pages, visited, True, 1, few) for few in (True, False))
    assert [(r["url"], r["key"], r["part"]) for r in many.orderBy("seq").collect()] == [(r["url"], r["key"], r["part"]) for r in few.orderBy("seq").collect()]
    assert str(many._jdf.queryExecution().optimizedPlan()).count("Generate ") == 1
    asked, own = [], crawl.discovered
    monkeypatch.setattr(crawl, "discovered", lambda *a: asked.append(a[-1]) or own(*a))
    r = spider(spark, site).follow("a", 5).run()
    assert sorted(x["url"][-1] for x in r.pages.selectExpr("split(url, '[?]')[0] url").collect()) == list("012345")
    assert asked == [False, False, True, True]  # 2 links beside 1 visited page, 4 beside 3, 1 beside 5, 1 beside 6
