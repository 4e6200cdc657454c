"""A query for each operator over the benchmark tables, and its DuckDB SQL.

Operators on HTML, XML, robots files and snapshots that the tables don't hold
get them generated from other tables inside the query; the SQL then says what
must come out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import transforms, urls
from quarry.functions.transforms import Transform
from quarry.operators import coverage, dedup, diff, extract, heal, politeness
from quarry.operators.crawl import Folder, Plan, crawl
from quarry.plans import recipe as recipes
from quarry.plans.spec import ARTICLE, PRODUCT, FieldSpec, Kind
from quarry.sources import readers, sinks
from quarry.sources.fetch import CachedFetcher, TableFetcher, stored_archive

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Unicode white space and how the SQL spells it.
_WS = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _decoded(x: str) -> str:
    for entity, c in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{c}')"
    return x


def _tidy(x: str) -> str:
    return f"nullif(regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g'), '')"


# Extraction from the tables' own pages.


@query(
    f"""SELECT page_id, {_tidy(_decoded("regexp_extract(html, '<title>(.*?)</title>', 1, 's')"))} title,
  {_tidy(_decoded("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')"))} h1 FROM pages"""
)
def css_title_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"title": FieldSpec("head > title"), "h1": FieldSpec("article h1")}
    return extract.extract(table(spark, sf_dir, "pages"), fields).select("page_id", "title", "h1")


@query("SELECT page_id, nullif(regexp_extract(html, '<a href=\"([^\"]*)\"', 1), '') href FROM pages")
def css_attr_first_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"), {"href": FieldSpec("nav a[href]", attribute="href")}).select("page_id", "href")


@query(
    f"""WITH li AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) h, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) l FROM pages),
x AS (SELECT page_id, unnest(range(len(h))) i, h, l FROM li)
SELECT page_id, i::INT item_seq, {_tidy(_decoded("l[i + 1]"))} label, {_decoded("h[i + 1]")} href FROM x"""
)
def css_items_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"label": FieldSpec("a"), "href": FieldSpec("a", attribute="href")}
    return extract.extract(table(spark, sf_dir, "pages"), fields, "nav li").select("page_id", "item_seq", "label", "href")


@query(
    f"""SELECT page_id, nullif(regexp_extract({_decoded("regexp_extract(html, '<footer>(.*?)</footer>', 1, 's')")}, '[a-z0-9.-]+\\.example\\.[a-z]+'), '') site FROM pages"""
)
def regex_on_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"), {"site": FieldSpec("footer", Kind.REGEX, r"[a-z0-9.-]+\.example\.[a-z]+")}).select("page_id", "site")


@query(
    f"""SELECT page_id, {_tidy(_decoded("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')"))} heading,
  regexp_extract_all(html, '<li><a href="([^"]*)">', 1)[2] second_link, len(regexp_extract_all(html, '<li>'))::VARCHAR n_links FROM pages"""
)
def xpath_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"heading": FieldSpec("//article/h1[1]", Kind.XPATH), "second_link": FieldSpec("//nav//li[2]/a", Kind.XPATH, "href"), "n_links": FieldSpec("count(//nav/ul/li)", Kind.XPATH)}
    return extract.extract(table(spark, sf_dir, "pages"), fields).select("page_id", *fields)


_ARTICLE = "regexp_extract(html, '<article>(.*?)</article>', 1, 's')"


@query(
    f"""WITH a AS (SELECT page_id, regexp_replace({_ARTICLE}, '<h1>.*?</h1>', '', 's') body, {_ARTICLE} whole FROM pages),
p AS (SELECT page_id, unnest(string_split(body, '<p>')[2:]) x, generate_subscripts(string_split(body, '<p>')[2:], 1) i FROM a),
t AS (SELECT page_id, i, {_tidy(_decoded("regexp_replace(string_split(x, '</p>')[1], '<[^>]*>', '', 'g')"))} x FROM p),
j AS (SELECT page_id, string_agg(x, chr(10) || chr(10) ORDER BY i) t FROM t WHERE x IS NOT NULL GROUP BY 1)
SELECT a.page_id, CASE WHEN length({_decoded("regexp_replace(whole, '<[^>]*>', '', 'g')")}) >= 100 THEN {_tidy("regexp_replace(t, '[ \\t]+', ' ', 'g')")} END content
FROM a LEFT JOIN j USING (page_id)"""
)
def main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"), {"content": FieldSpec(kind=Kind.MAIN_CONTENT)}).select("page_id", "content")


@query(
    f"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) h, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) i FROM pages)
SELECT page_id, (i - 1)::INT pos, regexp_extract(url, '^[a-z]+://[^/]+') || {_decoded("h")} link FROM l"""
)
def links_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.spread(table(spark, sf_dir, "pages")).select("page_id", extract.links("nav a")("url", "html").alias("links"))
    return found.select("page_id", F.posexplode("links").alias("pos", "link"))


# Extraction from generated pages.


def _json(**values: Column | str) -> Column:
    """A JSON object of strings (columns) and JSON texts that are already written (str)."""
    parts = [F.concat(F.lit(f'"{k}":"'), v, F.lit('"')) if isinstance(v, Column) else F.lit(f'"{k}":{v}') for k, v in values.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _raw(x: Column) -> Column:
    return F.concat(F.lit('"price":'), x, F.lit(',"priceCurrency":"EUR"'))


def _page(*parts: Column | str) -> Column:
    return F.concat(F.lit("<!doctype html><html><head>"), *(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("</body></html>"))


@query(
    """SELECT p_partkey, p_name "Name", p_partkey::VARCHAR "Sku", NULL::VARCHAR "Description", p_brand "Brand",
  p_retailprice::DECIMAL(18,2)::VARCHAR "Price", 'EUR' "Currency", NULL::VARCHAR "Availability", NULL::VARCHAR "Image",
  CASE WHEN p_size % 2 = 0 THEN '4.50' END "RatingValue", CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END "ReviewCount" FROM part"""
)
def jsonld_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A malformed block, an array block and the product's, with numbers that must stay as written."""
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    rating = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(',"aggregateRating":{"ratingValue":4.50,"reviewCount":'), F.col("p_size").cast("string"), F.lit("}"))).otherwise("")
    product = F.concat(
        F.lit('{"@type":"Product","name":"'), F.col("p_name"), F.lit('","sku":"'), F.col("p_partkey").cast("string"), F.lit('","brand":{"name":"'), F.col("p_brand"),
        F.lit('"},"image":["a.png"],"offers":{'), _raw(price), F.lit("}"), rating, F.lit("}"),
    )
    html = _page('<script type="application/ld+json">{broken</script><script type="application/ld+json">[{"@type":"WebSite"},null]</script><script type="application/ld+json"> ', product, " </script></head><body>")
    pages = table(spark, sf_dir, "part").select("p_partkey", F.lit("http://x.example/").alias("url"), html.alias("html"))
    return extract.extract(pages, PRODUCT).select("p_partkey", *PRODUCT)


@query(
    """SELECT o_orderkey, o_orderpriority "Headline", 'Customer ' || o_custkey "Author", strftime(o_orderdate, '%Y-%m-%d') "DatePublished",
  NULL::VARCHAR "DateModified", CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END "Description", NULL::VARCHAR "Publisher" FROM orders"""
)
def jsonld_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    article = F.concat(
        F.lit('[{"headline":"'), F.col("o_orderpriority"), F.lit('","author":{"name":"Customer '), F.col("o_custkey").cast("string"), F.lit('"},"datePublished":"'),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('","description":'), (F.col("o_orderstatus") == "F").cast("string"), F.lit(',"publisher":null}]'),
    )
    html = _page('<script type="application/ld+json">', article, "</script></head><body>")
    pages = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("http://x.example/").alias("url"), html.alias("html"))
    return extract.extract(pages, ARTICLE).select("o_orderkey", *ARTICLE)


@query(
    """SELECT c_custkey, c_name og_title, c_mktsegment og_type, 2::INT n_og, 'second ' || c_custkey description, 1::INT n_meta FROM customer"""
)
def og_meta_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = _page(
        '<meta property="og:title" content="old"><meta property="og:title" content="', F.col("c_name"), '"><meta property="OG:type" content="', F.col("c_mktsegment"),
        '"><meta property="fb:x" content="1"><meta name="description" content="first"><meta name="description" content="second ', F.col("c_custkey").cast("string"), '"></head><body>',
    )
    pages = table(spark, sf_dir, "customer").select("c_custkey", F.lit("").alias("url"), html.alias("html"))
    found = extract.spread(pages).select("c_custkey", extract.open_graph()("url", "html").alias("og"), extract.meta_tags()("url", "html").alias("meta"))
    return found.select(
        "c_custkey", F.col("og")["og:title"].alias("og_title"), F.col("og")["OG:type"].alias("og_type"), F.size("og").alias("n_og"), F.col("meta")["description"].alias("description"), F.size("meta").alias("n_meta")
    )


@query("SELECT s_suppkey, s_name AS name, CASE WHEN s_suppkey % 3 <> 2 THEN s_nationkey::VARCHAR END nation FROM supplier")
def fallback_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three templates by key; the third has no nation."""
    key = F.col("s_suppkey") % 3
    nation = F.col("s_nationkey").cast("string")
    body = (
        F.when(key == 0, F.concat(F.lit('<h1 class="name">'), F.col("s_name"), F.lit('</h1><span data-nation="'), nation, F.lit('"></span>')))
        .when(key == 1, F.concat(F.lit('<div id="title">'), F.col("s_name"), F.lit('</div><i data-nation="'), nation, F.lit('"></i>')))
        .otherwise(F.concat(F.lit("<p class='x title-text y'> "), F.col("s_name"), F.lit("</p>")))
    )
    pages = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("").alias("url"), _page("</head><body>", body).alias("html"))
    fields = {"name": FieldSpec("h1.name", fallbacks=("#title", "p[class~='title-text']")), "nation": FieldSpec("span[data-nation]", attribute="data-nation", fallbacks=("i:not(.x)",))}
    return extract.extract(pages, fields).select("s_suppkey", *fields)


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages; every fifth has no price, every seventh an odd one."""
    key = F.col("p_partkey")
    price = F.when(key % 5 == 0, "").when(key % 7 == 0, "1-2").otherwise(F.concat(F.lit("EUR "), F.col("p_retailprice").cast("decimal(18,2)").cast("string")))
    html = _page("</head><body><b class='p'>", price, "</b><i>", F.col("p_size").cast("string"), "</i><u>", F.lower("p_type"), "</u><time>2024-02-", F.lpad((key % 28 + 1).cast("string"), 2, "0"), "</time><a>", F.concat(F.when(key % 2 == 0, "http://x.example/").otherwise("/"), key.cast("string")), "</a>")
    return table(spark, sf_dir, "part").select("p_partkey", F.lit("").alias("url"), html.alias("html"))


_TYPED = {
    "price": FieldSpec("b.p", type="decimal", required=True), "size": FieldSpec("i", type="int"), "kind": FieldSpec("u", type="ECONOMY|STANDARD|PROMO"),
    "day": FieldSpec("time", type="datetime"), "link": FieldSpec("a", type="url"), "price_int": FieldSpec("b.p", type="int"),
}
_TYPED_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN NULL ELSE p_retailprice::DECIMAL(38,10) END price, p_size size,
  CASE WHEN upper(p_type) IN ('ECONOMY', 'STANDARD', 'PROMO') THEN upper(p_type) END kind, ('2024-02-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0'))::TIMESTAMP AS "day",
  CASE WHEN p_partkey % 2 = 0 THEN 'http://x.example/' || p_partkey END link, NULL::INT price_int FROM part"""


@query(_TYPED_SQL)
def typed_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.bind(extract.extract(_priced(spark, sf_dir), _TYPED), _TYPED, enforce_required=False).select("p_partkey", *_TYPED)


@query(f"SELECT * FROM ({_TYPED_SQL}) WHERE price IS NOT NULL")
def required_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.bind(extract.extract(_priced(spark, sf_dir), _TYPED), _TYPED).select("p_partkey", *_TYPED)


# Transforms.

_T_SQL = {
    "trim": "regexp_replace(text, '^[WS]+|[WS]+$', '', 'g')", "lowercase": "lower(text)", "uppercase": "replace(upper(replace(text, 'ß', chr(57344))), chr(57344), 'ß')",
    "collapse_whitespace": "regexp_replace(regexp_replace(text, '[WS]+', ' ', 'g'), '^ | $', '', 'g')", "strip_non_digits": "regexp_replace(text, '[^\\p{Nd}.\\-]', '', 'g')",
    "strip_currency_symbols": "regexp_replace(text, '[^\\p{Nd}.,\\-]', '', 'g')",
}


def _transform(t: Transform) -> None:
    name = t.name.lower()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", transforms.apply(F.col("text"), [t]).alias("value"))

    run.__name__ = f"transform_{name}"
    query(f"SELECT doc_id, {_T_SQL[name].replace('WS', _WS)} AS value FROM documents")(run)


for _t in Transform:
    _transform(_t)


@query(f"SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g')), '[{_WS}]+', ' ', 'g'), '^ | $', '', 'g') AS value FROM documents")
def transform_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = transforms.parse_names(["Trim", "lowercase", "COLLAPSEWHITESPACE"])
    return table(spark, sf_dir, "documents").select("doc_id", transforms.apply(F.col("text"), line).alias("value"))


# URLs.

_NORMALIZED = """(SELECT page_id, url, lower(r.s) || '://' || h || CASE WHEN r.p IN ('', '/') THEN '/' ELSE rtrim(r.p, '/') END ||
    CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END n
  FROM (SELECT page_id, url, r, lower(r.h) h, list_filter(string_split(ltrim(r.q, '?'), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN
    ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'msclkid', 'ref', 'mc_cid', 'mc_eid', 'igshid')) q
    FROM (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$', ['s', 'h', 'p', 'q', 'f']) r FROM pages)))"""


@query(f"SELECT page_id, n AS normalized FROM {_NORMALIZED}")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("normalized"))


@query(f"SELECT min(page_id) page_id, lower(n) AS key FROM {_NORMALIZED} GROUP BY 2")
def visited_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "pages").select("page_id", urls.visited_key(F.col("url")).alias("key"))
    return dedup.by_key(keyed, "key", ["page_id"])


@query("SELECT page_id, upper(sha256(url)) || '.html' AS cache_name FROM pages")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.cache_name(F.col("url")).alias("cache_name"))


@query(
    r"""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS origin, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host,
  CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS path FROM pages"""
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.origin(u).alias("origin"), urls.host(u).alias("host"), urls.path_and_query(u).alias("path"))


# Politeness.


def _robots(pages: DataFrame) -> DataFrame:
    """A robots file for two origins in three: /de and .../PRIVATE are closed to all, and BadBot's rules must not count."""
    origins = pages.select(urls.origin(F.col("url")).alias("origin")).distinct()
    n = F.length("origin") % 3
    content = F.concat(
        F.lit("# rules\nUser-agent: *\nDisallow:\nDisallow: /DE\nno colon\nCrawl-Delay: "), n.cast("string"), F.lit(".5\r\nUser-agent: BadBot\nDisallow: /\nCrawl-delay: 60\nUser-Agent: *\nDisallow: /fr/1\nCrawl-delay: -1\n")
    )
    return origins.where(n > 0).select("origin", content.alias("content"))


_ROBOTS_SQL = """SELECT page_id, CASE WHEN length(o) % 3 = 0 THEN NULL ELSE (length(o) % 3)::DOUBLE + 0.5 END crawl_delay,
  length(o) % 3 = 0 OR NOT (starts_with(p, '/de') OR starts_with(p, '/fr/1')) allowed
  FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+')) o, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^#]*)', 1)) p FROM pages)"""


@query(f"SELECT page_id, allowed FROM ({_ROBOTS_SQL})")
def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return politeness.with_robots(pages, _robots(pages)).select("page_id", "allowed")


@query(f"SELECT page_id, greatest(1000.0::DOUBLE, coalesce(crawl_delay * 1000, 0)) delay_ms FROM ({_ROBOTS_SQL})")
def crawl_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return politeness.with_robots(pages, _robots(pages)).select("page_id", politeness.effective_delay_ms(F.lit(1000.0), F.col("crawl_delay")).alias("delay_ms"))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"))


@query(
    """WITH a AS (SELECT event_id, user_id, epoch_us(ts) arrival, (row_number() OVER w - 1) * 90000000 b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id))
SELECT event_id, (b + max(arrival - b) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING))::BIGINT start_us FROM a"""
)
def rate_limit_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as hosts, in microseconds, so that all is exact."""
    planned = politeness.schedule(_arrivals(spark, sf_dir), F.lit(90_000_000).cast("long"), "user_id", "arrival", "event_id")
    return planned.select("event_id", F.col("start_ms").cast("long").alias("start_us"))


_ADAPTIVE = """WITH l AS (SELECT user_id, list(event_type <> 'error' ORDER BY event_id) FILTER (event_type IN ('error', 'view', 'purchase')) o FROM events GROUP BY 1),
m AS (SELECT user_id, list_reduce(list_prepend(1.0::DOUBLE, list_transform(coalesce(o, []), lambda x: CASE WHEN x THEN -1.0 ELSE -2.0 END)), lambda a, x:
  CASE WHEN x = -1.0 THEN greatest(1.0, a * 0.85) ELSE least(16.0, a * 2.0) END) m FROM l)"""


@query(f"{_ADAPTIVE} SELECT user_id, round(m, 9) multiplier, round(least(30000.0, m * 2500), 6) delay_ms FROM m")
def adaptive_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are failures, views and purchases successes, the rest neither."""
    kind = F.col("event_type")
    ok = F.when(kind == "error", F.lit(False)).when(kind.isin("view", "purchase"), F.lit(True))
    found = politeness.adaptive_delay(table(spark, sf_dir, "events").withColumn("ok", ok), 2500, "user_id", "event_id")
    return found.select("user_id", F.round("multiplier", 9).alias("multiplier"), F.round("delay_ms", 6).alias("delay_ms"))


@query("SELECT event_id, a::INT attempt, (1000 * power(2, a))::DOUBLE wait_ms FROM events, (SELECT unnest(range(3)) a) WHERE event_type = 'error'")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id")
    return politeness.retry_schedule(failures, 1000, 3)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 50 > 0 THEN (o_orderkey % 50) * 1000.0 WHEN o_orderkey % 3 = 2 AND o_orderdate > TIMESTAMP '1995-01-01' THEN epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01')
  ELSE 500 * power(2, o_orderkey % 4) END::DOUBLE wait_ms FROM orders"""
)
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds for a third of the orders (0 among them, which is no wait), a date for another, neither for the rest."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    wait = politeness.retry_delay_ms(
        (key % 4).cast("double"), 500, F.when(key % 3 == 1, key % 50), F.when(key % 3 == 2, F.col("o_orderdate").cast("timestamp")), F.lit("1995-01-01 00:00:00").cast("timestamp")
    )
    return orders.select("o_orderkey", wait.cast("double").alias("wait_ms"))


@query("SELECT o_orderkey, (o_orderkey % 10) * 60 = 429 OR (o_orderkey % 10) * 60 >= 500 OR o_orderkey % 7 = 0 retryable FROM orders")
def retryable(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 7 == 0, 429).otherwise((F.col("o_orderkey") % 10) * 60)
    return table(spark, sf_dir, "orders").select("o_orderkey", politeness.is_retryable(status).alias("retryable"))


@query("SELECT event_id, ['agent a', 'agent b', 'agent c'][event_id % 3 + 1] user_agent FROM events")
def ua_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return politeness.with_rotation(table(spark, sf_dir, "events").select("event_id"), ["agent a", "agent b", "agent c"], "user_agent", "event_id")


@query("SELECT event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 4)::INT slot FROM events")
def host_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = politeness.with_slots(table(spark, sf_dir, "events").select("event_id", "user_id"), 4, "user_id", "event_id")
    return found.select("event_id", F.col("slot").cast("int").alias("slot"))


# Deduplication, coverage, differences.


@query("SELECT user_id, event_type, min(event_id) event_id FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(user_id % 40, 0)::VARCHAR, '') ORDER BY event_id) n FROM events) WHERE n = 1 GROUP BY ALL")
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key that is null for some users, who so count as one."""
    events = table(spark, sf_dir, "events").withColumn("key", F.nullif(F.col("user_id") % 40, F.lit(0).cast("long")))
    return dedup.by_key(events, "key", ["event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT min(doc_id) doc_id, text, lang FROM documents GROUP BY text, lang")
def dedup_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.by_content(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["text", "lang"], ["doc_id"])


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("lang")).alias("lang"), F.col("quality").cast("string").alias("quality"), F.lit(None).cast("string").alias("never"))


@query(
    """WITH d AS (SELECT CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END lang, quality::VARCHAR quality FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT 'lang' field, count(*) FILTER (lang <> '') n_present, count(*) n FROM d UNION ALL SELECT 'quality', count(*) FILTER (quality <> ''), count(*) FROM d)
SELECT field, n_present, n_present / n::DOUBLE coverage FROM c WHERE n_present > 0"""
)
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.field_coverage(_sparse(spark, sf_dir), ["quality", "lang", "never"])


@query(
    """WITH l AS (SELECT event_id % 10 k, event_id FROM events)
SELECT 'items' metric, NULL::VARCHAR AS name, count(*) n FROM l WHERE k NOT IN (1, 2, 3) UNION ALL SELECT 'malformed', NULL, count(*) FROM l WHERE k IN (1, 2)
UNION ALL SELECT 'field', 'k', count(*) FROM l WHERE k NOT IN (1, 2, 3) UNION ALL SELECT 'field', 'list', count(*) FROM l WHERE k = 4 UNION ALL SELECT 'field', 'flag', count(*) FROM l WHERE k = 4"""
)
def jsonl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' props as lines; some are cut, some an array, some blank, some hold nulls, empty strings, lists and flags."""
    k = F.col("event_id") % 10
    line = F.when(k == 1, F.substring("props", 1, 5)).when(k == 2, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(k == 3, "  ")
    line = line.when(k == 4, F.concat(F.lit('{"none":null,"empty":"","list":[],"flag":false,'), F.substring("props", 2, 100))).otherwise(F.col("props"))
    return coverage.jsonl_stats(table(spark, sf_dir, "events").select(line.alias("value")))


@query(
    """SELECT count(*) pages_fetched, count(*) FILTER (page_id % 9 = 0) pages_failed, (SELECT sum(len(regexp_extract_all(html, '<li>')))::BIGINT FROM pages WHERE page_id % 9 <> 0) items_extracted FROM pages"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("success", F.col("page_id") % 9 != 0)
    return coverage.run_summary(pages, extract.extract(pages.where("success"), {"label": FieldSpec("a")}, "nav li"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as lines; the new ones lack some keys, change some, add some, and repeat some whose last line counts."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    line = lambda status: F.concat(F.lit('{"id":'), key.cast("string"), F.lit(',"status":"'), status, F.lit('"}'))
    old = orders.where(key % 11 != 0).select(key.alias("line_no"), line(F.col("o_orderstatus")).alias("line"))
    new = orders.where(key % 7 != 0).select((key + 1_000_000_000).alias("line_no"), line(F.when(key % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("line"))
    first = orders.where(key % 13 == 0).select(key.alias("line_no"), line(F.lit("gone")).alias("line"))
    other = orders.where(key % 100 == 0).select((key + 2_000_000_000).alias("line_no"), F.when(key % 200 == 0, '{"id":null}').otherwise("[1]").alias("line"))
    return old, new.union(first).union(other)


_DIFF = """(WITH k AS (SELECT o_orderkey id, o_orderkey % 11 <> 0 o, o_orderkey % 7 <> 0 OR o_orderkey % 13 = 0 n, o_orderstatus s,
  CASE WHEN o_orderkey % 7 = 0 THEN 'gone' WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END t FROM orders)
SELECT id::VARCHAR AS key, CASE WHEN NOT o THEN 'added' WHEN NOT n THEN 'removed' WHEN s <> t THEN 'changed' ELSE 'unchanged' END status FROM k WHERE o OR n)"""


@query(f"SELECT * FROM {_DIFF}")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.snapshot_diff(*_snapshots(spark, sf_dir), "id").select("key", "status")


@query(f"SELECT status, count(*) n FROM {_DIFF} GROUP BY 1")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.counts(diff.snapshot_diff(*_snapshots(spark, sf_dir), "id"))


@query(f"SELECT 'only old' kind, key FROM {_DIFF} WHERE status = 'removed' UNION ALL SELECT 'both', key FROM {_DIFF} WHERE status IN ('changed', 'unchanged')")
def diff_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (diff.keyed_lines(x, "id") for x in _snapshots(spark, sf_dir))
    return diff.except_keys(old, new).select(F.lit("only old").alias("kind"), "key").union(diff.intersect_keys(old, new).select(F.lit("both"), "key"))


@query("SELECT o_orderkey::VARCHAR AS key FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 ORDER BY o_orderkey LIMIT 20")
def diff_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty removed keys: a report's list."""
    return diff.sample(diff.snapshot_diff(*_snapshots(spark, sf_dir), "id"), "removed")


@query(
    """WITH o AS (SELECT o_orderkey id, o_orderkey % 4 < 2 AND o_orderkey % 11 <> 0 a, o_orderkey % 7 <> 0 b, CASE WHEN o_orderkey % 3 = 0 THEN 'second' WHEN o_orderkey % 4 < 2 THEN 'first' ELSE 'third' END x FROM orders)
SELECT id::VARCHAR AS key, CASE WHEN NOT a THEN 'added' WHEN NOT b THEN 'removed' WHEN x = 'first' THEN 'unchanged' ELSE 'changed' END status,
  CASE WHEN b THEN '{"id":' || id || ',"from":"' || x || '"}' END new_line FROM o WHERE a OR b"""
)
def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as folders of files: of a key's lines the one in the file with the later name counts, though that file is the smallest and read last."""
    folder, orders = Folder(spark, None).path, table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")

    def write(name: str, rows: DataFrame, source: str) -> None:
        line = F.concat(F.lit('{"id":'), key.cast("string"), F.lit(f',"from":"{source}"}}'))
        rows.select(line.alias("value")).write.mode("append").text(f"{folder}/{name}")

    first, old = key % 4 < 2, f"{folder}/old"
    write("old", orders.where(first & (key % 11 != 0)), "first")
    kept = orders.where(key % 7 != 0)
    write("new/1", kept.where(first), "first")
    write("new/1", kept.where(~first), "third")
    write("new/2", kept.where(key % 3 == 0), "second")
    new = readers.json_lines(spark, f"{folder}/new/*")
    return diff.snapshot_diff(readers.json_lines(spark, old), new, "id").select("key", "status", "new_line")


# Sources.


def _urlset(entries: Column, root: str = "urlset", entry: str = "url") -> Column:
    locs = F.array_join(F.transform(entries, lambda u: F.concat(F.lit(f"<{entry}><loc> "), u, F.lit(f" </loc></{entry}>"))), "")
    return F.concat(F.lit(f'<?xml version="1.0"?><{root} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), locs, F.lit(f"</{root}>"))


@query("SELECT c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT pos, 'http://x.example/c/' || c_custkey loc FROM customer WHERE c_custkey % 10 <> 0 AND c_nationkey <> 3 QUALIFY pos < 40")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap a nation, with relative entries that don't count, a cap of 40, and one that is no XML."""
    key = F.col("c_custkey")
    u = F.struct(key, F.concat(F.when(key % 10 == 0, "/c/").otherwise("http://x.example/c/"), key.cast("string")).alias("u"))
    maps = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(u)), lambda x: x["u"]).alias("l"))
    xml = F.when(F.col("c_nationkey") == 3, "plain words, no markup").otherwise(_urlset(F.col("l")))
    return readers.sitemap_urls(maps.select("c_nationkey", xml.alias("xml")), cap=40)


@query("SELECT 'http://x.example/s/' || s_suppkey loc FROM supplier WHERE s_nationkey <> 4")
def sitemap_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of nations' sitemaps (one is missing) in an index of itself, which depth ends."""
    suppliers = table(spark, sf_dir, "supplier").where("s_nationkey <> 4")
    own = suppliers.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.concat(F.lit("http://x.example/s/"), F.col("s_suppkey").cast("string")))).alias("l"))
    maps = own.select(F.concat(F.lit("http://x.example/map/"), F.col("s_nationkey").cast("string")).alias("url"), _urlset(F.col("l")).alias("xml"))
    nations = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.concat(F.lit("http://x.example/map/"), i.cast("string")))
    index = spark.range(1).select(F.lit("http://x.example/index").alias("url"), _urlset(nations, "sitemapindex", "sitemap").alias("xml"))
    top = spark.range(1).select(F.lit("http://x.example/top").alias("url"), _urlset(F.array(F.lit("http://x.example/index")), "sitemapindex", "sitemap").alias("xml"))
    return readers.sitemap_index(maps.union(index).union(top), "http://x.example/top", cap=1_000_000)


@query("SELECT 'https://x.example/' || c_custkey url FROM customer WHERE c_custkey % 4 = 0")
def seed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    k = key.cast("string")
    line = F.when(key % 4 == 0, F.concat(F.lit(" \thttps://x.example/"), k, F.lit("  "))).when(key % 4 == 1, F.concat(F.lit("# http://x.example/"), k)).when(key % 4 == 2, "").otherwise(F.concat(F.lit("words, no address "), k))
    return readers.seed_lines(table(spark, sf_dir, "customer").select(line.alias("value")))


# Crawling.


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer i as a page that links to 2i + 1 and 2i + 2, to itself and, with tracking, to its parent."""
    key = F.col("c_custkey")
    a = lambda x, q="": F.concat(F.lit('<a href="/'), x.cast("string"), F.lit(f'{q}">x</a>'))
    body = F.concat(a(key * 2 + 1), a(key * 2 + 2), a(key, "#top"), a(F.greatest(F.floor((key - 1) / 2), F.lit(0)), "?utm_source=x"))
    html = _page("</head><body><h1>", F.col("c_name"), "</h1>", body)
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("http://t.example/"), key.cast("string")).alias("url"), html.alias("html"))


def _crawl_tree(spark: SparkSession, sf_dir: str, depth: int, most: int):
    """The tree is an archive that is stored once, in buckets by URL."""
    name = f"archive_{uuid.uuid4().hex}"
    archive = stored_archive(_tree(spark, sf_dir), name, int(spark.conf.get("spark.sql.shuffle.partitions")), f"{Folder(spark, None).path}/{name}")
    plan = Plan({"name": FieldSpec("h1")}, archive, link_selector="a", max_depth=depth, max_pages=most)
    return crawl(spark, readers.seeds(spark, ["http://t.example/0", "http://t.example/0#again"]), plan)


_TREE = """(WITH RECURSIVE t(id, depth) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT unnest([2 * id + 1, 2 * id + 2]), depth + 1 FROM t WHERE depth < 6 AND id < (SELECT count(*) FROM customer)) SELECT * FROM t)"""


@query(f"SELECT 'http://t.example/' || id url, depth, c_name AS name FROM {_TREE} JOIN customer ON c_custkey = id")
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of depth, which is the feature: 127 pages at every scale (``bfs_whole`` has none)."""
    return _crawl_tree(spark, sf_dir, 6, 1_000_000).items.select("url", "depth", "name")


@query(
    """SELECT 'http://t.example/' || id url, depth, c_name AS name FROM (WITH RECURSIVE t(id, depth) AS (
    SELECT 0::BIGINT, 0 UNION ALL SELECT unnest([2 * id + 1, 2 * id + 2]), depth + 1 FROM t WHERE id < (SELECT count(*) FROM customer)) SELECT * FROM t) JOIN customer ON c_custkey = id"""
)
def bfs_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tree: neither limit is reached, the crawl ends where no page has a link left."""
    n = table(spark, sf_dir, "customer").count()
    return _crawl_tree(spark, sf_dir, n + 1, 2 * n + 3).items.select("url", "depth", "name")


@query(f"SELECT depth, count(*) pages, count(*) FILTER (c_custkey IS NULL) failed FROM (SELECT * FROM {_TREE} WHERE id < 100) LEFT JOIN customer ON c_custkey = id GROUP BY 1")
def page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred pages in breadth-first order: a limit that is the feature."""
    pages = _crawl_tree(spark, sf_dir, 6, 100).pages
    return pages.groupBy("depth").agg(F.count("*").alias("pages"), F.count_if(~F.col("success")).alias("failed"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 <> 9 THEN 'http://x.example/p/' || (p_partkey + 1) END next_url FROM part")
def pagination_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of ten pages; the link is marked in four ways."""
    key = F.col("p_partkey")
    to = (key + 1).cast("string")
    tag = F.when(key % 10 == 9, '<a rel="prev" href="/p/0">x</a>').when(key % 4 == 0, F.concat(F.lit('<a rel="next" href="/p/'), to, F.lit('">n</a>')))
    tag = tag.when(key % 4 == 1, F.concat(F.lit('<ul class="pagination"><li class="next"><a href="../p/'), to, F.lit('">n</a></li></ul>')))
    tag = tag.when(key % 4 == 2, F.concat(F.lit('<a class="b next" href="http://x.example/p/'), to, F.lit('">n</a>'))).otherwise(F.concat(F.lit('<li class="next"><a href="'), to, F.lit('">n</a></li>')))
    pages = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("http://x.example/p/"), key.cast("string")).alias("url"), _page("</head><body>", tag).alias("html"))
    return extract.spread(pages).select("p_partkey", extract.next_page()("url", "html").alias("next_url"))


# Repair.


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 OR s_nationkey < 10 THEN s_name END AS name FROM supplier")
def heal_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd suppliers' pages lost the class; the repair is known for the hosts of ten nations."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    html = _page("</head><body>", F.when(key % 2 == 0, '<b class="name">').otherwise('<b class="n">'), F.col("s_name"), "</b>")
    pages = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("http://n"), nation, F.lit(".example/"), key.cast("string")).alias("url"), html.alias("html"))
    cache = heal.HealingCache()
    for i in range(10):
        cache.set(f"n{i}.example", "name", "b.n")
    fields = {"name": FieldSpec("b.name")}
    return extract.items_of(heal.heal(pages, fields, None, cache, None), fields).select("s_suppkey", "name")


@query("SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN '.a' || s_suppkey WHEN 1 THEN '.b' || s_suppkey WHEN 2 THEN '.c' || s_suppkey END selector FROM supplier")
def heal_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, fenced and broken replies; null, a number, an object and white space are no selectors."""
    k, key = F.col("s_suppkey") % 8, F.col("s_suppkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit('{"selector": ".a'), key, F.lit('", "confidence": 1}'))).when(k == 1, F.concat(F.lit('```json\n{"selector":".b'), key, F.lit('"}\n```')))
    raw = raw.when(k == 2, F.concat(F.lit('It is "selector": ".c'), key, F.lit('" I think'))).when(k == 3, '{"selector": null}').when(k == 4, F.concat(F.lit('{"selector": '), key, F.lit("}")))
    raw = raw.when(k == 5, '{"selector": {"css": "b"}}').when(k == 6, '{"selector": " \\t\u2003"}').otherwise("no idea")
    return table(spark, sf_dir, "supplier").select("s_suppkey", heal.reply_column(raw).alias("selector"))


@query("SELECT s_suppkey, item_seq::INT item_seq, 'n' || (s_suppkey + item_seq) AS name FROM supplier, (SELECT unnest(range(3)) item_seq) WHERE s_suppkey % 2 = 0 OR s_nationkey < 10")
def heal_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd suppliers' lists lost their class; the container's repair is known for the hosts of ten nations."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    tag = F.when(key % 2 == 0, '<li class="row">').otherwise('<li class="line">')
    rows = F.concat(*(x for i in range(3) for x in (tag, F.lit("<b>n"), (key + i).cast("string"), F.lit("</b></li>"))))
    pages = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("http://n"), nation, F.lit(".example/"), key.cast("string")).alias("url"), _page("</head><body><ul>", rows, "</ul>").alias("html"))
    cache = heal.HealingCache()
    for i in range(10):
        cache.set(f"n{i}.example", extract.CONTAINER, "li.line")
    fields = {"name": FieldSpec("b")}
    return extract.items_of(heal.heal(pages, fields, "li.row", cache, None), fields).select("s_suppkey", "item_seq", "name")


# Requests, fetching and sinks.


@query(
    """SELECT * FROM (VALUES ('http://a.example/', 'GET', NULL, 0::BIGINT), ('http://b.example/', 'GET', NULL, 1), ('http://c.example/', 'POST', 'x', 2), ('http://d.example/', 'GET', NULL, 3), ('http://e.example/', 'POST', NULL, 4)) t(url, method, q, seq)"""
)
def seed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs, then requests; whatever isn't GET is POST."""
    found = readers.seeds(spark, ["http://a.example/", "http://b.example/"], [("http://c.example/", "POST", {"q": "x"}), ("http://d.example/", "get", None), ("http://e.example/", "PUT", {})])
    return found.select("url", "method", F.col("form")["q"].alias("q"), "seq")


@query(
    """SELECT page_id seq, CASE WHEN page_id % 2 = 0 OR page_id % 3 = 0 THEN 200 ELSE 0 END status, page_id % 2 = 0 OR page_id % 3 = 0 success,
  CASE WHEN page_id % 2 = 0 THEN 'cached' WHEN page_id % 3 = 0 THEN 'fetched' END html, CASE WHEN page_id % 2 <> 0 AND page_id % 3 <> 0 THEN 'not found' END error FROM pages"""
)
def cached_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the pages are in the cache, a third in the archive behind it."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("http://x.example/"), F.col("page_id").cast("string")).alias("url"))
    cache = pages.where("page_id % 2 = 0").select(urls.cache_name(F.col("url")).alias("name"), F.lit("cached").alias("html"))
    archive = pages.where("page_id % 3 = 0").select("url", F.lit("fetched").alias("html"))
    asked = pages.select("url", F.lit(0).alias("depth"), F.lit("GET").alias("method"), F.lit(None).cast("map<string,string>").alias("form"), F.col("page_id").alias("seq"))
    return CachedFetcher(cache, TableFetcher(archive)).fetch(asked).select("seq", "status", "success", "html", "error")


def _odd_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with quotes, commas, line breaks and blanks around them; some nations are null."""
    key = F.col("s_suppkey")
    name = F.concat(F.when(key % 4 == 0, '"q", ').when(key % 4 == 1, " a\n").otherwise("x,"), F.col("s_name"), F.lit(" "))
    return table(spark, sf_dir, "supplier").select(key.cast("string").alias("id"), name.alias("name"), F.when(key % 3 > 0, F.col("s_nationkey").cast("string")).alias("nation"))


_ODD_SQL = """SELECT s_suppkey::VARCHAR id, CASE WHEN s_suppkey % 4 = 0 THEN '"q", ' WHEN s_suppkey % 4 = 1 THEN ' a' || chr(10) ELSE 'x,' END || s_name || ' ' AS name,
  CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey::VARCHAR END nation FROM supplier"""


@query(_ODD_SQL)
def sink_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Folder(spark, None).path}/items"
    sinks.JsonLines(path).write(_odd_items(spark, sf_dir))
    return spark.read.schema("id string, name string, nation string").json(path)


@query(_ODD_SQL)
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Folder(spark, None).path}/items"
    sinks.Csv(path).write(_odd_items(spark, sf_dir))
    return spark.read.schema("id string, name string, nation string").csv(path, header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


# Recipes.

_RECIPES = {
    "good": '{"SeedUrls":["http://x.example/"],"itemSelector":".i","fields":{"a":{"selector":"b"}}}',
    "empty": "{}",
    "null": "null",
    "broken": "{",
    "many": '{"seedUrls":["x"],"fields":{"a":{"selector":" ","xpath":true,"jsonLd":true}},"linkSelector":"a","autoPagination":true,"useBrowserRendering":true,"userAgentPool":["u"],'
    '"healing":{"provider":"groq,nobody,openai-compatible"},"output":{"format":"xml"}}',
}


@query(
    "SELECT * FROM (VALUES ('empty', 1, 1), ('null', 1, 0), ('broken', 1, 0), ('many', 5, 5)) t(name, errors, warnings)"
)
def recipe_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recipes.validate_table(spark.createDataFrame(list(_RECIPES.items()), "name string, recipe string"))
    return found.groupBy("name").agg(F.count_if(F.col("severity") == "error").cast("int").alias("errors"), F.count_if(F.col("severity") == "warning").cast("int").alias("warnings"))


# Streams.


def _streamed(df: DataFrame, *key: str) -> DataFrame:
    """All of a bounded stream: each batch is a table of its own, written again as a whole if it is repeated; with a key, each key's rows of its latest batch."""
    spark, folder = df.sparkSession, Folder(df.sparkSession, None).path
    writer = df.writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).outputMode("update" if key else "append")
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    if not key:
        return rows.drop("batch")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*df.columns), "batch").alias("r")).select("r.*")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.streaming import state

    return _streamed(state.unseen_items(_stream(spark, sf_dir, "events").select("user_id", "event_type")))


@query("SELECT 'event_type' field, count(*) n_present FROM events")
def stream_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.streaming import state

    items = _stream(spark, sf_dir, "events").select("event_type", F.lit("").alias("blank"))
    return _streamed(state.field_presence(items, ["event_type", "blank"]), "field")


@query(f"{_ADAPTIVE} SELECT user_id::VARCHAR AS host, round(m, 9) multiplier FROM m")
def stream_adaptive_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.streaming import state

    kind = F.col("event_type")
    ok = F.when(kind == "error", F.lit(False)).when(kind.isin("view", "purchase"), F.lit(True))
    rows = _stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("seq"), ok.alias("ok"))
    return _streamed(state.adaptive_delays(rows, 2500), "host").select("host", F.round("multiplier", 9).alias("multiplier"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu entries of all pages, cleaned, without repeats: how often each was seen."""
    fields = {"label": FieldSpec("a", transforms=(Transform.TRIM, Transform.LOWERCASE)), "href": FieldSpec("a", attribute="href")}
    items = extract.extract(table(spark, sf_dir, "pages"), fields, "nav li")
    return items.groupBy("label", "href").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))
