"""Readers: seeds, sitemaps, JSON-Lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.transforms import trim
from quarry.functions.urls import is_absolute
from quarry.sources.fetch import REQUEST, Fetcher

SITEMAP_CAP, SITEMAP_DEPTH = 1000, 3
#: Where a line stands: lines of files are in the order of their files' names, then of their places in them.
PLACE = "struct<file:string,block:long,row:long>"


def seeds(spark: SparkSession, urls: Sequence[str] = (), requests: Sequence[tuple[str, str, dict[str, str] | None]] = ()) -> DataFrame:
    """Requests of depth 0: the URLs, then the (url, method, form) requests, in order."""
    rows = [(u, 0, "GET", None, i) for i, u in enumerate(urls)]
    rows += [(u, 0, "GET" if m.upper() == "GET" else "POST", f, len(urls) + i) for i, (u, m, f) in enumerate(requests)]
    return spark.createDataFrame(rows, REQUEST)


def seed_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """(url): trimmed absolute URLs of text lines; blanks and lines that start with # go."""
    url = trim(F.col(col))
    return lines.select(url.alias("url")).where((F.col("url") != "") & ~F.startswith("url", F.lit("#")) & is_absolute(F.col("url")))


def seed_file(spark: SparkSession, path: str) -> DataFrame:
    """The URLs of a file's lines, in their order."""
    return seed_lines(json_lines(spark, path).orderBy("line_no"), "line")


def as_requests(urls: DataFrame) -> DataFrame:
    """Requests of depth 0 of (url, seq)."""
    return urls.select("url", F.lit(0).alias("depth"), F.lit("GET").alias("method"), F.lit(None).cast("map<string,string>").alias("form"), F.col("seq").cast("long").alias("seq"))


_WRAP = "q7w1-all"  # an element around a document; a text that has this name in it is read as no document
_PROLOG = r"(?s)^[\s\x{FEFF}]*(<\?xml.*?\?>)?(\s|<!--.*?-->)*(<!DOCTYPE[^>\[]*(\[.*?\]\s*)?>)?\s*"


def locations(xml: Column, entry: str) -> Column:
    """The texts of loc in each ``entry`` of a sitemap, at any depth, under names that are prefixed as the root's; nothing where the text isn't one XML document.

    What stands before the root is cut off and the rest wrapped in an element, so
    that the parser, which else stops at the root's end, sees all of it; XPath
    then runs on texts that were parsed.
    """
    body = F.regexp_replace(xml, _PROLOG, "")
    whole = F.concat(F.lit(f"<{_WRAP}>"), body, F.lit(f"</{_WRAP}>"))
    parsed = F.from_xml(whole, "broken string", {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"})
    good = ~F.contains(body, F.lit(_WRAP)) & F.startswith(body, F.lit("<")) & parsed.isNotNull() & parsed["broken"].isNull()
    root = f"/{_WRAP}/*[1]"
    prefix = f"substring-before(name({root}),':'),substring(':',1,number(contains(name({root}),':')))"
    one = F.xpath_int(whole, F.lit(f"number(count(/{_WRAP}/*) = 1 and count(/{_WRAP}/text()[normalize-space()]) = 0)"))
    found = F.xpath(whole, F.lit(f"//*[name()=concat({prefix},'{entry}')]/*[name()=concat({prefix},'loc')]/text()"))
    texts = F.when(good, F.when(one == 1, F.filter(F.transform(found, trim), lambda t: t != "")))
    return F.coalesce(texts, F.array().cast("array<string>"))


def sitemap_urls(sitemaps: DataFrame, xml_col: str = "xml", cap: int = SITEMAP_CAP) -> DataFrame:
    """The other columns, ``pos`` and ``loc``: the first ``cap`` absolute URLs of each sitemap, in document order."""
    keep = [c for c in sitemaps.columns if c != xml_col]
    absolute = F.slice(F.filter(locations(F.col(xml_col), "url"), is_absolute), 1, cap)
    return sitemaps.select(*keep, F.posexplode(absolute).alias("pos", "loc"))


def sitemap_crawl(spark: SparkSession, fetcher: Fetcher, root: str, cap: int = SITEMAP_CAP, depth: int = SITEMAP_DEPTH) -> DataFrame:
    """(loc, place): the first ``cap`` absolute URLs reached from the sitemap at ``root``, numbered from 0.

    A sitemap's children come before its own URLs, children of children to
    ``depth``; sitemaps that can't be had or read are skipped, and one that
    several indexes name is read for each.  A level's documents are fetched
    together and stored; the order is a path of positions, so the levels need no
    order of their own and the cap is one ordered limit.
    """
    from quarry.operators.crawl import Folder

    folder, below = Folder(spark, None), spark.createDataFrame([(root, [])], "url string, path array<int>")
    levels = []
    for n in range(depth + 1):
        level = folder.put(f"maps-{n}", below)
        asked = as_requests(level.groupBy("url").agg(F.min("path").alias("p")).select("url", F.lit(0).alias("seq")))
        read = folder.put(f"read-{n}", fetcher.fetch(asked).where("success").select("url", locations(F.col("html"), "url").alias("own"), locations(F.col("html"), "sitemap").alias("children")))
        levels.append((level, read))
        inner = level.join(read, "url").select("path", F.posexplode("children").alias("pos", "child"))
        below = inner.where(is_absolute(F.col("child"))).select(F.col("child").alias("url"), F.concat("path", F.array("pos")).alias("path"))
        if n < depth and below.isEmpty():
            break
    parts = []
    for level, read in levels:
        own = level.join(read, "url").select("path", F.posexplode("own").alias("pos", "loc")).where(is_absolute(F.col("loc")))
        parts.append(own.select(F.concat("path", F.array(F.lit(1 << 30), F.col("pos"))).alias("path"), "loc"))
    first = reduce(DataFrame.union, parts).orderBy("path").limit(cap)
    return folder.put("urls", first.select("loc", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("place")))  # cap rows at most


def sitemap_index(sitemaps: DataFrame, root: str, cap: int = SITEMAP_CAP, depth: int = SITEMAP_DEPTH) -> DataFrame:
    """(loc): the URLs of ``sitemap_crawl`` in a table (url, xml) of sitemaps."""
    from quarry.sources.fetch import TableFetcher

    return sitemap_crawl(sitemaps.sparkSession, TableFetcher(sitemaps.select("url", F.col("xml").alias("html"))), root, cap, depth).select("loc")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line): the raw lines; line_no (see PLACE) grows in the order of the files' names and of the lines in each, however they are split and read."""
    rows = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return rows.select(F.struct(F.col("file_path").alias("file"), F.col("file_block_start").alias("block"), "row").alias("line_no"), F.col("value").alias("line"))
