"""What the physical plans must and must not contain."""

import re

import pytest

from quarry import queries

DATA = "/root/testdata/sf0.001"
NATIVE = [
    *(n for n in queries.QUERIES if n.startswith("transform_")), "url_normalize", "visited_dedup", "cache_key", "url_parts", "robots_filter", "crawl_delay", "rate_limit_schedule", "adaptive_delay", "retry_schedule", "retry_after",
    "retryable", "ua_rotation", "host_slots", "dedup_key", "dedup_content", "field_coverage", "seed_file", "heal_reply", "cached_fetch",
]


def plan(spark, name):
    return queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_run_no_python(spark, name):
    text = plan(spark, name)
    assert not re.search("Python|Pandas|Arrow", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["css_title_h1", "css_items_nav", "main_content", "xpath_heading", "regex_on_text"])
def test_a_page_is_one_arrow_stage(spark, name):
    assert len(re.findall("MapInArrow", plan(spark, name))) == 1


def test_scans_are_pruned(spark):
    read = lambda name: re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name))
    assert read("dedup_content") == ["doc_id:bigint,text:string,lang:string"]
    assert read("ua_rotation") == ["event_id:bigint"]
    assert read("cache_key") == ["page_id:bigint,url:string"]
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan(spark, "retry_schedule")


@pytest.mark.parametrize("name", ["dedup_key", "dedup_content", "visited_dedup", "diff_counts", "field_coverage"])
def test_aggregates_combine_before_the_shuffle(spark, name):
    assert "partial_" in plan(spark, name)


def test_few_small_files_are_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    from quarry.operators import extract

    pages = spark.range(100).selectExpr("'http://x.example/' AS url", "concat('<b>', id) AS html")
    pages.coalesce(1).write.parquet(f"file://{tmp_path}/one")
    pages.repartition(9).write.parquet(f"file://{tmp_path}/nine")
    dealt = lambda name: "RoundRobinPartitioning" in extract.spread(spark.read.parquet(f"file://{tmp_path}/{name}"))._jdf.queryExecution().executedPlan().toString()
    assert dealt("one") and not dealt("nine") and extract.spread(pages) is pages
    monkeypatch.setattr(extract, "SPLIT", 10)
    assert not dealt("one")
