
from quarry.streaming import state


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_unvisited(spark, tmp_path):
    rows = [("http://x.example/a?ref=1",), ("http://X.example/A",), ("http://x.example/b",)]
    assert len(run(state.unvisited(stream(spark, tmp_path, rows, "url string")), "unvisited")) == 2


def test_rate_limit(spark, tmp_path):
    rows = [("a", 1, 0.0), ("a", 2, 10.0), ("b", 3, 5.0), ("a", 4, 500.0)]
    got = run(state.rate_limited(stream(spark, tmp_path, rows, "host string, seq long, arrival_ms double"), 100.0), "limited")
    assert {r["seq"]: r["start_ms"] for r in got} == {1: 0, 2: 100, 3: 5, 4: 500}


def test_adaptive_delay(spark, tmp_path):
    rows = [("a", 1, False), ("a", 2, False), ("a", 3, True), ("b", 4, None), ("b", 5, True)]
    got = run(state.adaptive_delays(stream(spark, tmp_path, rows, "host string, seq long, ok boolean"), 1000), "adaptive", "update")
    assert {r["host"]: round(r["delay_ms"]) for r in got} == {"a": 3400, "b": 1000}


def test_items_and_presence(spark, tmp_path):
    rows = [("1", "x"), (None, "y"), ("", "z"), ("1", "w")]
    df = stream(spark, tmp_path, rows, "id string, name string")
    assert len(run(state.unseen_items(df, "id"), "unseen")) == 2
    got = run(state.field_presence(df, ["id", "name"]), "presence", "complete")
    assert {r["field"]: r["n_present"] for r in got} == {"id": 2, "name": 4}


def test_snapshots(spark, tmp_path):
    seen = []
    df = stream(spark, tmp_path, [(0, '{"k":1}'), (1, '{"k":2}')], "line_no long, line string")
    q = state.watch_snapshots(df, "k", f"file://{tmp_path}/snap", lambda d, n: seen.append({r["key"]: r["status"] for r in d.collect()})).option("checkpointLocation", str(tmp_path / "cp"))
    q.trigger(availableNow=True).start().awaitTermination()
    stream(spark, tmp_path, [(0, '{"k":2}')], "line_no long, line string")
    q.trigger(availableNow=True).start().awaitTermination()
    assert seen == [{"1": "added", "2": "added"}, {"1": "removed", "2": "unchanged"}]
    assert df.isStreaming


def test_robots_that_change_between_batches(spark, tmp_path):
    seen, rules = [], str(tmp_path / "robots")
    put = lambda text: spark.createDataFrame([("http://x.example", text)], "origin string, content string").write.mode("overwrite").parquet(rules)
    put("User-agent: *\nDisallow: /a")
    df = stream(spark, tmp_path, [("http://x.example/a",), ("http://x.example/b",), ("http://y.example/a",)], "url string")
    keep = lambda rows, n: seen.append({r["url"][7:]: (r["allowed"], r["crawl_delay"]) for r in rows.collect()})
    q = state.checked(df, lambda: spark.read.parquet(rules), keep).option("checkpointLocation", str(tmp_path / "cp"))
    q.trigger(availableNow=True).start().awaitTermination()
    put("User-agent: *\nDisallow: /b\nCrawl-delay: 2")
    stream(spark, tmp_path, [("http://x.example/a",), ("http://x.example/b",)], "url string")
    q.trigger(availableNow=True).start().awaitTermination()
    assert seen == [{"x.example/a": (False, None), "x.example/b": (True, None), "y.example/a": (True, None)}, {"x.example/a": (True, 2.0), "x.example/b": (False, 2.0)}]


def test_a_stream_of_several_batches_gives_each_key_once(spark, tmp_path):
    from quarry import queries

    rows = [("a", 1, False), ("b", 2, True)], [("a", 3, False)], [("c", 4, False), ("a", 5, True)]
    for own in rows:
        df = stream(spark, tmp_path, own, "host string, seq long, ok boolean")
    slow = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = queries._streamed(state.adaptive_delays(slow, 1000), "host").collect()
    assert sorted((r["host"], r["multiplier"]) for r in got) == [("a", 3.4), ("b", 1.0), ("c", 2.0)]
