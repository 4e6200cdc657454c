import dataclasses
import datetime
import json

import pytest
from pyspark.sql import functions as F

from quarry.functions.transforms import Transform
from quarry.operators import coverage, dedup, diff, extract
from quarry.plans.spec import FieldSpec, Kind, fields_of, harvest_field

PAGE = "<div class=q><b> One </b><i>$1,200.50</i></div><div class=q><b></b><i>x</i></div><div class=q></div>"


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, url string, html string")


def test_items_of_pages(spark):
    fields = {"name": FieldSpec("b", transforms=(Transform.UPPERCASE,)), "price": FieldSpec("i", Kind.REGEX, r"[\d,.]+"), "fall": FieldSpec("u", fallbacks=("s", "i"))}
    got = extract.extract(pages(spark, (1, "http://x.example/", PAGE), (2, None, None), (3, "u", "")), fields, ".q").orderBy("id", "item_seq").collect()
    assert [(r["id"], r["item_seq"], r["name"], r["price"], r["fall"]) for r in got] == [(1, 0, "ONE", "1,200.50", "$1,200.50"), (1, 1, None, None, "x"), (1, 2, None, None, None)]
    whole = extract.extract(pages(spark, (1, "u", PAGE)), {"name": FieldSpec("b")}).collect()
    assert [(r["item_seq"], r["name"]) for r in whole] == [(0, "One")]
    assert extract.extract(pages(spark, (1, "u", PAGE)).limit(0), fields, ".q").count() == 0
    with pytest.raises(ValueError):
        extract.extract(pages(spark), {"x": FieldSpec("b[")})


def test_attribute_present_but_empty_is_a_value(spark):
    got = extract.extract(pages(spark, (1, "u", "<a href=''>x</a>")), {"h": FieldSpec("a", attribute="HREF", fallbacks=("b",)), "m": FieldSpec("a", attribute="title")}).first()
    assert got["h"] == "" and got["m"] is None


def test_typed_items(spark):
    @dataclasses.dataclass
    class Item:
        name: str = harvest_field("b", required=True)
        price: float = harvest_field("i", type="double")
        kind: str = harvest_field("u", type="New|Used")

    rows = pages(spark, (1, "u", "<b>a</b><i>EUR 1.5</i><u>used</u>"), (2, "u", "<i>2</i>"), (3, "u", "<p>"), (4, "u", "<b>d</b><i>1-2</i><u>old</u>"))
    got = extract.bind(extract.extract(rows, fields_of(Item)), fields_of(Item)).orderBy("id").collect()
    assert [(r["id"], r["name"], r["price"], r["kind"]) for r in got] == [(1, "a", 1.5, "Used"), (4, "d", None, None)]


@pytest.mark.parametrize(
    ("text", "kind", "expected"),
    [
        ("19.99", "int", None), ("n 42", "int", 42), ("", "long", None), ("-7", "long", -7), ("2024-02-03", "datetime", datetime.datetime(2024, 2, 3)), ("nope", "datetime", None),
        ("2024-02-03T04:05:06", "datetime", datetime.datetime(2024, 2, 3, 4, 5, 6)), ("/a", "url", None), (" http://x.example/a ", "url", "http://x.example/a"), ("x", "string", "x"),
    ],
)
def test_casts(spark, text, kind, expected):
    assert spark.range(1).select(extract.typed(F.lit(text), kind).alias("v")).first()["v"] == expected


def test_dedup_keeps_the_first(spark):
    rows = spark.createDataFrame([(3, "1", "Alicia"), (1, "1", "Alice"), (2, None, "x"), (4, "", "y"), (5, "2", "Bob")], "n int, id string, name string")
    assert sorted(r["n"] for r in dedup.by_key(rows, "id", ["n"]).collect()) == [1, 2, 5]
    twice = rows.select("id", "name", "n").union(rows.select("id", "name", F.col("n") + 10))
    once = dedup.by_content(twice, ["id", "name"], ["n"])
    assert sorted(r["n"] for r in once.collect()) == [1, 2, 3, 4, 5]
    assert sorted(dedup.by_content(once, ["id", "name"], ["n"]).collect(), key=lambda r: r["n"]) == sorted(once.collect(), key=lambda r: r["n"])


def test_coverage(spark):
    rows = spark.createDataFrame([("a", ""), ("b", None), (None, None), ("", "")], "text string, none string")
    assert [tuple(r) for r in coverage.field_coverage(rows, ["text", "none"]).collect()] == [("text", 2, 0.5)]
    assert coverage.field_coverage(rows.limit(0), ["text"]).count() == 0
    assert "text: 50%" in coverage.print_summary({"pages_fetched": 1, "pages_failed": 0, "items_extracted": 4}, [("text", 0.5)])


def test_reports_are_in_the_order_of_names(spark):
    rows = spark.createDataFrame([("1", "2", "3", "4")], "d string, b string, c string, a string")
    assert [r["field"] for r in coverage.field_coverage(rows, rows.columns).collect()] == ["a", "b", "c", "d"]
    lines = spark.createDataFrame([('{"d":1,"b":1,"c":1,"a":1}',), ("{",)], "value string")
    assert [(r["metric"], r["name"]) for r in coverage.jsonl_stats(lines).collect()] == [*(("field", x) for x in "abcd"), ("items", None), ("malformed", None)]
    assert coverage.print_summary({"pages_fetched": 1, "pages_failed": 0, "items_extracted": 1}, [("b", 1.0), ("a", 0.5)]).splitlines()[-2:] == ["  a: 50%", "  b: 100%"]


def test_an_item_without_any_value_goes(spark):
    rows = pages(spark, (1, "u", "<b>a</b>"), (2, "u", "<p>"), (3, "u", "<i>x</i>"))
    fields = {"name": FieldSpec("b"), "more": FieldSpec("i")}
    assert sorted(r["id"] for r in extract.bind(extract.extract(rows, fields), fields).collect()) == [1, 3]


def test_stats(spark):
    lines = ['{"a":1,"b":"","c":null,"d":[]}', "", "[1]", "{", '{"a":false}', None]
    got = {(r["metric"], r["name"]): r["n"] for r in coverage.jsonl_stats(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {("items", None): 2, ("malformed", None): 2, ("field", "a"): 2, ("field", "d"): 1}


def lines_of(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")


def test_diff(spark):
    old = lines_of(spark, '{"k":1,"v":1}', '{"k":2}', '{"k":true}', "bad", '{"k":"1.0"}')
    new = lines_of(spark, '{"k":1,"v":9}', '{"k":1,"v":1}', '{"k": 2}', '{"k":"new"}', '{"k":null}', "[1]", '{"k":""}')
    got = {r["key"]: r["status"] for r in diff.snapshot_diff(old, new, "k").collect()}
    assert got == {"1": "unchanged", "2": "changed", "True": "removed", "1.0": "removed", "new": "added"}
    same = diff.snapshot_diff(old, old, "k")
    assert {r["status"] for r in same.collect()} == {"unchanged"}
    assert {r["status"]: r["n"] for r in diff.counts(diff.snapshot_diff(old.limit(0), new, "k")).collect()} == {"added": 3}
    assert [r["key"] for r in diff.sample(diff.snapshot_diff(old, new, "k"), "removed", 1).collect()] == ["True"]


def test_json_numbers_keep_their_spelling(spark):
    got = diff.keyed_lines(lines_of(spark, json.dumps({"k": 1}), '{"k":1.0}', '{"k":1e2}'), "k")
    assert sorted(r["key"] for r in got.collect()) == ["1", "1.0", "1e2"]


def test_lines_are_in_the_order_of_files_and_places(spark, tmp_path):
    """The first file is the largest, so it is read last or in several splits; the last line of a key is the last file's."""
    from quarry.sources.readers import json_lines

    line = lambda k, v: json.dumps({"k": k, "v": v, "pad": "x" * 40})
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.jsonl").write_text("\n".join(line(i % 500, ["a", i]) for i in range(4000)))
    (tmp_path / "f" / "b.jsonl").write_text("\n".join(line(i, ["b", i]) for i in range(100, 300)))
    (tmp_path / "f" / "c.jsonl").write_text("\n".join(line(i, ["c", i]) for i in range(200, 250)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("20000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = json_lines(spark, f"file://{tmp_path}/f")
            assert lines.rdd.getNumPartitions() > 5 or size == "128m"
            got = {int(r["key"]): json.loads(r["line"])["v"] for r in diff.keyed_lines(lines, "k").collect()}
            assert got == {k: ["c", k] if 200 <= k < 250 else ["b", k] if 100 <= k < 300 else ["a", 3500 + k] for k in range(500)}
            assert [json.loads(r["line"])["v"] for r in lines.orderBy("line_no").collect()] == [["a", i] for i in range(4000)] + [["b", i] for i in range(100, 300)] + [["c", i] for i in range(200, 250)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_job_that_fails_leaves_the_old_output(spark, tmp_path):
    import sqlite3

    from quarry.sources import sinks

    good = spark.createDataFrame([("a",), ("b",)], "x string")
    bad = spark.range(0, 2000, 1, 8).select(F.when(F.col("id") == 1990, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("x"))
    for kind, append in (("json", False), ("csv", True)):
        sink = sinks.OneFile(str(tmp_path / kind), kind, append)
        sink.write(good)
        before = (tmp_path / kind).read_text()
        with pytest.raises(Exception, match="no"):
            sink.write(bad)
        assert (tmp_path / kind).read_text() == before != ""
    db = str(tmp_path / "d.sqlite")
    sinks.Sqlite(db).write(good)
    with pytest.raises(Exception, match="no"):
        sinks.Sqlite(db).write(bad)
    with sqlite3.connect(db) as found:
        assert found.execute("select count(*) from item").fetchone() == (2,)
