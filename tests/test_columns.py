import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import transforms, urls
from quarry.functions.transforms import Transform
from quarry.operators import politeness


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "names", "expected"),
    [
        ("  a b \n", ["trim"], "a b"), ("AbÉ", ["LOWERCASE"], "abé"), ("straße", ["Uppercase"], "STRAßE"), ("Hello   \n  World ", ["CollapseWhitespace"], "Hello World"), ("1,299 items", ["StripNonDigits"], "1299"),
        ("$1,299.00 ", ["StripCurrencySymbols"], "1,299.00"), (None, ["trim"], None), ("abc", ["StripNonDigits"], ""), (" A  B ", ["trim", "collapsewhitespace", "lowercase"], "a b"), ("x", [], "x"),
    ],
)
def test_transforms(spark, text, names, expected):
    assert value(spark, transforms.apply(F.lit(text).cast("string"), transforms.parse_names(names))) == expected


def test_unknown_transforms_warn():
    with pytest.warns(UserWarning):
        assert transforms.parse_names(["trim", "nope"]) == [Transform.TRIM]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://example.com/page?utm_source=x&id=5", "https://example.com/page?id=5"), ("https://example.com/page#section", "https://example.com/page"), ("https://example.com/page/", "https://example.com/page"),
        ("https://example.com/", "https://example.com/"), ("https://example.com", "https://example.com/"), ("HTTP://EXAMPLE.com:80/A/?b=1&%75tm_source=2&REF=3&c", "http://example.com/A?b=1&c"), ("https://x.example:444/p?a=%zz", "https://x.example:444/p?a=%zz"),
        ("not a url", "not a url"), (None, None),
    ],
)
def test_normalize(spark, url, expected):
    assert value(spark, urls.normalize(F.lit(url).cast("string"))) == expected


def test_normalize_is_idempotent(spark):
    part = st.text(alphabet="abA/=&?#%.:", max_size=12)

    @settings(max_examples=1, deadline=None)
    @given(st.lists(part, min_size=200, max_size=200))
    def check(parts):
        df = spark.createDataFrame([(f"http://h.example/{p}",) for p in parts], "u string")
        once = df.select(urls.normalize(F.col("u")).alias("u"))
        assert once.collect() == once.select(urls.normalize(F.col("u")).alias("u")).collect()

    check()


def test_keys(spark):
    u = F.lit("http://X.example/Path?ref=1#f")
    assert value(spark, urls.visited_key(u)) == "http://x.example/path"
    assert value(spark, urls.visited_key(u, False)) == "http://x.example/path?ref=1#f"
    assert value(spark, urls.cache_name(F.lit("http://x.example/"))).endswith(".html")
    assert [value(spark, urls.is_absolute(F.lit(x))) for x in ("http://x.example", "mailto:a@b", "/a", "not a url")] == [True, True, False, False]


ROBOTS = "User-agent: BadBot\nDisallow: /\nCrawl-delay: 60\n# c\n\nUser-agent: *\nDisallow: /only-this\nDisallow:\ncrawl-delay: 2.5\r\nCrawl-delay: x\n"


def test_robots(spark):
    rules = value(spark, politeness.robots_rules(F.lit(ROBOTS)))
    assert rules["disallow"] == ["/only-this"] and rules["crawl_delay"] == 2.5
    d = F.array(F.lit("/Only"))
    assert [value(spark, politeness.is_allowed(F.lit(p), d)) for p in ("/public", "/only-this?x", "/ONLY")] == [True, False, False]
    assert value(spark, politeness.is_allowed(F.lit("/"), F.lit(None).cast("array<string>"))) is True
    none = value(spark, politeness.robots_rules(F.lit("User-agent: BadBot\nCrawl-delay: 60\nUser-agent: *\n")))
    assert none["disallow"] == [] and none["crawl_delay"] is None


@pytest.mark.parametrize(("ok", "expected"), [([True, False, False, True], 3.4), ([False] * 10, 16.0), ([False] * 2 + [True] * 20, 1.0), ([], 1.0), ([None, False], 2.0), ([True, False], 2.0)])
def test_multiplier(spark, ok, expected):
    assert value(spark, politeness.multiplier(F.lit(ok).cast("array<boolean>") if ok else F.array().cast("array<boolean>"))) == pytest.approx(expected)


def test_schedule_is_the_recurrence(spark):
    import random

    rng = random.Random(1)
    rows = [(h, float(rng.randint(0, 3000)), i) for i, h in enumerate(rng.choice("ab") for _ in range(200))]
    got = {r["seq"]: r["start_ms"] for r in politeness.schedule(spark.createDataFrame(rows, "host string, arrival_ms double, seq long"), 25.0).collect()}
    last = {}
    for h, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        last[h] = t if h not in last else max(t, last[h] + 25)
        assert got[i] == pytest.approx(last[h])


def test_rotation_and_retries(spark):
    assert [value(spark, politeness.rotate(["A", "B"], F.lit(i))) for i in range(3)] == ["A", "B", "A"]
    with pytest.raises(ValueError):
        politeness.rotate([], F.lit(0))
    assert [value(spark, politeness.is_retryable(F.lit(s))) for s in (200, 404, 429, 500, 503)] == [False, False, True, True, True]
    assert value(spark, politeness.retry_delay_ms(F.lit(2), 1000, F.lit(0))) == 4000
    assert value(spark, politeness.retry_delay_ms(F.lit(2), 1000, F.lit(7))) == 7000
    from quarry.sources.fetch import retry_wait_s

    assert [retry_wait_s(1, x, 1000, 0) for x in (None, "3", "0", "Thu, 01 Jan 1970 00:00:09 GMT", "junk")] == [2, 3, 2, 9, 2]


def test_plain_urls_normalize_like_all_others(spark, monkeypatch):
    rows = [(f"{s}{h}{p}",) for s in ("http://", "HTTPS://", "s3+x://") for h in ("a.example", "A.b", "a:80", "u@a", "é") for p in ("", "/", "//", "/a", "/A/b;c=1", "/a/", "/a?b=1&ref=2", "/a#t", "/a\n", "/a/\u2028", "/é", "/a b")]
    df = spark.createDataFrame(rows, "u string")
    fast = df.select(urls.normalize(F.col("u"))).collect()
    monkeypatch.setattr(urls, "_NORMAL", "(?!)")
    assert fast == df.select(urls.normalize(F.col("u"))).collect()
