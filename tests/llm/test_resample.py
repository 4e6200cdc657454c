"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from quarry.llm import resample
from quarry.llm._text import ALNUM_ENDS, Words, chunks

DOC = "doc_id long, text string, row long, part int, id string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def brute(docs, target, buckets=10_000, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for count, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            count.update(map(bucket, features(x)))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, x in docs:
        f = features(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if (r[1] + 1) // 2 >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, rows), key=str)


def run(spark, docs, target, **how):
    rows = spark.createDataFrame([(i, x, 0, 0, "y") for i, x in docs], DOC).repartition(3)
    got = resample.resample(rows, spark.createDataFrame([(x,) for x in target], "text string"), **how)
    return sorted((tuple(r) for r in got.collect()), key=str)


LONG = " ".join(f"w{i % 977} " + "é" * (i % 90) for i in range(20_000))
DOCS = [(i, " ".join(f"a{(i * j) % 31}" for j in range(i))) for i in range(60)] + [(100, None), (101, ""), (102, "... ?!"), (103, "Word"), (104, LONG), (105, "x" * 5000 + " y " + "z" * 64 + " " + "z" * 65)]


def test_against_plain_python(spark):
    target = ["a1 a2 a3 A4", "W5 é", None, ""]
    assert run(spark, DOCS, target) == brute(DOCS, target)
    assert run(spark, DOCS, target, buckets=77, percent=60, min_words=1) == brute(DOCS, target, 77, 60, 1)


def test_null_and_repeated_ids_and_empty_sides(spark):
    twice = [(1, "a b c " * 30), (1, "a b c " * 30), (None, "d e f " * 30), (None, None), (2, "g " * 25)]
    assert run(spark, twice, ["a b"], percent=100) == brute(twice, ["a b"], percent=100)
    assert run(spark, DOCS[:30], []) == brute(DOCS[:30], [])
    assert run(spark, [], ["a b"]) == []


def test_a_word_in_every_document_is_split(spark, monkeypatch):
    monkeypatch.setattr(resample, "SHARE", 10)
    docs = [(i, "the " * 40 + f"n{i} n{i % 7}") for i in range(150)]
    assert run(spark, docs, ["the n3 n3"]) == brute(docs, ["the n3 n3"])


def test_hashes_of_words_and_pairs():
    texts = ["a", "", "ab c", "é" * 40 + " b", "x" * 64 + " " + "y" * 65 + " " + "z" * 64, "q" * 200]
    seen = Counter()
    for lo, _, data, offs in chunks(pa.array(texts)):
        row, bucket = resample.feature_keys(Words(data, offs, ALNUM_ENDS, lower=True), 1 << 32)
        seen.update(zip((row + lo).tolist(), bucket.tolist(), strict=True))
    assert seen == Counter((i, zlib.crc32(f.encode())) for i, x in enumerate(texts) for f in features(x))


def test_ranks_over_many_parts(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("score"), "id")
    got = {r["id"]: r["rank"] for r in resample.ranked(rows, F.desc("score"), F.asc("id")).collect()}
    line = sorted(((r["score"], r["id"]) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    assert got == {i: k + 1 for k, (_, i) in enumerate(line)} and np.unique(list(got.values())).size == 5000
