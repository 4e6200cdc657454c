"""Language identification and quality rules against versions in plain Python, and the queries that SQL can't express against brute force on a given table."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import langid, quality, queries
from tests.llm.test_operators import LOW, by_id, corpus

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LONG = ("eine lange Zeile, in der Wörter stehen " * 20_000).strip()  # beyond a chunk of 512 KB


@pytest.fixture(scope="module")
def texts():
    return [*((i, t) for i, t, *_ in corpus()), (1000, LONG), (1001, LONG), (1002, "12 34 !"), (1002, "12 34 !")]


@pytest.fixture
def labelled_docs(spark, texts):
    rows = [(i, t, "xx" if k % 3 else "yy", -1.0, "u", True, 7) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, accepted boolean, log_bytes int").repartition(4)


def trigrams(text):
    letters = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in (text or "").lower().encode())
    padded = b" " + letters + b" "
    return Counter(((padded[i - 1] << 16 | padded[i] << 8 | padded[i + 1]) * 2654435761 % (1 << 32)) >> 19 for i in range(1, len(padded) - 1) if padded[i] != 0x20)


def cosine(counts, idf, centroid):
    weighed = {b: n * float(idf[b]) for b, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in weighed.values()))
    return sum(x * float(centroid[b]) for b, x in weighed.items()) / norm if norm else 0.0


def test_language_against_plain_python(labelled_docs, texts):
    model = langid.fit(labelled_docs, per_language=10_000, most=100_000, centroids=3)
    taught = [t for _, t in texts if t is not None]
    seen = Counter(b for t in taught for b in trigrams(t))
    assert all(model.idf[b] == pytest.approx(math.log((1 + len(taught)) / (1 + n)) + 1, rel=1e-5) for b, n in seen.items())
    assert np.linalg.norm(model.centroids, axis=1) == pytest.approx(1, rel=1e-5) and sorted(set(model.languages)) == ["xx", "yy"]
    got = Counter(map(tuple, langid.predict(labelled_docs, model).select("doc_id", "lang_pred", F.round("score", 4), "accepted").collect()))
    assert sum(got.values()) == len(texts)
    for (i, lang, score, accepted), n in got.items():
        own = [t for k, t in texts if k == i]
        assert n == len(own)  # rows that repeat are scored alike
        if not re.search(r"[^\W\d_]", own[0] or ""):
            assert (lang, score, accepted) == ("und", 0.0, False)
            continue
        counts = trigrams(own[0])
        sims = [cosine(counts, model.idf, c) for c in model.centroids]
        assert score == pytest.approx(max(sims), abs=2e-4)
        assert max(s for s, x in zip(sims, model.languages, strict=True) if x == lang) == pytest.approx(max(sims), abs=1e-5)
        assert accepted == (max(sims) >= model.floor[lang]) or abs(max(sims) - model.floor[lang]) < 1e-5


def test_language_centroids_are_means_of_their_texts():
    rng = np.random.default_rng(1)
    x = np.abs(np.concatenate([rng.normal(0, 0.02, (40, 12)) + np.eye(12)[k] for k in range(3)]))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = langid._kmeans(x, 3)
    own = (x @ c.T).argmax(1)
    assert len(set(own.tolist())) == 3
    for k in range(3):
        mean = x[own == k].mean(0)
        assert c[k] == pytest.approx(mean / np.linalg.norm(mean))


def test_language_ties_and_carried_columns(spark):
    one = np.full((1, langid.BINS), 1 / math.sqrt(langid.BINS), np.float32)
    model = langid.Model(["aa", "bb"], np.concatenate([one, one]), np.ones(langid.BINS, np.float32), {"aa": 0.0, "bb": 0.0})
    docs = spark.createDataFrame([(1, "some words", "x"), (2, None, "y"), (2, "", "z")], "doc_id long, text string, source string")
    got = langid.predict(docs, model, carry=("doc_id", "text", "source")).collect()
    assert sorted((r["doc_id"], r["text"] or "", r["source"], r["lang_pred"]) for r in got) == [(1, "some words", "x", "aa"), (2, "", "y", "und"), (2, "", "z", "und")]


def plain_statistics(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    share = lambda n, of: n / max(of, 1)
    count = lambda chars: share(sum(b in chars for b in raw), len(raw))
    breaks = sum(b in b"\n\r" for b in raw)
    pairs = list(zip(words, words[1:], strict=False))
    return {
        "log_bytes": math.log1p(len(raw)), "log_words": math.log1p(len(words)), "word_length": share(sum(map(len, words)), len(words)),
        "longest_word": math.log1p(max(map(len, words), default=0)), "upper": count(range(0x41, 0x5B)), "digit": count(range(0x30, 0x3A)),
        "punctuation": count(b".,;:?'\"()-"), "symbol": count(b"#$%&*+<=>@[]^_`{}~\\/"), "bar_or_bang": count(b"|!"), "line_break": count(b"\n\r"),
        "non_ascii": count(range(0x80, 0x100)), "distinct_words": share(len(set(words)), len(words)),
        "top_word": share(max(Counter(words).values(), default=0), len(words)), "words_per_line": math.log1p(len(words) / (breaks + 1)),
        "bare_words": share(sum(w[-1] >= 0x80 or 0x61 <= w[-1] <= 0x7A for w in words), len(words)),
        "repeated_pairs": 1 - len(set(pairs)) / len(pairs) if pairs else 0.0,
    }


def test_quality_against_plain_python(labelled_docs, texts):
    stats = quality.statistics(labelled_docs)
    own = {i: plain_statistics(t) for i, t in texts}
    assert stats.columns == ["doc_id", *quality.STATISTICS] and stats.count() == len(texts)
    for r in stats.collect():
        assert {c: r[c] for c in quality.STATISTICS} == pytest.approx(own[r["doc_id"]])
    label = F.when(F.col("doc_id") == 3, F.lit(None)).otherwise((F.col("distinct_words") > 0.5).cast("int"))
    rules = quality.fit(stats.withColumn("label", label))
    assert rules == quality.fit(stats.repartition(7, "top_word").withColumn("label", label)) and rules.rules
    for r in stats.select("doc_id", rules.score().alias("score")).collect():
        total = rules.bias
        for weight, rule in rules.rules:
            if all(own[r["doc_id"]][name] <= cut if op == "<=" else own[r["doc_id"]][name] > cut for name, op, cut in rule):
                total += weight
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)))


def test_lasso_weights_are_optimal():
    rng = np.random.default_rng(5)
    x = (rng.random((400, 9)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x[:, 0] - 2 * x[:, 3])))).astype(float)
    penalty = 0.02
    bias, w = quality._lasso_logistic(x, y, penalty, rounds=5000)
    slope = x.T @ (1 / (1 + np.exp(-(bias + x @ w))) - y) / len(y)
    assert (w == 0).any() and (w != 0).any()
    assert slope[w != 0] == pytest.approx(-penalty * np.sign(w[w != 0]), abs=1e-5) and (np.abs(slope[w == 0]) <= penalty + 1e-5).all()


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_query_on_held_out_rows(spark):
    docs = by_id(queries.table(spark, LARGER, "documents"))
    got = by_id(queries.op4_language_id(spark, LARGER))
    assert set(got) == set(docs) and all(r["held_out"] == (fold(i, 5) == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    known = [i for i, r in got.items() if r["held_out"] and docs[i]["lang"] is not None and re.search(r"[^\W\d_]", docs[i]["text"] or "")]
    assert len(known) > 100 and np.mean([got[i]["lang_pred"] == docs[i]["lang"] for i in known]) >= 0.95


def test_quality_query_on_held_out_rows(spark):
    label = {r["doc_id"]: r["quality"] for r in queries.table(spark, LARGER, "labels").collect()}
    got = by_id(queries.op6_quality_rules(spark, LARGER))
    assert len(got) == queries.table(spark, LARGER, "documents").count()
    assert all(r["held_out"] == (fold(i, 4) == 2) and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    good, bad = ([got[i]["score"] for i in label if i in got and got[i]["held_out"] and label[i] == k] for k in (1, 0))
    assert good and bad and np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) >= 0.95


def test_token_queries(spark):
    import public_tokenizers
    import tiktoken

    with open(queries.byte_bpe_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {i: r["text"] or "" for i, r in by_id(queries.table(spark, DATA, "documents")).items()}
    ids = {i: encoding.encode_ordinary(t) for i, t in docs.items()}
    got = by_id(queries.op9_byte_bpe(spark, DATA))
    assert {i: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for i, r in got.items()} == {
        i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(docs[i].encode()).hexdigest()) for i, x in ids.items()
    }
    packed = queries.op1_token_packing(spark, DATA)
    assert packed.agg(F.sum("n_tokens")).first()[0] == sum(map(len, ids.values())) and packed.where("n_tokens > 2048").count() == 0


def test_katz_query(spark):
    docs = by_id(queries.table(spark, DATA, "documents"))
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(LOW)), None] for i, r in docs.items()}
    count = Counter(w for i, t in tokens.items() if fold(i, 7) != 2 for w in t)
    total = sum(count.values())
    got = by_id(queries.op8_katz_backoff(spark, DATA))
    assert set(got) == set(docs)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i, 7) == 2, len(t), sum(w in count for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in t))
        assert r["score"] < 0 and (r["held_out"] or len(t) < 50 or r["score"] > r["base_score"])
