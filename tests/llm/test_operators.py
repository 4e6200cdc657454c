"""Each operator against a brute-force version on a small fixture with nulls, empty and long texts, ties, repeated rows, and clashing extra columns."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, embed, jaccard, katz, langid, packing, quality, substring, warc

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, id string, n int, n_words long, items string, spans string"


def corpus(seed=1, n=60):
    """Texts of a few words, some null, empty, of white space, very long, repeated or nearly so."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "été", "Über", "a1", "x.y", "日本", "don't", *(f"w{i}" for i in range(40))]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = [None, "", "  \n\t ", "one", "two words", make(3000), "x" * 5000, "rep " * 300, "The the THE"]
    base = make(120)
    texts += [base, base, base.upper()]
    for _ in range(10):
        w = base.split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append("  ".join(w))
    passage = make(50)
    texts += [f"{make(20)} {passage}\n{make(rng.randint(0, 60))}" for _ in range(6)]
    texts += [make(rng.randint(1, 80)) for _ in range(n - len(texts))]
    return [(i * 3, t, "clash", 5, -1, "c", "d") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def empty(docs):
    return docs.limit(0)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize(("size", "bucket", "chunk"), [(6, 1 << 24, 1 << 22), (6, 2000, 1500), (2, 2000, 1500), (35, 2000, 1500)])
def test_substring(docs, rows, monkeypatch, size, bucket, chunk):
    for name, v in (("BUCKET", bucket), ("CHUNK", chunk)):
        monkeypatch.setattr(substring, name, v)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, *_ in rows}
    seen = Counter(tuple(w[k : k + size]) for w in words.values() for k in range(len(w) - size + 1))
    got = by_id(substring.report(docs, substring.repeated(docs, size)))
    assert len(got) == len(rows)
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - size + 1) if seen[tuple(w[k : k + size])] > 1 for j in range(size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_substring_edges(spark, docs):
    cut = by_id(substring.remove(docs, substring.repeated(docs, 6)))
    assert cut[0]["text"] is None and cut[3]["text"] == "" and cut[9]["items"] == "c" and cut[6]["text"] == "  \n\t "
    assert substring.report(empty(docs), substring.repeated(empty(docs), 3)).count() == 0
    twice = docs.union(docs)
    assert substring.report(twice, substring.repeated(twice, 3)).where("n_words >= 3 and n_removed < n_words").count() == 0
    with pytest.raises(ValueError):
        substring.repeated(docs, 1)


def test_substring_ids_that_are_null_or_repeat(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    own = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, f"{own('a', 5)} {passage}"), (1, own("b", 60)), (None, f"{passage} {own('c', 9)}"), (None, own("d", 50)), (1, f"{own('e', 70)} {passage}"), (2, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["n_words"], r["n_removed"]) for r in substring.report(docs, substring.repeated(docs)).collect())
    assert got == [(1, 0), (45, 40), (49, 40), (50, 0), (60, 0), (110, 40)]
    left = sorted(len((r["text"] or "").split()) for r in substring.remove(docs, substring.repeated(docs)).collect())
    assert left == [1, 5, 9, 50, 60, 70]


def test_substring_meetings_are_verified(docs, rows, monkeypatch):
    """With edges of four bits nearly all meet; only those with equal words may cut anything, and digests see to it."""
    real = substring.FIRST.grams
    monkeypatch.setattr(type(substring.FIRST), "grams", lambda self, h, k: real(h, k) >> np.uint64(60) << np.uint64(60))
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, *_ in rows}
    seen = Counter(tuple(w[k : k + 6]) for w in words.values() for k in range(len(w) - 5))
    for i, r in by_id(substring.report(docs.coalesce(1), substring.repeated(docs.coalesce(1), 6))).items():
        w = words[i]
        assert r["n_removed"] <= len({k + j for k in range(len(w) - 5) if seen[tuple(w[k : k + 6])] > 1 for j in range(6)})


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50), (2, 100)])
def test_jaccard(docs, rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = by_id(jaccard.Join(docs, k, percent).components())
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_edges(spark, docs):
    assert jaccard.Join(empty(docs)).components().count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "A b  c"), (3, None), (4, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.Join(twice, 2, 90).components().collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4)]
    with pytest.raises(ValueError):
        jaccard.Join(docs, percent=0)


@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_decontamination(spark, docs, rows, block_words):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = lambda t: re.findall(pattern, (t or "").translate(LOW))
    items = [(1, rows[9][1][:200]), (2, "rep REP rep"), (3, None), (4, ""), (5, "one"), (6, "nowhere " * 12), (7, "rep rep, rep"), (10, rows[23][1])]
    got = by_id(decontaminate.report(decontaminate.scan(docs, spark.createDataFrame(items, "item_id long, text string"), 10, block_words=block_words)))
    windows = defaultdict(set)
    for k, t in items:
        w = split(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(str(k))
    for i, t, *_ in rows:
        w, hit, found = split(t), set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if tuple(w[j : j + size]) in windows:
                    hit |= set(range(j, j + size))
                    found |= windows[tuple(w[j : j + size])]
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit)), i
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_items_without_an_id_are_spread_over_blocks(spark, monkeypatch):
    """Many items of one id or of none: each is in one block, no block has all of them, and executors build the blocks."""
    sizes, save = [], decontaminate._save
    texts = [f"a{i} b{i % 7} c{i % 11} d{i} e{i % 3}" for i in range(10_000)]
    items = spark.createDataFrame([(None if i % 2 else 5, t) for i, t in enumerate(texts)] + [(5, texts[0])] * 50, "item_id long, text string").repartition(4)
    docs = spark.createDataFrame([(i, f"x {texts[i]} y" if i % 2 else f"x {texts[i][1:]} y") for i in range(400)], "doc_id long, text string")
    got = by_id(decontaminate.report(decontaminate.scan(docs, items, block_words=5000)))
    monkeypatch.setattr(decontaminate, "_save", lambda *a: (sizes.append(a), save(*a)))
    assert decontaminate.scan(docs, items, block_words=5000).count() == 400 and sizes == []
    assert all((r["contaminated"], r["n_hit"], r["n_items"]) == ((True, 5, 1) if i % 2 else (False, 0, 0)) for i, r in got.items())
    letters = sum(map(len, texts))
    blocks = -(-letters // 10_000)
    spread = items.distinct().groupBy(F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(blocks))).count().agg(F.max("count"), F.count("*")).first()
    assert spread[1] == blocks and spread[0] < 3 * 10_000 / blocks


def test_decontamination_edges(spark, docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(decontaminate.scan(docs, none)).where("contaminated").count() == 0
    item = spark.createDataFrame([(1, "Two WORDS")], "item_id long, text string")
    assert decontaminate.clean(docs, item).count() == len(rows) - 1
    small = spark.createDataFrame([(1, "see two, words here", "x"), (2, None, "y")], "doc_id long, text string, hits string")
    cut = by_id(decontaminate.clean(small, item, "spans"))
    assert cut[1]["text"] == "see  here" and cut[2]["text"] is None and cut[1]["hits"] == "x"
    assert decontaminate.clean(empty(docs), item).count() == 0
    with pytest.raises(ValueError):
        decontaminate.clean(docs, item, "words")


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding(ranks):
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})


def test_bpe(spark, docs, rows, ranks, encoding):
    got, ids, back = by_id(bpe.round_trip(docs, ranks)), by_id(bpe.encode(docs, ranks)), by_id(bpe.decode(bpe.encode(docs, ranks), ranks))
    for i, t, *_ in rows:
        want = encoding.encode_ordinary(t or "")
        raw = np.array(want, "<u4").tobytes()
        assert ids[i]["ids"] == raw and back[i]["text"] == (t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(want), hashlib.sha256(raw).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(empty(docs), ranks).count() == 0


def test_bpe_pieces(ranks, encoding):
    import pyarrow as pa

    from quarry.llm._text import chunks

    rng = random.Random(1)
    parts = ["a", "b", "'s", "'S", "'", "'re", "'ll", "'stop", "'vex", " ", "  ", "\n", "\t", "\xa0", "　", "\x85", "1", "½", "é", "日本", "!", "?!", "''", "\x00", "😀", " x'd ", "ſ", "hello", "zqxj" * 30]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["a" * 3000, " " * 2000 + "b", "ab" * 2000, "'" * 99]
    m = bpe.Merger(ranks)
    m.CACHE = 500  # so that the cache is emptied now and then
    for lo, hi, data, offs in chunks(pa.array(texts)):
        ids, at = m.encode(data, offs)
        for i in range(hi - lo):
            assert ids[at[i] : at[i + 1]].tolist() == encoding.encode_ordinary(texts[lo + i]), texts[lo + i]


@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_packing(docs, rows, ranks, encoding, capacity):
    want = {i: encoding.encode_ordinary(t or "") for i, t, *_ in rows}
    found, total = defaultdict(dict), 0
    for r in packing.pack(docs, ranks, capacity).collect():
        ids, positions, cu = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(positions) == capacity and cu[0] == 0 and cu[-1] == r["n_tokens"] <= capacity
        for k, (doc, part) in enumerate(zip(r["doc_ids"], r["parts"], strict=True)):
            assert part not in found[doc]
            found[doc][part] = ids[cu[k] : cu[k + 1]].tolist()
            assert positions[cu[k] : cu[k + 1]].tolist() == list(range(cu[k + 1] - cu[k]))
        assert not ids[cu[-1] :].any() and not positions[cu[-1] :].any()
        total += 1
    assert {i: [x for p in sorted(found[i]) for x in found[i][p]] for i in found} == {i: w for i, w in want.items() if w}
    assert total >= sum(map(len, want.values())) / capacity


def test_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([1, 2, 7, 64])
        lengths = np.array(sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 60))), reverse=True), int)
        rooms = []
        for n in lengths.tolist():
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((capacity if fit is None else fit) - n)
        rows = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(capacity - int(lengths[r].sum()) for r in rows) == sorted(rooms)
        assert sorted(p for r in rows for p in r) == list(range(len(lengths)))


def test_packing_files(docs, ranks, tmp_path):
    packed = packing.pack(docs, ranks, 64)
    assert packing.write(packed, f"file://{tmp_path}/out", ranks).agg(F.sum("rows")).first()[0] == packed.count()
    ids, cu, offs = (np.load(tmp_path / "out" / f"{n}-000000.npy") for n in ("ids", "cu_seqlens", "cu_offsets"))
    assert ids.shape[1] == 64 and len(offs) == len(ids) + 1 and offs[-1] == len(cu)
    assert np.load(tmp_path / "out" / "positions-000000.npz")["positions"].shape == ids.shape
    assert packing.pack(empty(docs), ranks).count() == 0
    assert packing.digest(packed).columns[-2:] == ["ids_sha256", "positions_sha256"]
    with pytest.raises(ValueError):
        packing.pack(docs, ranks, 0)


def test_embeddings_of_repeated_ids_and_several_lengths(spark):
    e = np.eye(4)
    rows = [(1, [*e[0]]), (1, [*e[1]]), (2, [*(e[0] + 0.1 * e[2])]), (3, [*(e[1] + 0.1 * e[2])]), (4, [*(e[1] + 0.1 * e[3])]), (None, [*(e[3] + 0.1 * e[2])]), (9, [*e[3]])]
    rows += [(20 + i, [1.0, 0.1 * i]) for i in range(3)] + [(30, [1.0]), (31, [2.0]), (32, [-2.0]), (40, [1.0, 1.0, 1.0])]
    rows = [(i, [float(y) for y in v]) for i, v in rows]
    got = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), 0.95).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in got) == sorted(
        [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (0, 1, 9), (9, 1, 9), (20, 2, 20), (21, 2, 20), (22, 2, 20), (30, 1, 30), (31, 1, 30), (32, 0, 32), (40, 0, 40)]
    )


def test_pairs_just_above_the_threshold(spark):
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.standard_normal((3000, 64)))
    r = rng.standard_normal((1000, 64))
    r = unit(r - (r * x[:1000]).sum(1, keepdims=True) * x[:1000])
    c = rng.uniform(0.9505, 0.96, (1000, 1))
    rows = [(i, [float(v) for v in y]) for i, y in enumerate([*x, *(c * x[:1000] + np.sqrt(1 - c**2) * r)])]
    got = by_id(embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95), "vec_id")
    assert np.mean([got[3000 + i]["component_id"] == i for i in range(1000)]) >= 0.97 and all(got[i]["n_links"] == 0 for i in range(1000, 3000))


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((1500, 32))
    near = base[:200] + 0.15 * rng.standard_normal((200, 32))
    chain = np.array([np.cos(a) * base[0] / np.linalg.norm(base[0]) + np.sin(a) * np.eye(32)[3] for a in np.linspace(0, 1, 6)])
    tight = base[7] + 0.05 * rng.standard_normal((700, 32))
    x = [*base, *near, *chain, *tight, base[3], 2 * base[3], base[3]]
    rows = [(i * 2, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [1.0] * 31, [float("inf")] + [0.0] * 31]
    rows += [(100_000 + i, v) for i, v in enumerate(odd)]
    got = by_id(embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit(0)).repartition(3), 0.95), "vec_id")
    unit = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    root = np.arange(len(x)) * 2
    a, b = np.nonzero(link)
    while True:
        old = root.copy()
        np.minimum.at(root, a, root[b])
        if (old == root).all():
            break
    n, found = link.sum(1), np.array([got[i * 2]["n_links"] for i in range(len(x))])
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum()
    assert np.mean([got[i * 2]["component_id"] == root[i] for i in range(len(x))]) > 0.99
    for i in range(len(odd)):
        assert (got[100_000 + i]["n_links"], got[100_000 + i]["component_id"], got[100_000 + i]["kept"]) == (0, 100_000 + i, True)
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert embed.near_duplicates(none).first()["kept"] and embed.near_duplicates(none.limit(0)).count() == 0


def test_language(spark):
    rng = random.Random(2)
    parts = {"xx": ["ka", "lo", "mi"], "yy": ["str", "engt", "hz"], "zz": ["é", "où", "ça"]}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(lang := rng.choice(list(parts)), rng.randint(3, 60)), lang, "s") for i in range(400)]
    rows += [(1000, None, "xx", "s"), (1001, "", "yy", "s"), (1002, "12 !? 3", "zz", "s"), (1003, make("xx", 5000).upper(), None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    held = langid.fold("doc_id", 5) == 0
    got = by_id(langid.predict(docs, langid.fit(docs.where(~held), per_language=60)))
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang, _ in rows[:400]]) > 0.98
    for i in (1000, 1001, 1002):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["accepted"]) == ("und", 0.0, False)
    assert got[1003]["lang_pred"] == "xx" and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[i]["accepted"] for i in range(400)]) > 0.98
    nothing = langid.predict(docs, langid.fit(docs.where("lang = 'none'")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert langid.predict(empty(docs), langid.fit(docs)).count() == 0
    assert spark.range(1).select(langid.fold("id", 5)).first()[0] == zlib.crc32(b"0") % 5


def test_quality(spark):
    rng = random.Random(4)
    good = lambda: ". ".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(rng.randint(4, 9))) for _ in range(5))
    bad = lambda: rng.choice([" ".join(["SPAM!!"] * rng.randint(5, 60)), " ".join(f"a{rng.random()}###" for _ in range(20))])
    rows = [(i, (good if i % 2 else bad)(), i % 2) for i in range(500)] + [(600, None, None), (601, "", 0), (602, "x " * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    stats = quality.statistics(docs)
    assert stats.count() == len(rows) and stats.where("doc_id in (600, 601)").select(*quality.STATISTICS).distinct().count() == 1
    labelled = stats.join(docs.select("doc_id", "label"), "doc_id")
    rules = quality.fit(labelled.where("doc_id < 300"), max_labelled=250)
    assert 0 < len(rules.rules) < 200
    got = by_id(stats.select("doc_id", rules.score().alias("score")))
    assert np.mean([(got[i]["score"] >= 0.5) == bool(i % 2) for i in range(300, 500)]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.fit(labelled.where("label = 1")).rules == [] and quality.fit(labelled.limit(0)).bias == 0
    assert quality.statistics(empty(docs)).count() == 0


def test_statistics_by_hand():
    import pyarrow as pa

    from quarry.llm._text import chunks

    ((_, _, data, offs),) = chunks(pa.array(["Ab ab 1!\nab #x", "", "q"]))
    s = [dict(zip(quality.STATISTICS, r, strict=True)) for r in quality.statistics_of(data, offs)]
    assert s[0]["log_words"] == pytest.approx(math.log1p(5)) and s[0]["distinct_words"] == pytest.approx(4 / 5) and s[0]["top_word"] == pytest.approx(2 / 5)
    assert s[0]["upper"] == pytest.approx(1 / 14) and s[0]["line_break"] == pytest.approx(1 / 14) and s[0]["bar_or_bang"] == pytest.approx(1 / 14)
    assert s[0]["word_length"] == pytest.approx(10 / 5) and set(s[1].values()) == {0}


def test_warc(spark, tmp_path):
    big, small = "é" * 600, "x" * 999
    rows = [(1, "http://a.example/", big), (5, None, big), (3, "http://b.example/\nx", big), (7, "u", small), (8, "u", small), (9, "", None), (10, "u", ""), (11, "u", "y" * 1000), (11, "u", "y" * 1000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, key string").repartition(2)
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(warc.plan(pages), folder, archive_bytes=600)
    got = sorted(warc.read(manifest, folder, payloads=True).collect(), key=lambda r: r["page_id"])
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == [(1, "revisit", 5), (3, "revisit", 5), (5, "response", None), *((i, "response", None) for i in (7, 8, 9, 10, 11, 11))]
    html = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(r["verified"] and r["payload_bytes"] == len(html[r["page_id"]]) and r["payload_digest"] == hashlib.sha1(html[r["page_id"]]).hexdigest() for r in got)
    assert all(r["payload"] == html[r["page_id"]] for r in got if r["record_type"] == "response")
    (tmp_path / "w" / "stray.warc.gz").write_bytes(b"a failed attempt's")
    again = warc.read(manifest, folder).collect()
    assert len(again) == len(rows)
    with gzip.open(manifest.first()["path"]) as f:
        assert f.readline() == b"WARC/1.1\r\n"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_records_are_checked():
    raw = warc.record(4, "u", b"payload", None, "2000-01-01T00:00:00Z")
    fields, http, payload, ok = warc.parse(raw)
    assert ok and payload == b"payload" and http["content-length"] == "7" and warc.number(fields["warc-record-id"]) == 4
    assert not warc.parse(raw.replace(b"payload\r", b"pAyload\r"))[3]
    with pytest.raises(ValueError):
        warc.parse(raw[:-6])
    import io

    stream = io.BytesIO(gzip.compress(raw) + gzip.compress(raw))
    assert list(warc.members(stream)) == [raw, raw]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(gzip.compress(raw)[:-12])))


def test_a_large_record_is_read_in_little_memory():
    import io
    import tracemalloc

    payload = b"0123456789abcdef" * (4 << 20)
    stream = gzip.compress(warc.record(7, "u", payload, None, "2000-01-01T00:00:00Z"), 1) + gzip.compress(warc.record(8, "u", b"small", 7, "2000-01-01T00:00:00Z"))
    want, size = hashlib.sha1(payload).hexdigest(), len(payload)
    del payload
    tracemalloc.start()
    got = [(warc.number(r.fields["warc-record-id"]), r.size, r.payload.hexdigest(), ok) for r, ok in warc.framed(io.BytesIO(stream))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(7, size, want, True), (8, 0, hashlib.sha1(b"").hexdigest(), True)] and peak < 4 << 20
    broken = gzip.compress(warc.record(7, "u", b"x" * 200_000, None, "2000-01-01T00:00:00Z")[:-4])
    with pytest.raises(ValueError):
        list(warc.framed(io.BytesIO(broken)))


def test_a_page_id_twice_with_other_html(spark):
    pages = spark.createDataFrame([(1, "u", "a" * 1200), (1, "u", "b" * 1200), (2, "u", "a" * 1200), (None, None, None)], "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == [(0, 0, "response", None), (1, 1200, "response", None), (1, 1200, "revisit", 2), (2, 1200, "response", None)]



@pytest.mark.parametrize(("bucket", "chunk", "hot"), [(1 << 24, 1 << 22, 1024), (2000, 3000, 8)])
def test_katz(docs, rows, monkeypatch, bucket, chunk, hot):
    for name, v in (("BUCKET", bucket), ("CHUNK", chunk), ("HOT", hot)):
        monkeypatch.setattr(katz, name, v)
    got = by_id(katz.score(docs, langid.fold("doc_id", 7) != 2))
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), "</s>"] for i, t, *_ in rows}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2}
    one, two = Counter(), Counter()
    for i in train:
        one.update(tokens[i])
        two.update(zip(["<s>", *tokens[i][:-1]], tokens[i], strict=True))

    def discount(counts):
        n, d = Counter(counts.values()), dict.fromkeys(range(1, 6), 1.0)
        tail = 6 * n[6] / n[1] if n[1] and n[6] else 1
        for r in range(1, 6):
            if n[r] and tail < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
                d[r] = x if 0 < x < 1 else 1.0
        return lambda c: c * d.get(c, 1.0)

    d1, d2, total = discount(one), discount(two), sum(one.values())
    gone = total - sum(map(d1, one.values()))
    p1 = lambda w: d1(one[w]) / (total if gone > 1e-9 else total + 1) if w in one else (gone / total if gone > 1e-9 else 1 / (total + 1))
    after = defaultdict(list)
    for (h, w), c in two.items():
        after[h].append((w, c))

    def p2(h, w):
        if h not in after:
            return p1(w)
        n = sum(c for _, c in after[h])
        left = n - sum(d2(c) for _, c in after[h])
        n, left = (n, left) if left > 1e-9 else (n + 1, 1)
        return d2(two[h, w]) / n if (h, w) in two else left / n / (1 - sum(p1(x) for x, _ in after[h])) * p1(w)

    for h in ["<s>", "the", "rep", *list(after)[:5]]:
        assert sum(p2(h, w) for w in one) + p2(h, "\0") == pytest.approx(1)
    for i, t in tokens.items():
        r = got[i]
        assert (r["train"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in train, len(t), sum(w in one for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((one[w] + 1) / (total + len(one) + 1)) for w in t))
        assert r["score"] == pytest.approx(sum(math.log10(p2(h, w)) for h, w in zip(["<s>", *t[:-1]], t, strict=True)))


def test_katz_edges(docs):
    assert katz.score(empty(docs), F.lit(True)).count() == 0
    untaught = katz.score(docs, F.lit(False)).where("doc_id in (0, 9)").collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in untaught} == {(0, 0, 0.0)}


def test_few_embeddings(spark):
    rows = [(i, [1.0, 2.0]) for i in range(5)] + [(9, [2.0, 4.0]), (10, [2.0, -1.0])]
    got = by_id(embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), "vec_id")
    assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in (0, 4, 9, 10)] == [(5, 0, True), (5, 0, False), (5, 0, False), (0, 10, True)]
    one = by_id(embed.near_duplicates(spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>")), "vec_id")
    assert one[0]["n_links"] == 0 and one[0]["kept"]


@pytest.mark.parametrize(("order", "bucket", "chunk", "hot"), [(3, 1 << 24, 1 << 22, 1024), (3, 2000, 3000, 8), (4, 2000, 3000, 8)])
def test_katz_orders(docs, rows, monkeypatch, order, bucket, chunk, hot):
    for name, v in (("BUCKET", bucket), ("CHUNK", chunk), ("HOT", hot)):
        monkeypatch.setattr(katz, name, v)
    got = by_id(katz.score(docs, langid.fold("doc_id", 7) != 2, order=order))
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), "</s>"] for i, t, *_ in rows}
    grams = lambda t, k: [tuple((["<s>"] * (k - 1) + t)[j : j + k]) for j in range(len(t))]
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = [Counter(g for i in train for g in grams(tokens[i], k)) for k in range(1, order + 1)]
    factors, after = [], [defaultdict(list) for _ in counts]
    for k, c in enumerate(counts):
        n, d = Counter(c.values()), dict.fromkeys(range(1, 6), 1.0)
        tail = 6 * n[6] / n[1] if n[1] and n[6] else 1
        for r in range(1, 6):
            if n[r] and tail < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
                d[r] = x if 0 < x < 1 else 1.0
        factors.append(d)
        for g in c:
            after[k][g[:-1]].append(g)
    backoff = {}

    def own(g):
        k = len(g) - 1
        return counts[k][g] * factors[k].get(counts[k][g], 1.0)

    def prob(g):
        k, h = len(g) - 1, g[:-1]
        seen = after[k].get(h)
        if not seen:
            return prob(g[1:])
        n = sum(counts[k][x] for x in seen)
        left = n - sum(map(own, seen))
        n, left = (n, left) if left > 1e-9 else (n + 1, 1)
        if counts[k][g]:
            return own(g) / n
        if not k:
            return left / n
        if h not in backoff:
            backoff[h] = left / n / (1 - sum(prob(x[1:]) for x in seen))
        return backoff[h] * prob(g[1:])

    for h in list(after[-1])[:5]:
        assert sum(prob((*h, *w)) for w in counts[0]) + prob((*h, "\0")) == pytest.approx(1)
    for i, t in tokens.items():
        assert got[i]["n_tokens"] == len(t) and got[i]["n_known"] == sum((w,) in counts[0] for w in t)
        assert got[i]["score"] == pytest.approx(sum(math.log10(prob(g)) for g in grams(t, order)))


@pytest.mark.parametrize(("common", "n"), [(0.85, 10**7), (0.7, 10**8), (0.93, 10**8)])
def test_skewed_embeddings_reach_the_recall(common, n):
    rng = np.random.default_rng(3)

    def unit(k):
        x = rng.standard_normal((k, 64))
        x *= math.sqrt(1 - common) / np.linalg.norm(x, axis=1, keepdims=True)
        x[:, 0] += math.sqrt(common)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    index, x = embed.calibrate(unit(4096), n, 0.95, 0.99), unit(4000)
    r = rng.standard_normal(x.shape)
    r -= (r * x).sum(1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    assert (index.cells(index.project(x)) == index.cells(index.project(y))).any(1).mean() >= 0.98


def test_packing_is_read_back_from_files(docs, ranks, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BYTES", 4000)
    monkeypatch.setattr(packing, "fresh_dir", lambda spark, name: f"file://{tmp_path}/{name}")
    got = packing.round_trip(docs, ranks, 64)
    want = packing.digest(packing.pack(docs, ranks, 64))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len(list((tmp_path / "packed").glob("ids-*.npy"))) == want.select("shard").distinct().count() > 1
    path = next((tmp_path / "packed").glob("ids-*.npy"))
    np.save(path, np.load(path) + 1)
    assert sorted(map(str, got.select("*").collect())) != sorted(map(str, want.collect()))
    assert packing.round_trip(empty(docs), ranks).count() == 0


def test_regular_long_words(spark, ranks, encoding):
    """Thue-Morse words and their mirror images, which polynomials modulo 2**64 can't tell apart."""
    words = ["".join("ab"[bin(i).count("1") % 2] for i in range(n)) for n in (1024, 2048, 4096)]
    mirrors = [w.translate(str.maketrans("ab", "ba")) for w in words]
    rows = [(k, " ".join(f"x{i}" if i % 2 else w for i in range(8))) for k, w in enumerate(words + mirrors)] + [(9, " ".join(words)), (10, " ".join(mirrors))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = by_id(bpe.round_trip(docs, ranks))
    for i, t in rows:
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(encoding.encode_ordinary(t), "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert {r["n_removed"] for r in substring.report(docs, substring.repeated(docs, 3)).collect()} == {0}
    assert {i: r["component_id"] for i, r in by_id(jaccard.Join(docs, 3, 90).components()).items()} == {i: i for i, _ in rows}
    scored = by_id(katz.score(docs, F.col("doc_id") < 3))
    assert [scored[i]["n_known"] for i in (0, 3, 9, 10)] == [9, 5, 4, 1]
    packed = packing.pack(docs, ranks, 4096).collect()
    flat = {(d, p): np.frombuffer(r["ids"], "<u2")[a:b].tolist() for r in packed for d, p, a, b in zip(r["doc_ids"], r["parts"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True)}
    for i, t in rows:
        assert [x for p in range(sum(d == i for d, _ in flat)) for x in flat[i, p]] == encoding.encode_ordinary(t)


@pytest.mark.parametrize(("bucket", "chunk", "hot"), [(1 << 24, 1 << 22, 1024), (2000, 3000, 8)])
def test_katz_model_scores_other_texts(docs, monkeypatch, bucket, chunk, hot):
    for name, v in (("BUCKET", bucket), ("CHUNK", chunk), ("HOT", hot)):
        monkeypatch.setattr(katz, name, v)
    train = langid.fold("doc_id", 7) != 2
    want = by_id(katz.score(docs, train, order=3))
    model = katz.fit(docs.where(train), order=3)
    got = by_id(model.score(docs))
    assert set(got) == set(want)
    for i, r in got.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == tuple(want[i][c] for c in ("n_tokens", "n_known", "train_tokens"))
        assert (r["score"], r["base_score"]) == pytest.approx((want[i]["score"], want[i]["base_score"]))
    other = by_id(model.score(docs.sparkSession.createDataFrame([(1, "never seen such texts"), (2, None)], "doc_id long, text string")))
    assert other[1]["n_known"] == 1 and other[1]["score"] < other[2]["score"] < 0
    assert model.score(empty(docs)).count() == 0
    model.drop()
    with pytest.raises(ValueError):
        katz.fit(empty(docs))
