"""The pipeline's stages, each against a brute-force version on what the stage before it kept."""

import hashlib
import re

from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm._cluster import stored
from tests.llm.test_operators import LOW

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    import public_tokenizers  # noqa: F401

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert docs.columns == names
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    start, spoken, distinct, cut, clean = kept
    assert len(spoken) >= 0.97 * len(start) and all(spoken[i] == start[i] for i in spoken)

    sets, root = {}, {i: i for i in spoken}
    for i, t in spoken.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(distinct) == {i for i in spoken if find(i) == i}

    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in distinct.items()}
    seen = {}
    for w in words.values():
        for j in range(len(w) - 34):
            seen[tuple(w[j : j + 35])] = seen.get(tuple(w[j : j + 35]), 0) + 1
    want = {}
    for i, w in words.items():
        gone = {j + x for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for x in range(35)}
        text = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else distinct[i]
        if text:
            want[i] = text
    assert cut == want

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
    bench = [split(r["text"] or "") for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(w[j : j + 10]) for w in bench if w for j in range(max(1, len(w) - 9))}
    hit = lambda t: any(tuple(w[j : j + n]) in windows for w in [split(t)] for n in {len(x) for x in windows} for j in range(len(w) - n + 1))
    assert clean == {i: t for i, t in cut.items() if not hit(t)}

    last = {r["doc_id"]: r for r in docs.collect()}
    assert set(last) == set(clean)
    assert all(last[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in clean.items())


def test_run_and_edges(spark, tmp_path):
    rows = [(1, None, "en", "s", 0, 1), (2, "", "en", "s", 0, 2), (3, "the same text of a few words", "en", "s", 28, 3), (3, "the same text of a few words", "en", "s", 28, 3), (4, "another text, with other words in it", "en", "s", 36, 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of this kind is there")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == [3, 4]
    none = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and out.columns == none.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "substring_dedup", "decontamination", "byte_bpe"]


def test_null_and_repeated_ids(spark):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    copy, passage = words("copy", 30), words("passage", 60)
    rows = [(None, copy), (7, copy), (7, words("other", 30)), (7, words("other", 30)), (None, words("lone", 30)), (None, words("odd", 30) + " " + passage), (None, words("even", 30) + " " + passage), (8, words("last", 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.join_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame(rows[1:3] + rows[4:], docs.schema).collect()))
    cut = corpus_pipeline.cut_repeats(spark, stored(kept, "kept"), "")
    assert cut.columns == docs.columns
    want = [(7, copy), (7, words("other", 30)), (None, words("lone", 30)), (None, words("odd", 30)), (None, words("even", 30)), (8, words("last", 9))]
    assert sorted(map(str, cut.collect())) == sorted(map(str, spark.createDataFrame(want, docs.schema).collect()))


def test_benchmark_items_without_an_id(spark):
    from quarry.llm import decontaminate

    docs = spark.createDataFrame([(1, "a b c"), (2, "x y"), (3, "x y and a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c"), (5, "x y"), (None, "and a")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(decontaminate.scan(docs, items)).collect()}
    assert [(got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) for i in (1, 2, 3)] == [(3, 1, True), (2, 1, True), (6, 2, True)]
    assert got[3]["items_sha256"] == got[2]["items_sha256"] != got[1]["items_sha256"]
    assert decontaminate.clean(docs, items).count() == 0
