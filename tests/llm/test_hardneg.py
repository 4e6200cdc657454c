"""Hard negatives against all pairs in plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import hardneg

ROW = "vec_id long, embedding array<float>, label int, id string, rank int"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    """Triples of rows (id, label, integers), the anchors being the ids divisible by 50."""
    out = []
    for a, la, va in rows:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, label, v in rows if i != a and len(v) == len(va))
        for s, p, _ in [t for t in scored if t[2] == la][:positives]:
            fit = [(t[1], -t[0]) for t in scored if t[2] != la and low * -s <= 100 * -t[0] <= high * -s][:negatives]
            out += [(a, p, k + 1, i, -s, n) for k, (i, n) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **how):
    table = spark.createDataFrame(rows, ROW).repartition(3)
    asked = table.select(F.col("vec_id").alias("id"), "label", hardneg.integers(F.col("embedding")).alias("v"))
    got = hardneg.mine(asked, F.col("id") % 50 == 0, **how)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


def clean(rows):
    whole = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    return [(i, label, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v, label, *_ in whole]


def test_random_vectors_in_small_blocks(spark, monkeypatch):
    for name, n in (("BLOCK", 40), ("QUERIES", 3), ("LEAF", 7), ("SAMPLE", 100)):
        monkeypatch.setattr(hardneg, name, n)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 6)) + rng.integers(0, 2, (600, 1)) * 2
    rows = [(i, v.tolist(), int(rng.integers(0, 3)), "x", 0) for i, v in enumerate(x)]
    assert mined(spark, rows) == brute(clean(rows)) and mined(spark, rows, positives=2, negatives=9, low=90, high=99) == brute(clean(rows), 2, 9, 90, 99)


def test_copies_ties_lengths_and_holes(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 50)
    monkeypatch.setattr(hardneg, "LEAF", 4)
    hot = [(i, [1.0, 0.5, -0.25], i % 3, "x", 0) for i in range(0, 200)]
    near = [(i, [1.0, 0.5, -0.25 + i / 1000], 1, "x", 0) for i in range(200, 260)]
    odd = [(i, [0.9, 0.5], i % 2, None, None) for i in range(300, 320)] + [(400, [], 1, "x", 0), (401, [], 0, "x", 0), (450, [], 1, "x", 0)]
    holes = [(500, None, 1, "x", 0), (501, [1.0, None, 0.0], 1, "x", 0), (550, [float("nan"), 1.0, 0.0], 0, "x", 0), (600, [float("inf"), 1.0, 0.0], 0, "x", 0), (650, [1.0, 1.0, 0.0], None, "x", 0), (None, [1.0, 1.0, 0.0], 1, "x", 0)]
    rows = hot + near + odd + holes + [(700, [0.0, 0.0, 0.0], 1, "x", 0), (750, [-1.0, -0.5, 0.25], 2, "x", 0)]
    got = mined(spark, rows, high=100)  # copies of other labels are within the window
    assert got == brute(clean(rows), high=100) and {a for a, *_ in got} >= {0, 50, 100, 200, 250, 300}


def test_one_label_no_rows_and_too_large(spark):
    assert mined(spark, [(i, [float(i)], 1, "x", 0) for i in range(60)]) == []
    assert mined(spark, []) == []
    far = [(0, [1e30], 1, "x", 0), (1, [1.0], 1, "x", 0), (2, [0.8], 2, "x", 0), (50, [1.0], 1, "x", 0)]
    assert mined(spark, far) == [(50, 1, 1, 2, 65536, 52224)]


def test_an_id_twice_is_two_rows_that_never_meet(spark):
    rows = [(50, [1.0, 0.0], 1, "x", 0), (50, [1.0, 0.1], 1, "x", 0), (1, [1.0, 0.0], 1, "x", 0), (2, [0.9, 0.0], 2, "x", 0)]
    got = mined(spark, rows)
    assert [(a, p, n) for a, p, _, n, *_ in got] == [(50, 1, 2), (50, 1, 2)]


@pytest.mark.parametrize("spread", [0.0, 0.01, 1.0])
def test_the_tree_gives_rows_nearest_first(spread):
    rng = np.random.default_rng(1)
    v = np.floor(256 * (np.ones((500, 8)) + spread * rng.standard_normal((500, 8)))).astype(np.int64)
    ids, m2 = rng.permutation(500), int((v * v).sum(1).max())
    tree, q = hardneg.VPTree(v, m2, 16), v[3]
    s = v @ q
    lo, hi = int(np.quantile(s, 0.3)), int(np.quantile(s, 0.8))
    want = sorted((-int(s[i]), int(ids[i])) for i in range(500) if lo <= s[i] <= hi and i % 2)[:40]
    found = tree.nearest(q, lo, hi, lambda r: r % 2 == 1, 40, ids)
    assert [(-s, int(ids[i])) for s, i in list(found)[:40]] == want


def test_queries_share_the_leaves_that_they_visit():
    rng = np.random.default_rng(2)
    v = np.floor(256 * rng.standard_normal((1000, 16))).astype(np.int64)
    ids, m2, calls = rng.permutation(1000), int((v * v).sum(1).max()), []
    q = v[:300]
    s = q @ v.T
    lo, hi = np.sort(rng.integers(-(10**6), 10**6, (2, 300, 3)), 0)  # three windows a query

    def keep(i, r):
        calls.append(len(r))
        return (r + i) % 3 > 0

    tree = hardneg.VPTree(v, m2, 50)
    got = {}
    for i, w, r, score in zip(*(c.tolist() for c in tree.search(q, lo, hi, keep, 4, ids)), strict=True):
        got.setdefault((i, w), []).append((-score, int(ids[r])))
    want = {(i, w): sorted((-int(s[i, r]), int(ids[r])) for r in np.flatnonzero((s[i] >= lo[i, w]) & (s[i] <= hi[i, w]) & ((np.arange(1000) + i) % 3 > 0)))[:4] for i in range(300) for w in range(3)}
    assert got == {k: x for k, x in want.items() if x}
    assert len(calls) <= sum(r is not None for r in tree.rows)  # and not once a query and leaf


@pytest.mark.parametrize(("size", "kind"), [(1 << 9, np.float32), (1 << 20, np.float64), (1 << 26, np.int64)])
def test_scores_are_exact_in_the_type_of_their_size(size, kind):
    rng = np.random.default_rng(4)
    v = rng.integers(-size, size, (60, 8))
    m2 = int((v * v).sum(1).max())
    assert hardneg.exact(m2) is kind
    _, _, rows, scores = hardneg.VPTree(v, m2, 7).search(v[:1], np.array([[-hardneg.NEVER]]), np.array([[hardneg.NEVER]]), lambda _, r: r >= 0, 60, np.arange(60))
    assert sorted(rows.tolist()) == list(range(60)) and (scores == v[rows] @ v[0]).all()


def test_copies_that_no_query_can_meet_are_left_out():
    v, labels, ids = np.array([[1, 2]] * 7 + [[1, 3]], np.int32), np.array([0, 0, 0, 0, 0, 0, 1, 0]), np.array([9, 5, 5, 5, 7, 8, 6, 5])
    assert sorted(ids[hardneg.firsts(v, labels, ids, 2)[:-2]].tolist()) == [5, 5, 7, 8]  # two of each id, the own id and two more
    assert hardneg.firsts(v, labels, ids, 2)[-2:].tolist() == [6, 7]
