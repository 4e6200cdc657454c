"""Hard negatives by vantage-point trees over norm-augmented vectors.

A vector x of integers gets one more component, sqrt(M^2 - |x|^2), with M the
largest norm of all; a query q gets a zero.  Then |q - x|^2 = |q|^2 + M^2 - 2 qx:
an inner product is a distance, and a window of scores is an annulus around the
query.  A tree that is fitted on a bounded sample deals the rows to cells; cells
are dealt to blocks of bounded size, each a group of its own with a tree that its
task builds over all its rows.  A request (a vector, a window, whether labels
shall agree) first visits the cell nearest to it; the k-th best score found there
is the floor below which no other cell can add anything, and it then visits the
cells whose annuli meet what is left of its windows.  In a block all requests go
down the tree together, the nearer side first; each stays as long as the bounds
of a side meet its windows above its floors, and a leaf's rows are multiplied at
once with the requests that reach it, in a type in which that is exact.  Copies
(vector and label) of k rows with smaller ids are left out before.  Blocks'
answers are merged by request.  The result is exact: neither the sample nor the
floors nor the copies lose a row.

Two such searches make the triples: each anchor's nearest rows of its label,
then, for each score among them, the nearest rows of other labels whose score
lies between two percentages of it.

Defined cases: rows without an id, a label or a vector, and rows with a null or
non-finite component take no part, nor do those with a component of 2^27 or more
or, in vectors of d numbers, of sqrt(2^55 / d), whose scores would not fit;
vectors meet only those of their length, empty ones included; labels are
integers; rows that repeat an id are rows of their own, each an anchor if its id
is, and never meet each other; an empty table gives none; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._cluster import dropped, release, stored
from quarry.llm._text import lean

BLOCK, QUERIES, LEAF = 8192, 16384, 256  # rows and requests of a group at most, rows of a leaf
FEWEST = 1024  # rows of a group in tables of less than 64 times as many, so that all cores have some
TOGETHER = 1024  # queries that a leaf's rows are multiplied with at once
SAMPLE, CELLS = 4096, 1024  # vectors that the dealing tree is fitted on, and its leaves, at most
NEVER = 1 << 62


class VPTree:
    """Vantage points over integer rows of norms up to sqrt(m2); children keep the distances that they span from their vantage point."""

    def __init__(self, v: np.ndarray, m2: int, leaf: int):
        self.v, self.m2, self.leaf = v, m2, leaf
        self.rows: list[np.ndarray | None] = []  # of leaves
        self.point: list[np.ndarray | None] = []  # vantage points, augmented
        self.cut: list[float] = []
        self.below: list[tuple[tuple[int, float, float], tuple[int, float, float]] | None] = []  # (child, nearest, farthest) inside and outside
        self._grow(augmented(v, m2), np.arange(len(v)))

    def _grow(self, x: np.ndarray, own: np.ndarray) -> int:
        at = len(self.rows)
        for column in (self.rows, self.point, self.below):
            column.append(None)
        self.cut.append(0.0)
        if len(own) > self.leaf:
            here = x[own]
            far = here[int(np.argmax(((here - here.mean(0)) ** 2).sum(1)))]  # a point at the rim
            d = np.sqrt(((here - far) ** 2).sum(1))
            cut = float(np.partition(d, len(d) // 2)[len(d) // 2])
            if cut == d.max():  # many at one distance: they go outside
                cut = float(np.nextafter(cut, 0))
            inside = d <= cut
            if inside.any() and not inside.all():
                self.point[at], self.cut[at] = far, cut
                spans = [(self._grow(x, own[part]), float(d[part].min()), float(d[part].max())) for part in (inside, ~inside)]
                self.below[at] = (spans[0], spans[1])
                return at
        self.rows[at] = own
        return at

    def search(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, keep, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, window, row, score) of the k best rows of each window lo <= score <= hi of each query among those that ``keep`` lets pass, highest score first, ties by id.

        The queries go down the tree together, each as far as its bounds let it; a leaf
        multiplies its rows with all queries that reach it.
        """
        width, kind = lo.shape[1], exact(self.m2)
        floor, hi = (np.clip(x, -self.m2 - 1, self.m2 + 1) for x in (lo, hi))  # no score is that far out
        qk, qf = q.astype(kind), q.astype(np.float64)
        base = (qf * qf).sum(1) + self.m2
        slack, most = 1e-7 * base + 1, hi.max(1)
        least = floor.min(1)  # what a row must reach to add to any window of a query
        none = np.zeros(0, np.int64)
        best, wait, waiting = (none, none, none), [], 0

        def settle() -> None:
            """The k best so far of each query and window; the k-th is the window's floor from then on."""
            nonlocal best, waiting
            key, row, score = (np.concatenate(c) for c in zip(best, *wait, strict=True))
            order = np.lexsort((ids[row], -score, key))
            new = np.flatnonzero(np.diff(key[order], prepend=-1))
            place = np.arange(len(order)) - np.repeat(new, np.diff(new, append=len(order)))
            best = tuple(c[order[place < k]] for c in (key, row, score))
            full = order[place == k - 1]
            floor.ravel()[key[full]] = score[full]
            changed = np.unique(key[full] // width)
            least[changed] = floor[changed].min(1)
            wait.clear()
            waiting = 0

        stack = [(0, np.arange(len(q)), np.zeros(len(q)))]
        while stack:
            at, on, near = stack.pop()
            able = (base[on] - near * near) / 2 + slack[on] >= least[on]
            on, near = on[able], near[able]
            own = self.rows[at]
            if own is not None:
                x = self.v[own].astype(kind).T
                for s in range(0, len(on), TOGETHER):
                    some = on[s : s + TOGETHER]
                    scores = qk[some] @ x
                    hit = np.flatnonzero((scores >= least[some, None].astype(kind)) & (scores <= most[some, None].astype(kind)))
                    i, row, score = some[hit // len(own)], own[hit % len(own)], scores.ravel()[hit].astype(np.int64)
                    good = keep(i, row)
                    i, row, score = i[good], row[good], score[good]
                    for w in range(width):
                        fit = np.flatnonzero((score >= floor[i, w]) & (score <= hi[i, w]))
                        wait.append((i[fit] * width + w, row[fit], score[fit]))
                        waiting += len(fit)
                    if waiting > max(4 * TOGETHER, len(best[0])):
                        settle()
            elif len(on):
                d = np.sqrt(np.maximum(base[on] - 2 * (qf[on] @ self.point[at][:-1]), 0.0))
                parts = []
                for child, nearest, farthest in self.below[at]:
                    low = np.maximum(near, np.maximum(d - farthest, nearest - d))
                    able = (base[on] - (d + farthest) ** 2) / 2 - slack[on] <= most[on]
                    parts.append((child, on[able], low[able]))
                stack += sorted(parts, key=lambda p: -p[2].mean() if len(p[2]) else 0.0)  # the nearer one first
        if wait:
            settle()
        return best[0] // width, best[0] % width, best[1], best[2]

    def nearest(self, q: np.ndarray, lo: int, hi: int, keep, k: int, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(score, row) of the k best rows for one query."""
        _, _, rows, scores = self.search(q[None], np.array([[lo]]), np.array([[hi]]), lambda _, r: keep(r), k, ids)
        return zip(scores.tolist(), rows.tolist(), strict=True)


def exact(m2: int) -> type:
    """The fastest type whose sums of products are exact for vectors of squared norms up to m2: no part of a product exceeds m2."""
    return np.float32 if m2 < (1 << 24) - 1 else np.float64 if m2 < (1 << 53) - 1 else np.int64


def augmented(v: np.ndarray, m2: int) -> np.ndarray:
    x = v.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(m2 - (x * x).sum(1), 0.0))[:, None]], 1)


class Cells:
    """The leaves of a tree of a sample as cells of any rows; their spans are the tree's cuts, which hold for rows outside the sample too."""

    def __init__(self, v: np.ndarray, m2: int, cells: int):
        tree = VPTree(v, m2, max(1, -(-len(v) // cells)))
        self.m2, self.d = m2, v.shape[1]
        self.points = np.array([p for p in tree.point if p is not None]).reshape(-1, self.d + 1)
        self.cuts = np.array([c for c, p in zip(tree.cut, tree.point, strict=True) if p is not None])
        number = np.cumsum([p is not None for p in tree.point]) - 1
        self.paths: list[list[tuple[int, bool]]] = []  # of each cell: (cut, inside)
        stack: list[tuple[int, list[tuple[int, bool]]]] = [(0, [])]
        while stack:
            at, path = stack.pop()
            if tree.below[at] is None:
                self.paths.append(path)
            else:
                for side, (child, _, _) in zip((True, False), tree.below[at], strict=True):
                    stack.append((child, [*path, (int(number[at]), side)]))

    def of(self, v: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        inside = self._distances(augmented(v, self.m2)) <= self.cuts
        out = np.zeros(len(v), np.int64)
        for cell, path in enumerate(self.paths):
            if path:
                out[np.all([inside[:, i] == side for i, side in path], 0)] = cell
        return out

    def _distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + self.m2 - 2 * x @ self.points.T, 0.0))

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest and lowest score that each query can have in each cell, with room for rounding."""
        x = np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], 1)
        d, base = self._distances(x), (x * x).sum(1) + self.m2
        slack = 1e-7 * base + 1
        high, low = np.empty((len(q), len(self.paths))), np.empty((len(q), len(self.paths)))
        for cell, path in enumerate(self.paths):
            near = reduce(np.maximum, (d[:, i] - self.cuts[i] if side else self.cuts[i] - d[:, i] for i, side in path), np.zeros(len(q)))
            far = reduce(np.minimum, (d[:, i] + self.cuts[i] for i, side in path if side), np.full(len(q), np.inf))
            high[:, cell], low[:, cell] = (base - near**2) / 2 + slack, (base - far**2) / 2 - slack
        return high, low


def packed(column, d: int) -> np.ndarray:
    """The vectors of a column of their bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column) or not d:
        return np.zeros((len(column), d), np.int32)
    column = column.cast(pa.binary())
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.int32, len(column) * d, int(start)).reshape(-1, d)


def windows_of(column) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r, id, label, v) with whole vectors within the limits as bytes, their lengths and squared norms."""
    for b in batches:
        v = b.column(3)
        d, flat = np.diff(v.offsets.to_numpy()), v.flatten()
        x = flat.fill_null(1 << 27).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(d)), d)
        far = (np.abs(x) >= 1 << 27) | (x * x * d[row] > 1 << 55)
        good = np.bincount(row[far], minlength=len(d)) == 0
        ends = np.concatenate([[0], np.cumsum(d)])
        sums = np.concatenate([[0], np.cumsum(np.where(far, 0, x) ** 2)])
        m2, data = sums[ends[1:]] - sums[ends[:-1]], x.astype(np.int32).tobytes()
        offsets = pa.py_buffer((4 * ends).astype(np.int32))
        blobs = pa.Array.from_buffers(pa.binary(), len(d), [None, offsets, pa.py_buffer(data)])
        whole = pa.RecordBatch.from_arrays([*b.columns[:3], blobs, pa.array(d.astype(np.int32)), pa.array(m2)], ["r", "id", "label", "v", "d", "m2"])
        yield whole.filter(pa.array(good))


def firsts(v: np.ndarray, labels: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of all rows but copies (vector and label) that k others of smaller ids precede for any query: those of the first k + 1 ids, k of each."""
    if not len(v):
        return np.zeros(0, np.int64)
    _, same = np.unique(np.concatenate([v, labels.astype(np.int64)[:, None].view(np.int32).reshape(len(v), 2)], 1), axis=0, return_inverse=True)
    same = same.reshape(-1)
    order = np.lexsort((ids, same))
    group = np.diff(same[order], prepend=-1) != 0
    first = group | (np.diff(ids[order], prepend=-1) != 0)
    number = np.cumsum(first)  # of the id, over all groups
    starts = np.flatnonzero(group)
    in_group = number - np.repeat(number[starts], np.diff(starts, append=len(order)))
    at = np.flatnonzero(first)
    in_id = np.arange(len(order)) - np.repeat(at, np.diff(at, append=len(order)))
    return np.sort(order[(in_group <= k) & (in_id < k)])


class Miner:
    """Exact searches among the rows of a table (id, label, v), v being arrays of integers."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        able = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
        numbered = able.select(F.monotonically_increasing_id().alias("r"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"))
        self.plain = stored(numbered.mapInArrow(lean(pack), "r long, id long, label long, v binary, d int, m2 long"), "rows")
        sizes = self.plain.groupBy("d").agg(F.count("*").alias("n"), F.max("m2").alias("m2")).orderBy(F.desc("n"), F.desc("d")).first()
        self.rows = None
        if sizes is None:
            return
        total, m2 = self.plain.agg(F.count("*"), F.max("m2")).first()
        n, d = sizes["n"], sizes["d"]
        conf = self.spark.conf.get("spark.sql.shuffle.partitions", "200")
        self.parts = max(int(conf), 2 * self.spark.sparkContext.defaultParallelism)
        self.block = block = min(BLOCK, max(FEWEST, total // 64))
        same = self.plain.where(F.col("d") == d)
        hashed = F.pmod(F.xxhash64("r"), F.lit(1 << 32))
        part = same.where(hashed < SAMPLE * (1 << 32) // n) if n > SAMPLE else same
        some = np.array([np.frombuffer(r["v"], np.int32) for r in part.select("v").orderBy(hashed, "r").limit(2 * SAMPLE).collect()], np.int64).reshape(-1, d)
        if not len(some):
            some = np.zeros((1, d), np.int64)
        self.cells = self.spark.sparkContext.broadcast((d, Cells(some, m2, min(CELLS, max(1, -(-n // block))))))
        self.m2, cells = m2, self.cells

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common, by = cells.value
            for b in batches:
                size = b.column(4).to_numpy()
                cell = np.zeros(b.num_rows, np.int64)
                usual = np.flatnonzero(size == common)
                if len(usual):
                    cell[usual] = by.of(packed(b.column(3).take(pa.array(usual)), common))
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(cell)], [*b.schema.names[:5], "cell"])

        self.rows = stored(self.plain.mapInArrow(lean(place), "r long, id long, label long, v binary, d int, cell long"), "placed")
        self.filled = self.rows.groupBy("d", "cell").agg(F.ceil(F.count("*") / block).alias("blocks"))

    def done(self) -> None:
        dropped(self.plain, *([self.rows] if self.rows is not None else []))
        release(self.spark)

    def _route(self, requests: DataFrame, home: bool) -> DataFrame:
        """requests (q, id, label, v, d, lo, hi, and home unless it is asked for) with a cell, or one row for each cell that may add to them."""
        cells = self.cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common, by = cells.value
            for b in batches:
                if not b.num_rows:
                    continue
                size, lo, hi = b.column(4).to_numpy(), windows_of(b.column(5)), windows_of(b.column(6))
                pairs = [np.stack([np.flatnonzero(size != common), np.zeros((size != common).sum(), np.int64)])]
                for usual in np.array_split(np.flatnonzero(size == common), -(-b.num_rows // 1000)):
                    if len(usual):
                        high, low = by.scores(packed(b.column(3).take(pa.array(usual)), common))
                        if home:
                            pairs.append(np.stack([usual, np.argmax(high, 1)]))
                        else:
                            meets = reduce(np.logical_or, ((high >= lo[usual, w, None]) & (low <= hi[usual, w, None]) for w in range(lo.shape[1])))
                            i, cell = np.nonzero(meets)
                            pairs.append(np.stack([usual[i], cell]))
                at, cell = np.concatenate(pairs, 1)
                if not home:
                    other = cell != b.column(7).to_numpy()[at]
                    at, cell = at[other], cell[other]
                for s in range(0, len(at), 10_000):
                    part = pa.RecordBatch.from_arrays(b.columns[:7], b.schema.names[:7]).take(pa.array(at[s : s + 10_000]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell[s : s + 10_000])], [*part.schema.names, "cell"])

        return requests.mapInArrow(lean(run), "q long, id long, label long, v binary, d int, lo array<long>, hi array<long>, cell long")

    def _visit(self, routed: DataFrame, same: bool, k: int) -> DataFrame:
        """(q, w, id, score): the k best of each request's windows in each block that it visits."""
        m2, parts, routed = self.m2, self.parts, stored(routed, "routed")
        asked = routed.groupBy("d", "cell").agg(F.ceil(F.count("*") / QUERIES).alias("shares"))
        both = self.filled.join(asked, ["d", "cell"])
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = self.rows.join(both, ["d", "cell"]).select("d", "cell", F.pmod(F.xxhash64("r"), F.col("blocks")).alias("i"), upto("shares").alias("j"), "id", "label", "v")
        right = routed.join(both, ["d", "cell"]).select("d", "cell", F.pmod(F.xxhash64("q"), F.col("shares")).alias("j"), upto("blocks").alias("i"), "q", "id", "label", "v", "lo", "hi")

        def search(key: tuple[pa.Scalar, ...], rows: pa.Table, asks: pa.Table) -> pa.Table:
            d = key[0].as_py()
            v, ids, labels = packed(rows["v"], d), rows["id"].to_numpy(), rows["label"].to_numpy()
            q, own, label = packed(asks["v"], d), asks["id"].to_numpy(), asks["label"].to_numpy()
            if not len(v) or not len(q):
                found = [np.zeros(0, np.int64)] * 4
            else:
                some = firsts(v, labels, ids, k)
                v, ids, labels = v[some].astype(np.int64), ids[some], labels[some]
                keep = lambda i, r: ((labels[r] == label[i]) == same) & (ids[r] != own[i])
                i, w, row, score = VPTree(v, m2, LEAF).search(q, windows_of(asks["lo"]), windows_of(asks["hi"]), keep, k, ids)
                found = [asks["q"].to_numpy()[i], w, ids[row], score]
            return pa.table({n: pa.array(f, pa.int64()) for n, f in zip(("q", "w", "id", "score"), found, strict=True)})

        keys = ("d", "cell", "i", "j")
        left, right = (x.repartition(parts, *keys) for x in (left, right))  # few bytes are much work: Spark isn't to join parts
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "q long, w long, id long, score long")

    def search(self, requests: DataFrame, same: bool, k: int) -> DataFrame:
        """(q, w, rank, id, score): the first k rows of the same label, or of others, for each window of each request (q, id, label, v, d, lo, hi).

        lo and hi are arrays of one length in all requests.
        """
        best = Window.partitionBy("q", "w").orderBy(F.desc("score"), "id")
        at_home = stored(self._route(requests, True), "home")
        near = stored(self._visit(at_home, same, k), "near")
        floors = near.withColumn("k", F.row_number().over(best)).where(F.col("k") == k)
        floors = floors.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("floors"))
        raised = F.transform("lo", lambda lo, w: F.coalesce(F.col("floors")[w.cast("long")], lo))
        rest = at_home.withColumnRenamed("cell", "home").join(floors, "q", "left").select("q", "id", "label", "v", "d", raised.alias("lo"), "hi", "home")
        far = self._visit(self._route(rest, False), same, k)
        every = near.union(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return stored(every.select("q", "w", "rank", "id", "score"), "best")


def integers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component x, as a double; null where one is null or not finite, or too large for a search."""
    x = vector.cast("array<double>")
    good = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))) & (F.abs(y * scale) < F.lit(float(1 << 30))))
    return F.when(good, F.transform(x, lambda y: F.floor(y * scale)))


def _part(x: Column, percent: int) -> Column:
    """floor(percent * x / 100) of whole numbers."""
    return F.call_function("div", x * percent - F.pmod(x * percent, F.lit(100)), F.lit(100))


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (id, label, v) and a condition on id.

    For each anchor and each of its first ``positives`` rows of its label, the first ``negatives``
    rows of other labels with low * positive_score <= 100 * score <= high * positive_score.
    """
    miner = Miner(rows)
    if miner.rows is None:
        long = F.lit(None).cast("long")
        return miner.plain.limit(0).select(long.alias("anchor_id"), long.alias("positive_id"), F.lit(0).alias("rank"), long.alias("negative_id"), long.alias("positive_score"), long.alias("negative_score"))
    own = miner.rows.where(anchors).select(F.col("r").alias("q"), "id", "label", "v", "d")
    near = miner.search(own.select("*", F.array(F.lit(-NEVER)).alias("lo"), F.array(F.lit(NEVER)).alias("hi")), True, positives)
    scores = F.array_distinct(F.sort_array(F.collect_list("score"), asc=False))
    asked = own.join(near.groupBy("q").agg(scores.alias("scores")), "q")
    window = lambda w: F.get("scores", F.lit(w))
    lo = F.array(*(F.coalesce(-_part(-window(w), low), F.lit(NEVER)) for w in range(positives)))  # nothing is in a window beyond the scores
    hi = F.array(*(F.coalesce(_part(window(w), high), F.lit(-NEVER)) for w in range(positives)))
    hard = miner.search(asked.select("q", "id", "label", "v", "d", lo.alias("lo"), hi.alias("hi")), False, negatives)
    pairs = near.select("q", F.col("id").alias("positive_id"), F.col("score").alias("s"))
    met = asked.select("q", F.col("id").alias("anchor_id"), F.posexplode("scores").alias("w", "s")).join(pairs, ["q", "s"]).join(hard, ["q", "w"])
    out = met.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("s").alias("positive_score"), F.col("score").alias("negative_score"))
    out = stored(out, "triples")
    miner.done()
    return out
