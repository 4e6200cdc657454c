"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Equal vectors are one class.  Each table of the index cuts some random
projections at their medians; the cuts of one table give a cell, and the number
of tables is calibrated so that a pair at the threshold shares a cell with the
wanted recall; where the most tables don't reach it (vectors with a common
direction), a cell has fewer cuts, down to none.  Large cells are dealt into blocks, and pairs of blocks are
tasks' groups of bounded size.  Within a pair of blocks every projection is
sorted, each vector's window of others around its own value is found in the
sorted order, and the windows in which a pair meets are counted; pairs whose
count passes a limit, calibrated alike, are verified by their cosine in double
precision.  A pair counts in the first table that it meets in.  What leaves a
block is one row a vector: its links there and the root of its local component.

The medians and the two calibrations come from at most ``sample`` vectors;
every vector is indexed and queried.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; others link within their length, each length with
an index of its own; equal vectors link with each other; rows that repeat an id
are vectors of their own, with their own links, and a component's id is the
smallest of its vectors' ids, rows without an id aside; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._text import lean
from quarry.llm._cluster import components, dropped, release, stored

BLOCK = 512


@dataclass
class Index:
    directions: np.ndarray  # dimensions by projections
    medians: np.ndarray
    bits: int
    tables: int
    windows: int  # projections that are counted
    half: float  # half a window's width
    least: int  # collisions that a candidate has

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.directions

    def cells(self, p: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table."""
        bit = (p[:, : self.tables * self.bits] > self.medians[: self.tables * self.bits]).reshape(len(p), self.tables, self.bits)
        return (bit << np.arange(self.bits)).sum(2)


def calibrate(sample: np.ndarray, n: int, cosine: float, recall: float, windows: int = 24, seed: int = 7) -> Index:
    """An index for n unit vectors, from pairs made of the sample's vectors at exactly the threshold."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    bits = max(0, math.ceil(math.log2(max(1, n / BLOCK))))
    most = 64
    directions = rng.standard_normal((d, max(most * bits, windows)))
    own = sample @ directions
    medians = np.median(own, 0)
    x = sample[rng.integers(0, len(sample), 4000)]
    r = rng.standard_normal(x.shape)
    r -= (r * x).sum(1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine**2) * r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
    px, py = x @ directions, y @ directions
    half = 2 * float(np.abs(px - py).std())
    least = int(np.quantile((np.abs(px - py)[:, :windows] <= half).sum(1), 0.002))
    tables, same = 1, (px > medians) == (py > medians)
    while bits:
        met = same[:, : most * bits].reshape(len(x), most, bits).all(2)
        reached = np.flatnonzero(np.maximum.accumulate(met, 1).mean(0) >= recall)
        if len(reached):
            tables = int(reached[0]) + 1
            break
        bits -= 1  # larger cells: with none left all vectors share one
    return Index(directions, medians, bits, tables, windows, half, least)


def _collisions(pq: np.ndarray, pt: np.ndarray, half: float, windows: int) -> np.ndarray:
    """In how many of the sorted projections each target lies in the query's window."""
    count = np.zeros((len(pq), len(pt)), np.uint8)
    for i in range(windows):
        order = np.argsort(pt[:, i])
        rank = np.empty(len(pt), np.uint16)
        rank[order] = np.arange(len(pt), dtype=np.uint16)
        line = pt[order, i]
        lo = np.searchsorted(line, pq[:, i] - half).astype(np.uint16)
        hi = np.searchsorted(line, pq[:, i] + half, "right").astype(np.uint16)
        count += (rank[None, :] - lo[:, None]) < (hi - lo)[:, None]
    return count


def _roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each node's component over the links (a, b)."""
    root = ids.copy()
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (root == before).all():
            break
    return root


def block_links(index: Index, cosine: float, table: int, ids: np.ndarray, x: np.ndarray, times: np.ndarray, side: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links, roots) of the vectors with a link in one pair of blocks; side: 0 or 1, own: the two blocks are the same."""
    q, t = np.flatnonzero(side == 0), np.flatnonzero(side == 0 if own else side == 1)
    if not len(q) or not len(t):
        return ids[:0], times[:0], ids[:0]
    p = index.project(x)
    i, j = np.nonzero(_collisions(p[q], p[t], index.half, index.windows) >= index.least)
    i, j = q[i], t[j]
    if own:
        i, j = i[i < j], j[i < j]
    keep = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) >= cosine for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
    i, j = i[keep], j[keep]
    roots = _roots(len(ids), i, j, ids)
    cells = index.cells(p)
    first = ~(cells[i, :table] == cells[j, :table]).any(1) if table else np.ones(len(i), bool)
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, i[first], times[j[first]])
    np.add.at(links, j[first], times[i[first]])
    some = np.zeros(len(ids), bool)
    some[i] = some[j] = True
    return ids[some], links[some], roots[some]


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.99, sample: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every vector."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("x", lambda v: v != 0)
    keyed = rows.withColumn("good", F.coalesce(finite, F.lit(False))).withColumn("k1", F.xxhash64("x")).withColumn("k2", F.xxhash64(F.lit(11), "x"))
    out = keyed.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    for d, in keyed.where("good").select(F.size("x").alias("d")).groupBy("d").count().orderBy("d").select("d").collect():  # a row a length
        out = out.union(_of_length(keyed.where("good").where(F.size("x") == d), cosine, recall, sample))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _of_length(keyed: DataFrame, cosine: float, recall: float, sample: int) -> DataFrame:
    """(id, n_links, component_id) of vectors (id, x, k1, k2) of one length; a class of equal vectors is told from others by a number."""
    spark = keyed.sparkSession
    classes = keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("times"), F.first("x").alias("x"))
    unique = stored(classes.withColumn("v", F.monotonically_increasing_id()), "vectors")
    n = unique.count()
    part = unique.where(F.pmod("k1", F.lit(1 << 32)) < min(1 << 32, sample * (1 << 32) // n)) if n > sample else unique
    some = np.stack([np.asarray(r["x"]) for r in part.select("x").orderBy("k1").limit(2 * sample).collect()])
    index = calibrate(some / np.linalg.norm(some, axis=1, keepdims=True), n, cosine, recall)
    shipped = spark.sparkContext.broadcast(index)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shipped.value
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                c = b.slice(lo, 2000)
                x = c.column(2).flatten().to_numpy().reshape(c.num_rows, -1)
                cell = ix.cells(ix.project(x / np.linalg.norm(x, axis=1, keepdims=True)))
                every = pa.array(np.repeat(np.arange(c.num_rows), ix.tables))
                yield pa.RecordBatch.from_arrays(
                    [c.column(0).take(every), c.column(1).take(every), pa.array(np.tile(np.arange(ix.tables, dtype=np.int32), c.num_rows)), pa.array(cell.reshape(-1))], ["v", "times", "t", "cell"]
                )

    placed = unique.select("v", "times", "x").mapInArrow(lean(cells), "v long, times long, t int, cell long")
    filled = placed.groupBy("t", "cell").agg(F.count("*").alias("rows"))
    blocks = placed.join(filled, ["t", "cell"]).withColumn("of", F.ceil(F.col("rows") / BLOCK)).withColumn("s", F.pmod(F.xxhash64("v", "t"), F.col("of")))
    pairs = blocks.select("v", "times", "t", "cell", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("o"))
    pairs = pairs.select("v", "times", "t", "cell", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), (F.col("s") > F.col("o")).cast("int").alias("side"))
    full = pairs.join(unique.select("v", "x"), "v")

    def links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = table["x"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        t, _, i, j = (k.as_py() for k in key)
        found = block_links(shipped.value, cosine, t, table["v"].to_numpy(), x, table["times"].to_numpy(), table["side"].to_numpy(), i == j)
        return pa.table(dict(zip(("v", "links", "root"), map(pa.array, found), strict=True)))

    grouped = full.select("t", "cell", "i", "j", "v", "times", "side", "x").groupBy("t", "cell", "i", "j")
    met = stored(grouped.applyInArrow(links, "v long, links long, root long"), "met")
    release(spark)
    comp = stored(components(met, "v", "root").join(unique.select(F.col("v").alias("node"), "rep"), "node"), "components")
    first = stored(comp.groupBy("component").agg(F.min("rep").alias("first")), "first")  # the smallest id of a component
    total = met.groupBy("v").agg(F.sum("links").alias("links"))
    named = comp.join(first, "component").select(F.col("node").alias("v"), "first")
    per = unique.select("k1", "k2", "v", "rep", "times").join(total, "v", "left").join(named, "v", "left")
    per = per.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("l"), F.coalesce("first", "rep").alias("c"))
    per = stored(per, "classes")  # a table, so that the join may be split where a vector has many copies
    out = keyed.select("id", "k1", "k2").join(per, ["k1", "k2"]).select("id", F.col("l").cast("long").alias("n_links"), F.col("c").alias("component_id"))
    out = stored(out, "links")
    dropped(unique, met, comp, first, per)
    return out
