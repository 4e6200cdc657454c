"""Exact Jaccard self-join of documents by their sets of word shingles, with vertical partitioning.

Shingles have one global order: rarest first, by a count sketch of bounded size
(counts only order the shingles, so their error costs time, never a link), then
by hash.  Documents with equal sets are one class; its smallest id stands for it.

* Candidates: two sets that reach the threshold share one of their first
  n - ceil(t n) + 1 shingles, and the positions of the first shared one bound
  their overlap.  Each shared shingle's documents are compared with one pivot,
  the one with the fewest rarer shingles; afterwards only documents that are not
  yet in the pivot's component meet the others, so a group of near copies costs
  about one comparison a document instead of one a pair.
* Overlap: the global order is cut into fragments of like mass; candidate pairs
  meet in each fragment, partial overlaps are counted there and summed per pair.
  The sets' texts travel compressed, those without a candidate are left out by a
  bit set of at most MOST_BITS bits (which lets some others through).

Shingles are told apart by 56 bits of their hashes: the chance of an error in a
document of n shingles is about n squared in 2 ** 57.  Rows that repeat an id, or
have none, are documents of their own, and a group's id is the smallest of its
rows; a text of any length is one set.  Defined cases: null, empty and wordless texts have empty sets and link with
nothing (the component of a row without id is then null); a text with fewer words than a shingle is one shingle; repeated rows
and equal texts are linked; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _cluster
from quarry.llm._cluster import components, dropped, keyed, release, small_batches
from quarry.llm._text import FIRST, U64, Words, lean, mix, signed
from quarry.llm._text import chunks as _chunks


def stored(df: DataFrame, name: str) -> DataFrame:
    return _cluster.stored(df, name, "zstd")


def chunks(text):
    return _chunks(text, rows=ROWS)


RANGE = 1 << 16  # bins of the sketch in one row
MOST_BINS = 1 << 24


ROW, ROWS = U64(56), 256  # bits of a shingle's hash and rows of a chunk: one sort orders rows and hashes
MOST_BITS = 1 << 27
_ZSTD = pa.Codec("zstd", compression_level=1)


def _squeeze(text: str | None) -> bytes | None:
    if text is None:
        return None
    raw = text.encode()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _whole(z: bytes | None) -> bytes | None:
    return None if z is None else _ZSTD.decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True)


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash of 56 bits) of the distinct shingles of each row, sorted by both."""
    w = Words(data, offs, lower=True)
    h, row = w.hashes(), w.rows().astype(U64)
    g = FIRST.grams(h, k)
    key = (row[: len(g)] << ROW | g >> U64(8))[row[: len(g)] == row[k - 1 :]] if len(g) else g
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = mix(FIRST.spans(FIRST.prefix(h), w.first[short], w.first[short + 1]) + n[short].astype(U64))
        key = np.concatenate([key, short.astype(U64) << ROW | own >> U64(8)])
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> ROW).astype(np.int64), key & ((U64(1) << ROW) - U64(1))


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


class Join:
    """The join of ``docs`` on ``text_col``: sets of k-word shingles, similarity of at least percent / 100."""

    def __init__(self, docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"):
        if not 0 < percent <= 100:
            raise ValueError("percent must be from 1 to 100")
        small_batches(docs.sparkSession)
        self.spark, self.k, self.percent, self.id_col = docs.sparkSession, k, percent, id_col
        self.rows = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"))

    def _sets(self, bins: int) -> DataFrame:
        """(id, n, k1, k2, null, null): the size of each set and a hash of it; (null, ..., part, counts): a task's sketch, a range of bins a row."""
        k, shift, ranges = self.k, ROW - U64((bins - 1).bit_length()), bins // RANGE

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, names = np.zeros(bins, np.uint32), ["id", "n", "k1", "k2", "part", "counts"]
            kind = None
            for b in batches:
                kind = b.schema.field(0).type
                for lo, hi, data, offs in chunks(b.column(1)):
                    row, h = shingles(data, offs, k)
                    at = (h >> shift).astype(np.int64)
                    if len(at) * 8 > bins:
                        count += np.bincount(at, minlength=bins).astype(np.uint32)
                    else:
                        np.add.at(count, at, 1)
                    cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                    k1, k2 = _sums(mix(h + U64(1)), cuts), _sums(mix(h ^ U64(0x5851F42D4C957F2D)), cuts)
                    none = [pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(cuts)), pa.array(signed(k1)), pa.array(signed(k2)), *none], names)
            own = [(i, zlib.compress(x.tobytes(), 1)) for i, x in enumerate(count.reshape(ranges, RANGE)) if x.any()]
            if own:
                none = [pa.nulls(len(own), kind), *[pa.nulls(len(own), pa.int64())] * 3]
                yield pa.RecordBatch.from_arrays([*none, pa.array([i for i, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())], names)

        return self.texts.mapInArrow(lean(run), f"id {self.kind}, n long, k1 long, k2 long, part int, counts binary")

    @staticmethod
    def _sketch(counted: DataFrame, bins: int) -> np.ndarray:
        """Logarithms of the counts of shingles by the leading bits of their hash: at most MOST_BINS bytes."""
        ranges = bins // RANGE

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for i, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(raw.as_py()), np.uint32).astype(np.int64)
            rows = [np.minimum(255, np.round(6 * np.log2(1.0 + x))).astype(np.uint8).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(rows, pa.binary())], ["part", "n"])

        out = np.zeros((ranges, RANGE), np.uint8)
        for r in counted.select("part", "counts").repartition(ranges, "part").mapInArrow(lean(add), "part int, n binary").collect():
            out[r["part"]] = np.frombuffer(r["n"], np.uint8)
        return out.reshape(-1)

    def _prefixes(self, sketch) -> DataFrame:
        """(t, id, n, p): the rarest shingles of each set, its size, and the shingle's position in the order."""
        k, percent = self.k, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = sketch.value
            shift, low = ROW - U64((len(count) - 1).bit_length()), (U64(1) << U64(48)) - U64(1)
            for b in batches:
                for lo, hi, data, offs in chunks(b.column(1)):
                    row, h = shingles(data, offs, k)
                    # one sort: row, rarity, and the leading bits of the hash, which serve as the token
                    h = np.sort(row.astype(U64) << ROW | count[(h >> shift).astype(np.int64)].astype(U64) << U64(48) | h >> U64(8)) & low
                    cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                    n = np.diff(cuts)
                    p = np.arange(len(h)) - np.repeat(cuts[:-1], n)
                    size = n[row]
                    # sets too small to link with a set that isn't equal have no prefix
                    keep = (p <= size - -(-percent * size // 100)) & (100 * size >= percent * (size + 1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(h[keep])), b.column(0).take(pa.array(lo + row[keep])), pa.array(size[keep].astype(np.int32)), pa.array(p[keep].astype(np.int32))], ["t", "id", "n", "p"]
                    )

        return self.texts.mapInArrow(lean(run), f"t long, id {self.kind}, n int, p int")

    def _bits(self, ids: DataFrame) -> tuple[int, object]:
        """A bit set of ids by hash, at most MOST_BITS, that tasks get: 16 bits an id while there is room."""
        bits = min(MOST_BITS, max(RANGE, 1 << (16 * max(1, ids.count()) - 1).bit_length()))

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, np.ndarray] = {}
            for b in batches:
                at = b.column(0).to_numpy()
                for i in np.unique(at // RANGE).tolist():
                    parts.setdefault(i, np.zeros(RANGE, bool))[at[at // RANGE == i] % RANGE] = True
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([np.packbits(x).tobytes() for x in parts.values()], pa.binary())], ["part", "bits"])

        placed = ids.select(self._place(bits).alias("at")).distinct()
        out = np.zeros((bits // RANGE, RANGE // 8), np.uint8)
        for r in placed.repartition(max(1, bits // RANGE), F.floor(F.col("at") / RANGE)).mapInArrow(lean(put), "part int, bits binary").collect():
            out[r["part"]] |= np.frombuffer(r["bits"], np.uint8)
        return bits, self.spark.sparkContext.broadcast(out.reshape(-1))

    @staticmethod
    def _place(bits: int):
        return F.pmod(F.xxhash64("id"), F.lit(bits))

    def _fragments(self, wanted: DataFrame) -> DataFrame:
        """(id, f, tokens): the sets of the wanted documents, cut into fragments of the global order.  Their texts are shuffled compressed."""
        k, sketch, edges = self.k, self.sketch, self.edges
        bits, known = self._bits(wanted)

        def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.column(2).to_numpy()
                own = np.flatnonzero(known.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
                raw = [_squeeze(t) for t in b.column(1).take(pa.array(own)).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(raw, pa.binary())], ["id", "z"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = sketch.value
            shift = ROW - U64((len(count) - 1).bit_length())
            for b in batches:
                texts = pa.array([_whole(z) for z in b.column(1).to_pylist()], pa.large_binary())
                for lo, _, data, offs in chunks(texts):
                    row, h = shingles(data, offs, k)
                    f = np.searchsorted(edges, count[(h >> shift).astype(np.int64)].astype(U64) << ROW | h, "right")
                    part = row * FRAGMENTS + f
                    order = np.argsort(part, kind="stable")
                    part, h = part[order], h[order]
                    at = np.flatnonzero(np.diff(part, prepend=-1))
                    ends = np.append(at[1:], len(part))
                    raw = memoryview(h.tobytes())
                    rows = [raw[8 * x : 8 * y] for x, y in zip(at.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + part[at] // FRAGMENTS)), pa.array((part[at] % FRAGMENTS).astype(np.int32)), pa.array(rows, pa.binary())], ["id", "f", "tokens"])

        small = self.texts.withColumn("at", self._place(bits)).mapInArrow(lean(shrink), f"id {self.kind}, z binary")
        return small.join(wanted.hint("shuffle_merge"), "id").mapInArrow(lean(run), f"id {self.kind}, f int, tokens binary")

    def _linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, nx, y, ny) whose overlaps, summed over the fragments, reach the threshold: a stored table (x, y)."""
        kind, percent = self.kind, self.percent
        pairs = stored(pairs, "pairs")
        sets = stored(self._fragments(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()), "fragments")
        release(self.spark)

        def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = [len(np.intersect1d(np.frombuffer(x, U64), np.frombuffer(y, U64), True)) for x, y in zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(n, pa.int64())], ["x", "nx", "y", "ny", "f", "both"])

        # whatever the size, texts and sets are shuffled and never broadcast
        left = pairs.join(sets.select(F.col("id").alias("x"), "f", F.col("tokens").alias("tx")).hint("shuffle_merge"), "x")
        met = left.join(sets.select(F.col("id").alias("y"), "f", F.col("tokens").alias("ty")).hint("shuffle_merge"), ["y", "f"]).select("x", "nx", "y", "ny", "f", "tx", "ty")
        counted = met.mapInArrow(lean(overlap), f"x {kind}, nx int, y {kind}, ny int, f int, both long").distinct()
        total = counted.groupBy("x", "nx", "y", "ny").agg(F.sum("both").alias("both"))
        out = stored(total.where(100 * F.col("both") >= percent * (F.col("nx") + F.col("ny") - F.col("both"))).select("x", "y"), "links")
        release(self.spark)
        dropped(pairs, sets)
        return out

    def _bound(self, a: str, b: str):
        """Whether two sets can still reach the threshold, by a shared shingle's positions."""
        return F.least(F.col(f"n{a}") - F.col(f"p{a}"), F.col(f"n{b}") - F.col(f"p{b}")) * (100 + self.percent) >= self.percent * (F.col(f"n{a}") + F.col(f"n{b}"))

    def components(self) -> DataFrame:
        """(id, n_shingles, component_id): the smallest id reachable over links, per row."""
        rows, key = keyed(self.rows, "own")
        self.texts = rows.select(F.col(key).alias("id"), "text")
        self.kind = self.texts.schema["id"].dataType.simpleString()
        found = self._components()
        if key != "own":
            named = stored(found.join(rows.select(F.col(key).alias("id"), "own"), "id"), "named")
            least = stored(named.groupBy("component_id").agg(F.min("own").alias("least")), "least")
            found = stored(named.join(least, "component_id").select(F.col("own").alias("id"), "n_shingles", F.col("least").alias("component_id")), "components")
            dropped(rows, named, least)
        return found.withColumnRenamed("id", self.id_col)

    def _components(self) -> DataFrame:
        letters = self.texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bins = min(MOST_BINS, max(RANGE, 1 << (max(1, letters // 400) - 1).bit_length()))
        scanned = stored(self._sets(bins), "sets")
        ranks = self._sketch(scanned.where("part is not null"), bins)
        sketch, self.edges = self.spark.sparkContext.broadcast(ranks), _edges(ranks)
        self.sketch = sketch
        sets = scanned.where("part is null")
        # each aggregate is a table before it is joined, so that both sides of the join are plain exchanges, which Spark may split
        classes = stored(sets.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep")), "classes")
        member = stored(sets.join(classes, ["k1", "k2", "n"], "left").select("id", "n", "rep"), "members")
        prefixes = stored(self._prefixes(sketch), "prefixes")
        shared = stored(prefixes.groupBy("t").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("t"), "shared")
        reps = member.where("id = rep").select("id").distinct()
        posts = stored(prefixes.join(shared, "t").join(reps, "id", "left_semi").distinct(), "postings")
        release(self.spark)
        dropped(scanned, classes, prefixes, shared)
        x = posts.select("t", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("p").alias("px"))
        pivot = stored(posts.groupBy("t").agg(F.min(F.struct("p", "id", "n")).alias("v"), F.count("*").alias("c")).where("c > 1").select("t", F.col("v.id").alias("y"), F.col("v.n").alias("ny"), F.col("v.p").alias("py")), "pivots")
        pairs = x.join(pivot, "t").where(F.col("x") != F.col("y")).where(self._bound("x", "y"))
        ordered = lambda p: p.select(*(F.when(F.col("x") < F.col("y"), F.col(a)).otherwise(F.col(b)).alias(c) for c, a, b in (("x", "x", "y"), ("nx", "nx", "ny"), ("y", "y", "x"), ("ny", "ny", "nx")))).distinct()
        first = self._linked(ordered(pairs))
        comp = components(first, "x", "y")
        # what is not in its pivot's component meets all others of the shingle
        own = x.join(comp.select(F.col("node").alias("x"), F.col("component").alias("cx")), "x", "left").withColumn("cx", F.coalesce("cx", "x"))
        at = pivot.join(comp.select(F.col("node").alias("y"), F.col("component").alias("cy")), "y", "left").select("t", F.col("y").alias("pivot"), F.coalesce("cy", "y").alias("cp"))
        placed = stored(own.join(at, "t"), "placed")
        rest = placed.where("cx <> cp")
        others = placed.where("x <> pivot").select("t", *(F.col(a).alias(b) for a, b in (("x", "y"), ("nx", "ny"), ("px", "py"), ("cx", "cy"))))
        more = rest.join(others, "t").where("cx <> cy").where(self._bound("x", "y"))
        second = self._linked(ordered(more))
        final = components(first.union(second), "x", "y")
        out = member.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
        result = stored(out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id")), "components")
        release(self.spark)
        dropped(member, posts, pivot, first, second, placed)
        return result


FRAGMENTS = 4


def _edges(ranks: np.ndarray) -> np.ndarray:
    """Where the global order (rarity, then hash) is cut into FRAGMENTS parts that hold like numbers of shingles, by the sketch."""
    bins = np.bincount(ranks, minlength=256)
    mass = np.cumsum(bins * (2 ** (np.arange(256) / 6) - 1))
    out = []
    for i in range(1, FRAGMENTS):
        goal = mass[-1] * i / FRAGMENTS
        r = min(255, int(np.searchsorted(mass, goal)))
        before = mass[r - 1] if r else 0.0
        share = (goal - before) / max(mass[r] - before, 1e-9)
        out.append((r << 56) + min((1 << 56) - 1, int(share * (1 << 56))))
    return np.array(out, U64)
