"""Benchmark decontamination: a broadcast hash set of normalised n-word windows of the test items, looked up for every window of every text.

Texts are lower-cased (A-Z) and split into runs of letters, digits and
non-ASCII characters.  An item's windows are its runs of n words; an item with
fewer words, but not none, is one window.  A hit by hash counts only when the
words are the same.  The items come in blocks of about a million words.  One
block, the usual case, is broadcast; more are built by the executors, as files in
the shared folder, and each task takes them one after the other for every few MB of text that it has
read, so a benchmark of any size is one stage and one block a task in memory.

Defined cases: null and empty texts and items have no words; repeated items
each count, those without an id as one item, which is counted and not named;
repeated rows are scanned alike, texts of any length whole; an empty benchmark leaves
everything clean; other columns are carried along untouched by ``clean``.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._cluster import fresh_dir, small_batches
from quarry.llm._text import ALNUM_ENDS, FIRST, U64, Words, chunks, lean

SCHEMA = "n_words long, hits binary, items array<string>"


def _order(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


class Items:
    """Windows of some items, by length: sorted hashes, the words behind each, and the items that have it."""

    def __init__(self, rows: list[tuple[str | None, str]], n: int):
        windows: dict[int, dict[tuple[int, bytes], set[str | None]]] = {}
        if rows:
            for lo, hi, data, offs in chunks(pa.array([t for _, t in rows], pa.large_string())):
                w = Words(data, offs, ALNUM_ENDS, lower=True)
                h = w.hashes()
                for i in range(hi - lo):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    size = min(n, b - a)
                    if size:
                        for j, g in enumerate(FIRST.grams(h[a:b], size).tolist()):
                            key = (g, b" ".join(w.of(x) for x in range(a + j, a + j + size)))
                            windows.setdefault(size, {}).setdefault(key, set()).add(rows[lo + i][0])
        self.by_size = {}
        for size, found in windows.items():
            keys = sorted(found)
            hashes = np.array([k for k, _ in keys], U64)
            maybe = np.zeros(1 << 18, bool)
            maybe[(hashes >> U64(46)).astype(np.int64)] = True
            self.by_size[size] = (hashes, maybe, [k for _, k in keys], [sorted(found[k], key=_order) for k in keys])

    def scan(self, w: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and the items found in each row."""
        cover, items = np.zeros(len(w) + 1, np.int64), {}
        h, row = w.hashes(), w.rows()
        for size, (hashes, maybe, words, owners) in self.by_size.items():
            g = FIRST.grams(h, size)
            at = np.flatnonzero(maybe[(g >> U64(46)).astype(np.int64)])
            at = at[row[at] == row[at + size - 1]]
            k = np.searchsorted(hashes, g[at])
            same = hashes[np.minimum(k, len(hashes) - 1)] == g[at]
            for i, j in zip(at[same].tolist(), k[same].tolist(), strict=True):
                own = b" ".join(w.of(x) for x in range(i, i + size))
                while j < len(hashes) and hashes[j] == g[i]:
                    if words[j] == own:
                        cover[i] += 1
                        cover[i + size] -= 1
                        items.setdefault(int(row[i]), set()).update(owners[j])
                    j += 1
        return np.cumsum(cover)[:-1] > 0, items


def _runs(hit: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of True, flat."""
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).astype("<i4").reshape(-1)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, n_words, hits, items): hits are the runs of hit words as little-endian (start, end) pairs of 32-bit word numbers, items the ids found, as sorted strings."""
    marked = _marked(docs, benchmark, [id_col], text_col, n, **how)
    return marked.select(F.col("c0").alias(id_col), "n_words", "hits", "items")


def _marked(docs: DataFrame, benchmark: DataFrame, names: list[str], text_col: str, n: int = 10, item_col: str = "item_id", item_text_col: str = "text", block_words: int = 1_000_000) -> DataFrame:
    """The named columns as c0, c1, ... and what ``scan`` finds."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text")).where("text is not null")
    items = items.distinct()  # an item that is repeated as it is counts once
    letters = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-letters // (2 * block_words)))  # a word and its separator take two characters at least
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")  # items of one id, or of none, are spread
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    out = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col(f"`{text_col}`").alias("text"))
    if blocks == 1:
        own = sc.broadcast(Items([(r[0], r[1]) for r in items.collect()], n))  # block_words words, about
        found = lambda: iter([own.value])
    else:
        folder = fresh_dir(docs.sparkSession, "benchmark")

        def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            _save(folder, key[0].as_py(), Items(list(zip(rows["id"].to_pylist(), rows["text"].to_pylist(), strict=True)), n))
            return pa.table({"rows": pa.array([rows.num_rows], pa.int64())})

        items.withColumn("block", block).groupBy("block").applyInArrow(build, "rows long").count()
        found = partial(_load, folder, blocks)
    return out.mapInArrow(lean(_pass(found, len(names), blocks)), f"{kinds}, {SCHEMA}")


def _save(folder: str, k: int, items: Items) -> None:
    """By a rename, as another attempt may write the same block."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    part = f"{root}/part-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(pickle.dumps(items))
    fs.move(part, f"{root}/{k}")


def _load(folder: str, blocks: int) -> Iterator[Items]:
    """The blocks that have items, one at a time."""
    fs, root = pafs.FileSystem.from_uri(folder)
    for k in range(blocks):
        if fs.get_file_info(f"{root}/{k}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{root}/{k}") as f:
                yield pickle.loads(f.read())


HELD = 8 << 20  # bytes of text that meet all blocks together, if there are several


def _pass(found: Callable[[], Iterator[Items]], width: int, blocks: int):
    def scan_all(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.slice(lo, hi - lo), Words(data, offs, ALNUM_ENDS, lower=True)) for b in batches for lo, hi, data, offs in chunks(b.column(width))]
        hits, named = [np.zeros(len(w), bool) for _, w in parts], [{} for _ in parts]
        for block in found():
            for i, (_, w) in enumerate(parts):
                hit, items = block.scan(w)
                hits[i] |= hit
                for row, names in items.items():
                    named[i].setdefault(row, set()).update(names)
        for (part, w), hit, items in zip(parts, hits, named, strict=True):
            runs = [_runs(hit[x:y]).tobytes() if i in items else b"" for i, (x, y) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays(
                [part.column(i) for i in range(width)] + [pa.array(np.diff(w.first)), pa.array(runs, pa.binary()), pa.array([sorted(items.get(i, ()), key=_order) for i in range(len(runs))], pa.list_(pa.string()))],
                [part.schema.names[i] for i in range(width)] + ["n_words", "hits", "items"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column(width).nbytes
            if blocks == 1 or size >= HELD:
                yield from scan_all(held)
                held, size = [], 0
        if held:
            yield from scan_all(held)

    return run


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of what ``scan`` returns."""
    kind = scanned.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [np.frombuffer(x, "<i4").reshape(-1, 2) for x in b.column(1).to_pylist()]
            sha = [hashlib.sha256(",".join(y for y in x if y is not None).encode()).hexdigest() for x in b.column(2).to_pylist()]
            n_hit = pa.array([int((x[:, 1] - x[:, 0]).sum()) for x in runs], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n_hit, pa.array(sha, pa.string()), b.column(3), b.column(4)], ["id", "n_hit", "items_sha256", "n_words", "n_items"])

    flat = scanned.select(id_col, "hits", "items", "n_words", F.size("items").cast("long").alias("n_items"))
    out = flat.mapInArrow(lean(run), f"id {kind}, n_hit long, items_sha256 string, n_words long, n_items long")
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", **how) -> DataFrame:
    """The texts without contamination, all columns kept: hit documents go, or (remove="spans") the bytes from the first to the last word of each hit run."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove: documents or spans")
    names = docs.columns
    found = _marked(docs, benchmark, names, text_col, **how)
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    if remove == "documents":
        return found.where(F.size("items") == 0).select(*own)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, raw in enumerate(b.column(len(names)).to_pylist()):
                if raw:
                    (_, _, data, offs), = chunks(b.column(at).slice(i, 1))
                    w, keep = Words(data, offs, ALNUM_ENDS, lower=True), np.ones(len(data), bool)
                    for x, y in np.frombuffer(raw, "<i4").reshape(-1, 2).tolist():
                        keep[w.starts[x] : w.ends[y - 1]] = False
                    keep[-1] = False
                    texts[i] = data[keep].tobytes().decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))], names)

    return found.select(*(f"c{i}" for i in range(len(names))), "hits").mapInArrow(lean(run), docs.schema)
