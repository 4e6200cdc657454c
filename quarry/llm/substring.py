"""Removal of long repeated word sequences through a compacted De Bruijn graph of word k-mers.

A window is ``window`` consecutive words of one document, two at least; every
window is an edge of the graph, from its first to its last window - 1 words.

1. Documents travel in chunks.  A chunk sends each of its distinct edges once,
   with the place of its first occurrence, to the edge's bucket; what repeats
   within the chunk it knows by itself.  A bucket finds the edges that several
   chunks have, and the first place of each in the corpus, its source.
2. Repeated edges that follow each other in a document, and whose sources
   follow each other in one document too, are a nonbranching path: they compact
   to a span of words with the coordinates of its source.  Where the graph
   branches, sources part, and a new span begins.
3. Spans are joined with the texts at both coordinates and verified: the words
   there must have equal SHA-256 digests.  Verified spans and their sources are
   what repeats, for an edge that occurs elsewhere has a source elsewhere, or is
   one.

An edge is an entry of a blob, never a row of Spark's; a hot one comes once a
chunk, whatever its occurrences there, and a source once, however many spans it
is for.  Edges are told apart by 64-bit hashes (of two that share one, the later
could be missed, with a chance of the number of words squared over 2**65), and
documents by 128 bits of their id and text.

Defined cases: null and empty texts, and those shorter than a window, lose
nothing; texts of any length are taken whole, in a chunk of their own if need
be; a window may repeat within its own document; rows that repeat an id, with
the same or another text, and rows with a null id are documents like any other;
an empty table gives none; extra columns are carried by ``remove`` and
otherwise ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import _cluster
from quarry.llm._cluster import dropped, fresh_dir, release, small_batches, stored
from quarry.llm._packed import groups, pack, unpack
from quarry.llm._text import FIRST, U64, Words, as_array, chunks, joined, lean, tidy

WINDOW = 35
CHUNK = 4 << 20
BUCKET = 4 << 20
MOST_BUCKETS = 1 << 20  # of more text, each holds more
DOCUMENT, EDGES, WITHIN = range(3)  # kinds of rows
KEY = "struct<h1:bigint,h2:bigint>"


def _key(id_col: str, text_col: str) -> Column:
    """What tells documents apart: rows that agree in it repeat each other."""
    both = [F.col(id_col).isNull(), F.col(id_col), F.col(text_col)]
    return F.struct(F.xxhash64(*both).alias("h1"), F.xxhash64(F.lit(5), *reversed(both)).alias("h2"))


def _compacted(at: list[np.ndarray], to: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Edges in order, each with its coordinates (the last is the word) and its source's, compacted to the first of each path, and the paths' lengths."""
    n = len(at[-1])
    if not n:
        return at, to, np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for line in (at, to):
        for c in line[:-1]:
            new[1:] |= c[1:] != c[:-1]
        new[1:] |= np.diff(line[-1]) != 1
    first = np.flatnonzero(new)
    return [c[first] for c in at], [c[first] for c in to], np.diff(np.append(first, n))


FIELDS = [f"x{i}" for i in range(1, 6)]
TRAVEL = f"kind int, chunk long, keys array<{KEY}>, " + ", ".join(f"{x} binary" for x in FIELDS)
_KEY_TYPE = pa.struct([pa.field("h1", pa.int64()), pa.field("h2", pa.int64())])
_KINDS = [pa.int32(), pa.int64(), pa.list_(_KEY_TYPE), *[pa.binary()] * 5]
_NAMES = ["kind", "chunk", "keys", *FIELDS]


def _edges(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Rows by bucket b: a chunk's documents; its sorted distinct edges with document and word of their first occurrences; spans that repeat within it (document, word, source's document and word, number of edges)."""

    def build(batches: list[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
        keys, text = (pa.concat_arrays([as_array(b.column(i)) for b in batches]) for i in range(2))
        for lo, hi, data, offs in chunks(text, CHUNK):
            w = Words(data, offs)
            g, row = FIRST.grams(w.hashes(), window), w.rows()
            whole = np.flatnonzero(row[: len(g)] == row[window - 1 :]) if len(g) else np.zeros(0, np.int64)
            word, doc = whole - w.first[row[whole]], row[whole]
            every, _, which = groups(g[whole])
            first = np.full(len(every), len(whole), np.int64)
            np.minimum.at(first, which, np.arange(len(whole)))
            again = np.flatnonzero(first[which] != np.arange(len(whole)))
            source = first[which[again]]
            at, to, n = _compacted([doc[again], word[again]], [doc[source], word[source]])
            home = chunk % buckets
            rows = [(home, DOCUMENT, chunk, keys.slice(lo, hi - lo).to_pylist(), *[None] * 5)]
            if len(n):
                rows.append((home, WITHIN, chunk, None, *map(pack, (*at, *to, n))))
            cuts = np.searchsorted(every, np.array([(i << 64) // buckets for i in range(1, buckets)], U64)).tolist()
            doc, word = doc[first], word[first]
            for b, (x, y) in enumerate(zip([0, *cuts], [*cuts, len(every)], strict=True)):
                if x < y:
                    rows.append((b, EDGES, chunk, None, pack(np.diff(every[x:y], prepend=U64(0))), pack(doc[x:y]), pack(word[x:y]), None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.int32(), *_KINDS])], ["b", *_NAMES])
            chunk += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            held.append(b)
            size += b.column(1).nbytes
            if size >= CHUNK:
                for out in build(held, chunk):
                    yield out
                    chunk += 1
                held, size = [], 0
        if held:
            yield from build(held, chunk)

    return docs.mapInArrow(lean(run), f"b int, {TRAVEL}")


def _sources(edges: DataFrame) -> DataFrame:
    """Documents and spans within chunks as they are; of edges those that another chunk has first: document, word, and their source's chunk, document and word."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        kind = t["kind"].to_numpy()
        rest = t.filter(pa.array(kind != EDGES)).select(_NAMES)
        t = t.filter(pa.array(kind == EDGES)).sort_by("chunk")
        if not t.num_rows:
            return rest
        chunk = t["chunk"].to_numpy()
        edge = [np.cumsum(unpack(x).astype(U64), dtype=U64) for x in t["x1"].to_pylist()]
        doc, word = (np.concatenate([unpack(x) for x in t[name].to_pylist()]) for name in ("x2", "x3"))
        own = np.repeat(np.arange(len(edge)), list(map(len, edge)))
        every, _, which = groups(np.concatenate(edge))
        del edge
        first = np.full(len(every), len(own), np.int64)
        np.minimum.at(first, which, np.arange(len(own)))  # chunks are in order
        again = np.flatnonzero(first[which] != np.arange(len(own)))
        source = first[which[again]]
        cuts = np.searchsorted(own[again], np.arange(len(chunk) + 1)).tolist()
        columns = [doc[again], word[again], chunk[own[source]], doc[source], word[source]]
        rows = [(EDGES, int(chunk[i]), None, *(pack(c[x:y]) for c in columns)) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y]
        found = pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], _NAMES)
        del own, every, which, first, again, source, columns, doc, word
        tidy()
        return pa.concat_tables([rest.cast(found.schema), found])

    return edges.groupBy("b").applyInArrow(run, TRAVEL)


SPAN = "chunk long, doc long, a long, other long, odoc long, oa long, n long"
SPAN_NAMES = [x.split()[0] for x in SPAN.split(", ")]


def _paths(found: DataFrame) -> DataFrame:
    """SPAN of the edges of each chunk, compacted over all its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, parts = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                doc, word, other, odoc, oword = (np.concatenate([unpack(p[x]) for p in parts]).astype(np.int64) for x in FIELDS)
                order = np.argsort(doc << 40 | word)
                at, to, n = _compacted([doc[order], word[order]], [other[order], odoc[order], oword[order]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk)), *map(pa.array, (*at, *to, n))], SPAN_NAMES)

    parts = found.groupBy("chunk").agg(F.collect_list(F.struct(*FIELDS)).alias("parts"))
    return parts.mapInArrow(lean(run), SPAN)


def _within(found: DataFrame) -> DataFrame:
    """SPAN of what repeats within a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, (doc, a, odoc, oa, n) = batch.column(0)[i].as_py(), (unpack(batch.column(k)[i].as_py()).astype(np.int64) for k in range(1, 6))
                here = np.full(len(n), chunk)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (here, doc, a, here, odoc, oa, n))), SPAN_NAMES)

    return found.select("chunk", *FIELDS).mapInArrow(lean(run), SPAN)


def _digests(rows: DataFrame) -> DataFrame:
    """(key, a, n, sha) of the spans listed with each text: the digest of their words, one space between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = as_array(b.column(2))
            ends = lists.offsets.to_numpy()
            a, n = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            for lo, hi, data, offs in chunks(b.column(1)):
                w = Words(data, offs)
                text, _ = joined(w, np.ones(len(w), bool))
                at = np.concatenate([[0], np.cumsum(w.ends - w.starts + 1)])
                x, y = ends[lo], ends[hi]
                row = np.repeat(np.arange(lo, hi), np.diff(ends[lo : hi + 1]))
                start = w.first[row - lo] + a[x:y]
                view = memoryview(text)
                sha = [hashlib.sha256(view[i : j - 1]).digest() for i, j in zip(at[start].tolist(), at[start + n[x:y]].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(a[x:y]), pa.array(n[x:y]), pa.array(sha, pa.binary())], ["key", "a", "n", "sha"])

    return rows.mapInArrow(lean(run), f"key {KEY}, a long, n long, sha binary")


def repeated(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, spans): for each document with repeated windows, array<struct<a bigint, n bigint>> of first words and numbers of words; spans may overlap."""
    if window < 2:
        raise ValueError("a window has two words at least")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    letters = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(1, -(-letters // BUCKET)))
    folder = fresh_dir(spark, "edges")
    found = _sources(_edges(texts, window, buckets))
    found.write.option("compression", "uncompressed").partitionBy("kind").parquet(folder)
    release(spark)
    every = spark.read.schema(found.schema).parquet(folder)
    spans = stored(_paths(every.where(F.col("kind") == EDGES)).union(_within(every.where(F.col("kind") == WITHIN))), "spans")
    places = stored(every.where(F.col("kind") == DOCUMENT).select("chunk", F.posexplode("keys").alias("doc", "key")).withColumn("doc", F.col("doc").cast("long")), "places")
    release(spark)
    _cluster.remove(spark, folder)
    # what is joined is a table on both sides, so that both are plain exchanges, which Spark may split
    located = spans.join(places, ["chunk", "doc"]).select("key", "a", "other", "odoc", "oa", (F.col("n") + (window - 1)).alias("n"))
    located = stored(located.join(places.select(F.col("chunk").alias("other"), F.col("doc").alias("odoc"), F.col("key").alias("okey")), ["other", "odoc"]).select("key", "a", "okey", "oa", "n"), "located")
    release(spark)
    dropped(spans, places)
    source = located.select(F.col("okey").alias("key"), F.col("oa").alias("a"), "n").distinct()
    wanted = located.select("key", "a", "n").union(source).distinct().groupBy("key").agg(F.collect_list(F.struct("a", "n")).alias("spans"))
    wanted = stored(wanted, "wanted")
    digests = stored(_digests(texts.join(wanted, "key").select("key", "text", "spans")).distinct(), "digests")
    release(spark)
    both = located.join(digests, ["key", "a", "n"]).join(digests.select(F.col("key").alias("okey"), F.col("a").alias("oa"), "n", F.col("sha").alias("osha")), ["okey", "oa", "n"])
    sure = stored(both.where("sha = osha").select("key", "a", "okey", "oa", "n"), "verified")
    release(spark)
    sides = sure.select("key", "a", "n").union(sure.select("okey", "oa", "n").distinct()).distinct()
    out = stored(sides.groupBy("key").agg(F.collect_list(F.struct("a", "n")).alias("spans")), "spans")
    release(spark)
    dropped(located, wanted, digests, sure)
    return out


def _kept(w: Words, spans) -> np.ndarray:
    """Which words stay; spans: a list array, one list a row."""
    cover = np.zeros(len(w) + 1, np.int64)
    spans = as_array(spans)
    row = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
    ends = spans.offsets.to_numpy()
    a = spans.values.field(0).to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    n = spans.values.field(1).to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    start = w.first[row] + a
    np.add.at(cover, start, 1)
    np.add.at(cover, start + n, -1)
    return np.cumsum(cover)[:-1] == 0


def _with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    empty = F.array().cast("array<struct<a:bigint,n:bigint>>")
    keyed = docs.withColumn("__key", _key(id_col, text_col))
    return keyed.join(spans.select(F.col("key").alias("__key"), F.col("spans").alias("__spans")), "__key", "left").withColumn("__spans", F.coalesce("__spans", empty))


def report(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(1)):
                w = Words(data, offs)
                kept = _kept(w, b.column(2).slice(lo, hi - lo))
                text, ends = joined(w, kept)
                view, n = memoryview(text), np.diff(np.concatenate([[0], np.cumsum(kept)])[w.first])
                sha = [hashlib.sha256(view[x : max(x, y - 1)]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(w.first)), pa.array(np.diff(w.first) - n), pa.array(sha)],
                    ["id", "n_words", "n_removed", "kept_sha256"],
                )

    rows = _with_spans(docs.select(id_col, text_col), spans, id_col, text_col).select(id_col, text_col, "__spans")
    out = rows.mapInArrow(lean(run), f"id {kind}, n_words long, n_removed long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def remove(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their repeated words cut out, kept words joined by one space; untouched texts stay as they are."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before, after = as_array(b.column(at)), []
            for lo, hi, data, offs in chunks(before):
                w = Words(data, offs)
                kept = _kept(w, b.column(len(names)).slice(lo, hi - lo))
                text, ends = joined(w, kept)
                cut = np.diff(np.concatenate([[0], np.cumsum(~kept)])[w.first]) > 0
                after += [text[x : max(x, y - 1)].tobytes().decode() if c else before[lo + i].as_py() for i, (x, y, c) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), cut.tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(after, pa.string()) if i == at else b.column(i) for i in range(len(names))], names)

    return _with_spans(docs, spans, id_col, text_col).select(*names, "__spans").mapInArrow(lean(run), docs.schema)
