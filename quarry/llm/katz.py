"""A word n-gram model of any order with Katz backoff: fitted to tables, which score these or other texts.

Texts are lower-cased (A-Z), split at ASCII white space, and ended by one end
token; order - 1 start marks stand before the first.  Counts are discounted
after Good and Turing up to ``TOP`` (where the level's counts of counts allow
it), what is left of a history goes to the words unseen after it in proportion
to their probability after the history without its first word, and so on down
to the unigrams, of which what is left goes to unknown words: every level sums
to exactly one.

All histories of a token end in the word before it, so a bucket of n-grams by
that word holds every level of them, and one shuffle serves any order.  A hot
history, one with more than 1 / HOT of the training tokens, is too much for one
bucket: the counts of its next words are kept spread by (history, word), its
sums are a row that every task gets, and its n-grams of the next level are
dealt by the history that is one word longer, and so on while those are hot.

Tables: the vocabulary and the hot levels' counts by bucket of their keys; the
n-grams with their counts and, for every history, its backoff weight by bucket
of the history, a folder a bucket.  Documents travel in chunks of a few MB:
a chunk asks the vocabulary and the hot levels for the counts of what it holds
(once, however often it occurs there), then its tokens go to their histories'
buckets, where they are counted or, by recursion from the shorter histories
to the longest, scored; sums by document come back.

Words and histories are told apart by 64-bit hashes.  Defined cases: null and
empty texts are one end token; a text of any length is one document, and a
chunk of its own if need be; repeated rows, also of one id, count and score
alike; without training rows every word is unknown and the score is that of
one unknown class, 0; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._cluster import dropped, fresh_dir, release, remove, small_batches, stored
from quarry.llm._packed import find, groups, pack, sorting, unpack
from quarry.llm._text import U64, Words, as_array, chunks, lean, mix, tidy

TOP = 5  # counts above it are not discounted
HOT = 256
MOST_HOT = 1 << 20  # a level's hot histories, however many buckets there are
CHUNK = 4 << 20
BUCKET = 8 << 20
MOST_BUCKETS = 1 << 20  # of more text, each holds more
PASSES = 2  # parts of the buckets that are scored one after the other, for less disk
END = U64(0x9D39247E33776D41)
UNIT = float(1 << 26)  # of the sums of -log10 that buckets send back
START, UNKNOWN = 0, 1  # numbers of the start mark and of words without a count; others follow


def discounts(of: list[int]) -> np.ndarray:
    """Good-Turing factors for counts 0..TOP from the numbers of events seen 1..TOP + 1 times; 1 where the estimate isn't between 0 and 1."""
    d = np.ones(TOP + 1)
    if of[0] and of[TOP]:
        tail = (TOP + 1) * of[TOP] / of[0]
        for r in range(1, TOP + 1):
            if of[r - 1] and tail < 1:
                x = ((r + 1) * of[r] / (r * of[r - 1]) - tail) / (1 - tail)
                d[r] = x if 0 < x < 1 else 1
    return d


class Unigrams:
    def __init__(self, n: int, distinct: int, of: list[int]):
        self.n, self.distinct, self.d = n, distinct, discounts(of)
        gone = sum(r * of[r - 1] * (1 - self.d[r]) for r in range(1, TOP + 1))
        self.total, self.unknown = (n, gone / n) if gone else (n + 1, 1 / (n + 1))

    def prob(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, c * np.where(c <= TOP, self.d[np.minimum(c, TOP).astype(np.int64)], 1) / self.total, self.unknown)


class Level:
    """Discounts of one level, and what they make of counts."""

    def __init__(self, of: list[int]):
        self.d = discounts(of)

    def totals(self, tokens: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Denominators of histories and the mass that is left of each, from their tokens and the numbers of words seen 1..TOP times after them."""
        gone = few @ (np.arange(1, TOP + 1) * (1 - self.d[1:]))
        total = np.where(gone > 0, tokens, tokens + 1.0)
        return total, np.where(gone > 0, gone, 1.0) / total

    def weights(self, left: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Backoff weights; seen: the probability one level below of all words seen after the history."""
        return left / np.maximum(1 - seen, 1e-300)

    def own(self, n: np.ndarray, total: np.ndarray) -> np.ndarray:
        return n * np.where(n <= TOP, self.d[np.minimum(n, TOP).astype(np.int64)], 1) / total


@dataclass
class Hot:
    """The hot histories of a level, sorted by key, with their denominators and backoff weights."""

    keys: np.ndarray
    total: np.ndarray
    weight: np.ndarray


@dataclass
class Model:
    """What ``fit`` leaves: the tables, and the few numbers that all tasks get."""

    order: int
    buckets: int
    words: DataFrame | None = None  # a row a bucket: key, n
    hot_counts: dict[int, DataFrame] = field(default_factory=dict)  # by level, a row a bucket: key, n, more
    folder: str = ""  # n-grams and backoff weights by bucket of the history
    unigrams: Unigrams | None = None
    levels: dict[int, Level] = field(default_factory=dict)
    hot: dict[int, Hot] = field(default_factory=dict)
    starts: int = 0  # training documents

    @property
    def limit(self) -> float:
        return max(self.unigrams.n / min(max(HOT, 2 * self.buckets), MOST_HOT), 1)

    def bare(self) -> Model:
        """Without the tables, for tasks."""
        return Model(self.order, self.buckets, None, {}, self.folder, self.unigrams, self.levels, self.hot, self.starts)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_tokens, n_known, train_tokens, base_score, score) of texts, which teach nothing."""
        state = _numbered(_rows(docs, F.lit(False), id_col, text_col), self)
        return state if state.columns[0] != "chunk" else _scored(state, self, id_col).drop("train")

    def drop(self) -> None:
        dropped(self.words, *self.hot_counts.values())
        remove(self.words.sparkSession, self.folder)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def _rows(docs: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))


CHUNK_COLUMNS = ["chunk", "ids", "size", "train", "tokens"]
ASKED = "b int, chunk long, key binary, n binary, more binary"
ASK_COLUMNS = [x.split()[0] for x in ASKED.split(", ")]
ASK_KINDS = [pa.int32(), pa.int64(), *[pa.binary()] * 3]


def _cuts(keys: np.ndarray, buckets: int) -> list[int]:
    """Where sorted keys are cut into buckets."""
    return [0, *np.searchsorted(keys, np.array([(i << 64) // buckets for i in range(1, buckets)], U64)).tolist(), len(keys)]


def _asks(chunk: int, keys: np.ndarray, n: np.ndarray, more: list[np.ndarray], buckets: int) -> list[tuple]:
    cuts = _cuts(keys, buckets)
    return [(b, chunk, pack(keys[x:y]), pack(n[x:y]), pack(np.concatenate([m[x:y] for m in more])) if more else None) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y]


def _chunk_table(rows: DataFrame, buckets: int) -> DataFrame:
    """Documents in chunks, their tokens as numbers into the chunk's sorted vocabulary (kind 0: CHUNK_COLUMNS), and what each chunk asks of the vocabulary's buckets (kind 1: ASK_COLUMNS)."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["kind", *CHUNK_COLUMNS, *(c for c in ASK_COLUMNS if c != "chunk")]

    def build(batches: list[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
        ids, text, train = (pa.concat_arrays([as_array(b.column(i)) for b in batches]) for i in range(3))
        kinds = [pa.int32(), pa.int64(), pa.list_(ids.type), *[pa.binary()] * 3, pa.int32(), *[pa.binary()] * 3]
        for lo, hi, data, offs in chunks(text, CHUNK):
            w = Words(data, offs, lower=True)
            size = np.diff(w.first) + 1
            tokens = np.insert(w.hashes(), w.first[1:], END)
            vocab, _, local = groups(tokens)
            own = train.slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(local[np.repeat(own, size)], minlength=len(vocab))
            out = [(0, chunk, ids.slice(lo, hi - lo).to_pylist(), pack(size), pack(own.astype(np.uint8)), pack(local), None, None, None, None)]
            out += [(1, k, None, None, None, None, b, *rest) for b, k, *rest in _asks(chunk, vocab, counts, [], buckets)]
            yield _batch(out, names, kinds)
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

    return rows.mapInArrow(lean(run), f"kind int, chunk long, ids array<{kind}>, size binary, train binary, tokens binary, b int, key binary, n binary, more binary")


def _stats(c: np.ndarray) -> list[int]:
    """Tokens, events, and events seen 1..TOP + 1 times."""
    return [int(c.sum()), int((c > 0).sum()), *np.bincount(np.minimum(c, TOP + 2).astype(np.int64), minlength=TOP + 3)[1 : TOP + 2].tolist()]


def _sum_stats(df: DataFrame) -> list[int]:
    """Sums over the rows' ``stats``, entry by entry."""
    return [r["n"] for r in df.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("n")).orderBy("i").collect()]


def _count(asked: DataFrame, buckets: int, numbered: bool) -> DataFrame:
    """Adds up what chunks (and, as chunk -1, a fitted table) ask for, by bucket: for each chunk its keys' counts and numbers; one row a bucket, as chunk -1, is the table of what has a count."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        b, chunk = key[0].as_py(), t["chunk"].to_pylist()
        keys = [unpack(x) for x in t["key"].to_pylist()]
        every, at, place = groups(np.concatenate(keys).astype(U64))
        c = np.bincount(place, np.concatenate([unpack(x) for x in t["n"].to_pylist()]), len(every)).astype(np.int64)
        number = np.full(len(every), UNKNOWN)
        if numbered:  # frequent words first; numbers are unique over all buckets
            known = np.flatnonzero(c)
            number[known[np.argsort(-c[known], kind="stable")]] = np.arange(len(known)) * buckets + b + UNKNOWN + 1
        cuts = np.cumsum([0, *map(len, keys)])
        some = c > 0
        more = None
        if not numbered:
            width = [unpack(x) for x in t["more"].to_pylist()]
            count = len(width[0]) // len(keys[0])
            columns = [np.concatenate([x.reshape(count, -1)[i] for x in width]).astype(U64) for i in range(count)]
            more = pack(np.concatenate([x[at[some]] for x in columns]))
        rows = [(b, k, None, pack(c[place[x:y]]), None, pack(number[place[x:y]]) if numbered else None, None, None) for k, x, y in zip(chunk, cuts[:-1], cuts[1:], strict=True) if k >= 0]
        rows.append((b, -1, pack(every[some]), pack(c[some]), more, None, _stats(c), int(c.max(initial=0))))
        tidy()
        return pa.Table.from_batches([_batch(rows, [*ASK_COLUMNS, "number", "stats", "most"], [*ASK_KINDS, pa.binary(), pa.list_(pa.int64()), pa.int64()])])

    return asked.groupBy("b").applyInArrow(run, f"{ASKED}, number binary, stats array<long>, most long")


KEPT = ["size", "train", "known", "base", "word", "number", "count"]


def _answers(counted: DataFrame) -> DataFrame:
    return counted.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("b", "n", "number")).alias("found"))


def _together(found: list[dict], name: str) -> np.ndarray:
    return np.concatenate([unpack(a[name]) for a in sorted(found, key=lambda a: a["b"])]).astype(np.int64)


def _know_words(state: DataFrame, unigrams: Unigrams) -> DataFrame:
    """Chunks with the number and count of each distinct word, frequent ones first, and each document's known words and base score."""
    kind = state.schema["ids"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size, train, tokens, found = (batch.column(k)[i].as_py() for k in range(2, 6))
                number, count = _together(found, "number"), _together(found, "n")
                order = np.argsort(-count, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                word, n = rank[unpack(tokens).astype(np.int64)], unpack(size).astype(np.int64)
                number, count = number[order], count[order]
                c, doc = count[word], np.repeat(np.arange(len(n)), n)
                base = np.bincount(doc, np.log10((c + 1) / (unigrams.n + unigrams.distinct + 1)), len(n))
                known = np.bincount(doc, c > 0, len(n)).astype(np.int64)
                packed = [size, train, *map(pack, (known, base, word, number, count))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *(pa.array([x], pa.binary()) for x in packed)], ["chunk", "ids", *KEPT])

    return state.mapInArrow(lean(run), f"chunk long, ids {kind}, " + ", ".join(f"{x} binary" for x in KEPT))


_A = U64(0x9E3779B97F4A7C15)


def extend(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a history with one more word before it, or of a history and the word after it."""
    return mix(key * _A + word.astype(U64) + U64(1))


class Tokens:
    """A chunk's tokens: their words, histories, and the counts that are known."""

    def __init__(self, row: dict, order: int, starts: int, limit: float):
        self.size, self.train, word, number, count = (unpack(row[x]).astype(np.int64) for x in ("size", "train", "word", "number", "count"))
        self.local, self.word, self.order = word, number[word], order
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.at = np.arange(len(word)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.counts = [count[word]]  # of the last 1, 2, ... words, from 2 on only where the history is hot
        hot, self.depth, level = np.ones(len(word), bool), np.zeros(len(word), np.int64), 2
        while level <= order:
            before = np.empty(len(word), np.int64)
            before[1:] = self.counts[-1][:-1]
            hot = hot & (np.where(self.at > 0, before, starts) > limit)
            self.hot = hot  # of the first level that isn't known, at the end
            if f"c{level}" not in row:
                break
            c = np.zeros(len(word), np.int64)
            c[hot] = unpack(row[f"c{level}"])
            self.counts.append(c)
            self.depth += hot
            level += 1

    def before(self, j: int, where: np.ndarray, names: np.ndarray | None = None) -> np.ndarray:
        """The words j places before the tokens ``where`` (or what else ``names`` has of each token)."""
        return np.where(self.at[where] >= j, (self.word if names is None else names)[np.maximum(where - j, 0)], START)

    def keys(self, words: int, where: np.ndarray) -> list[np.ndarray]:
        """Of the histories of 1, ... words of the tokens ``where``."""
        out = [np.zeros(len(where), U64)]
        for j in range(1, words + 1):
            out.append(extend(out[-1], self.before(j, where)))
        return out[1:]


def _after_hot(model: Model, level: int, where: np.ndarray, keys: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """p with the probabilities of this level at the places ``where``, whose histories have these keys."""
    out, own = p.copy(), model.hot[level]
    at = np.searchsorted(own.keys, keys)
    out[where] = np.where(c[where] > 0, model.levels[level].own(c[where], own.total[at]), own.weight[at] * p[where])
    return out


def _per_chunk(state: DataFrame, model: Model, make, schema: str) -> DataFrame:
    """make(chunk, tokens, row) -> record batches, for every chunk."""
    order, starts, limit = model.order, model.starts, model.limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names) if name != "ids"}
                yield from make(batch.slice(i, 1), Tokens(row, order, starts, limit), row)

    return state.mapInArrow(lean(run), schema)


def _ask_hot(state: DataFrame, model: Model, level: int) -> DataFrame:
    buckets = model.buckets

    def make(batch: pa.RecordBatch, t: Tokens, row: dict) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(t.hot)
        histories = t.keys(level - 1, at)
        keys, first, which = groups(extend(histories[-1], t.word[at]))
        n = np.bincount(which, t.train[t.doc[at]], len(keys)).astype(np.int64)
        more = [*(k[first] for k in histories), *(c[at[first]].astype(U64) for c in t.counts)]
        yield _batch(_asks(row["chunk"], keys, n, more, buckets), ASK_COLUMNS, ASK_KINDS)

    return _per_chunk(state, model, make, ASKED)


def _know_hot(state: DataFrame, model: Model, level: int) -> DataFrame:
    names = [c for c in state.columns if c != "found"]
    kinds = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in names)

    def make(batch: pa.RecordBatch, t: Tokens, row: dict) -> Iterator[pa.RecordBatch]:
        c = np.zeros(0, np.int64)
        if t.hot.any():
            at = np.flatnonzero(t.hot)
            c = _together(row["found"], "n")[groups(extend(t.keys(level - 1, at)[-1], t.word[at]))[2]]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array([pack(c)], pa.binary())], [*names, f"c{level}"])

    return _per_chunk(state, model, make, f"{kinds}, c{level} binary")


def _numbered(rows: DataFrame, model: Model) -> DataFrame:
    """Chunks with all that the vocabulary and the hot levels know of them; a model that is being fitted gets its vocabulary and hot counts here.  An empty table gives the empty result."""
    spark, fitted = rows.sparkSession, model.words is not None
    small_batches(spark)
    folder = fresh_dir(spark, "chunks")
    made = _chunk_table(rows, model.buckets)
    made.write.option("compression", "uncompressed").partitionBy("kind").parquet(folder)
    part = lambda k, columns: spark.read.schema(made.select(*columns).schema).parquet(f"{folder}/kind={k}")
    if rows.isEmpty():
        return spark.createDataFrame([], f"id {rows.schema['id'].dataType.simpleString()}, {SCORES}")
    table = lambda t: t.select(*ASK_COLUMNS)
    asked = part(1, ASK_COLUMNS)
    counted = stored(_count(asked.union(table(model.words)) if fitted else asked, model.buckets, True), "words")
    release(spark)
    remove(spark, f"{folder}/kind=1")
    if not fitted:
        sums = _sum_stats(counted)
        model.unigrams, model.words = Unigrams(sums[0], sums[1], sums[2:]), stored(counted.where("chunk < 0").select(*ASK_COLUMNS, "stats"), "vocabulary")
    state = stored(_know_words(part(0, CHUNK_COLUMNS).join(_answers(counted), "chunk"), model.unigrams), "numbered", "uncompressed")
    release(spark)
    remove(spark, folder)
    for level in range(2, model.order + 1):
        if level not in model.hot_counts if fitted else max(model.starts, counted.agg(F.max("most")).first()[0] or 0) <= model.limit:
            break  # no history of this length is hot, and no longer one
        dropped(counted)
        asked = _ask_hot(state, model, level)
        counted = stored(_count(asked.union(table(model.hot_counts[level])) if fitted else asked, model.buckets, False), "hot")
        release(spark)
        after = stored(_know_hot(state.join(_answers(counted), "chunk", "left"), model, level), "numbered", "uncompressed")
        release(spark)
        if not fitted:
            model.hot_counts[level] = stored(counted.where("chunk < 0").select(*ASK_COLUMNS, "stats"), "hot")
        dropped(state)
        state = after
    dropped(counted)
    return state


def _dealt(t: Tokens, model: Model, at: np.ndarray, mine=lambda b: b >= 0) -> tuple[np.ndarray, np.ndarray]:
    """The tokens ``at`` that are ``mine`` in the order of their buckets, and the buckets of all."""
    last = model.order - 1
    key, depth = np.zeros(len(at), U64), t.depth[at]
    for j in range(1, last + 1):
        deep = np.flatnonzero(depth >= j - 1)
        key[deep] = extend(key[deep], t.before(j, at[deep]))
    key = np.where(depth == last, extend(key, t.word[at]), key)
    b = (key % U64(model.buckets)).astype(np.int64)
    some = mine(b)
    at, b = at[some], b[some]
    line, room = b.astype(U64), min(22, int(t.local.max(initial=0) + 1).bit_length())
    for j in (1, 2):
        line = line << U64(room) | (t.before(j, at, t.local + 1).astype(U64) & U64((1 << room) - 1) if j <= last else U64(0))
    order = sorting(line)
    return at[order], b[order]


def _bucket_rows(b: np.ndarray, columns: list[np.ndarray], chunk: int) -> list[tuple]:
    new = np.flatnonzero(np.diff(b, prepend=-1))
    return [(int(b[x]), chunk, *(pack(c[x:y]) for c in columns)) for x, y in zip(new.tolist(), np.append(new[1:], len(b))[: len(new)].tolist(), strict=True)]


def _history_names(order: int) -> list[str]:
    return [f"h{j}" for j in range(1, order)]


def _fit_buckets(state: DataFrame, model: Model) -> DataFrame:
    """A row a bucket: its training n-grams of the longest kind with their counts, what is known of them below the bucket's level, and the counts of counts of each level."""
    order = model.order
    names = ["b", "chunk", *_history_names(order), "w", "depth", *(f"c{i}" for i in range(1, order))]
    bare = model.bare()

    def make(batch: pa.RecordBatch, t: Tokens, row: dict) -> Iterator[pa.RecordBatch]:
        at, b = _dealt(t, bare, np.flatnonzero(t.train[t.doc].astype(bool) & (t.depth < order - 1)))
        columns = [*(t.before(j, at) for j in range(1, order)), *(x[at] for x in (t.word, t.depth, *t.counts[: order - 1]))]
        yield _batch(_bucket_rows(b, columns, row["chunk"]), names, [pa.int32(), pa.int64(), *[pa.binary()] * (2 * order)])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        columns = [np.concatenate([unpack(x) for x in table[name].to_pylist()]) for name in names[2:]]
        every = Grams(order, columns[: order - 1], columns[order - 1], columns[order], np.ones(len(columns[0]), np.int64), histories=False)
        first, n = every.first[order], every.n[order]
        stats = [x for level in range(2, order + 1) for x in _stats(every.n[level])]
        second = columns[min(1, order - 2)][first].astype(U64)
        like = sorting(columns[0][first].astype(U64) << U64(min(32, int(second.max(initial=0)).bit_length())) ^ second)  # like histories together take less room
        first, n = first[like], n[like]
        packed = [pack(c[first]) for c in columns]
        out = _batch([(key[0].as_py(), *packed, pack(n), stats)], [names[0], *names[2:], "n", "stats"], [pa.int32(), *[pa.binary()] * (2 * order + 1), pa.list_(pa.int64())])
        del every, columns
        tidy()
        return pa.Table.from_batches([out])

    asked = _per_chunk(state, bare, make, "b int, chunk long, " + ", ".join(f"{x} binary" for x in names[2:]))
    return asked.groupBy("b").applyInArrow(run, "b int, " + ", ".join(f"{x} binary" for x in [*names[2:], "n"]) + ", stats array<long>")


class Grams:
    """Distinct n-grams of a bucket by level: sorted keys and counts, and the keys and tokens of their histories; for fitting also a place of each and which every row is."""

    def __init__(self, order: int, before: list[np.ndarray], word: np.ndarray, depth: np.ndarray, n: np.ndarray, histories: bool = True, places: bool = True):
        self.order, self.depth = order, depth.astype(np.uint8)
        key = np.zeros(len(word), U64)
        self.keys, self.n, self.first, self.which, self.histories, self.of, self.tokens = ({} for _ in range(7))
        for level in range(2, order + 1):
            key = extend(key, before[level - 2])
            at = self.some(level)
            self.keys[level], first, which = groups(extend(key[at], word[at]))
            count = self.n[level] = np.bincount(which, n[at], len(self.keys[level])).astype(np.int64)
            if places:
                self.first[level], self.which[level] = first.astype(np.int32), which.astype(np.int32)
            if histories:
                self.histories[level], _, own = groups(key[at])  # rows with one history lie together, so few are sorted
                own = own[first]
                self.of[level], self.tokens[level] = own.astype(np.int32), np.bincount(own, count, len(self.histories[level]))

    def some(self, level: int) -> np.ndarray:
        """Those whose history of this level is in the bucket whole."""
        return np.flatnonzero(self.depth <= level - 2)

    def totals(self, level: int, rules: Level) -> tuple[np.ndarray, np.ndarray]:
        own, n = self.of[level], self.n[level]
        few = np.stack([np.bincount(own[n == r], minlength=len(self.tokens[level])) for r in range(1, TOP + 1)], 1) if len(own) else np.zeros((0, TOP))
        return rules.totals(self.tokens[level], few)


def _weigh(raw: DataFrame, model: Model) -> DataFrame:
    """The buckets' n-grams and counts with the backoff weight of every history, level by level."""
    order, bare = model.order, model.bare()
    past = _history_names(order)
    names = ["b", *past, "w", "depth", "n", *(f"weight{level}" for level in range(2, order + 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                x = {k: unpack(v) for k, v in row.items() if isinstance(v, bytes)}
                g = Grams(order, [x[h] for h in past], x["w"], x["depth"], x["n"])
                p, key, weights = bare.unigrams.prob(x["c1"]), np.zeros(len(g.depth), U64), []
                for level in range(2, order + 1):
                    key = extend(key, x[past[level - 2]])
                    if level in bare.hot and level < order:
                        deep = np.flatnonzero(g.depth >= level - 1)
                        p = _after_hot(bare, level, deep, key[deep], x[f"c{level}"].astype(np.int64), p)
                    at, first, own = g.some(level), g.first[level], g.of[level]
                    total, left = g.totals(level, bare.levels[level])
                    seen = np.bincount(own, p[at[first]], len(total))
                    weights.append(bare.levels[level].weights(left, seen))
                    p[at] = bare.levels[level].own(g.n[level], total[own])[g.which[level]]
                packed = [row[k] for k in names[1 : order + 3]] + [pack(w) for w in weights]
                yield _batch([(row["b"], *packed)], names, [pa.int32(), *[pa.binary()] * (len(names) - 1)])

    return raw.drop("stats").mapInArrow(lean(run), "b int, " + ", ".join(f"{x} binary" for x in names[1:]))


def _hot_sums(model: Model, level: int) -> Hot:
    """The hot histories of a level, from the table of their counts; at most MOST_HOT rows."""
    bare = model.bare()
    few = [f"m{r}" for r in range(1, TOP + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = unpack(n).astype(np.int64)
                more = unpack(more).reshape(2 * level - 2, len(n))
                p = bare.unigrams.prob(more[level - 1])
                for k in range(2, level):
                    p = _after_hot(bare, k, np.arange(len(n)), more[k - 2].astype(U64), more[level + k - 2].astype(np.int64), p)
                keys, _, own = groups(more[level - 2].astype(U64))
                counts = [np.bincount(own, x, len(keys)).astype(np.int64) for x in (n, *(n == r for r in range(1, TOP + 1)))]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, counts), pa.array(np.bincount(own, p, len(keys)))], ["h", "t", *few, "seen"])

    parts = model.hot_counts[level].select("n", "more").where("more is not null").mapInArrow(lean(run), "h long, t long, " + ", ".join(f"{m} long" for m in few) + ", seen double")
    found = parts.groupBy("h").agg(*(F.sum(c).alias(c) for c in ("t", *few, "seen"))).collect()
    keys = np.array([r["h"] for r in found], np.int64).view(U64)
    order = np.argsort(keys)
    x = np.array([[r[c] for c in ("t", *few, "seen")] for r in found], float).reshape(len(found), TOP + 2)[order]
    total, left = model.levels[level].totals(x[:, 0], x[:, 1 : TOP + 1])
    return Hot(keys[order], total, model.levels[level].weights(left, x[:, TOP + 1]))


def _fit(state: DataFrame, model: Model) -> None:
    spark = state.sparkSession
    raw = stored(_fit_buckets(state, model), "grams", "uncompressed")
    release(spark)
    width = TOP + 3
    sums = _sum_stats(raw) or [0] * width * (model.order - 1)
    for level in range(2, model.order + 1):
        hot = _sum_stats(model.hot_counts[level]) if level in model.hot_counts else []
        hot = hot or [0] * width
        whole = [a + b for a, b in zip(sums[(level - 2) * width : (level - 1) * width], hot, strict=True)]
        model.levels[level] = Level(whole[2:])
        if level in model.hot_counts:
            model.hot[level] = _hot_sums(model, level)
    model.folder = fresh_dir(spark, "model")
    _weigh(raw, model).write.option("compression", "uncompressed").partitionBy("b").parquet(model.folder)
    dropped(raw)


def _load(folder: str, b: int, order: int) -> tuple[Grams, list[np.ndarray]]:
    """A bucket of the model: its n-grams and its histories' backoff weights."""
    fs, root = pafs.FileSystem.from_uri(folder)
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/b={b}", allow_not_found=True)) if f.base_name.endswith(".parquet")]
    none = np.zeros(0, np.int64)
    if not files:
        return Grams(order, [none] * (order - 1), none, none, none, places=False), [none.astype(float)] * (order - 1)
    with fs.open_input_file(files[0]) as source:
        row = pq.read_table(source).to_pylist()[0]
    x = {k: unpack(v) for k, v in row.items() if isinstance(v, bytes)}
    return Grams(order, [x[h] for h in _history_names(order)], x["w"], x["depth"], x["n"], places=False), [x[f"weight{level}"] for level in range(2, order + 1)]


SCORES = "train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_buckets(state: DataFrame, model: Model, part: int) -> DataFrame:
    """(chunk, doc, s): sums of -log10 by document from the buckets of one part."""
    bare, order = model.bare(), model.order
    past = _history_names(order)
    names = ["b", "chunk", *past, "w", "depth", *(f"c{i}" for i in range(1, order + 1)), "doc"]

    def make(batch: pa.RecordBatch, t: Tokens, row: dict) -> Iterator[pa.RecordBatch]:
        at, b = _dealt(t, bare, np.arange(len(t.word)), lambda b: b % PASSES == part)
        counts = [*t.counts, *[np.zeros(len(t.word), np.uint8)] * (order - len(t.counts))]
        columns = [*(t.before(j, at) for j in range(1, order)), *(x[at] for x in (t.word, t.depth, *counts, t.doc))]
        yield _batch(_bucket_rows(b, columns, row["chunk"]), names, [pa.int32(), pa.int64(), *[pa.binary()] * (2 * order + 2)])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grams, weights = _load(bare.folder, key[0].as_py(), order)
        column = lambda name: [unpack(x) for x in table[name].to_pylist()]
        docs = column("doc")
        before, word, depth = [np.concatenate(column(h)) for h in past], np.concatenate(column("w")), np.concatenate(column("depth"))
        p, history = bare.unigrams.prob(np.concatenate(column("c1"))), np.zeros(len(word), U64)
        for level in range(2, order + 1):
            history = extend(history, before[level - 2])
            deep = np.flatnonzero(depth >= level - 1)
            if len(deep):  # only where the level has hot histories
                p = _after_hot(bare, level, deep, history[deep], np.concatenate(column(f"c{level}")).astype(np.int64), p)
            at = np.flatnonzero(depth <= level - 2)
            keys, events = grams.histories[level], grams.keys[level]
            if not len(at) or not len(keys):
                continue
            total, _ = grams.totals(level, bare.levels[level])
            e, known = find(events, extend(history[at], word[at]))
            seen, e = at[known], e[known]
            p[seen] = bare.levels[level].own(grams.n[level][e], total[grams.of[level][e]])
            at = at[~known]
            h, known = find(keys, history[at])
            p[at[known]] *= weights[level - 2][h[known]]
        lost = np.maximum(np.rint(-np.log10(p) * UNIT), 0).astype(np.int64)
        rows, x = [], 0
        for chunk, doc in zip(table["chunk"].to_pylist(), docs, strict=True):
            own = np.flatnonzero(np.bincount(doc))
            rows.append((chunk, pack(own), pack(np.bincount(doc, lost[x : x + len(doc)])[own].astype(np.int64))))
            x += len(doc)
        del grams, weights, p, before, word, history
        tidy()
        return pa.Table.from_batches([_batch(rows, ["chunk", "doc", "s"], [pa.int64(), pa.binary(), pa.binary()])])

    asked = _per_chunk(state, bare, make, "b int, chunk long, " + ", ".join(f"{x} binary" for x in names[2:]))
    return asked.groupBy("b").applyInArrow(run, "chunk long, doc binary, s binary")


def _scored(state: DataFrame, model: Model, id_col: str) -> DataFrame:
    spark, n_train = state.sparkSession, model.unigrams.n
    sums = []
    for part in range(PASSES):
        sums.append(stored(_score_buckets(state, model, part), "sums", "uncompressed"))
        release(spark)
    every = sums[0]
    for more in sums[1:]:
        every = every.union(more)
    kind = state.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size, train, known, base = (unpack(batch.column(k)[i].as_py()) for k in range(2, 6))
                total = np.zeros(len(size))
                for found in batch.column(6)[i].as_py():
                    total[unpack(found["doc"]).astype(np.int64)] -= unpack(found["s"]) / UNIT
                columns = [batch.column(1)[i].values, pa.array(train.astype(bool)), *(pa.array(x.astype(np.int64)) for x in (size, known)), pa.array(np.full(len(size), n_train)), pa.array(base), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    found = every.groupBy("chunk").agg(F.collect_list(F.struct("doc", "s")).alias("sums"))
    own = state.select("chunk", "ids", "size", "train", "known", "base").join(found, "chunk")
    out = stored(own.mapInArrow(lean(run), f"id {kind}, {SCORES}"), "scores")
    release(spark)
    dropped(state, *sums)
    return out.withColumnRenamed("id", id_col)


def _begun(rows: DataFrame, order: int) -> Model:
    if order < 2:
        raise ValueError("the order is 2 at least")
    sums = rows.agg(F.sum(F.octet_length("text")), F.sum(F.col("train").cast("long"))).first()
    return Model(order, min(MOST_BUCKETS, max(1, -(-(sums[0] or 0) // BUCKET))), starts=sums[1] or 0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> Model:
    """A model of all documents given; ``order`` words, 2 at least, make the longest n-gram."""
    rows = _rows(docs, F.lit(True), id_col, text_col)
    model = _begun(rows, order)
    state = _numbered(rows, model)
    if state.columns[0] != "chunk":
        raise ValueError("there is nothing to learn from")
    _fit(state, model)
    dropped(state)
    return model


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every document, learnt from those where ``train`` holds; documents are numbered once for both."""
    rows = _rows(docs, train, id_col, text_col)
    model = _begun(rows, order)
    state = _numbered(rows, model)
    if state.columns[0] != "chunk":
        return state.withColumnRenamed("id", id_col)
    _fit(state, model)
    out = _scored(state, model, id_col)
    model.drop()
    return out
