"""Importance resampling of documents towards a target corpus, by inverted postings of hashed features.

Features are runs of one and two words, hashed into buckets by CRC-32.  A
document's counts become postings (bucket, document, count): one row a document
and range of buckets, with the counts of that range in two arrays.  Totals of
both corpora meet by bucket after each task has added up its own.  Postings are
shuffled by range of buckets and, as frequent buckets are in nearly every
document, by a share of the documents; each such group meets the totals of its
range, computes the gains of its buckets and emits what they contribute to its
documents.  Contributions are reduced by document.

The draw is without replacement: a document's weight and a Gumbel variate of its
id make its score, and the highest scores are drawn.  Ranks come from a table in
the order of scores, whose parts are counted and shifted; no task sees all rows.

Defined cases: null and empty texts have no feature, weight 0, and are never
drawn; a null id counts as the empty string in the variate and comes last among
ties; rows that repeat an id are documents of their own (ties among them fall to
the first row read); an empty target or corpus gives gains of an empty side;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._cluster import dropped, release, small_batches, stored
from quarry.llm._text import ALNUM_ENDS, Words, chunks, lean

RANGES = 16  # ranges of buckets, each of which is a part of the postings' key
SHARE = 20_000  # documents of a group of postings, on average
CACHED = 64  # bytes of a word up to which its CRC is computed side by side with others


def _crc_table() -> np.ndarray:
    """What a byte does to a CRC-32 register, from the polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


TABLE = _crc_table()


def _after_zeros() -> np.ndarray:
    """[n][k][v]: a register that holds v in its byte k, n zero bytes later."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    out = [now]
    for _ in range(CACHED + 1):
        now = (now >> 8) ^ TABLE[now & 255]
        out.append(now)
    return np.stack(out)


AFTER = _after_zeros()


def _later(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs as the first part of something that goes on for n bytes."""
    out = AFTER[n, 0, crc & 255]
    for k in range(1, 4):
        out ^= AFTER[n, k, (crc >> np.uint32(8 * k)) & 255]
    return out


def word_crcs(words: Words) -> np.ndarray:
    """CRC-32 of each word's bytes."""
    size, reg = words.ends - words.starts, np.full(len(words), 0xFFFFFFFF, np.uint32)
    left, k = np.flatnonzero(size <= CACHED), 0
    while len(left):
        r = reg[left]
        reg[left] = TABLE[(r ^ words.data[words.starts[left] + k]) & 255] ^ (r >> np.uint32(8))
        k += 1
        left = left[size[left] > k]
    reg ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > CACHED).tolist():
        reg[i] = zlib.crc32(words.of(i))
    return reg


def feature_keys(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature: the words, then pairs of neighbours of a row joined by a space."""
    crc, rows, size = word_crcs(words), words.rows(), words.ends - words.starts
    first = np.flatnonzero(rows[1:] == rows[:-1])
    second = first + 1
    n = np.minimum(size[second], CACHED)
    space = np.full(len(n), zlib.crc32(b" "), np.uint32)
    pair = _later(crc[first], n + 1) ^ _later(space, n) ^ crc[second]
    for i in np.flatnonzero(size[second] > CACHED).tolist():
        pair[i] = zlib.crc32(words.of(second[i]), zlib.crc32(b" ", int(crc[first[i]])))
    return np.concatenate([rows, rows[first]]), np.concatenate([crc, pair]).astype(np.int64) % buckets


def postings(docs: DataFrame, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_words, n_features, part, buckets, counts): a document's own row has part -1 and its id; then one a range of buckets that it has."""
    small_batches(docs.sparkSession)
    width, kind = math.ceil(buckets / RANGES), docs.schema[id_col].dataType.simpleString()
    narrow = np.int16 if buckets <= 1 << 15 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(1)):
                words = Words(data, offs, ALNUM_ENDS, lower=True)
                row, bucket = feature_keys(words, buckets)
                n = hi - lo
                key = np.sort(row * (RANGES * width) + bucket)
                new = np.flatnonzero(np.diff(key, prepend=-1))
                times, key = np.diff(new, append=len(key)), key[new]
                group = key // width
                at = np.flatnonzero(np.diff(group, prepend=-1))
                group, ends = group[at], np.append(at, len(key)).astype(np.int32)
                m = len(group)
                head = np.zeros(n + 1, np.int32)
                n_words = np.diff(words.first)
                zeros = np.zeros(m, np.int64)
                cols = [
                    np.concatenate([base + np.arange(n), base + group // RANGES]),
                    pa.concat_arrays([b.column(0).slice(lo, n), pa.nulls(m, b.column(0).type)]),
                    np.concatenate([n_words, zeros]),
                    np.concatenate([np.maximum(2 * n_words - 1, 0), zeros]),
                    np.concatenate([np.full(n, -1), group % RANGES]).astype(np.int32),
                    pa.ListArray.from_arrays(np.concatenate([head, ends[1:]]), (key % (RANGES * width)).astype(narrow)),
                    pa.ListArray.from_arrays(np.concatenate([head, ends[1:]]), times.astype(np.int32)),
                ]
                base += n
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], ["row", "id", "n_words", "n_features", "part", "buckets", "counts"])

    schema = f"row long, id {kind}, n_words long, n_features long, part int, buckets array<{'smallint' if narrow is np.int16 else 'int'}>, counts array<int>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), schema)


def totals(posted: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, name): features of the corpus by bucket; a task adds up its own before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for b in batches:
            at = b.column(0).flatten().to_numpy(zero_copy_only=False)
            own += np.bincount(at, b.column(1).flatten().to_numpy(zero_copy_only=False), buckets).astype(np.int64) if len(at) else 0
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(own[some])], ["bucket", "n"])

    own = posted.where("part >= 0").select("buckets", "counts").mapInArrow(lean(run), "bucket int, n long")
    return own.groupBy("bucket").agg(F.sum("n").alias(name))


def gain(s: np.ndarray, t: np.ndarray, source: int, target: int, buckets: int) -> np.ndarray:
    """floor(1000 ln) of the ratio of the target's and the source's smoothed shares."""
    s, t = s.astype(np.float64), t.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * float(source + buckets) / ((s + 1) * float(target + buckets)))).astype(np.int64)


def weights(docs: DataFrame, target: DataFrame, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(row, id, n_words, n_features, weight) of every document: weight is the floored mean of its features' gains."""
    spark, width = docs.sparkSession, math.ceil(buckets / RANGES)
    posted = stored(postings(docs, buckets, id_col, text_col), "postings")
    wanted = target.select(F.lit(0).alias("id"), F.col(target_col).alias("text"))
    both = stored(totals(posted, buckets, "s").join(totals(postings(wanted, buckets, "id"), buckets, "t"), "bucket", "full"), "totals")
    source, aim = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    n = posted.where("part < 0").count()
    shares = max(1, -(-n // SHARE))
    share = F.pmod(F.xxhash64("row"), F.lit(shares)).cast("int").alias("share")
    dealt = posted.where("part >= 0").select("part", share, "row", "buckets", "counts")
    known = both.select((F.col("bucket") / width).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))

    def contribute(post: pa.Table, total: pa.Table) -> pa.Table:
        if not post.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "gains": pa.array([], pa.int64())})
        low = int(total["bucket"][0].as_py()) // width * width
        gains = np.zeros(width, np.int64)
        gains[total["bucket"].to_numpy() - low] = gain(total["s"].to_numpy(), total["t"].to_numpy(), source, aim, buckets)
        at, times = post["buckets"].combine_chunks(), post["counts"].combine_chunks()
        ends = np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        line = np.concatenate([[0], np.cumsum(gains[at.flatten().to_numpy().astype(np.int64) - low] * times.flatten().to_numpy())])
        return pa.table({"row": post["row"], "gains": pa.array(line[ends] - line[np.concatenate([[0], ends[:-1]])])})

    given = dealt.groupBy("part", "share").cogroup(known.groupBy("part", "share")).applyInArrow(contribute, "row long, gains long")
    own = posted.where("part < 0").select("row", "id", "n_words", "n_features", F.lit(0).cast("long").alias("gains"))
    every = own.unionByName(given, allowMissingColumns=True)
    reduced = every.groupBy("row").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.max("n_features").alias("n_features"), F.sum("gains").alias("gains"))
    mean = F.expr("CASE WHEN n_features > 0 THEN (gains - pmod(gains, n_features)) DIV n_features ELSE 0 END")
    out = stored(reduced.select("row", "id", "n_words", "n_features", mean.cast("long").alias("weight")), "weights")
    dropped(posted, both)
    release(spark)
    return out


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with ``rank`` from 1 in the given order, which should be total: parts of a table in that order are counted, and each is shifted by those before it."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    sizes = line.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row a partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("__part", before.alias("__before"))
    out = line.withColumn("__part", part).join(F.broadcast(shifts), "__part")
    return out.withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__before")


def draw(weighted: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """``weighted`` with score and rank; of the N documents with at least ``min_words`` words the floor(percent * N / 100) highest scores have one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weighted.withColumn("score", F.col("weight") + noise)
    able = scored.where(F.col("n_words") >= min_words)
    most = percent * able.count() // 100
    placed = ranked(able, F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return placed.unionByName(scored.where(F.col("n_words") < min_words), allowMissingColumns=True)


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; rank is null where it isn't drawn."""
    out = draw(weights(docs, target, buckets, id_col, text_col), percent, min_words, seed)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
