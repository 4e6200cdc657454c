"""The corpus pipeline: documents through five stages, each a table that the next one reads.

Every stage returns the columns of documents, but the last, which returns what
byte-level BPE makes of the texts that are left.  Stages take rows as they come:
null and empty texts go at language identification, which needs a letter; extra
columns are carried through; an empty table gives an empty table; texts of any
length are whole.  Rows without an id, or whose id others have too, are
documents like any other.  Of a group of near copies the row with the smallest
id stays; of rows that tie in it, the first of the numbered table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, jaccard, langid, substring
from quarry.llm._cluster import keyed, stored
from quarry.llm.queries import byte_bpe_ranks

#: SQL can't express language identification or BPE merging; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter or far from every centroid go."""
    names = docs.columns
    found = langid.predict(docs, langid.fit(docs), carry=tuple(names))
    return found.where("accepted").select(*names)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more between sets of five-word shingles: the one with the smallest id (null comes last)."""
    docs, key = keyed(docs)
    groups = jaccard.Join(docs, k=5, percent=80, id_col=key).components()
    if key != "doc_id":
        named = groups.select(key, "component_id").join(docs.select(key, "doc_id"), key)
        first = named.groupBy("component_id").agg(F.min_by(key, F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias(key))
        return docs.join(first.select(key).hint("shuffle_merge"), key, "left_semi").drop(key)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(kept.hint("shuffle_merge"), "doc_id", "left_semi")  # a shuffle at every size, as it must be at large ones


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 35 words that also start elsewhere; documents of which nothing is left go."""
    left = _counted(substring.remove(docs, substring.repeated(docs)))
    return left.where(F.length("text") > 0)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes decoded from them."""
    return bpe.round_trip(docs, byte_bpe_ranks())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard", join_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_benchmark_leaks),
    ("byte_bpe", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
