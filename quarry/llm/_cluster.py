"""The folder that all executors share, tables written to it, and connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 500  # rows of an Arrow batch: what executors hold off their heap grows with it
_written: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and the session is local."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    global _local
    _local = globals().get("_local") or tempfile.mkdtemp(prefix="quarry-")
    return f"file://{_local}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session has ended: its folder goes with it
            return


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df written as a table in the shared folder and read from there: later plans start from it, and it survives executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    for t in tables:
        remove(t.sparkSession, t._quarry_path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer in use; listeners hold on to the last plan until another has run."""
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of rows with long texts stay small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def keyed(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """Documents and a column that tells them apart: their id or, where one is null or repeated, a row number in a stored table."""
    if docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty():
        return docs, id_col
    return stored(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered"), "__row"


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the undirected links (a, b); nodes without a link are absent.

    Alternating large-star and small-star rounds: each is a pre-aggregated
    minimum by node and a join that Spark may split where one node has many
    links.  Rounds are tables in the shared folder; only two sums reach the driver.
    """
    links = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "links"
    )
    seen = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # aggregates and what they are joined with are tables: plain exchanges on both sides, which Spark may split
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        down = stored(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = (
            large.join(down, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        after = stored(small, "links")
        dropped(links, low, large, down)
        links = after
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum("v")).first()
        if state == seen:
            break
        seen = state
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
