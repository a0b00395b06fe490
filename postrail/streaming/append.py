"""Appending to an index from a stream.

A micro-batch of (list_id, doc_id) is built into lists and segments of its own, in a folder named by the
batch, which a repeated batch overwrites; so each posting is stored once, whatever fails in between. A posting
that arrives in two batches is stored twice and counts once in set queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.model import build_index, lists_of
from ..sources.store import Index


def store_batch(batch: DataFrame, path: str, number: int, epsilon: int | str = "adaptive") -> None:
    """Builds one batch of postings and stores it as part `number`, in place of what was there. Lines are fitted once."""
    segments = f"{path}/segments/batch={number}"
    build_index(batch, epsilon).segments.write.mode("overwrite").parquet(segments)
    lists_of(batch.sparkSession.read.parquet(segments)).write.mode("overwrite").parquet(f"{path}/lists/batch={number}")


def append(stream: DataFrame, path: str, progress: str, epsilon: int | str = "adaptive", **trigger) -> StreamingQuery:
    """Starts the query; `progress` is its checkpoint folder, and `trigger` goes to DataStreamWriter.trigger."""

    def store(batch: DataFrame, number: int) -> None:
        store_batch(batch, path, number, epsilon)

    writer = stream.select("list_id", "doc_id").writeStream.foreachBatch(store).option("checkpointLocation", progress)
    return (writer.trigger(**trigger) if trigger else writer).start()


def load_appended(spark: SparkSession, path: str) -> Index:
    """The index over all batches so far; positions run on from batch to batch, and `batch` tells parts with different bounds apart.

    `lists` has a row for each list and batch.
    """
    lists, segments = (spark.read.parquet(f"{path}/{t}") for t in ("lists", "segments"))
    before = Window.partitionBy("list_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    starts = lists.select("list_id", "batch", F.coalesce(F.sum("n").over(before), zero).alias("positions"), F.coalesce(F.sum("n_segments").over(before), zero).alias("parts"))
    moved = segments.join(starts, ["list_id", "batch"])
    moved = moved.withColumns({"first": F.col("first") + F.col("positions"), "seg_id": (F.col("seg_id") + F.col("parts")).cast("int")})
    return Index(lists, moved.drop("positions", "parts"))
