"""Bounded samples of labelled rows that classifiers are fitted on; only fitting is bounded, never scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, least_by_hash

#: Labelled rows that a classifier is fitted on at most, those with the least hash of their id.
SAMPLE_ROWS = 12_000


def sample(docs: DataFrame, labels: DataFrame, label: str, trains: Column, rows: int = SAMPLE_ROWS, text: str = "text") -> DataFrame:
    """(doc_id, y, text): whole texts of at most `rows` labelled ids for which `trains` holds.

    An id's labels are reduced to their greatest, and its texts, where it has several, to the one of least hash, so an id
    counts once however often it repeats. Rows without an id or a label are never taken. The ids chosen are few enough to broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & trains).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = least_by_hash(known, ["doc_id"], rows)
    found = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return checkpoint(one.select("doc_id", "y", "text"))
