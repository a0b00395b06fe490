"""The compressed index as Parquet tables."""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Index(NamedTuple):
    """lists: a row for each list; segments: a row for each line, with its residuals."""

    lists: DataFrame
    segments: DataFrame


#: What segments are sorted by.
KEYS = ("list_id", "seg_min_doc")


def save_index(index: Index, path: str, parts: int | None = None) -> None:
    """Writes both tables; segments are ranged and sorted by list and least posting, so that row-group statistics prune scans.

    Ranging reads the segments twice, so they are settled first and lines are fitted once.
    """
    own = settle(index)
    own.lists.write.mode("overwrite").parquet(f"{path}/lists")
    ranged = own.segments.repartitionByRange(parts, *KEYS) if parts else own.segments.repartitionByRange(*KEYS)
    ranged.sortWithinPartitions(*KEYS).write.mode("overwrite").parquet(f"{path}/segments")


def scratch(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; under one of our own only where the session names none and all is one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="postrail-"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def settle(index: Index, path: str | None = None) -> Index:
    """The index stored as it is dealt (in a scratch folder if no path is given), each part sorted, and loaded again; lines are fitted once."""
    from ..operators.model import lists_of

    spark = index.segments.sparkSession
    path = path or scratch(spark)
    index.segments.sortWithinPartitions(*KEYS).write.mode("overwrite").parquet(f"{path}/segments")
    lists_of(spark.read.parquet(f"{path}/segments")).write.mode("overwrite").parquet(f"{path}/lists")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/segments"))


#: List ids that are pushed into a scan as a filter; more are met in a join.
PUSHED = 1000


def load_lists(index: Index, wanted: DataFrame, strict: bool = False) -> Index:
    """The index of those lists only whose ids are in `wanted` (list_id). With `strict` an unknown id is an error."""
    wanted = wanted.select("list_id").distinct()
    few = [r.list_id for r in wanted.limit(PUSHED + 1).collect()]
    if strict and (lost := wanted.join(index.lists, "list_id", "left_anti").limit(5).collect()):
        raise ValueError(f"no such lists: {[r.list_id for r in lost]}")
    if len(few) <= PUSHED:
        return Index(index.lists.where(F.col("list_id").isin(few)), index.segments.where(F.col("list_id").isin(few)))
    return Index(index.lists.join(wanted, "list_id", "left_semi"), index.segments.join(wanted, "list_id", "left_semi"))


def save_codes(table: DataFrame, encoded: DataFrame, path: str) -> None:
    """A code table (list_id, symbol, count, code) and what was coded with it; tables as text, as they are few and often looked at."""
    table.select("list_id", "epsilon", "symbol", "count", "code").write.mode("overwrite").csv(f"{path}/table", sep="\t")
    encoded.write.mode("overwrite").parquet(f"{path}/coded")


def load_codes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    table = spark.read.schema("list_id long, epsilon int, symbol int, count long, code string").csv(f"{path}/table", sep="\t")
    return table, spark.read.parquet(f"{path}/coded")
