"""Posting lists out of ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reserved; no posting may have it. Fixed value: the greatest unsigned 32-bit number.
SENTINEL = 4294967295


def postings(table: DataFrame, list_id: Column | str, doc_id: Column | str) -> DataFrame:
    """Distinct (list_id, doc_id) pairs; rows with a null in either are no postings."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    pairs = table.select(as_column(list_id).cast("long").alias("list_id"), as_column(doc_id).cast("long").alias("doc_id"))
    return pairs.where("list_id IS NOT NULL AND doc_id IS NOT NULL").distinct()


def postings_of_terms(table: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Distinct (term, doc_id): the lower-cased runs of ASCII letters and digits of each text."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))
    return table.where(F.col(doc_id).isNotNull()).select(F.explode(terms).alias("term"), F.col(doc_id).cast("long").alias("doc_id")).distinct()


def numbered(rows: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """`rows` with their place in the order from 1. They are sorted and stored over the cluster; only the sizes of the parts are added up."""
    from .store import scratch

    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    rows.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")).write.parquet(path)
    stored = spark.read.parquet(path)
    sizes = stored.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_start") + 1
    return stored.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_part", "_at", "_start")


def validate(rows: DataFrame) -> DataFrame:
    """The same postings; reading one that is negative, or not below the sentinel, is an error."""
    bad = (F.col("doc_id") < 0) | (F.col("doc_id") >= SENTINEL)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("posting out of range: "), F.col("doc_id").cast("string"))).cast("long")).otherwise(F.col("doc_id"))
    return rows.withColumn("doc_id", checked)
