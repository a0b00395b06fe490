"""From lines and residuals back to postings, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import approximate
from ..sources.store import Index

#: Positions of a block by which single positions are looked up.
BLOCK = 1 << 12


def _value(j: Column, residual: Column) -> Column:
    return approximate(j, F.lit(0), F.col("intercept"), F.col("slope_exponent"), F.col("slope_significand")) + residual


def decode(segments: DataFrame, mode: str = "simd") -> DataFrame:
    """(list_id, pos, doc_id) of every posting: row-local arithmetic over exploded residuals, no shuffle.

    `mode` may be "simd" or "normal"; both give the same.
    """
    if mode not in ("simd", "normal"):
        raise ValueError("mode must be simd or normal")
    rows = segments.select("list_id", "first", "intercept", "slope_exponent", "slope_significand", F.posexplode("residual").alias("j", "e"))
    return rows.select("list_id", (F.col("first") + F.col("j")).alias("pos"), _value(F.col("j"), F.col("e")).alias("doc_id"))


def decode_segment(segments: DataFrame, list_id: int, seg_id: int) -> DataFrame:
    return decode(segments.where((F.col("list_id") == list_id) & (F.col("seg_id") == seg_id)))


def decode_differences(diffs: DataFrame, segments: DataFrame) -> DataFrame:
    """The same from stored differences: running sums within each line, for every bound but 1, whose residuals are stored as they are."""
    from pyspark.sql import Window

    along = Window.partitionBy("list_id", "seg_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    e = F.when(F.col("epsilon") < 3, F.col("diff")).otherwise(F.sum("diff").over(along))
    lines = segments.select("list_id", "seg_id", "first", "intercept", "slope_exponent", "slope_significand")
    rows = diffs.select("list_id", "seg_id", "pos", e.alias("e")).join(lines, ["list_id", "seg_id"])
    return rows.select("list_id", "pos", _value(F.col("pos") - F.col("first"), F.col("e")).alias("doc_id"))


def access(segments: DataFrame, asked: DataFrame) -> DataFrame:
    """`asked` (list_id, pos) with the posting there; positions that are not there give no row.

    Lines and positions meet in blocks of positions, an equi-join whatever a list's length.
    """
    blocks = F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("covered") - 1) / BLOCK)))
    lines = segments.withColumn("block", blocks)
    joined = asked.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(lines, ["list_id", "block"])
    j = F.col("pos") - F.col("first")
    inside = joined.where((j >= 0) & (j < F.col("covered")))
    return inside.select("list_id", "pos", _value(j, F.element_at("residual", (j + 1).cast("int"))).alias("doc_id"))


def unequal(decoded: DataFrame, postings: DataFrame) -> DataFrame:
    """One row, `unequal`: postings in one of the two but not in the other."""
    both = decoded.select("list_id", "doc_id", F.lit(1).alias("a"), F.lit(0).alias("b")).union(postings.select("list_id", "doc_id", F.lit(0), F.lit(1)))
    counts = both.groupBy("list_id", "doc_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return counts.agg(F.coalesce(F.sum(F.when(F.col("a") != F.col("b"), 1)), F.lit(0)).cast("long").alias("unequal"))


def verify(index: Index, postings: DataFrame) -> bool:
    return unequal(decode(index.segments), postings.select("list_id", "doc_id").distinct()).first()[0] == 0
