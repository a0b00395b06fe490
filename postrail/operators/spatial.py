"""Points: Morton order, boxes, exact nearest neighbours and membership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.zorder import morton


def with_code(points: DataFrame, coordinates: list[str], bits: int = 0) -> DataFrame:
    """Adds `zcode`, by which a table may be ranged so that boxes prune its files."""
    return points.withColumn("zcode", morton(*[F.col(c) for c in coordinates], bits=bits))


def box(points: DataFrame, low: dict[str, float], high: dict[str, float]) -> DataFrame:
    """The points within the closed box; plain bounds, which reach the scan."""
    return points.where(reduce(lambda a, b: a & b, [F.col(c).between(low[c], high[c]) for c in low]))


def square_distance(at: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [(F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in at.items()])


def nearest(points: DataFrame, at: dict[str, float], k: int, tie: str) -> DataFrame:
    """The k points of least distance, ties to the smaller `tie`; a bounded top-k of each task is merged."""
    return points.withColumn("distance2", square_distance(at)).orderBy("distance2", tie).limit(k)


def has_points(points: DataFrame, asked: DataFrame, coordinates: list[str]) -> DataFrame:
    """The asked points that are among `points`."""
    return asked.join(points.select(*coordinates), coordinates, "left_semi")
