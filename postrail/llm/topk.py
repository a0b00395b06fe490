"""Exact top-k inner-product search: tiled matrix products, partial selection, merging by query.

Vectors are quantised to floor(scale * x). The queries are read in blocks of bounded size; each block
is broadcast, which in Spark is by way of the driver, and taken back once its results are stored, so the driver and the
executors hold `PLAN_BLOCKS` blocks at most. Every partition of candidates is multiplied with it tile by tile. A tile keeps, for
each query, its k best by partial selection (ties to the smaller id); they are folded into the
partition's list, and the lists of a query are merged in two levels. A block's products are exact:
in doubles while no sum can pass 2^53, in 64-bit integers below 2^63, else in Python's integers.
Scores beyond 64 bits are returned as the nearest 64-bit number.

Vectors that are null, hold a null or non-finite component, or have no id take no part. A query meets
only vectors of its own length. A query's own row is left out once, so another row with the same id
is a candidate; repeated query rows each give their list. An empty table gives no rows, and neither does one without queries;
a query without candidates has none. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Queries in a block, candidates in a tile, and blocks whose results are merged in one plan.
QUERY_BLOCK, TILE, PLAN_BLOCKS = 4096, 2048, 16
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def quantise(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(vectors * float(scale))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of whole numbers held in doubles, as int64."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2**62 and max(np.abs(a).max(), np.abs(b).max()) < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(exact, LOW, HIGH).astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ids ascending among equal scores; `ids` ascend along a row or are one row for all."""
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k][:, None]
        above, ties = scores > least, scores == least
        room = k - above.sum(1, keepdims=True)
        keep = above | (ties & (np.cumsum(ties, axis=1) <= room))
        columns = np.nonzero(keep)[1].reshape(-1, k)
        scores = np.take_along_axis(scores, columns, 1)
        ids = ids[columns] if ids.ndim == 1 else np.take_along_axis(ids, columns, 1)
    elif ids.ndim == 1:
        ids = np.broadcast_to(ids, scores.shape)
    return scores, ids


def _merge(old: tuple | None, new: tuple, k: int) -> tuple:
    if old is None:
        return new
    scores, ids = np.concatenate([old[0], new[0]], 1), np.concatenate([old[1], new[1]], 1)
    order = np.argsort(ids, axis=1, kind="stable")
    return select(np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1), k)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of each length in a batch, ids ascending."""
    column = batch.column("vector")
    sizes, ids = np.diff(column.offsets.to_numpy()), batch.column("id").to_numpy()
    flat, begins = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()[:-1]
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        own = own[np.argsort(ids[own], kind="stable")]
        yield ids[own], flat[begins[own][:, None] + np.arange(size)]


def _multiply(shared, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value  # length -> (query numbers, quantised vectors)
        best: dict[int, tuple] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                for ids, vectors in _vectors(batch.slice(at, TILE)):
                    size = vectors.shape[1]
                    if size in blocks:
                        scores = product(blocks[size][1], quantise(vectors, scale))
                        best[size] = _merge(best.get(size), select(scores, ids, k), k)
        for size, (scores, ids) in best.items():
            offsets = pa.array(np.arange(len(scores) + 1, dtype=np.int32) * scores.shape[1])
            top = pa.StructArray.from_arrays([pa.array(np.negative(scores, where=scores > LOW, out=np.full_like(scores, HIGH)).ravel()), pa.array(np.ascontiguousarray(ids).ravel())], ["lost", "id"])
            part = pa.array(np.full(len(scores), hash(int(ids.flat[0])) % 64 if ids.size else 0, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(blocks[size][0]), part, pa.ListArray.from_arrays(offsets, top)], ["query", "part", "top"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~bad)
    candidates = rows.select("id", "vector")
    plans, done, used = [], [], []
    for ids, block in _blocks(rows.where("asks").select("id", "vector"), scale):
        if len(plans) == PLAN_BLOCKS:
            done.append(checkpoint(_union(plans)))
            for shared in used:
                shared.destroy()
            plans, used = [], []
        used.append(spark.sparkContext.broadcast(block))
        lists = candidates.mapInArrow(_multiply(used[-1], k + 1, scale), "query int, part int, top array<struct<lost: long, id: long>>")
        plans.append(_best(lists, ids, k))
    out = _union(done + plans)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for frame in frames:
        out = frame if out is None else out.union(frame)
    return out


def _blocks(queries: DataFrame, scale: int) -> Iterator[tuple[list, dict]]:
    """The queries, one partition after another, in blocks of bounded size."""
    held: list = []

    def block() -> tuple[list, dict]:
        lengths: dict[int, list[int]] = {}
        for i, (_, v) in enumerate(held):
            lengths.setdefault(len(v), []).append(i)
        vectors = {n: quantise(np.array([held[i][1] for i in own], np.float64).reshape(len(own), n), scale) for n, own in lengths.items()}
        own_scores = {i: int(product(v[j : j + 1], v[j : j + 1])[0, 0]) for n, v in vectors.items() for j, i in enumerate(lengths[n])}
        return [(i, x[0], own_scores[i]) for i, x in enumerate(held)], {n: (np.array(lengths[n], np.int32), v) for n, v in vectors.items()}

    for x in queries.toLocalIterator():
        held.append((x.id, x.vector))
        if len(held) == QUERY_BLOCK:
            yield block()
            held = []
    if held:
        yield block()


def _best(lists: DataFrame, ids: list, k: int) -> DataFrame:
    """Merges the partitions' lists by query, first within groups of partitions, and leaves out the query itself once."""
    top = lambda: F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k + 1).alias("top")
    merged = lists.groupBy("query", "part").agg(top()).groupBy("query").agg(top())
    names = lists.sparkSession.createDataFrame(ids, "query int, query_id long, own long")
    own = F.struct(F.when(F.col("own") > LOW, -F.col("own")).otherwise(F.lit(HIGH)).alias("lost"), F.col("query_id").alias("id"))
    at = F.array_position("top", own)
    kept = F.when(at > 0, F.expr("concat(slice(top, 1, cast(at - 1 as int)), slice(top, cast(at + 1 as int), size(top)))")).otherwise(F.col("top"))
    flat = merged.join(F.broadcast(names), "query").withColumn("at", at).withColumn("kept", F.slice(kept, 1, k))
    out = flat.select("query_id", F.posexplode("kept").alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.when(F.col("x.lost") == HIGH, F.lit(LOW)).otherwise(-F.col("x.lost")).alias("score"))
