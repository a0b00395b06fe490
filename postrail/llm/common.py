"""What the corpus operators share: splits, checkpoints, batches of Arrow rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once, and of one text that it cuts up at once.
CHUNK_BYTES, BLOCK_BYTES = 4 << 20, 1 << 18
_SPACE = re.compile(rb"[ \t-\r]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo `modulus`; -1 for a null id, which is in no split."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(-1))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where the session names none and all is one machine, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="postrail-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Spark's setting by which an action's shuffle files go when it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """Frames made in here drop their shuffle files as soon as their action ends; what is made anew of them is shuffled anew."""
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder, so that it outlives executors; shuffle files that led to it are dropped."""
    shared_folder(df.sparkSession)
    with _freeing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: columnar and compressed, for wide rows."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with _freeing(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all checkpoints and stored frames of this session; results that were not yet read are lost with them."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        path = sc._jvm.org.apache.hadoop.fs.Path(sc._jsc.sc().getCheckpointDir().get())
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.delete(path, True)
        files.mkdirs(path)


def least_by_hash(frame: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The `rows` distinct rows of least hash of their keys (ties by the keys), or all if there are fewer.

    Rows are first thinned to about half as many again as are asked for, so that no task has to send its own
    `rows` best to the driver; should too few be left, all are ordered.
    """
    order = F.shiftrightunsigned(F.xxhash64(*keys), 32)
    known = frame.withColumn("_order", order)
    n = known.count()
    if n > 2 * rows:
        thin = known.where(F.col("_order") < int(1.5 * rows / n * 2**32))
        known = thin if thin.count() >= rows else known
    return known.orderBy("_order", *keys).limit(rows).drop("_order")


def most_frequent(counts: DataFrame, n: str, limit: int, key: str = "word") -> DataFrame:
    """The `limit` rows with the greatest counts `n`, ties by least hash of `key`; all rows if there are fewer.

    Only a histogram of counts comes to the driver, at most `limit` rows of it, so no task sends it its own `limit` greatest.
    """
    sizes = counts.groupBy(F.col(n).alias("c")).count().orderBy(F.desc("c"))
    held, over = 0, None
    for c, rows in sizes.toLocalIterator():
        if held + rows > limit:
            over = c
            break
        held += rows
    if over is None:
        return counts
    above = counts.where(F.col(n) > over)
    return above.union(least_by_hash(counts.where(F.col(n) == over), [key], limit - held)) if held < limit else above


def trim() -> None:
    """Gives back what this worker's allocators keep for later: workers outlive their tasks, and those of an executor share its memory."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that `column` holds about `limit` bytes in each, whole rows always."""
    for batch in batches:
        trim()
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def raw_texts(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]




def blocks(raw: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A text in parts of about `size` bytes that end after a space or line end; a longer word stays whole."""
    at = 0
    while at < len(raw):
        end = at + size
        if end < len(raw):
            cut = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end)) + 1
            if cut <= at:
                found = _SPACE.search(raw, end)
                cut = found.end() if found else len(raw)
            end = cut
        yield raw[at:end]
        at = end
