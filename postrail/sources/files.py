"""Binary collections, query files and key files.

A collection is a stream of little-endian unsigned 32-bit numbers: 1, the universe, and then for each
list its length and its ascending postings; files of any length are read. A query file has one query in a line, ids set apart by spaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Postings in one row of a parsed collection.
PART = 1 << 16


#: Bytes of a collection file up to which one task reads it whole; a larger one is read in parts of many lists.
WHOLE = 1 << 30
#: Words that are held while a large file's list lengths are followed.
WINDOW = 1 << 22


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is this machine's."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _batch(name: str, ordinal: int, begin: int, own: np.ndarray) -> pa.RecordBatch:
    n = len(own)
    return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.full(n, ordinal)), pa.array(np.arange(begin, begin + n, dtype=np.int32)), pa.array(own.astype(np.int64))], ["file", "list_id", "pos", "doc_id"])


def _lists(data: np.ndarray, name: str, ordinal: int, drop_last: bool) -> Iterator[pa.RecordBatch]:
    """The lists that lie one after another in `data`, the first of them the file's `ordinal`th."""
    at = 0
    while at < len(data):
        n = int(data[at])
        own = data[at + 1 : at + 1 + n]
        if len(own) < n:
            raise ValueError(f"{name} ends within list {ordinal}")
        own = own[:-1] if drop_last else own
        for begin in range(0, len(own), PART):
            yield _batch(name, ordinal, begin, own[begin : begin + PART])
        at, ordinal = at + 1 + n, ordinal + 1


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of large files, of some `WINDOW` words unless one list is longer: file, the word where it begins, its words, its first list's ordinal."""
    for batch in batches:
        for name in batch.column("path").to_pylist():
            store, path = _store(name)
            with store.open_input_file(path) as file:
                words, held, window = file.size() // 4, np.zeros(0, "<u4"), 0
                if words < 2 or np.frombuffer(file.read_at(4, 0), "<u4")[0] != 1:
                    raise ValueError(f"{name} is no collection")
                at, ordinal, out, begin, first = 2, 0, [], 2, 0
                while at < words:
                    if not window <= at < window + len(held):
                        held, window = np.frombuffer(file.read_at(4 * WINDOW, 4 * at), "<u4"), at
                    at, ordinal = at + 1 + int(held[at - window]), ordinal + 1
                    if at > words:
                        raise ValueError(f"{name} ends within list {ordinal - 1}")
                    if at - begin >= WINDOW or at == words:
                        out.append((name, begin, at - begin, first))
                        begin, first = at, ordinal
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], ["path", "begin", "words", "ordinal"])


def read_docs(spark: SparkSession, path: str, compat_drop_last: bool = False) -> DataFrame:
    """(file, list_id, pos, doc_id) of the collections at `path`; list_id is a list's ordinal in its file.

    A file of up to `WHOLE` bytes is read by one task through Spark's own reader. The list lengths of a larger one are followed by
    one task that holds `WINDOW` words; its parts are then read by many, through the store that its address names. With
    `compat_drop_last` the last posting of each list is left out, as some old readers do.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = np.frombuffer(raw.as_buffer(), "<u4")
                if len(data) < 2 or data[0] != 1:
                    raise ValueError(f"{name} is no collection")
                yield from _lists(data[2:], name, 0, compat_drop_last)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, where = _store(r["path"])
                with store.open_input_file(where) as file:
                    yield from _lists(np.frombuffer(file.read_at(4 * r["words"], 4 * r["begin"]), "<u4"), r["path"], r["ordinal"], compat_drop_last)

    schema = "file string, list_id long, pos int, doc_id long"
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= WHOLE).select("path", "content").mapInArrow(whole, schema)
    large = files.where(F.col("length") > WHOLE).select("path").mapInArrow(_spans, "path string, begin long, words long, ordinal long")
    return small.union(large.repartition("path", "begin").mapInArrow(parts, schema))


def write_docs(rows: DataFrame, path: str, universe: int, parts: int = 1) -> None:
    """Writes (list_id, doc_id) as `parts` collection files under the folder `path`, lists in the order of their ids.

    `path` is an address of a store that all executors reach; a path without a scheme is taken for one only where all is one machine. Each task
    writes its own range of lists under a name of its own and then gives the file its name, so a task that is run again does no harm.
    """
    if ":" not in path.split("/")[0] and not rows.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError(f"{path} would be on each executor's own disk; give an address with a scheme")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        target = f"{folder}/{TaskContext.get().partitionId():05d}.docs"
        draft = f"{folder}/_{TaskContext.get().partitionId():05d}.{TaskContext.get().taskAttemptId()}"
        held: list[np.ndarray] = []
        current, count = None, 0
        with store.open_output_stream(draft) as out:
            out.write(np.array([1, universe], "<u4").tobytes())

            def close() -> None:
                if current is not None:
                    own = np.concatenate(held)
                    out.write(np.array([len(own)], "<u4").tobytes() + own.astype("<u4").tobytes())

            for batch in batches:
                ids, docs = (batch.column(c).to_numpy() for c in ("list_id", "doc_id"))
                for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids)) + 1) if len(ids) else ():
                    if ids[part[0]] != current:
                        close()
                        current, held, count = ids[part[0]], [], count + 1
                    held.append(docs[part])
            close()
        store.move(draft, target)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["lists"])

    ordered = rows.select("list_id", "doc_id").repartitionByRange(parts, "list_id").sortWithinPartitions("list_id", "doc_id")
    ordered.mapInArrow(run, "lists long").write.format("noop").mode("overwrite").save()


def write_keys(keys: list[int], path: str) -> None:
    """A key file: a 64-bit count, then the 64-bit keys."""
    store, where = _store(path)
    with store.open_output_stream(where) as out:
        out.write(np.array([len(keys), *keys], "<i8").tobytes())


def lines_of_queries(lines: DataFrame, line: str = "value", query_id: str = "query_id") -> DataFrame:
    """(query_id, list_id), distinct: the numbers of each line up to its first word that is none."""
    numbers = F.transform(F.split(F.trim(line), r"\s+"), lambda x: x.try_cast("long"))
    stop = F.array_position(F.transform(numbers, lambda x: x.isNull()), True)
    upto = F.when(stop == 0, F.size(numbers)).otherwise((stop - 1).cast("int"))
    return lines.select(query_id, F.explode(F.slice(numbers, F.lit(1), upto)).alias("list_id")).distinct()


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """The queries of a text file; query_id is the line's number in a file read as one piece, from 0."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("query_id", "value"))
    return lines_of_queries(lines.select(F.col("query_id").cast("long").alias("query_id"), "value"))


def keys_from(spark: SparkSession, path: str) -> DataFrame:
    """(key) of a binary file: a 64-bit count, then so many 64-bit keys; ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                data = np.frombuffer(raw.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(data[1 : 1 + int(data[0])])], ["key"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "key long").orderBy("key")


def drawn(seed: int, *columns: str):
    """A number by which rows are drawn: the same for the same ids in any engine. Two odd factors, and a modulus."""
    value = F.lit(seed).cast("long")
    for c in columns:
        value = ((value + F.col(c).cast("long") % 1_000_003 + 1) * 48_271) % 2_147_483_647
    return (value * 69_621) % 2_147_483_647


def sample_lists(lists: DataFrame, n: int = 8, seed: int = 0, replacement: bool = False) -> DataFrame:
    """(draw, list_id) of n lists at random but repeatably, each list at most once, or with replacement."""
    ids = lists.select("list_id").distinct()
    if not replacement:
        chosen = ids.orderBy(drawn(seed, "list_id"), "list_id").limit(n)
        return chosen.select((F.row_number().over(Window.orderBy(drawn(seed, "list_id"), "list_id")) - 1).alias("draw"), "list_id")
    draws = ids.select("list_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    return draws.groupBy("draw").agg(F.min_by("list_id", F.struct(drawn(seed, "draw", "list_id"), "list_id")).alias("list_id"))
