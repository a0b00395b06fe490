"""Bit-packed storage: the fields of lines and the coded residual differences of a list as binary columns.

A row holds `PART` positions of a list at most, so a list of any length is spread over rows and tasks. The fields
of its lines are packed column by column, each as wide as its greatest value, in whole 64-bit words. Of a residual difference
the magnitude goes into `corrections` if it is within the inline limit, and its sign into `signs`; else `corrections` has a zero
with a negative sign, and the magnitude and sign are in `wide_corrections` and `wide_signs`, in order. For the bound 1 the residual
itself is coded, and 2 is written as a negative zero. For a list of one row the bytes written are `size_bytes_with_covered`, but for
signs, which fill up whole bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import flag_runs, packed_runs, unflagged_runs, unpacked_runs
from .model import CHUNK
from .short import bit_lengths, shifts_of

#: Positions in one row.
PART = CHUNK
FIELDS = ("first", "covered", "intercept", "slope_exponent", "slope_significand")
STREAMS = ("corrections", "signs", "wide_corrections", "wide_signs")
_SCHEMA = "list_id long, part long, epsilon int, base long, n int, n_segments int, n_exceptions int, first_doc long, last_doc long, " + ", ".join([*(f"bpc_{f} int" for f in FIELDS), *(f"{f} binary" for f in (*FIELDS, *STREAMS))])


def coded(e: np.ndarray, starts: np.ndarray, counts: np.ndarray, epsilons: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The four streams of the residuals of adjacent rows, and the number of exceptions of each. `starts` are all lines' first positions."""
    wide, shift = bit_lengths(epsilons), shifts_of(epsilons)
    every, plain = np.repeat(epsilons, counts), np.repeat(shift == 0, counts)
    d = np.diff(e, prepend=0)
    d[starts] = e[starts]
    d = np.where(plain, e, d)
    beyond = np.where(plain, e > every, np.abs(d) > every >> np.repeat(shift, counts))
    size, exception = np.where(beyond, 0, np.abs(d)), beyond & ~plain
    n_exceptions = np.add.reduceat(exception.astype(np.int64), np.cumsum(counts) - counts)
    far = d[exception]
    return [packed_runs(size, counts, wide - shift), flag_runs(beyond | (d < 0), counts), packed_runs(np.abs(far), n_exceptions, wide + 1), flag_runs(far < 0, n_exceptions)], n_exceptions


def decoded(streams: list[tuple[np.ndarray, np.ndarray]], starts: np.ndarray, covered: np.ndarray, counts: np.ndarray, n_exceptions: np.ndarray, epsilons: np.ndarray) -> np.ndarray:
    """The residuals of adjacent rows."""
    wide, shift = bit_lengths(epsilons), shifts_of(epsilons)
    corrections, signs, wide_corrections, wide_signs = streams
    size, minus = unpacked_runs(*corrections, counts, wide - shift), unflagged_runs(*signs, counts)
    far = unpacked_runs(*wide_corrections, n_exceptions, wide + 1)
    plain = np.repeat(shift == 0, counts)
    d, negative_zero = np.where(minus, -size, size), minus & (size == 0)
    d[negative_zero & ~plain] = np.where(unflagged_runs(*wide_signs, n_exceptions), -far, far)
    sums = np.cumsum(np.where(plain, 0, d))
    sums -= np.repeat(sums[starts] - np.where(plain, 0, d)[starts], covered)
    return np.where(plain, np.where(negative_zero, np.repeat(epsilons, counts) + 1, d), sums)


def _binary(run: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    raw, offsets = run
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw.tobytes())])


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[0] + int(sizes.sum())] if data else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw), offsets[:-1] - offsets[0]


def _slices(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of about `PART` positions."""
    cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // CHUNK)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    for whole in batches:
        for batch in _slices(whole, whole.column("n").to_numpy(zero_copy_only=False)):
            lines, n_lines = batch.column("lines").flatten(), batch.column("lines").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            of = lambda f: lines.field(f).to_numpy(zero_copy_only=False).astype(np.int64)
            table = {f: of(f) for f in FIELDS}
            begins, ends = np.cumsum(n_lines) - n_lines, np.cumsum(n_lines) - 1
            e = pc.list_flatten(lines.field("residual")).to_numpy(zero_copy_only=False).astype(np.int64)
            base, epsilons = table["first"][begins], batch.column("epsilon").to_numpy(zero_copy_only=False).astype(np.int64)
            table["first"] = table["first"] - np.repeat(base, n_lines)
            counts = np.add.reduceat(table["covered"], begins)
            streams, n_exceptions = coded(e, np.cumsum(table["covered"]) - table["covered"], counts, epsilons)
            widths = {f: bit_lengths(np.maximum.reduceat(table[f], begins)) for f in FIELDS}
            int32 = lambda v: pa.array(v.astype(np.int32))
            row = [*(batch.column(c) for c in ("list_id", "part", "epsilon")), pa.array(base), int32(counts), int32(n_lines), int32(n_exceptions), pa.array(of("seg_min_doc")[begins]), pa.array(of("seg_max_doc")[ends])]
            row += [*(int32(widths[f]) for f in FIELDS), *(_binary(packed_runs(table[f], n_lines, widths[f])) for f in FIELDS), *map(_binary, streams)]
            yield pa.RecordBatch.from_arrays(row, names)


def pack_index(segments: DataFrame) -> DataFrame:
    """The packed rows of an index's lines; write them with any of Spark's writers."""
    fields = F.struct("first", "covered", "intercept", "slope_exponent", "slope_significand", "seg_min_doc", "seg_max_doc", "residual")
    rows = segments.groupBy("list_id", "epsilon", F.floor(F.col("first") / PART).alias("part")).agg(F.sort_array(F.collect_list(fields)).alias("lines"), F.sum("covered").alias("n"))
    return rows.select("list_id", "part", "epsilon", "lines", "n").mapInArrow(_pack, _SCHEMA)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _slices(whole, whole.column("n").to_numpy(zero_copy_only=False).astype(np.int64)):
            of = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
            counts, n_lines = of("n"), of("n_segments")
            table = {f: unpacked_runs(*_raw(batch.column(f)), n_lines, of(f"bpc_{f}")) for f in FIELDS}
            covered = table["covered"]
            starts = np.cumsum(covered) - covered
            e = decoded([_raw(batch.column(s)) for s in STREAMS], starts, covered, counts, of("n_exceptions"), of("epsilon"))
            j = np.arange(int(counts.sum())) - np.repeat(starts, covered)
            slope, places, intercept = (np.repeat(table[f], covered) for f in ("slope_significand", "slope_exponent", "intercept"))
            ends = np.cumsum(counts)
            pos = np.arange(len(e)) + np.repeat(of("base") - (ends - counts), counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(of("list_id"), counts)), pa.array(pos), pa.array((slope * j >> places) + intercept + e)], ["list_id", "pos", "doc_id"])


def decode_packed(rows: DataFrame) -> DataFrame:
    """(list_id, pos, doc_id) of packed rows, many rows at a time by whole-array arithmetic; no shuffle. Filters on list_id, first_doc and last_doc prune rows."""
    return rows.mapInArrow(_unpack, "list_id long, pos long, doc_id long")


def written_bytes(rows: DataFrame) -> DataFrame:
    """(list_id, n, bytes): what the binary columns of each list take."""
    sizes = sum([F.octet_length(f) for f in (*FIELDS, *STREAMS)][1:], F.octet_length(FIELDS[0]))
    return rows.groupBy("list_id").agg(F.sum("n").alias("n"), F.sum(sizes).cast("long").alias("bytes"))
