"""Building the index: chunks of lists, the best error bound of each, lines and residuals, exact sizes.

A list longer than `CHUNK` postings is cut by rank into chunks that tasks fit separately; a line never crosses a chunk's
edge, which costs at most one more line for each chunk. The error bound is still one for the whole list.

A list of one chunk is fitted in one pass: its candidates are tried from the likeliest on, and one is given up as soon as its
fields take more than the best size so far, so the choice is that of trying all; lists of at most `short.MOST` postings are fitted side by side. A longer list's candidates are measured chunk by
chunk and their sizes added up before one is chosen. All that is known of a list is an aggregate of its lines, so nothing is kept
in memory between the two tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import bit_width
from ..sources.store import Index
from ..sources.tables import validate
from .lines import EPSILONS, SHORT, Line, fit, residuals
from .short import MOST, best_many, fit_many, over_many, residuals_many, within

CHUNK = 1 << 18
_METRICS = "list_id long, chunk long, epsilon int, n long, n_segments long, n_exceptions long, first_max long, covered_max long, intercept_max long, exponent_max int, significand_max long, first_doc long, last_doc long"
_SEGMENTS = "list_id long, chunk long, epsilon int, seg int, start long, covered int, intercept long, slope_exponent int, slope_significand long, seg_min_doc long, seg_max_doc long, exceptions int, residual array<int>"


def shift_of(epsilon: int) -> int:
    """Bits that an inline residual difference has less than the bound. 0 below 3, 1 below 7, else 2."""
    return 0 if epsilon < 3 else 1 if epsilon < 7 else 2


def chunks(postings: DataFrame, size: int = CHUNK) -> DataFrame:
    """(list_id, chunk, docs): ascending distinct postings. chunk is null for a list of at most `size`; others have under twice as many in a chunk."""
    whole, many = _dealt(postings, size)
    return whole.union(many)


def _dealt(postings: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """`chunks` of the lists of at most `size` postings, which are dealt once, and of the others.

    Long lists are counted by blocks of ids, each of at most `size` ids; a block goes where the postings before it say, so postings
    that lie close together are cut like any others. The ids of long lists are broadcast: there is at most one for `size` postings.
    """
    rows = validate(postings.select("list_id", "doc_id"))
    long = F.broadcast(rows.groupBy("list_id").agg(F.count("*").alias("n")).where(F.col("n") > size).select("list_id"))
    docs = F.sort_array(F.collect_set("doc_id")).alias("docs")
    whole = rows.join(long, "list_id", "left_anti").groupBy("list_id").agg(docs).select("list_id", F.lit(None).cast("long").alias("chunk"), "docs")
    own = rows.withColumn("block", F.shiftright("doc_id", size.bit_length() - 1)).join(long, "list_id", "left_semi")
    counts = own.groupBy("list_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("list_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marks = counts.select("list_id", "block", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / size).alias("chunk"))
    return whole, own.join(marks, ["list_id", "block"]).groupBy("list_id", "chunk").agg(docs)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            yield columns[0][i].as_py(), columns[1][i].as_py(), columns[2][i].values.to_numpy(zero_copy_only=False), columns[3][i].as_py() if len(columns) > 3 else None


def over(e: np.ndarray, lines: list[Line], epsilon: int) -> np.ndarray:
    """For each line its residual differences beyond the inline limit; a line's first residual stands against 0."""
    starts, shift = np.array([x.first for x in lines]), shift_of(epsilon)
    if not shift:
        return np.zeros(len(lines), np.int64)
    d = np.diff(e, prepend=0)
    d[starts] = e[starts]
    return np.add.reduceat((np.abs(d) > epsilon >> shift).astype(np.int64), starts)


def exceptions(e: np.ndarray, lines: list[Line], epsilon: int) -> int:
    return int(over(e, lines, epsilon).sum())


def _measure(epsilons: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _METRICS.split(", ")]
        kinds = [pa.int32() if n in ("epsilon", "exponent_max") else pa.int64() for n in names]
        for list_id, chunk, docs, _ in _rows(batches):
            held = []
            for epsilon in epsilons:
                lines = fit(docs, epsilon)
                top = np.array(lines, np.int64).max(0).tolist()
                held.append((list_id, chunk, epsilon, len(docs), len(lines), exceptions(residuals(docs, lines), lines, epsilon), *top, docs[0], docs[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return run


def size_of(n: int, lines: list[Line], n_exceptions: int, epsilon: int) -> int:
    """The encoded size in bytes of a list of one chunk, as `with_sizes` has it."""
    words = lambda bits: -(-bits // 64)
    tops = list(map(max, zip(*lines)))
    wide, shift = epsilon.bit_length(), shift_of(epsilon)
    fields = sum(words(len(lines) * tops[i].bit_length()) for i in (0, 2, 3, 4))
    corrections = words(n * (wide - shift)) + (words(n_exceptions * (wide + 1)) if shift else 0)
    return 8 * (fields + corrections) + (n + n_exceptions) // 8


def likely(docs: np.ndarray, epsilons: tuple[int, ...]) -> list[int]:
    """The bounds from the likeliest on; the order decides how soon others are given up, not which is chosen.

    A bound pays while it is not far above the gaps of the list, and never above what makes one line of it.
    """
    n = len(docs)
    chord = docs[0] + (docs[-1] - docs[0]) / max(1, n - 1) * np.arange(n)
    guess = min(int(np.abs(docs - chord).max()), 5 * int(docs[-1] - docs[0]) // max(1, n - 1)).bit_length()
    return sorted(epsilons, key=lambda e: (abs(e.bit_length() - guess), e))


def _few_exceptions(plain: list[int], lines: list[Line], epsilon: int) -> int:
    """`exceptions` of a short list, with plain numbers."""
    limit, count = epsilon >> shift_of(epsilon), 0
    for first, covered, intercept, exponent, significand in lines:
        before = 0
        for j in range(covered):
            e = plain[first + j] - (significand * j >> exponent) - intercept
            count += abs(e - before) > limit
            before = e
    return count if shift_of(epsilon) else 0


def best(docs: np.ndarray, epsilons: tuple[int, ...]) -> tuple[int, list[Line]]:
    """The bound with the least size, ties to the smaller, and its lines."""
    found: tuple | None = None
    plain, short = docs.tolist(), len(docs) < 4 * SHORT
    for epsilon in likely(docs, epsilons):
        room = None
        if found:
            fixed = -(-len(docs) * (epsilon.bit_length() - shift_of(epsilon)) // 64) * 8 + len(docs) // 8
            room = found[0] - fixed
            if room < 0:
                continue
        lines = fit(docs, epsilon, room, plain)
        if lines is not None:
            n_exceptions = _few_exceptions(plain, lines, epsilon) if short else exceptions(residuals(docs, lines), lines, epsilon)
            size = size_of(len(docs), lines, n_exceptions, epsilon)
            if not found or (size, epsilon) < found[:2]:
                found = size, epsilon, lines
    return found[1:]


#: Postings that are fitted or written at once, but for a longer list.
_AT_ONCE = 1 << 18


def _runs(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about `_AT_ONCE` values of the list column `name`, with its values and their numbers by row."""
    sizes = batch.column(name).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // _AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
    for a, b in zip(cuts, cuts[1:]):
        own = batch.slice(a, b - a)
        yield own, own.column(name).flatten().to_numpy(zero_copy_only=False), sizes[a:b]


def _segments_of(list_ids: pa.Array, chunks: pa.Array, epsilons: np.ndarray, docs: np.ndarray, sizes: np.ndarray, lines: np.ndarray) -> pa.RecordBatch:
    """Rows of the lines that cover adjacent lists one after another."""
    own = np.repeat(np.arange(len(sizes)), sizes)[np.cumsum(lines[:, 1]) - lines[:, 1]]
    counts, ends, bound = np.bincount(own, minlength=len(sizes)), np.cumsum(lines[:, 1]), epsilons[own]
    rest = residuals_many(docs, lines)
    e = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(rest.astype(np.int32)))
    ints = [bound, within(counts), lines[:, 0], lines[:, 1], lines[:, 2], lines[:, 3], lines[:, 4], docs[ends - lines[:, 1]], docs[ends - 1], over_many(rest, lines, bound)]
    kinds = [pa.int32() if x.split()[1] == "int" else pa.int64() for x in _SEGMENTS.split(", ")[2:-1]]
    return pa.RecordBatch.from_arrays(
        [list_ids.take(pa.array(own)), chunks.take(pa.array(own)), *(pa.array(v.astype(k.to_pandas_dtype())) for v, k in zip(ints, kinds)), e],
        [x.split()[0] for x in _SEGMENTS.split(", ")],
    )


def _fit(epsilons: tuple[int, ...] = ()):
    """Lines for the bound that comes with a row, or for the best of `epsilons`. Short lists are fitted side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, docs, sizes in _runs(batch, "docs"):
                list_ids, chunks = part.column("list_id"), part.column("chunk")
                given = part.column("epsilon").to_numpy(zero_copy_only=False).astype(np.int64) if not epsilons else None
                short, starts = sizes <= MOST, np.cumsum(sizes) - sizes
                few, own = docs[np.repeat(short, sizes)], np.flatnonzero(short)
                if len(own):
                    bound, lines = (given[own], fit_many(few, sizes[own], given[own])[1]) if given is not None else best_many(few, sizes[own], epsilons)
                    yield _segments_of(list_ids.take(pa.array(own)), chunks.take(pa.array(own)), bound, few, sizes[own], lines)
                own = np.flatnonzero(~short)
                if len(own):
                    whole = [docs[a : a + n] for a, n in zip(starts[own], sizes[own])]
                    found = [(int(given[i]), fit(d, int(given[i]))) if given is not None else best(d, epsilons) for i, d in zip(own, whole)]
                    table = np.concatenate([np.array(lines, np.int64) for _, lines in found])
                    yield _segments_of(list_ids.take(pa.array(own)), chunks.take(pa.array(own)), np.array([e for e, _ in found], np.int64), np.concatenate(whole), sizes[own], table)

    return run


def with_sizes(metrics: DataFrame) -> DataFrame:
    """The bit widths and encoded sizes in bytes of rows with a list's totals for one error bound."""
    wide = bit_width(F.col("epsilon"))
    shift = F.when(F.col("epsilon") < 3, 0).when(F.col("epsilon") < 7, 1).otherwise(2)
    words = lambda bits: F.ceil(bits / 64)
    widths = {f"bpc_{c}": bit_width(F.greatest(F.col(f"{m}_max"), F.lit(0))) for c, m in (("first", "first"), ("covered", "covered"), ("intercept", "intercept"), ("slope_exponent", "exponent"), ("slope_significand", "significand"))}
    out = metrics.withColumns(widths | {"inline_bits": wide - shift, "exception_bits": wide + 1})
    column = lambda c: words(F.col("n_segments") * F.col(f"bpc_{c}"))
    segment = 8 * (column("first") + column("intercept") + column("slope_significand") + column("slope_exponent"))
    correction = 8 * (words(F.col("n") * F.col("inline_bits")) + F.when(shift > 0, words(F.col("n_exceptions") * F.col("exception_bits"))).otherwise(0))
    out = out.withColumns({"segment_bytes": segment.cast("long"), "correction_bytes": correction.cast("long"), "sign_bytes": F.floor((F.col("n") + F.col("n_exceptions")) / 8).cast("long")})
    total = F.col("segment_bytes") + F.col("correction_bytes") + F.col("sign_bytes")
    return out.withColumns({"size_bytes": total, "size_bytes_with_covered": total + (8 * column("covered")).cast("long")})


def candidates(parts: DataFrame, epsilons: tuple[int, ...] = EPSILONS) -> DataFrame:
    """Metrics of each chunk for each error bound."""
    return parts.mapInArrow(_measure(tuple(epsilons)), _METRICS)


def per_list(metrics: DataFrame) -> DataFrame:
    """A list's totals over its chunks; positions of later chunks stand after those of earlier ones."""
    before = Window.partitionBy("list_id", "epsilon").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = metrics.withColumn("first_max", F.col("first_max") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = [F.sum(c).alias(c) for c in ("n", "n_segments", "n_exceptions")]
    most = [F.max(c).alias(c) for c in ("first_max", "covered_max", "intercept_max", "exponent_max", "significand_max", "last_doc")]
    return with_sizes(placed.groupBy("list_id", "epsilon").agg(*sums, *most, F.min("first_doc").alias("first_doc")))


def lists_of(segments: DataFrame) -> DataFrame:
    """A row for each list: its totals, bit widths and exact sizes, out of its lines."""
    most = {"first_max": "first", "covered_max": "covered", "intercept_max": "intercept", "exponent_max": "slope_exponent", "significand_max": "slope_significand", "last_doc": "seg_max_doc"}
    sums = [F.sum("covered").alias("n"), F.count("*").alias("n_segments"), F.sum("exceptions").alias("n_exceptions")]
    return with_sizes(segments.groupBy("list_id", "epsilon").agg(*sums, *[F.max(c).cast("int" if n == "exponent_max" else "long").alias(n) for n, c in most.items()], F.min("seg_min_doc").alias("first_doc")))


def choose(sized: DataFrame) -> DataFrame:
    """Of each list the candidate with the least size, ties to the smaller bound."""
    least = F.min_by("epsilon", F.struct("size_bytes", "epsilon"))
    return sized.groupBy("list_id").agg(least.alias("epsilon"))


def build_index(postings: DataFrame, epsilon: int | str = "adaptive", chunk: int = CHUNK) -> Index:
    """The compressed index of (list_id, doc_id). `epsilon` is one bound for all lists, or "adaptive".

    Both tables are lazy, and `lists` is an aggregate of `segments`; `sources.settle` stores an index that is asked more than once.
    """
    if epsilon != "adaptive" and epsilon not in EPSILONS:
        raise ValueError(f"epsilon must be adaptive or one of {EPSILONS}")
    epsilons = EPSILONS if epsilon == "adaptive" else (int(epsilon),)
    whole, many = _dealt(postings, chunk)
    whole = whole.mapInArrow(_fit(epsilons), _SEGMENTS)
    metrics = candidates(many, epsilons)
    lines = many.join(choose(per_list(metrics)), "list_id").select("list_id", "chunk", "docs", "epsilon").mapInArrow(_fit(), _SEGMENTS)
    names = ["list_id", "epsilon", "seg_id", "first", "covered", "intercept", "slope_exponent", "slope_significand", "seg_min_doc", "seg_max_doc", "exceptions", "residual"]
    segments = whole.withColumnsRenamed({"seg": "seg_id", "start": "first"}).select(names).union(_placed(lines, metrics).select(names))
    return Index(lists_of(segments), segments)


def _placed(lines: DataFrame, metrics: DataFrame) -> DataFrame:
    """Positions and numbers of lines within the whole list."""
    before = Window.partitionBy("list_id", "epsilon").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    counts = metrics.select("list_id", "epsilon", "chunk", F.coalesce(F.sum("n").over(before), zero).alias("positions"), F.coalesce(F.sum("n_segments").over(before), zero).alias("segments"))
    out = lines.join(counts, ["list_id", "epsilon", "chunk"])
    return out.withColumns({"seg_id": (F.col("seg") + F.col("segments")).cast("int"), "first": F.col("start") + F.col("positions")})


def differences(segments: DataFrame) -> DataFrame:
    """(list_id, epsilon, seg_id, pos, residual, diff, limit, is_exception, inline, sign): the codec's view of each residual; row-local."""
    e = F.col("residual")
    before = F.concat(F.array(F.lit(0)), F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))))
    pairs = F.zip_with(e, before, lambda x, y: F.struct(x.alias("residual"), F.when(F.col("epsilon") < 3, x).otherwise(x - y).alias("diff")))
    rows = segments.select("list_id", "epsilon", "seg_id", "first", F.posexplode(pairs).alias("j", "x"))
    limit = F.when(F.col("epsilon") < 7, F.shiftright("epsilon", 1)).otherwise(F.shiftright("epsilon", 2))
    out = rows.select("list_id", "epsilon", "seg_id", (F.col("first") + F.col("j")).alias("pos"), "x.residual", F.col("x.diff").cast("int").alias("diff"), limit.alias("limit"))
    beyond = (F.col("epsilon") >= 3) & (F.abs("diff") > F.col("limit"))
    return out.withColumn("is_exception", beyond).withColumns({"inline": F.when(beyond, 0).otherwise(F.abs("diff")), "sign": F.when(beyond | (F.col("diff") < 0), 1).otherwise(0)})
