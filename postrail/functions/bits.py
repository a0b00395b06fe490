"""Widths of numbers in bits, and packing of equal-width fields."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType


def bit_width(x: Column) -> Column:
    """Bits that a non-negative number takes; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x.cast("long")))).cast("int")


def bit_ceiling(x: Column) -> Column:
    """The least power of two that is not below x."""
    wide = bit_width(x - 1)
    return F.when(x < 2, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), wide).cast("long"))


#: Fields that are laid out as bits at once.
_BLOCK = 1 << 14


def packed(values: np.ndarray, width: int) -> bytes:
    """Fields of `width` bits, the lowest bit first, in whole 64-bit words."""
    if not width or not len(values):
        return b""
    places, values, parts = np.arange(width, dtype=np.uint64), np.asarray(values).astype(np.uint64), []
    for at in range(0, len(values), _BLOCK):  # whole words in each block
        bits = (values[at : at + _BLOCK, None] >> places).astype(np.uint8) & 1
        parts.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    flat = b"".join(parts)
    return flat + b"\0" * (-len(flat) % 8)


def unpacked(raw: bytes, width: int, n: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.int64)
    whole, out = np.frombuffer(raw, np.uint8), np.zeros(n, np.uint64)
    for at in range(0, n, _BLOCK):
        m = min(_BLOCK, n - at)
        bits = np.unpackbits(whole[at * width // 8 :], count=m * width, bitorder="little").reshape(m, width)
        for place in range(width):
            out[at : at + m] |= bits[:, place].astype(np.uint64) << np.uint64(place)
    return out.astype(np.int64)


def _within(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def packed_runs(values: np.ndarray, counts: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`packed` of adjacent runs of values, each run with a width below 64: all bytes, and where each run's begin and end."""
    sizes = np.where(widths > 0, -(-counts * widths // 64), 0)
    ends, width = np.cumsum(sizes), np.repeat(widths, counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    used = width > 0
    at = (np.repeat(64 * (ends - sizes), counts) + _within(counts) * width)[used]
    values, width = np.asarray(values)[used].astype(np.uint64), width[used]
    word, shift = at >> 6, at & 63
    if len(word):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(values << shift.astype(np.uint64), first)
        cut = shift + width > 64  # goes on in the next word
        out[word[cut] + 1] |= values[cut] >> (64 - shift[cut]).astype(np.uint64)
    return out.view(np.uint8), 8 * np.append(0, ends)


def unpacked_runs(raw: np.ndarray, offsets: np.ndarray, counts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The values of such runs; `raw` is whole words, and `offsets` has the first byte of each run."""
    whole, width = np.append(raw.view(np.uint64), np.uint64(0)), np.repeat(widths, counts)
    at = np.repeat(8 * offsets, counts) + _within(counts) * width
    word, shift = np.minimum(at >> 6, len(whole) - 1), (at & 63).astype(np.uint64)
    low, high = whole[word] >> shift, whole[np.minimum(word + 1, len(whole) - 1)] << (np.uint64(63) - shift) << np.uint64(1)
    return ((low | high) & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))).astype(np.int64)


def flag_runs(flags: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of flags as bits, each run in whole bytes: all bytes, and where each run's begin and end."""
    ends = np.cumsum(-(-counts // 8))
    bits = np.zeros(8 * int(ends[-1]) if len(ends) else 0, np.uint8)
    bits[np.repeat(8 * np.append(0, ends[:-1]), counts) + _within(counts)] = flags
    return np.packbits(bits, bitorder="little"), np.append(0, ends)


def unflagged_runs(raw: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(raw, bitorder="little")
    return bits[np.repeat(8 * offsets, counts) + _within(counts)].astype(bool)


@F.pandas_udf(BinaryType())
def _pack(values: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([packed(np.asarray(v), int(w)) for v, w in zip(values, width)])


@F.pandas_udf(ArrayType(LongType()))
def _unpack(raw: pd.Series, width: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([unpacked(bytes(r), int(w), int(k)) for r, w, k in zip(raw, width, n)])


def pack(values: Column, width: Column) -> Column:
    """An array of non-negative numbers as binary."""
    return _pack(values.cast("array<bigint>"), width.cast("int"))


def unpack(raw: Column, width: Column, n: Column) -> Column:
    return _unpack(raw, width.cast("int"), n.cast("int"))
