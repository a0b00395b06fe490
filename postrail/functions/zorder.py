"""Morton codes: the bits of the coordinates in turn."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def morton(*coordinates: Column, bits: int = 0) -> Column:
    """Interleaves non-negative coordinates, the first one in the lowest bit; `bits` each, as many as fit by default."""
    n = len(coordinates)
    bits = bits or 62 // n
    parts = [F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * n + d) for b in range(bits) for d, c in enumerate(coordinates)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def unmorton(code: Column, n: int, bits: int = 0) -> list[Column]:
    """The coordinates of a code."""
    bits = bits or 62 // n
    return [reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(code.cast("long"), b * n + d).bitwiseAND(F.lit(1).cast("long")), b) for b in range(bits)]) for d in range(n)]


def _spread(values: np.ndarray, n: int, d: int, bits: int) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for b in range(bits):
        out |= (values >> b & 1) << (b * n + d)
    return out


def _gathered(codes: np.ndarray, n: int, d: int, bits: int) -> np.ndarray:
    out = np.zeros(len(codes), np.int64)
    for b in range(bits):
        out |= (codes >> (b * n + d) & 1) << b
    return out


def next_codes(codes: np.ndarray, low: list[int], high: list[int], bits: int = 0) -> np.ndarray:
    """For each code the least one not below it whose point is in the closed box; -1 if there is none.

    The answer is the code itself, or it has the code's higher bits, a one where the code has a zero, and then the least that
    the box allows; of these the one that parts from the code latest is the least. A code only grows with each coordinate, so the
    least point below a prefix is that of the greater of the box's and the prefix's least coordinates.
    """
    n = len(low)
    bits = bits or 62 // n
    own = [_gathered(codes, n, d, bits) for d in range(n)]
    out = np.where(np.all([(own[d] >= low[d]) & (own[d] <= high[d]) for d in range(n)], axis=0), codes, -1)
    for place in range(bits * n):
        prefix = (codes >> place | 1) << place
        least = [_gathered(prefix, n, d, bits) for d in range(n)]
        free = [len(range(d, place, n)) for d in range(n)]  # bits of each coordinate below the prefix
        meets = np.all([(least[d] <= high[d]) & (least[d] + (1 << free[d]) - 1 >= low[d]) for d in range(n)], axis=0)
        found = reduce(np.bitwise_or, [_spread(np.maximum(least[d], low[d]), n, d, bits) for d in range(n)])
        out = np.where((out < 0) & (codes >> place & 1 == 0) & meets, found, out)
    return out


def next_in_box(code: Column, low: list[int], high: list[int], bits: int = 0) -> Column:
    """`next_codes` of a column; null if there is none. By it a scan in code order jumps over what lies outside a box."""

    @F.pandas_udf(LongType())
    def found(codes: pd.Series) -> pd.Series:
        return pd.Series(next_codes(codes.to_numpy(np.int64), low, high, bits))

    return F.nullif(found(code), F.lit(-1).cast("long"))
