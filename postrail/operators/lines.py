"""Error-bounded lines: the fewest pieces that keep every posting within epsilon, greedily from the left.

For a piece that begins at position a, a line with slope s stays within the bounds low[i]..high[i] of all
its positions iff, for all i < j, low[j] - high[i] <= s (j - i) <= high[j] - low[i]. The piece therefore
carries two limits of the slope, each with the pair that attains it, and grows while they do not cross (the published
online method for piecewise linear functions with bounded error).
The pair of a new limit is a tangent from the new point to a convex chain of earlier points. Limits
only tighten, so a chain's front is passed once, and a bound that does not tighten its limit never meets a later line. All comparisons are of products of whole numbers.

Any slope between the limits will do. The one taken is the dyadic number with the fewest binary places there, so that its
field is narrow and multiples of it are exact; its intercept is in the middle of what the postings leave. Where the limits have no such
number between them (they are equal, say), the steeper one is rounded down by less than half a unit over the whole piece. A value
then lies below its real line by less than 3/2, so the residuals of a piece are some 2 epsilon + 2 adjacent
whole numbers, and the intercept puts them in -epsilon..epsilon + 1.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: The error bounds tried (one less than the powers of two from 2 to 4096), and the greatest key.
EPSILONS = tuple(2**k - 1 for k in range(1, 13))
GREATEST = 2**32 - 1


#: Postings of a piece up to which plain numbers are quicker than arrays.
SHORT = 64


class Line(NamedTuple):
    """A fixed-point line: at position i it has the value ((significand (i - first)) >> exponent) + intercept."""

    first: int
    covered: int
    intercept: int
    exponent: int
    significand: int


class _Chain:
    """Points in order of position, kept convex on one side (turn = 1 below, -1 above)."""

    def __init__(self, turn: int, x: int, y: int):
        self.turn, self.xs, self.ys, self.front = turn, [x], [y], 0

    def tangent(self, x: int, y: int) -> int:
        """The chain's point whose slope to (x, y) is extreme; what lies before it is never asked for again."""
        xs, ys, turn, i = self.xs, self.ys, self.turn, self.front
        last = len(xs) - 1
        while i < last and turn * ((y - ys[i + 1]) * (x - xs[i]) - (y - ys[i]) * (x - xs[i + 1])) >= 0:
            i += 1
        self.front = i
        return i

    def add(self, x: int, y: int) -> None:
        xs, ys, turn = self.xs, self.ys, self.turn
        while len(xs) - self.front > 1 and turn * ((ys[-1] - ys[-2]) * (x - xs[-1]) - (y - ys[-1]) * (xs[-1] - xs[-2])) >= 0:
            xs.pop()
            ys.pop()
        xs.append(x)
        ys.append(y)


#: A slope as its rise and its run.
Slope = tuple[int, int]


def reach(docs: list[int], begin: int, epsilon: int) -> tuple[int, Slope, Slope]:
    """Where the piece from `begin` ends, and the flattest and the steepest slope of its lines."""
    n, y = len(docs), docs[begin]
    low, high = max(0, y - epsilon), min(GREATEST, y + epsilon)
    if begin + 1 == n:
        return n, (0, 1), (0, 1)
    floors, ceilings = _Chain(-1, begin, low), _Chain(1, begin, high)
    x, y = begin + 1, docs[begin + 1]
    low2, high2 = max(0, y - epsilon), min(GREATEST, y + epsilon)
    steep, flat = (begin, low, x, high2), (begin, high, x, low2)
    floors.add(x, low2)
    ceilings.add(x, high2)
    end = n
    for x in range(begin + 2, n):
        y = docs[x]
        low = y - epsilon if y > epsilon else 0
        high = y + epsilon if y < GREATEST - epsilon else GREATEST
        ax, ay, bx, by = steep
        cx, cy, dx, dy = flat
        run, span = (by - ay) * (x - ax) + ay * (bx - ax), bx - ax  # the steep line at x, scaled by its pair's distance
        rise, step = (dy - cy) * (x - cx) + cy * (dx - cx), dx - cx  # and the flat line
        if run < low * span or rise > high * step:
            end = x
            break
        if run > high * span:
            i = floors.tangent(x, high)
            steep = floors.xs[i], floors.ys[i], x, high
            ceilings.add(x, high)
        if rise < low * step:
            i = ceilings.tangent(x, low)
            flat = ceilings.xs[i], ceilings.ys[i], x, low
            floors.add(x, low)
    return end, (flat[3] - flat[1], flat[2] - flat[0]), (steep[3] - steep[1], steep[2] - steep[0])


def simplest(flat: Slope, steep: Slope, covered: int) -> tuple[int, int]:
    """(significand, exponent) of the dyadic slope with the fewest places between two slopes, in the middle if several have as many."""
    (a, p), (b, q) = flat, steep
    most_places = covered.bit_length() + 1
    for places in range(most_places + 1):
        least, most = max(0, -(-(a << places) // p)), (b << places) // q
        if least <= most:
            return (least + most) // 2, places
    return most, most_places


def fit(docs: np.ndarray, epsilon: int, most_bytes: float | None = None, plain: list[int] | None = None) -> list[Line] | None:
    """The lines of ascending postings below the greatest key; None as soon as their fields alone take over `most_bytes`.

    `plain` are the postings as a list, where that is at hand.
    """
    plain, out, at = docs.tolist() if plain is None else plain, [], 0
    tops = [0, 0, 0, 0]
    while at < len(plain):
        end, flat, steep = reach(plain, at, epsilon)
        covered = end - at
        significand, exponent = simplest(flat, steep, covered)
        if covered < SHORT:
            rest = [y - (significand * j >> exponent) for j, y in enumerate(plain[at:end])]
            low, high = min(rest), max(rest)
        else:
            rest = docs[at:end] - (significand * np.arange(covered) >> exponent)
            low, high = int(rest.min()), int(rest.max())
        intercept = min(max(0, (low + high) // 2, high - epsilon - 1), low + epsilon) if covered > 1 else low
        out.append(Line(at, covered, intercept, exponent, significand))
        if most_bytes is not None:
            tops = list(map(max, tops, (at, intercept, exponent, significand)))
            if len(out) * sum(t.bit_length() for t in tops) > 8 * most_bytes:
                return None
        at = end
    return out


def residuals(docs: np.ndarray, lines: list[Line]) -> np.ndarray:
    """What each posting is above its line."""
    table = np.array(lines, np.int64).reshape(-1, 5)
    own = np.repeat(np.arange(len(table)), table[:, 1])
    step = np.arange(len(docs)) - table[own, 0]
    return docs - ((table[own, 4] * step >> table[own, 3]) + table[own, 2])
