"""Lines of many short lists at once, the same that `lines.fit` gives one by one.

Lists lie side by side in an array, position by position, so that all take their next posting together. A piece's two limits are
compared over all earlier points of the piece; as doubles, which tell any two slopes apart while a rise is below 2^34 and a run at most `MOST`.
"""

from __future__ import annotations

import numpy as np

from .lines import GREATEST

#: Postings of a list up to which this is quicker, and lists that are held side by side.
MOST, BESIDE = 128, 1024


def bit_lengths(x: np.ndarray) -> np.ndarray:
    """Bits of whole numbers from 0 to 2^53."""
    return np.frexp(np.asarray(x, np.float64))[1].astype(np.int64)


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of adjacent runs of these sizes."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _pieces(docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, epsilons: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lane, begin, end, flattest, steepest slope) of the pieces of lists in falling order of `sizes`."""
    n, lanes = int(sizes[0]), len(sizes)
    at = np.minimum(np.arange(n)[:, None], sizes - 1) + starts
    low = np.maximum(0, docs[at] - epsilons).astype(np.float64)
    high = np.minimum(GREATEST, docs[at] + epsilons).astype(np.float64)
    begin, flat, steep = np.zeros(lanes, np.int64), np.full(lanes, -np.inf), np.full(lanes, np.inf)
    runs, room = np.arange(n, 0, -1, dtype=np.float64)[:, None], np.empty((n, lanes))
    held, going = [], len(sizes) - np.searchsorted(sizes[::-1], np.arange(n), "right")  # lists with a posting at x
    for x in range(1, n):
        m = int(going[x])
        c = int(begin[:m].min())
        run, slopes = runs[n - x + c :], room[: x - c, :m]
        np.subtract(high[x, :m], low[c:x, :m], out=slopes)
        np.divide(slopes, run, out=slopes)
        new_steep = np.minimum(steep[:m], slopes.min(0))
        np.subtract(low[x, :m], high[c:x, :m], out=slopes)
        np.divide(slopes, run, out=slopes)
        new_flat = np.maximum(flat[:m], slopes.max(0))
        over = np.flatnonzero(new_flat > new_steep)
        if len(over):
            held.append((over, begin[over], np.full(len(over), x), flat[over], steep[over]))
            begin[over], new_flat[over], new_steep[over] = x, -np.inf, np.inf
            low[c:x, over], high[c:x, over] = -np.inf, np.inf  # never a limit again
        flat[:m], steep[:m] = new_flat, new_steep
    held.append((np.arange(lanes), begin, sizes, flat, steep))
    return tuple(np.concatenate(x) for x in zip(*held))


def _simplest(flat: np.ndarray, steep: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`lines.simplest` of many pieces."""
    flat, steep = np.where(covered > 1, flat, 0.0), np.where(covered > 1, steep, 0.0)
    most_places = bit_lengths(covered) + 1
    places, significand, left = most_places.copy(), np.floor(np.ldexp(steep, most_places)).astype(np.int64), np.arange(len(flat))
    for k in range(int(most_places.max(initial=0)) + 1):
        left = left[most_places[left] >= k]
        least, most = np.maximum(0, np.ceil(np.ldexp(flat[left], k))).astype(np.int64), np.floor(np.ldexp(steep[left], k)).astype(np.int64)
        found = least <= most
        significand[left[found]], places[left[found]] = (least[found] + most[found]) // 2, k
        left = left[~found]
    return significand, places


def fit_many(docs: np.ndarray, sizes: np.ndarray, epsilons: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, line) of adjacent lists of at most `MOST` postings: a line's list, and its columns as in `lines.Line`."""
    starts, order = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
    held = []
    for at in range(0, len(order), BESIDE):
        own = order[at : at + BESIDE]
        lane, *rest = _pieces(docs, starts[own], sizes[own], epsilons[own])
        held.append((own[lane], *rest))
    owner, begin, end, flat, steep = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(starts[owner] + begin)
    owner, begin, covered, flat, steep = owner[order], begin[order], (end - begin)[order], flat[order], steep[order]
    significand, exponent = _simplest(flat, steep, covered)
    rest = docs - (np.repeat(significand, covered) * within(covered) >> np.repeat(exponent, covered))
    first, epsilon = np.cumsum(covered) - covered, epsilons[owner]
    low, high = np.minimum.reduceat(rest, first), np.maximum.reduceat(rest, first)
    middle = np.minimum(np.maximum(np.maximum(0, (low + high) // 2), high - epsilon - 1), low + epsilon)
    return owner, np.stack([begin, covered, np.where(covered > 1, middle, low), exponent, significand], 1)


def residuals_many(docs: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """What each posting is above its line; the lines cover adjacent lists one after another."""
    intercept, exponent, significand = (np.repeat(lines[:, i], lines[:, 1]) for i in (2, 3, 4))
    return docs - ((significand * within(lines[:, 1]) >> exponent) + intercept)


def shifts_of(epsilons: np.ndarray) -> np.ndarray:
    """`model.shift_of` of many bounds."""
    return np.where(epsilons < 3, 0, np.where(epsilons < 7, 1, 2))


def over_many(e: np.ndarray, lines: np.ndarray, epsilons: np.ndarray) -> np.ndarray:
    """`model.over` with a bound for each line."""
    starts = np.cumsum(lines[:, 1]) - lines[:, 1]
    d = np.diff(e, prepend=0)
    d[starts] = e[starts]
    beyond = np.abs(d) > np.repeat(epsilons >> shifts_of(epsilons), lines[:, 1])
    return np.where(epsilons < 3, 0, np.add.reduceat(beyond.astype(np.int64), starts))


def sizes_many(owner: np.ndarray, lines: np.ndarray, sizes: np.ndarray, n_exceptions: np.ndarray, epsilons: np.ndarray) -> np.ndarray:
    """`model.size_of` of every list."""
    words = lambda bits: -(-bits // 64)
    n_lines = np.bincount(owner, minlength=len(sizes))
    first, wide, shift = np.cumsum(n_lines) - n_lines, bit_lengths(epsilons), shifts_of(epsilons)
    tops = np.maximum.reduceat(lines, first, 0)
    fields = sum(words(n_lines * bit_lengths(tops[:, i])) for i in (0, 2, 3, 4))
    corrections = words(sizes * (wide - shift)) + np.where(shift > 0, words(n_exceptions * (wide + 1)), 0)
    return 8 * (fields + corrections) + (sizes + n_exceptions) // 8


def best_many(docs: np.ndarray, sizes: np.ndarray, epsilons: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(bound of each list, lines): what `model.best` chooses. Candidates are tried in its order, and none whose corrections alone take too much."""
    tried, starts = np.array(epsilons, np.int64), np.cumsum(sizes) - sizes
    gaps, whole = np.maximum(1, sizes - 1), docs[starts + sizes - 1] - docs[starts]
    far = np.abs(docs - np.repeat(docs[starts], sizes) - np.repeat(whole / gaps, sizes) * within(sizes)).astype(np.int64)
    guess = bit_lengths(np.minimum(np.maximum.reduceat(far, starts), 5 * whole // gaps))
    order = np.argsort(np.abs(bit_lengths(tried) - guess[:, None]) * 64 + bit_lengths(tried), 1)
    least, chosen, won, held = np.full(len(sizes), np.iinfo(np.int64).max), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    for turn in range(len(tried)):
        epsilon = tried[order[:, turn]]
        fixed = -(-sizes * (bit_lengths(epsilon) - shifts_of(epsilon)) // 64) * 8 + sizes // 8
        own = np.flatnonzero(fixed <= least)
        if not len(own):
            held.append((own, np.zeros((0, 5), np.int64)))
            continue
        kept, few, bound = np.zeros(len(sizes), bool), sizes[own], epsilon[own]
        kept[own] = True
        part = docs[np.repeat(kept, sizes)]
        owner, lines = fit_many(part, few, bound)
        n_exceptions = np.bincount(owner, over_many(residuals_many(part, lines), lines, bound[owner]), len(own)).astype(np.int64)
        size = sizes_many(owner, lines, few, n_exceptions, bound)
        better = (size < least[own]) | (size == least[own]) & (bound < chosen[own])
        least[own[better]], chosen[own[better]], won[own[better]] = size[better], bound[better], turn
        held.append((own[owner][better[owner]], lines[better[owner]]))
    owner, turn = np.concatenate([x for x, _ in held]), np.repeat(np.arange(len(held)), [len(x) for x, _ in held])
    last = won[owner] == turn
    owner, lines = owner[last], np.concatenate([x for _, x in held])[last]
    order = np.argsort(starts[owner] + lines[:, 0])
    return chosen, lines[order]
