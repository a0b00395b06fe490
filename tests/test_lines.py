"""Properties of the fitted lines and of the index, on the edge cases of the fixtures."""

import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postrail.functions.bits import flag_runs, packed, packed_runs, unflagged_runs, unpacked, unpacked_runs
from postrail.operators.lines import EPSILONS, GREATEST, fit, reach, residuals
from postrail.operators.model import _fit, best, exceptions, size_of
from postrail.operators.stats import code_lengths, codes_of, huffman_decode, patched_bits

RNG = random.Random(11)
LISTS = {
    "single": [7],
    "pair": [3, 900],
    "arithmetic": list(range(5, 905, 3)),
    "dense_run": list(range(500)),
    "clustered": [c * 100_000 + i for c in range(30) for i in range(RNG.randint(1, 40))],
    "uniform": sorted(RNG.sample(range(1_000_000), 800)),
    "trailing_outlier": [*range(0, 600, 2), 4_000_000_000],
    "near_max": sorted({GREATEST - 1 - RNG.randint(0, 5000) for _ in range(400)}),
    "wide": sorted(RNG.sample(range(GREATEST), 600)),
}


def feasible(docs, begin, end, epsilon):
    """Whether one line stays within the bounds of docs[begin:end], by all pairs."""
    low = [max(0, y - epsilon) for y in docs[begin:end]]
    high = [min(GREATEST, y + epsilon) for y in docs[begin:end]]
    least = max((Fraction(low[j] - high[i], j - i) for i in range(len(low)) for j in range(i + 1, len(low))), default=0)
    most = min((Fraction(high[j] - low[i], j - i) for i in range(len(low)) for j in range(i + 1, len(low))), default=0)
    return least <= most, least, most


def fitted(docs, epsilon):
    return fit(np.array(docs, np.int64), epsilon)


def check(docs, epsilon):
    lines = fitted(docs, epsilon)
    assert all(x.intercept >= 0 and x.significand >= 0 and x.exponent >= 0 for x in lines)
    assert [x.first for x in lines] == np.cumsum([0, *[x.covered for x in lines]])[:-1].tolist()
    assert sum(x.covered for x in lines) == len(docs)
    e = residuals(np.array(docs, np.int64), lines)
    assert e.min() >= -epsilon and e.max() <= epsilon + 1
    return lines


@pytest.mark.parametrize("name", LISTS)
@pytest.mark.parametrize("epsilon", EPSILONS)
def test_bounds_and_coverage(name, epsilon):
    check(LISTS[name], epsilon)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 3000), min_size=1, max_size=40), st.sampled_from(EPSILONS[:7]))
def test_pieces_are_as_long_as_can_be_and_slopes_as_short(docs, epsilon):
    docs = sorted(docs)
    at = 0
    for line in check(docs, epsilon):
        end, flat, steep = reach(docs, at, epsilon)
        assert (line.first, line.covered) == (at, end - at)
        possible, least, most = feasible(docs, at, end, epsilon)
        assert possible and (end == len(docs) or not feasible(docs, at, end + 1, epsilon)[0])
        if line.covered > 1:
            assert Fraction(*flat) == least and Fraction(*steep) == most
            places = line.covered.bit_length() + 1
            short = [k for k in range(places + 1) if any(least <= Fraction(m, 1 << k) <= most for m in {int(most * (1 << k))})]
            assert line.exponent == (short[0] if short else places)
            if short:
                assert max(0, least) <= Fraction(line.significand, 1 << line.exponent) <= most
        at = end


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 60_000), min_size=1, max_size=60), st.integers(0, 2**32 - 70_000))
def test_the_best_bound_is_that_of_trying_all(docs, base):
    docs = np.array(sorted(docs), np.int64) + base
    sizes = {e: size_of(len(docs), lines := fit(docs, e), exceptions(residuals(docs, lines), lines, e), e) for e in EPSILONS}
    epsilon, lines = best(docs, EPSILONS)
    assert epsilon == min(sizes, key=lambda e: (sizes[e], e)) and lines == fit(docs, epsilon)


def test_hand_worked_lines():
    assert fitted(LISTS["arithmetic"], 1) == [(0, 300, 5, 0, 3)]
    assert fitted([7], 3) == [(0, 1, 7, 0, 0)]
    *_, last = fitted(LISTS["trailing_outlier"], 1)
    assert last == (300, 1, 4_000_000_000, 0, 0)
    # at bound 1 slopes from 28/3 to 32/3 will do for these; the one whole number there is 10
    assert fitted([0, 10, 20, 30], 1) == [(0, 4, 0, 0, 10)]
    # from 17/2 to 10.5 there are 9 and 10, of which the middle, rounded down, is 9; residuals are 0, 0 and 1
    assert fitted([0, 9, 19], 1) == [(0, 3, 0, 0, 9)]


def test_exceptions_by_hand():
    lines = fitted([0, 10, 20, 1000], 3)
    assert sum(x.covered for x in lines) == 4
    e = residuals(np.array([0, 10, 20, 1000]), lines)
    want, before = 0, 0
    starts = {x.first for x in lines}
    for i, x in enumerate(e.tolist()):
        want += abs(x - (0 if i in starts else before)) > 3 >> 1
        before = x
    assert exceptions(e, lines, 3) == want
    assert exceptions(e, lines, 1) == 0


@given(st.lists(st.integers(0, 2**40 - 1), max_size=60), st.integers(40, 63))
def test_packing(values, width):
    raw = packed(np.array(values, np.int64), width)
    assert len(raw) % 8 == 0 and len(raw) * 8 >= len(values) * width
    assert unpacked(raw, width, len(values)).tolist() == values


@given(st.lists(st.integers(-9, 9), min_size=1, max_size=80))
def test_huffman_round_trip(values):
    counts = {v: values.count(v) for v in set(values)}
    codes = codes_of(code_lengths(counts))
    assert huffman_decode("".join(codes[v] for v in values), codes) == values
    mean = sum(len(codes[v]) for v in values) / len(values)
    entropy = -sum(n / len(values) * np.log2(n / len(values)) for n in counts.values())
    assert mean < max(1, entropy + 1) + 1e-9


def test_patched_bits():
    assert patched_bits(np.array([1] * 128), 128) == 128 + 16
    assert patched_bits(np.array([1] * 127 + [2**20]), 128) == 128 + (7 + 20) + 16


def batch_of(lists):
    import pyarrow as pa

    n = len(lists)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([None] * n, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["list_id", "chunk", "docs"])


def test_short_lists_are_fitted_side_by_side():
    """A batch of many lists gives few batches of lines, and the lines that each list has by itself."""
    rng = random.Random(7)
    lists = [sorted(rng.sample(range(base, base + 10 ** rng.randint(3, 7)), rng.randint(1, 130))) for base in (0, 3, 2**31, GREATEST - 10**7 - 1) for _ in range(60)]
    lists += [[0], [GREATEST - 1], [GREATEST - 2, GREATEST - 1], [0, GREATEST - 1], list(range(5, 105)), list(range(400))]
    out = list(_fit(EPSILONS)(iter([batch_of(lists)])))
    assert len(out) <= 2
    rows = sorted((x for b in out for x in b.to_pylist()), key=lambda x: (x["list_id"], x["start"]))
    want = [best(np.array(docs), EPSILONS) for docs in lists]
    assert [(x["list_id"], x["epsilon"], x["start"], x["covered"], x["intercept"], x["slope_exponent"], x["slope_significand"]) for x in rows] == [(i, e, *line) for i, (e, lines) in enumerate(want) for line in lines]
    assert [v for x in rows for v in x["residual"]] == [v for docs, (_, lines) in zip(lists, want) for v in residuals(np.array(docs), lines).tolist()]
    assert [sum(x["exceptions"] for x in rows if x["list_id"] == i) for i in range(len(lists))] == [exceptions(residuals(np.array(docs), lines), lines, e) for docs, (e, lines) in zip(lists, want)]


@given(st.lists(st.tuples(st.integers(0, 63), st.lists(st.integers(0, 2**63 - 1), max_size=40)), min_size=1, max_size=12))
def test_packing_of_many_runs(runs):
    values = [np.array([v % (1 << width) for v in own], np.int64) for width, own in runs]
    counts, widths, flat = np.array([len(v) for v in values]), np.array([w for w, _ in runs]), np.concatenate(values)
    raw, at = packed_runs(flat, counts, widths)
    assert [raw[a:b].tobytes() for a, b in zip(at, at[1:])] == [packed(v, w) for v, (w, _) in zip(values, runs)]
    assert unpacked_runs(raw, at[:-1], counts, widths).tolist() == flat.tolist()
    bits, at = flag_runs(flat % 2 == 1, counts)
    assert len(bits) == sum(-(-n // 8) for n in counts) and unflagged_runs(bits, at[:-1], counts).tolist() == (flat % 2 == 1).tolist()
