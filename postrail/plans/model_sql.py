"""SQL that fits the index by itself, point by point, so that whatever the engine says of lines has its answer from the tables.

It follows the definition and nothing else: a piece takes the next posting while some slope is left between the limits of all pairs;
its slope is the dyadic number with the fewest places between them, in the middle; its intercept is in the middle of what is left.
Limits are compared as doubles, which tell any two slopes of lists of some thousand postings apart.
"""

from __future__ import annotations

from ..operators.lines import EPSILONS, GREATEST

_PAIR = "{{'s': ({p}) / CAST({q} AS DOUBLE), 'p': CAST({p} AS BIGINT), 'q': CAST({q} AS BIGINT)}}"
_LOW, _HIGH = "greatest(0, {y} - epsilon)", f"least({GREATEST}, {{y}} + epsilon)"


def width(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0 ELSE length(bin(CAST({x} AS BIGINT))) END"


def segments(postings: str, epsilons: tuple[int, ...] = EPSILONS, adaptive: bool = False) -> str:
    """CTEs `w` (lists with their candidates), `segments` and `lists` with the engine's columns; with `adaptive` of each list's best bound only."""
    old, new = "d[i + 1]", "d[x + 2]"
    steep = _PAIR.format(p=f"{_HIGH.format(y=new)} - {_LOW.format(y=old)}", q="x + 1 - i")
    flat = _PAIR.format(p=f"{_LOW.format(y=new)} - {_HIGH.format(y=old)}", q="x + 1 - i")
    value = "((significand * j) >> places) + intercept"
    shift = "CASE WHEN epsilon < 3 THEN 0 WHEN epsilon < 7 THEN 1 ELSE 2 END"
    words = lambda bits: f"(({bits}) + 63) // 64"
    sizes = " + ".join(words(f"n_segments * bpc_{c}") for c in ("first", "intercept", "slope_significand", "slope_exponent"))
    chosen = "QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY size_bytes, epsilon) = 1" if adaptive else ""
    return f"""
RECURSIVE w AS (SELECT list_id, epsilon, list(doc_id ORDER BY doc_id) AS d FROM ({postings}) p, (SELECT CAST(unnest([{", ".join(map(str, epsilons))}]) AS BIGINT) AS epsilon) e GROUP BY list_id, epsilon),
points AS (
  SELECT list_id, epsilon, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS a, {_PAIR.format(p=0, q=1)} AS steep, {_PAIR.format(p=0, q=1)} AS flat FROM w
  UNION ALL
  SELECT list_id, epsilon, x + 1, CASE WHEN fits THEN a ELSE x + 1 END, CASE WHEN fits THEN new_steep ELSE {_PAIR.format(p=0, q=1)} END, CASE WHEN fits THEN new_flat ELSE {_PAIR.format(p=0, q=1)} END
  FROM (SELECT *, new_flat.s <= new_steep.s AS fits FROM (
    SELECT list_id, epsilon, x, a,
      list_min(list_append(list_transform(range(a, x + 1), lambda i: {steep}), CASE WHEN a < x THEN steep END)) AS new_steep,
      list_max(list_append(list_transform(range(a, x + 1), lambda i: {flat}), CASE WHEN a < x THEN flat END)) AS new_flat
    FROM points JOIN w USING (list_id, epsilon) WHERE x + 1 < len(d)))),
pieces AS (SELECT list_id, epsilon, a AS first, CAST(max(x) - a + 1 AS BIGINT) AS covered, arg_max(steep, x) AS steep, arg_max(flat, x) AS flat FROM points GROUP BY list_id, epsilon, a),
slopes AS (SELECT *, length(bin(covered)) + 1 AS most_places, list_transform(range(0, length(bin(covered)) + 2), lambda k:
    {{'k': k, 'least': CASE WHEN flat.p <= 0 THEN 0 ELSE ((flat.p << k) + flat.q - 1) // flat.q END, 'most': (steep.p << k) // steep.q}}) AS tried FROM pieces),
lines AS (SELECT * EXCLUDE (tried), coalesce(list_filter(tried, lambda t: t.least <= t.most)[1], {{'k': most_places, 'least': tried[-1].most, 'most': tried[-1].most}}) AS t FROM slopes),
rests AS (SELECT list_id, epsilon, first, covered, t.k AS places, CAST((t.least + t.most) // 2 AS BIGINT) AS significand, d, list_transform(range(0, covered), lambda j: d[first + j + 1] - ((CAST((t.least + t.most) // 2 AS BIGINT) * j) >> t.k)) AS r FROM lines JOIN w USING (list_id, epsilon)),
placed AS (SELECT *, CASE WHEN covered = 1 THEN r[1] ELSE least(greatest(0, (list_min(r) + list_max(r)) // 2, list_max(r) - epsilon - 1), list_min(r) + epsilon) END AS intercept FROM rests),
steps AS (SELECT *, list_transform(r, lambda v: v - intercept) AS residual FROM placed),
coded AS (SELECT *, list_transform(range(0, covered), lambda j: residual[j + 1] - CASE WHEN j = 0 OR epsilon < 3 THEN 0 ELSE residual[j] END) AS diffs, epsilon >> ({shift}) AS inline FROM steps),
every AS (SELECT list_id, epsilon, row_number() OVER (PARTITION BY list_id, epsilon ORDER BY first) - 1 AS seg_id, first, covered, intercept, places AS slope_exponent, significand AS slope_significand, d[first + 1] AS seg_min_doc, d[first + covered] AS seg_max_doc,
    CASE WHEN epsilon < 3 THEN 0 ELSE len(list_filter(diffs, lambda v: abs(v) > inline)) END AS exceptions, residual, diffs, inline FROM coded),
totals AS (SELECT list_id, epsilon, CAST(sum(covered) AS BIGINT) AS n, count(*) AS n_segments, CAST(sum(exceptions) AS BIGINT) AS n_exceptions, {", ".join(f"{width(f'max({c})')} AS bpc_{c}" for c in ("first", "covered", "intercept", "slope_exponent", "slope_significand"))}, max(slope_significand) AS significand_max, max(slope_exponent) AS exponent_max, min(seg_min_doc) AS first_doc, max(seg_max_doc) AS last_doc, {width("epsilon")} - ({shift}) AS inline_bits, {width("epsilon")} + 1 AS exception_bits FROM every GROUP BY list_id, epsilon),
sized AS (SELECT *, 8 * ({sizes}) AS segment_bytes, 8 * ({words("n * inline_bits")} + CASE WHEN epsilon < 3 THEN 0 ELSE {words("n_exceptions * exception_bits")} END) AS correction_bytes, (n + n_exceptions) // 8 AS sign_bytes, {words("n_segments * bpc_covered")} * 8 AS covered_bytes FROM totals),
lists AS (SELECT *, segment_bytes + correction_bytes + sign_bytes AS size_bytes, segment_bytes + correction_bytes + sign_bytes + covered_bytes AS size_bytes_with_covered FROM sized {chosen}),
segments AS (SELECT every.* FROM every JOIN lists USING (list_id, epsilon))
"""


def select(what: str, postings: str, epsilons: tuple[int, ...] = EPSILONS, adaptive: bool = False) -> str:
    return f"WITH {segments(postings, epsilons, adaptive)} {what}"
