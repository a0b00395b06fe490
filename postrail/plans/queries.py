"""Registered queries over the engine, and the SQL that gives the same rows from the tables alone.

The codec is lossless, so whatever is asked of the compressed index has its answer in the plain postings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import approximate, bit_ceiling, bit_width, doubles, find, find_value, insert, key_of_timestamp, morton, next_in_box, pack, remove, sign_of, slope, text_of_big, truncated_div, unmorton, unpack, words
from ..operators import decode as decoding
from ..operators import packing, search, setops, spatial, stats
from ..operators.lines import EPSILONS
from ..operators.model import build_index, differences
from ..sources import Index, keys_from, lines_of_queries, load_codes, load_lists, numbered, postings, postings_of_terms, read_docs, read_queries, sample_lists, save_codes, scratch, settle, write_docs, write_keys
from ..streaming import load_appended, store_batch
from . import model_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        key = name or query.__name__
        QUERIES[key] = query
        if sql:
            ORACLE[key] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Collections ---------------------------------------------------------------------------------------------------------

def supp(spark: SparkSession, d: str) -> DataFrame:
    return postings(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey")


def part(spark: SparkSession, d: str) -> DataFrame:
    return postings(table(spark, d, "lineitem"), "l_partkey", "l_orderkey")


def qty(spark: SparkSession, d: str) -> DataFrame:
    return postings(table(spark, d, "lineitem"), F.col("l_quantity").cast("long"), "l_orderkey")


def event(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array_position(F.array(*map(F.lit, ("click", "view", "purchase", "signup", "login", "logout", "error"))), F.col("event_type"))
    return postings(table(spark, d, "events"), kinds, "user_id")


def term(spark: SparkSession, d: str) -> DataFrame:
    """The lists of all terms; list_id is the rank by frequency, ties by term."""
    every = postings_of_terms(table(spark, d, "documents"))
    ranked = numbered(every.groupBy("term").agg(F.count("*").alias("df")), F.desc("df"), "term", name="list_id").select("term", "list_id")
    return every.join(ranked, "term").select("list_id", "doc_id")


SUPP = "SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS list_id, CAST(l_orderkey AS BIGINT) AS doc_id FROM lineitem WHERE l_suppkey IS NOT NULL AND l_orderkey IS NOT NULL"
PART = SUPP.replace("l_suppkey", "l_partkey")
QTY = SUPP.replace("l_suppkey", "l_quantity")
EVENT = "SELECT DISTINCT CAST(list_position(['click','view','purchase','signup','login','logout','error'], event_type) AS BIGINT) AS list_id, CAST(user_id AS BIGINT) AS doc_id FROM events WHERE user_id IS NOT NULL AND list_position(['click','view','purchase','signup','login','logout','error'], event_type) IS NOT NULL"
ALL_TERMS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term, CAST(doc_id AS BIGINT) AS doc_id FROM documents"
TERM = f"SELECT r.list_id, t.doc_id FROM ({ALL_TERMS}) t JOIN (SELECT term, CAST(row_number() OVER (ORDER BY count(*) DESC, term) AS BIGINT) AS list_id FROM ({ALL_TERMS}) GROUP BY term) r USING (term)"
_COLLECTIONS = {"supp": (supp, SUPP), "part": (part, PART), "qty": (qty, QTY), "event": (event, EVENT), "term": (term, TERM)}

for _name, (_rows, _sql) in _COLLECTIONS.items():
    register(_sql, f"postings_{_name}")(_rows)
    register(f"SELECT list_id, count(*) AS n FROM ({_sql}) GROUP BY list_id", f"list_lengths_{_name}")(lambda s, d, rows=_rows: rows(s, d).groupBy("list_id").agg(F.count("*").alias("n")))
register(ALL_TERMS, "postings_all_terms")(lambda s, d: postings_of_terms(table(s, d, "documents")))


@register(f"SELECT max(doc_id) + 1 AS universe, count(DISTINCT list_id) AS lists, count(*) AS postings FROM ({SUPP})")
def universe(s: SparkSession, d: str) -> DataFrame:
    return supp(s, d).agg((F.max("doc_id") + 1).alias("universe"), F.countDistinct("list_id").alias("lists"), F.count("*").alias("postings"))


# Set queries ---------------------------------------------------------------------------------------------------------


def _ids(k: int) -> str:
    return ", ".join(map(str, range(1, k + 1)))


for _k in (1, 2, 3, 4, 5):
    _rows, _sql = (qty, QTY) if _k < 4 else (term, TERM)
    register(f"SELECT doc_id FROM ({_sql}) WHERE list_id IN ({_ids(_k)}) GROUP BY doc_id HAVING count(*) = {_k}", f"and{_k}")(lambda s, d, k=_k, rows=_rows: setops.and_query(rows(s, d), list(range(1, k + 1))))
    register(f"SELECT DISTINCT doc_id FROM ({_sql}) WHERE list_id IN ({_ids(_k)})", f"or{_k}")(lambda s, d, k=_k, rows=_rows: setops.or_query(rows(s, d), list(range(1, k + 1))))

# Forty queries of two to five lists each, some with an id twice and some with an unknown id (0).
WORKLOAD = "SELECT DISTINCT q AS query_id, ((q * 7 + j * 3 + q * j) % 51) AS list_id FROM range(40) t(q), range(5) u(j) WHERE j < 2 + q % 4"


def workload(s: SparkSession) -> DataFrame:
    q = s.range(40).withColumnRenamed("id", "q").select("q", F.explode(F.sequence(F.lit(0), (1 + F.col("q") % 4).cast("int"))).alias("j"))
    return q.select(F.col("q").alias("query_id"), ((F.col("q") * 7 + F.col("j") * 3 + F.col("q") * F.col("j")) % 51).alias("list_id")).distinct()


_AND = f"SELECT query_id, doc_id FROM ({WORKLOAD}) w JOIN ({QTY}) p USING (list_id) JOIN (SELECT query_id, count(*) AS k FROM ({WORKLOAD}) GROUP BY query_id) k USING (query_id) GROUP BY query_id, doc_id, k HAVING count(*) = k"
_OR = f"SELECT DISTINCT query_id, doc_id FROM ({WORKLOAD}) w JOIN ({QTY}) p USING (list_id)"
register(_AND, "and_batch")(lambda s, d: setops.and_batch(qty(s, d), workload(s)))
register(_OR, "or_batch")(lambda s, d: setops.or_batch(qty(s, d), workload(s)))
register(_AND, "and_on_index")(lambda s, d: setops.on_index(settle(build_index(qty(s, d))), workload(s), "AND"))
register(_OR, "or_on_index")(lambda s, d: setops.on_index(settle(build_index(qty(s, d))), workload(s), "OR"))


def _kept(rows: DataFrame) -> DataFrame:
    """The rows stored and read again: they are dealt once, however often they are asked for."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def appended(s: SparkSession, rows: DataFrame, epsilon: int | str = "adaptive") -> Index:
    """The index of postings that came in three batches: early ids, late ids, and some of either once more."""
    path, rows = scratch(s), _kept(rows)
    middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0] or 0
    for number, part in enumerate((F.col("doc_id") < middle, F.col("doc_id") >= middle, F.col("doc_id") % 10 == 3)):
        store_batch(rows.where(part), path, number, epsilon)
    return load_appended(s, path)


register(_AND, "and_on_appended_index")(lambda s, d: setops.on_index(appended(s, qty(s, d)), workload(s), "AND"))
register(_OR, "or_on_appended_index")(lambda s, d: setops.on_index(appended(s, qty(s, d)), workload(s), "OR"))
register(f"SELECT count(*) AS total FROM ({_AND})", "workload_total_and")(lambda s, d: setops.total(setops.batch(qty(s, d), workload(s), "AND")))
register(f"SELECT count(*) AS total FROM ({_OR})", "workload_total_or")(lambda s, d: setops.total(setops.batch(qty(s, d), workload(s), "OR")))


@register(f"SELECT count(*) AS queries, avg(size) AS avg_size FROM (SELECT query_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS size FROM ({WORKLOAD}) w LEFT JOIN (SELECT list_id, count(*) AS n FROM ({QTY}) GROUP BY list_id) l USING (list_id) GROUP BY query_id)")
def query_sizes(s: SparkSession, d: str) -> DataFrame:
    return setops.query_sizes(qty(s, d).groupBy("list_id").agg(F.count("*").alias("n")), workload(s))


@register(" INTERSECT ".join(f"SELECT doc_id FROM ({TERM}) WHERE list_id = {i}" for i in (5, 1, 9)))
def and_chain3(s: SparkSession, d: str) -> DataFrame:
    rows = term(s, d)
    return setops.and_chain(rows, [5, 1, 9], rows.groupBy("list_id").agg(F.count("*").alias("n")))


@register(f"SELECT doc_id FROM ({TERM}) WHERE list_id = 3 EXCEPT SELECT doc_id FROM ({TERM}) WHERE list_id IN (1, 2)")
def except2(s: SparkSession, d: str) -> DataFrame:
    return setops.except_query(term(s, d), 3, [1, 2])


# Search --------------------------------------------------------------------------------------------------------------

# Each posting of every list and its neighbours are asked for, and a list that there is not.
PROBES = f"SELECT DISTINCT list_id, doc_id + v AS key FROM ({SUPP}) s, (VALUES (-1), (0), (1)) t(v) UNION ALL SELECT -1, 5"


def every_probe(s: SparkSession, d: str) -> DataFrame:
    """The probes, as often as they come: a search takes each once."""
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("list_id"), F.col("l_orderkey").cast("long").alias("doc_id")).where("list_id IS NOT NULL AND doc_id IS NOT NULL")
    near = F.explode(F.array(*[F.col("doc_id") + v for v in (-1, 0, 1)]))
    return rows.select("list_id", near.alias("key")).union(s.sql("SELECT -1L, 5L"))


def probes(s: SparkSession, d: str) -> DataFrame:
    return every_probe(s, d).distinct()


def _probe(select: str, side: str) -> str:
    rows = f"SELECT list_id, doc_id, row_number() OVER (PARTITION BY list_id ORDER BY doc_id) - 1 AS pos FROM ({SUPP})"
    return f"SELECT p.list_id, p.key, {select} FROM ({PROBES}) p ASOF LEFT JOIN ({rows}) d ON p.list_id = d.list_id AND p.key {side} d.doc_id"


register(_probe("d.doc_id AS next_geq", "<="), "next_geq")(lambda s, d: search.next_geq(supp(s, d), probes(s, d)))
register(_probe("d.doc_id AS next_geq", "<="), "next_geq_on_index")(lambda s, d: search.next_geq_on(settle(build_index(supp(s, d), 63)).segments, probes(s, d)))
register(_probe("d.doc_id AS next_geq", "<="), "next_geq_on_appended_index")(lambda s, d: search.next_geq_on(appended(s, supp(s, d), 63).segments, every_probe(s, d)))
register(_probe("d.doc_id AS lower_bound", "<="), "lower_bound")(lambda s, d: search.next_geq(supp(s, d), probes(s, d)).withColumnRenamed("next_geq", "lower_bound"))
register(_probe("d.doc_id AS upper_bound", "<"), "upper_bound")(lambda s, d: search.upper_bound(supp(s, d), probes(s, d)))
register(_probe("d.doc_id AS predecessor", ">="), "predecessor")(lambda s, d: search.located(supp(s, d), probes(s, d)).select("list_id", "key", "predecessor"))
register(_probe("coalesce(d.pos, 0) AS index", ">="), "max_not_greater_index")(lambda s, d: search.predecessor_index(supp(s, d), probes(s, d)))
register(_probe("coalesce(d.pos + 1, 0) AS rank", ">"), "lower_bound_index")(lambda s, d: search.located(supp(s, d), probes(s, d)).select("list_id", "key", "rank"))
register(f"SELECT list_id, doc_id AS key FROM ({SUPP})", "contains")(lambda s, d: search.contains(supp(s, d), probes(s, d)))
_KEYS = "SELECT o_orderkey AS key FROM orders UNION SELECT -o_orderkey - 1 FROM orders"
register(f"SELECT key, count(l_orderkey) AS n FROM ({_KEYS}) LEFT JOIN lineitem ON l_orderkey = key GROUP BY key", "count_key")(
    lambda s, d: search.count_key(table(s, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("key")), table(s, d, "orders").select(F.explode(F.array(F.col("o_orderkey").cast("long"), -F.col("o_orderkey").cast("long") - 1)).alias("key")))
)
register(f"SELECT list_id, doc_id, lag(doc_id) OVER w AS previous, lead(doc_id) OVER w AS following FROM ({SUPP}) WINDOW w AS (PARTITION BY list_id ORDER BY doc_id)", "next_posting")(lambda s, d: search.neighbours(supp(s, d), 1 << 11))

# Index ---------------------------------------------------------------------------------------------------------------

_POSITIONS = f"SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY doc_id) - 1 AS pos, doc_id FROM ({SUPP})"


def _decoded(index) -> DataFrame:
    return decoding.decode(index.segments).withColumn("pos", F.col("pos").cast("long"))


for _e in EPSILONS:
    register(_POSITIONS, f"roundtrip_eps{_e}")(lambda s, d, e=_e: _decoded(build_index(supp(s, d), e)))
register(_POSITIONS, "roundtrip_adaptive")(lambda s, d: _decoded(build_index(supp(s, d))))
register(_POSITIONS, "roundtrip_chunked")(lambda s, d: _decoded(build_index(supp(s, d), chunk=100)))
register(_POSITIONS.replace(SUPP, TERM), "roundtrip_terms")(lambda s, d: _decoded(build_index(term(s, d))))
register(_POSITIONS, "roundtrip_saved")(lambda s, d: _decoded(settle(build_index(supp(s, d)))))
register(_POSITIONS, "roundtrip_packed")(lambda s, d: packing.decode_packed(packing.pack_index(build_index(supp(s, d)).segments)))
register(_POSITIONS.replace(SUPP, PART), "roundtrip_packed_parts")(lambda s, d: packing.decode_packed(packing.pack_index(build_index(part(s, d)).segments)))


def _longs(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(n).cast("long").alias(n) if t in ("int", "tinyint", "smallint") else F.col(n) for n, t in rows.dtypes])


def modelled(what: str, name: str, *, lists: str = "part") -> Callable[[Query], Query]:
    """Registers a query over an index of `lists`: suppliers at bound 63, or parts with the best bound of each; the SQL fits lines by itself."""
    return register(model_sql.select(what, SUPP, (63,)) if lists == "supp" else model_sql.select(what, PART, adaptive=True), name)


def supp63(s: SparkSession, d: str) -> Index:
    return build_index(supp(s, d), 63)


def parts(s: SparkSession, d: str) -> Index:
    return build_index(part(s, d))


@register(_POSITIONS)
def roundtrip_differences(s: SparkSession, d: str) -> DataFrame:
    index = build_index(supp(s, d))
    return decoding.decode_differences(differences(index.segments), index.segments).withColumn("pos", F.col("pos").cast("long"))


@register(f"SELECT count(*) AS postings, CAST(2 * count(*) FILTER (WHERE list_id % 7 = 3) AS BIGINT) AS unequal FROM ({QTY})")
def verify_index(s: SparkSession, d: str) -> DataFrame:
    """An index whose lists 3, 10, 17 and so on are moved out of their range: each of their postings is lost, and another is there."""
    rows = qty(s, d)
    moved = decoding.decode(build_index(rows, 15).segments).withColumn("doc_id", F.col("doc_id") + F.when(F.col("list_id") % 7 == 3, 1 << 31).otherwise(0))
    return rows.agg(F.count("*").alias("postings")).crossJoin(decoding.unequal(moved, rows))  # one row each


@modelled("SELECT list_id, epsilon, min(list_min(residual)) AS least, max(list_max(residual)) AS most FROM segments GROUP BY list_id, epsilon", "residual_bound")
def residual_bound(s: SparkSession, d: str) -> DataFrame:
    return _longs(parts(s, d).segments.groupBy("list_id", "epsilon").agg(F.min(F.array_min("residual")).alias("least"), F.max(F.array_max("residual")).alias("most")))


@register(f"SELECT list_id, count(*) AS n FROM ({SUPP}) GROUP BY list_id")
def coverage(s: SparkSession, d: str) -> DataFrame:
    return build_index(supp(s, d), 31).segments.groupBy("list_id").agg(F.sum("covered").alias("n"))


def _every_position(s: SparkSession, d: str) -> DataFrame:
    lengths = supp(s, d).groupBy("list_id").agg(F.count("*").alias("n"))
    return lengths.select("list_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos"))


@register(_POSITIONS)
def access_pos(s: SparkSession, d: str) -> DataFrame:
    return decoding.access(build_index(supp(s, d)).segments, _every_position(s, d))


_VALUE = "((slope_significand * j) >> slope_exponent) + intercept"
modelled(f"SELECT list_id, first + j AS pos, {_VALUE} AS value, {_VALUE} - 63 AS low, {_VALUE} + 64 AS high FROM (SELECT *, unnest(range(0, covered)) AS j FROM segments)", "search_window", lists="supp")(lambda s, d: search.search_window(supp63(s, d).segments, _every_position(s, d)))


@register(f"SELECT list_id, doc_id FROM ({SUPP}) WHERE list_id IN (1, 3)")
def load_selected(s: SparkSession, d: str) -> DataFrame:
    wanted = s.createDataFrame([(1,), (3,), (999999,)], "list_id long")
    return decoding.decode(load_lists(build_index(supp(s, d), 127), wanted).segments).select("list_id", "doc_id")


register(f"SELECT list_id, min(doc_id) AS first_doc, max(doc_id) AS last_doc, count(*) AS n FROM ({PART}) GROUP BY list_id", "list_bounds")(lambda s, d: build_index(part(s, d), 7).lists.select("list_id", "first_doc", "last_doc", "n"))
_LISTS = ("list_id", "epsilon", "n", "n_segments", "n_exceptions", "first_doc", "last_doc", "bpc_first", "bpc_covered", "bpc_intercept", "bpc_slope_exponent", "bpc_slope_significand", "inline_bits", "exception_bits", "segment_bytes", "correction_bytes", "sign_bytes", "size_bytes", "size_bytes_with_covered")
modelled(f"SELECT {', '.join(_LISTS)} FROM lists", "lists_table")(lambda s, d: _longs(parts(s, d).lists.select(*_LISTS)))
_SEGMENTS = ("list_id", "seg_id", "first", "covered", "intercept", "slope_exponent", "slope_significand", "seg_min_doc", "seg_max_doc", "exceptions")
modelled(f"SELECT {', '.join(_SEGMENTS)} FROM segments", "segments_table", lists="supp")(lambda s, d: _longs(supp63(s, d).segments.select(*_SEGMENTS)))
modelled("SELECT epsilon, count(*) AS lists FROM lists GROUP BY epsilon", "epsilon_histogram")(lambda s, d: _longs(stats.epsilon_histogram(parts(s, d).lists)))
modelled("SELECT list_id, seg_id, covered FROM segments", "covered", lists="supp")(lambda s, d: _longs(stats.covered(supp63(s, d).segments)))
modelled("SELECT list_id, first + j AS pos, seg_doc AS doc_id FROM (SELECT s.list_id, first, unnest(range(0, covered)) AS j, unnest(d[first + 1 : first + covered]) AS seg_doc FROM segments s JOIN w USING (list_id, epsilon) WHERE s.list_id = 1 AND seg_id = 0)", "decode_segment", lists="supp")(
    lambda s, d: decoding.decode_segment(supp63(s, d).segments, 1, 0)
)
_DIFFS = "SELECT list_id, epsilon, seg_id, first + j AS pos, residual[j + 1] AS residual, diffs[j + 1] AS diff, epsilon >= 3 AND abs(diffs[j + 1]) > inline AS is_exception FROM (SELECT *, unnest(range(0, covered)) AS j FROM segments)"
_DIFF_COLUMNS = ("list_id", "epsilon", "seg_id", "pos", "residual", "diff", "is_exception")
modelled(_DIFFS, "residual_differences", lists="supp")(lambda s, d: _longs(differences(supp63(s, d).segments).select(*_DIFF_COLUMNS)))
modelled(_DIFFS, "residual_differences_of_parts")(lambda s, d: _longs(differences(parts(s, d).segments).select(*_DIFF_COLUMNS)))


def _drawn(*columns: str) -> str:
    value = "0"
    for c in columns:
        value = f"((({value} + {c} % 1000003 + 1) * 48271) % 2147483647)"
    return f"({value} * 69621) % 2147483647"


def _sample(n: int) -> str:
    return f"SELECT draw, arg_min(list_id, {{'k': {_drawn('draw', 'list_id')}, 'l': list_id}}) AS list_id FROM (SELECT DISTINCT list_id FROM ({SUPP})), range({n}) t(draw) GROUP BY draw"


register(_sample(8), "sample_lists")(lambda s, d: _longs(sample_lists(supp(s, d), 8, replacement=True)))
register(f"SELECT row_number() OVER (ORDER BY k, list_id) - 1 AS draw, list_id FROM (SELECT DISTINCT list_id, {_drawn('list_id')} AS k FROM ({SUPP})) QUALIFY draw < 8", "sample_lists_once")(lambda s, d: _longs(sample_lists(supp(s, d), 8)))


def _sampled(s: SparkSession, d: str, n: int):
    index = settle(supp63(s, d))
    return index, sample_lists(index.lists, n, replacement=True)


@modelled(f"SELECT draw, x.* EXCLUDE (epsilon) FROM ({_sample(8)}) JOIN ({_DIFFS}) x USING (list_id)", "residual_dump", lists="supp")
def residual_dump(s: SparkSession, d: str) -> DataFrame:
    index, chosen = _sampled(s, d, 8)
    return _longs(stats.residual_dump(index.segments, chosen))


@modelled(
    f"SELECT draw, list_id, seg_id, pos, residual, diff, is_exception FROM (SELECT draw, list_id, arg_min(seg_id, {{'k': {_drawn('draw', 'seg_id')}, 's': seg_id}}) AS seg_id FROM ({_sample(16)}) JOIN segments USING (list_id) GROUP BY draw, list_id) JOIN ({_DIFFS}) x USING (list_id, seg_id)",
    "random_segment_dump",
    lists="supp",
)
def random_segment_dump(s: SparkSession, d: str) -> DataFrame:
    index, chosen = _sampled(s, d, 16)
    return _longs(stats.residual_dump(index.segments, chosen).join(stats.random_segments(index.segments, chosen), ["draw", "list_id", "seg_id"]))


_WRITTEN = "size_bytes_with_covered - sign_bytes + (n + 7) // 8 + (n_exceptions + 7) // 8"
modelled(f"SELECT list_id, n, {_WRITTEN} AS bytes FROM lists", "packed_bytes")(lambda s, d: packing.written_bytes(packing.pack_index(parts(s, d).segments)))


@register(f"SELECT CAST(dense_rank() OVER (ORDER BY list_id) - 1 AS BIGINT) AS list_id, row_number() OVER (PARTITION BY list_id ORDER BY doc_id) - 1 AS pos, doc_id FROM ({SUPP})")
def collection_file(s: SparkSession, d: str) -> DataFrame:
    """Written as a collection file and read again; a list's id is its ordinal in the file."""
    path = scratch(s)
    write_docs(supp(s, d), path, 1 << 20)
    return _longs(read_docs(s, path).select("list_id", "pos", "doc_id"))


@register("SELECT DISTINCT CAST(key AS BIGINT) AS key FROM (SELECT n_nationkey * 7 - 50 AS key FROM nation)")
def key_file(s: SparkSession, d: str) -> DataFrame:
    """Keys of a small table written as a key file and read again."""
    path = scratch(s)
    write_keys([r.n_nationkey * 7 - 50 for r in table(s, d, "nation").select("n_nationkey").collect()], path)
    return keys_from(s, path)


@register(WORKLOAD)
def query_file(s: SparkSession, d: str) -> DataFrame:
    """The workload written as a query file, one query a line, and read again."""
    path = scratch(s)
    lines = workload(s).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("list_id")), " ").alias("value"))
    lines.coalesce(1).sortWithinPartitions("query_id").select("value").write.text(path)
    return read_queries(s, path)


# Statistics ----------------------------------------------------------------------------------------------------------

_GAPS = f"SELECT list_id, doc_id - lag(doc_id) OVER (PARTITION BY list_id ORDER BY doc_id) AS gap FROM ({SUPP})"
_GAP_ROWS = f"SELECT list_id, count(gap) AS gaps, avg(gap) AS mean_gap, var_pop(gap) AS var_gap FROM ({_GAPS}) GROUP BY list_id HAVING count(gap) > 0"
register(f"SELECT list_id, gaps, round(mean_gap, 6) AS mean_gap, round(var_gap, 4) AS var_gap FROM ({_GAP_ROWS})", "gap_statistics")(
    lambda s, d: stats.gap_statistics(supp(s, d)).select("list_id", "gaps", F.round("mean_gap", 6).alias("mean_gap"), F.round("var_gap", 4).alias("var_gap"))
)
register(f"SELECT round(avg(mean_gap), 6) AS mean_of_means, round(avg(var_gap), 4) AS mean_of_vars FROM ({_GAP_ROWS})", "gap_totals")(
    lambda s, d: stats.gap_totals(supp(s, d)).select(F.round("mean_of_means", 6).alias("mean_of_means"), F.round("mean_of_vars", 4).alias("mean_of_vars"))
)
modelled(
    "SELECT list_id, seg_id, count(*) AS gaps, round(avg(gap), 6) AS mean_gap, round(var_pop(gap), 6) AS var_gap FROM (SELECT s.list_id, seg_id, unnest(list_transform(range(1, covered), lambda j: d[first + j + 1] - d[first + j])) AS gap FROM segments s JOIN w USING (list_id, epsilon)) GROUP BY list_id, seg_id",
    "gap_statistics_by_segment",
    lists="supp",
)(lambda s, d: _longs(stats.gap_statistics_by_segment(supp63(s, d)).select("list_id", "seg_id", "gaps", F.round("mean_gap", 6).alias("mean_gap"), F.round("var_gap", 6).alias("var_gap"))))
register(f"SELECT list_id, 4 * count(*) AS raw_bytes FROM ({SUPP}) GROUP BY list_id", "raw_size")(lambda s, d: stats.raw_size(supp(s, d)))
register(f"SELECT list_id, CAST(count(*) * (2 + greatest(ceil(log2((max(doc_id) + 1) / count(*))), 0)) AS BIGINT) AS ef_bits FROM ({SUPP}) GROUP BY list_id", "elias_fano_size")(lambda s, d: stats.elias_fano_size(supp(s, d)))
_STEPS = "SELECT list_id, unnest(list_transform(range(0, covered), lambda j: abs(residual[j + 1] - CASE WHEN j = 0 THEN 0 ELSE residual[j] END))) AS v FROM segments"
_PICKS = ", ".join(f"s[(len(s) // {q}) * {p} + 1] AS {name}" for name, (q, p) in stats.QUANTILES.items())
modelled(f"SELECT list_id, s[1] AS least, {_PICKS}, s[-1] AS most, len(s) AS m FROM (SELECT list_id, list(v ORDER BY v) AS s FROM ({_STEPS}) GROUP BY list_id)", "residual_quantiles")(lambda s, d: _longs(stats.residual_quantiles(parts(s, d).segments)))

_LIMIT = "(epsilon >> 3)"
_SECOND = f"""SELECT list_id, epsilon, CAST(sum(CASE WHEN step > {_LIMIT} THEN 1 ELSE 0 END) AS BIGINT) AS over_num, coalesce(max(CASE WHEN step > {_LIMIT} THEN j - coalesce(last, -1) - 1 END), 0) AS max_distance,
    CAST(sum(CASE WHEN step > {_LIMIT} THEN 0 ELSE {model_sql.width(_LIMIT)} END) AS BIGINT) AS small_bits FROM (
  SELECT *, max(CASE WHEN step > {_LIMIT} THEN j END) OVER (PARTITION BY list_id, seg_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM (
    SELECT list_id, epsilon, seg_id, unnest(range(0, covered - 1)) AS j, unnest(list_transform(range(1, covered), lambda j: abs(residual[j + 1] - residual[j]))) AS step FROM segments)) GROUP BY list_id, epsilon"""
_COST = f"SELECT list_id, epsilon, over_num, max_distance, small_bits + over_num * ({model_sql.width('epsilon')} + 1 + {model_sql.width(_LIMIT)}) AS flag_bits, small_bits + over_num * ({model_sql.width('epsilon')} + 1 + {model_sql.width('max_distance')}) AS distance_bits FROM ({_SECOND})"
modelled(_COST, "second_difference_cost", lists="supp")(lambda s, d: _longs(stats.second_difference_cost(supp63(s, d))))
modelled(_COST, "second_difference_cost_of_parts")(lambda s, d: _longs(stats.second_difference_cost(parts(s, d))))
modelled(
    f"SELECT *, distance_bits / original_bits AS distance_ratio, flag_bits / original_bits AS flag_ratio FROM (SELECT CAST(sum(n * {model_sql.width('epsilon')}) AS BIGINT) AS original_bits FROM lists), (SELECT CAST(sum(distance_bits) AS BIGINT) AS distance_bits, CAST(sum(flag_bits) AS BIGINT) AS flag_bits FROM ({_COST}))",
    "second_difference_report",
)(lambda s, d: stats.second_difference_report(settle(parts(s, d))))
modelled("SELECT list_id, seg_id, j, (residual[j] + residual[j + 2]) // 2 - residual[j + 1] AS spline FROM (SELECT *, unnest(range(1, covered - 1, 2)) AS j FROM segments)", "spline_residuals", lists="supp")(lambda s, d: _longs(stats.spline_residuals(supp63(s, d).segments)))
modelled(f"SELECT list_id, n * ({model_sql.width('epsilon')} + 1) AS plain_bits, CAST(0 AS BIGINT) AS beyond FROM lists", "plain_residual_size")(lambda s, d: _longs(stats.plain_residual_size(parts(s, d))))

_TOTALS = "sum(n) AS integers, sum(n_segments) AS segments, sum(n_exceptions) AS exceptions, count(*) AS lists, sum(segment_bytes) AS segment_bytes, sum(correction_bytes) AS correction_bytes, sum(sign_bytes) AS sign_bytes, sum(size_bytes) AS size_bytes, sum(size_bytes_with_covered) AS size_bytes_with_covered, max(significand_max) AS slope_significand_max, max(exponent_max) AS slope_exponent_max"
_WHOLE = [x.split(" AS ")[1] for x in _TOTALS.split(", ")]
modelled(
    f"SELECT {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _WHOLE)}, round(integers / segments, 9) AS avg_covered, round(segments / lists, 9) AS avg_segments, round(size_bytes / (4 * integers), 9) AS ratio, round(size_bytes / integers, 9) AS bytes_per_integer, round(size_bytes / 1073741824, 12) AS size_gib, {model_sql.width('slope_significand_max')} AS slope_significand_width, {model_sql.width('slope_exponent_max')} AS slope_exponent_width FROM (SELECT {_TOTALS} FROM lists)",
    "index_statistics",
)(lambda s, d: _longs(stats.index_statistics(parts(s, d))).withColumns({c: F.round(c, 9) for c in ("avg_covered", "avg_segments", "ratio", "bytes_per_integer")} | {"size_gib": F.round("size_gib", 12)}))

register(None, "huffman_table")(lambda s, d: stats.huffman_table(supp63(s, d)))
# The least cost of a prefix code is the sum of all weights that are made by joining the two least again and again.
_MERGED = """, weights AS (SELECT list_id, list(c ORDER BY c) AS c, CAST(0 AS BIGINT) AS bits FROM (SELECT list_id, diff, count(*) AS c FROM (SELECT list_id, unnest(diffs) AS diff FROM segments) GROUP BY list_id, diff) GROUP BY list_id),
merged AS (SELECT list_id, len(c) AS symbols, c, CASE WHEN len(c) = 1 THEN c[1] ELSE bits END AS bits FROM weights
  UNION ALL SELECT list_id, symbols, list_sort(list_append(c[3:], c[1] + c[2])), bits + c[1] + c[2] FROM merged WHERE len(c) > 1)
SELECT list_id, symbols, bits AS data_bits FROM merged WHERE len(c) = 1"""


@modelled(_MERGED, "huffman_size")
def huffman_size(s: SparkSession, d: str) -> DataFrame:
    index = settle(parts(s, d))
    symbols = stats.huffman_table(index).groupBy("list_id").agg(F.count("*").alias("symbols"))
    return stats.huffman_size(index).join(symbols, "list_id").select("list_id", "symbols", "data_bits")


@modelled("SELECT list_id, seg_id, first + j AS pos, diffs[j + 1] AS diff FROM (SELECT *, unnest(range(0, covered)) AS j FROM segments)", "huffman_roundtrip", lists="supp")
def huffman_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Residual differences coded, stored with their tables, read and decoded again."""
    index, path = settle(supp63(s, d)), scratch(s)
    codes = stats.huffman_table(index)
    save_codes(codes, stats.huffman_encoded(index, codes), path)
    return _longs(stats.huffman_decoded(*reversed(load_codes(s, path))))


# A block's cost at each width, and of these the least: the definition over again, on zigzagged residuals.
_BLOCKS = "SELECT list_id, unnest(list_transform(range(0, covered, 128), lambda b: list_transform(residual[b + 1 : b + 128], lambda v: CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END))) AS block FROM segments"
_WIDTHS = f"SELECT list_id, block, list_max(list_transform(block, lambda v: {model_sql.width('v')})) AS top, list_transform(block, lambda v: {model_sql.width('v')}) AS ws FROM ({_BLOCKS})"
modelled(f"SELECT list_id, CAST(sum(16 + list_min(list_transform(range(0, top + 1), lambda b: b * len(ws) + len(list_filter(ws, lambda v: v > b)) * (7 + top - b)))) AS BIGINT) AS pfor_bits FROM ({_WIDTHS}) GROUP BY list_id", "patched_size")(lambda s, d: stats.patched_size(parts(s, d)))


@modelled("SELECT list_id, diff AS symbol, count(*) AS count, 1.0::DOUBLE AS kraft FROM (SELECT list_id, unnest(diffs) AS diff FROM segments) GROUP BY list_id, diff", "huffman_covers", lists="supp")
def huffman_covers(s: SparkSession, d: str) -> DataFrame:
    """The symbols that are coded and how often; a complete code sums to 1 over its lengths."""
    codes = stats.huffman_table(settle(supp63(s, d)))
    whole = stats.kraft_sums(codes).select("list_id", F.round("kraft", 9).alias("kraft"))
    return _longs(codes.join(whole, "list_id").select("list_id", "symbol", "count", "kraft"))


# Scalars -------------------------------------------------------------------------------------------------------------


@register(f"SELECT width, count(*) AS n FROM (SELECT CASE WHEN doc_id = 0 THEN 0 ELSE length(bin(doc_id)) END AS width FROM ({SUPP})) GROUP BY width")
def bit_widths(s: SparkSession, d: str) -> DataFrame:
    return supp(s, d).select(bit_width(F.col("doc_id")).cast("long").alias("width")).groupBy("width").agg(F.count("*").alias("n"))


@register("SELECT x, CASE WHEN x < 2 THEN 1 ELSE CAST(1 AS BIGINT) << length(bin(x - 1)) END AS ceiling FROM range(1000) t(x)")
def bit_ceilings(s: SparkSession, d: str) -> DataFrame:
    return s.range(1000).select(F.col("id").alias("x"), bit_ceiling(F.col("id")).alias("ceiling"))


@register("SELECT x, CAST(x AS BIGINT) // 7 AS quotient, CASE WHEN x < 0 THEN 1 ELSE 0 END AS negative, abs(x) AS size, round(x / 7.0::DOUBLE, 9) AS slope, ((x * 13) >> 3) + 5 AS line, CAST(x AS VARCHAR) AS words FROM range(-500, 500) t(x)")
def arithmetic(s: SparkSession, d: str) -> DataFrame:
    x = F.col("id")
    line = approximate(x, F.lit(0), F.lit(5), F.lit(3), F.lit(13).cast("long"))
    return s.range(-500, 500).select(x.alias("x"), truncated_div(x, F.lit(7).cast("long")).alias("quotient"), sign_of(x).alias("negative"), F.abs(x).alias("size"), F.round(slope(x, F.lit(7)), 9).alias("slope"), line.alias("line"), text_of_big(x).alias("words"))


def _packed(rows: DataFrame) -> DataFrame:
    lists = rows.groupBy("list_id").agg(F.sort_array(F.collect_list("doc_id")).alias("v"))
    width = bit_width(F.array_max("v"))
    return lists.select("list_id", F.explode(unpack(pack(F.col("v"), width), width, F.size("v"))).alias("value"))


register(f"SELECT list_id, doc_id AS value FROM ({SUPP})", "packed_fields")(lambda s, d: _packed(supp(s, d)))


@register("SELECT CAST(n_nationkey AS BIGINT) AS key, n_nationkey % 5 <> 2 AS found, CAST(CASE WHEN n_nationkey % 5 = 2 THEN NULL WHEN n_nationkey % 5 = 0 THEN n_nationkey + 100 ELSE n_nationkey % 5 END AS BIGINT) AS value FROM nation")
def keyed_store(s: SparkSession, d: str) -> DataFrame:
    """A store of 0 to 4, with one key removed and one set anew in each row."""
    key = F.col("n_nationkey").cast("long")
    store = F.map_from_arrays(F.array(*[F.lit(i).cast("long") for i in range(5)]), F.array(*[F.lit(i).cast("long") for i in range(5)]))
    rows = table(s, d, "nation").select(key.alias("key"), insert(remove(store, F.lit(2).cast("long")), F.lit(0).cast("long"), key + 100).alias("store"))
    asked = (F.col("key") % 5).cast("long")
    return rows.select("key", find(F.col("store"), asked).alias("found"), find_value(F.col("store"), asked).alias("value"))


_LINES = "1 2 3| 4   5 |7 x 9||2 2 8 1|abc|10"


@register("SELECT * FROM (VALUES (0, 1), (0, 2), (0, 3), (1, 4), (1, 5), (2, 7), (4, 2), (4, 8), (4, 1), (6, 10)) t(query_id, list_id)")
def query_lines(s: SparkSession, d: str) -> DataFrame:
    lines = s.range(1).select(F.posexplode(F.split(F.lit(_LINES), r"\|")).alias("query_id", "value"))
    return lines_of_queries(lines.select(F.col("query_id").cast("int").alias("query_id"), "value")).select("query_id", F.col("list_id").cast("int").alias("list_id"))


@register("SELECT * FROM (VALUES ('a', 1.5::DOUBLE), ('b', -2.0::DOUBLE), ('b', 30.0::DOUBLE)) t(part, number)")
def parsed_numbers(s: SparkSession, d: str) -> DataFrame:
    rows = s.range(1).select(F.explode(F.array(F.lit("a, 1.5 ,x"), F.lit(" b,-2, 3e1 ,"))).alias("line"))
    return rows.select(F.element_at(words(F.col("line")), 1).alias("part"), F.explode(doubles(F.col("line"))).alias("number"))


@register("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y%m%d_%H%M%S') AS name FROM events")
def log_names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", key_of_timestamp(F.col("ts")).alias("name"))


# Points --------------------------------------------------------------------------------------------------------------

_POINTS = "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS BIGINT) AS x, CAST(floor(p_retailprice) AS BIGINT) AS y FROM part"
_CODE = " + ".join(f"(((x >> {b}) & 1) << {2 * b}) + (((y >> {b}) & 1) << {2 * b + 1})" for b in range(16))


def points(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("long").alias("x"), F.floor("p_retailprice").alias("y"))


register(f"SELECT id, {_CODE} AS zcode, x, y FROM ({_POINTS})", "morton_codes")(
    lambda s, d: points(s, d).select("id", morton(F.col("x"), F.col("y"), bits=16).alias("zcode")).select("id", "zcode", *[c.alias(n) for c, n in zip(unmorton(F.col("zcode"), 2, 16), "xy")])
)
_BOX = f"SELECT {_CODE} AS next_code FROM (SELECT x, y FROM range(10, 31) a(x), range(905, 916) b(y))"
register(f"SELECT id, c.zcode, next_code FROM (SELECT id, {_CODE} AS zcode FROM ({_POINTS})) c ASOF LEFT JOIN ({_BOX}) b ON c.zcode <= b.next_code", "next_in_box")(
    lambda s, d: points(s, d).select("id", morton(F.col("x"), F.col("y"), bits=16).alias("zcode")).select("id", "zcode", next_in_box(F.col("zcode"), [10, 905], [30, 915], 16).alias("next_code"))
)
register(f"SELECT * FROM ({_POINTS}) WHERE x BETWEEN 10 AND 30 AND y BETWEEN 905 AND 915", "box_range")(lambda s, d: spatial.box(points(s, d), {"x": 10, "y": 905}, {"x": 30, "y": 915}))
register(f"SELECT id, x, y, (x - 25) * (x - 25) + (y - 910) * (y - 910) AS distance2 FROM ({_POINTS}) ORDER BY distance2, id LIMIT 10", "nearest_points")(lambda s, d: spatial.nearest(points(s, d), {"x": 25, "y": 910}, 10, "id"))
register(f"SELECT a.x, a.y FROM (SELECT x, 900 + 2 * y AS y FROM range(1, 51) t(x), range(60) u(y)) a SEMI JOIN ({_POINTS}) p ON a.x = p.x AND a.y = p.y", "has_points")(
    lambda s, d: spatial.has_points(points(s, d), s.range(1, 51).select(F.col("id").alias("x"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda y: 900 + 2 * y.cast("long"))).alias("y")), ["x", "y"])
)


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Two suppliers' orders, asked of the compressed index."""
    asked = s.createDataFrame([(0, 1), (0, 2)], "query_id long, list_id long")
    return setops.on_index(settle(build_index(supp(s, d))), asked, "AND")
