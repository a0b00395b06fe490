"""Set algebra over posting lists: single queries, chains of semi-joins, and whole workloads at once.

Duplicate ids in a query count once. An unknown list is empty: it empties AND and is nothing to OR.
A query of one list is that list; a query without lists has no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Index, load_lists
from .decode import decode
from .lines import GREATEST


def and_batch(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id) where the document is in all lists of the query: one join and one pre-aggregated count."""
    queries = queries.select("query_id", "list_id").distinct()
    sizes = queries.groupBy("query_id").agg(F.count("*").alias("k"))
    counted = queries.join(postings.select("list_id", "doc_id"), "list_id").groupBy("query_id", "doc_id").agg(F.count("*").alias("met"))
    return counted.join(sizes, "query_id").where("met = k").select("query_id", "doc_id")


def or_batch(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id) where the document is in some list of the query."""
    queries = queries.select("query_id", "list_id").distinct()
    return queries.join(postings.select("list_id", "doc_id"), "list_id").select("query_id", "doc_id").distinct()


def batch(postings: DataFrame, queries: DataFrame, kind: str) -> DataFrame:
    """A workload of AND or OR queries by name."""
    if kind not in ("AND", "OR"):
        raise ValueError("a query is AND or OR")
    return (and_batch if kind == "AND" else or_batch)(postings, queries)


def _few(postings: DataFrame, ids: list[int]) -> tuple[DataFrame, list[int]]:
    ids = sorted(set(ids))
    return postings.where(F.col("list_id").isin(ids)), ids


def and_query(postings: DataFrame, ids: list[int]) -> DataFrame:
    """(doc_id) in all of the lists; the ids are pushed into the scan."""
    rows, ids = _few(postings, ids)
    return rows.groupBy("doc_id").agg(F.count("*").alias("met")).where(F.col("met") == len(ids)).select("doc_id")


def or_query(postings: DataFrame, ids: list[int]) -> DataFrame:
    """(doc_id) in any of the lists."""
    return _few(postings, ids)[0].select("doc_id").distinct()


def and_chain(postings: DataFrame, ids: list[int], lists: DataFrame | None = None) -> DataFrame:
    """(doc_id) in all of the lists, by semi-joins from the shortest list up, as `lists` (list_id, n) has the lengths."""
    ids = sorted(set(ids))
    if lists is not None:
        sizes = {r.list_id: r.n for r in lists.where(F.col("list_id").isin(ids)).select("list_id", "n").collect()}
        ids.sort(key=lambda i: (sizes.get(i, 0), i))
    own = [postings.where(F.col("list_id") == i).select("doc_id") for i in ids]
    return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), own).distinct() if own else postings.select("doc_id").where("false")


def except_query(postings: DataFrame, keep: int, drop: list[int]) -> DataFrame:
    """(doc_id) in list `keep` and in none of `drop`."""
    return postings.where(F.col("list_id") == keep).select("doc_id").distinct().join(or_query(postings, drop), "doc_id", "left_anti")


def on_index(index: Index, queries: DataFrame, kind: str, strict: bool = False) -> DataFrame:
    """A workload on the compressed index: only its lists are read, and for AND only lines that can meet all lists of some query.

    A list may have several rows in `lists`, as an appended index has one for each batch.
    """
    own = load_lists(index, queries, strict)
    segments = own.segments
    if kind == "AND":
        segments = meeting(segments, own.lists, queries.select("query_id", "list_id").distinct())
    rows = decode(segments)
    if "batch" in segments.columns:  # a posting may have come in several batches
        rows = rows.select("list_id", "doc_id").distinct()
    return batch(rows, queries, kind)


#: Blocks that the ids of an index are cut into, to see where all lists of a query have lines.
ZONES = 4096


def meeting(segments: DataFrame, lists: DataFrame, asked: DataFrame) -> DataFrame:
    """The lines that can hold a document that is in all lists of some query.

    Such a document lies between the greatest first and the least last posting of the query's lists, and in a block of ids that a line of each of them
    touches. Only a line's own bounds are looked at, so residuals of the others are never read.
    """
    spans = lists.groupBy("list_id").agg(F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"))
    bounds = asked.join(spans, "list_id", "left").groupBy("query_id").agg(F.max("first_doc").alias("low"), F.min("last_doc").alias("high"), F.count("*").alias("k"), F.count("first_doc").alias("known"))
    bounds = bounds.where("k = known AND low <= high").select("query_id", "low", "high", "k")
    zone = lambda c: F.shiftright(c, (GREATEST // ZONES).bit_length())
    whole = segments.select("list_id", "seg_min_doc", "seg_max_doc")
    touched = whole.select("list_id", F.explode(F.sequence(zone("seg_min_doc"), zone("seg_max_doc"))).alias("zone")).distinct()
    met = asked.join(bounds, "query_id").join(touched, "list_id").where((F.col("zone") >= zone("low")) & (F.col("zone") <= zone("high")))
    shared = met.groupBy("query_id", "zone").agg(F.count("*").alias("n"), F.max("k").alias("k"), F.max("low").alias("low"), F.max("high").alias("high")).where("n = k")
    wanted = shared.join(asked, "query_id").groupBy("list_id", "zone").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    cut = whole.withColumn("zone", F.explode(F.sequence(zone("seg_min_doc"), zone("seg_max_doc"))))
    kept = cut.join(wanted, ["list_id", "zone"]).where("seg_max_doc >= low AND seg_min_doc <= high").select("list_id", "seg_min_doc", "seg_max_doc").distinct()
    return segments.join(kept, ["list_id", "seg_min_doc", "seg_max_doc"], "left_semi")


def read_share(index: Index, queries: DataFrame) -> DataFrame:
    """One row: the postings in the lists of a workload, and those in the lines that an AND of it reads."""
    own, asked = load_lists(index, queries), queries.select("query_id", "list_id").distinct()
    read = meeting(own.segments, own.lists, asked).agg(F.coalesce(F.sum("covered"), F.lit(0)).alias("read"))
    return own.lists.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("postings")).crossJoin(F.broadcast(read))  # one row each


def total(results: DataFrame) -> DataFrame:
    """One row, `total`: the sizes of all results together."""
    return results.agg(F.count("*").alias("total"))


def query_sizes(lists: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: the number of queries, and the mean over queries of their lists' lengths together."""
    sizes = queries.select("query_id", "list_id").distinct().join(lists.select("list_id", "n"), "list_id", "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("size"))
    return sizes.agg(F.count("*").alias("queries"), F.avg("size").alias("avg_size"))
