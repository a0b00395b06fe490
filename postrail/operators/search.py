"""Ordered search within lists: next greater or equal, predecessor, rank, membership and neighbours.

Probes and postings of a list are laid together in ranges of ids, so a list of any length is spread over
tasks; what lies beyond a probe's range is carried over from a table with one row for each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids in one range.
SPAN = 1 << 20


def _range(column: str, span: int):
    return F.floor(F.col(column) / span)


#: What an id is: bits of `kind`.
_POSTING, _ASKED = 1, 2


def _events(postings: DataFrame, probes: DataFrame, span: int) -> DataFrame:
    """(list_id, range, at, kind): one row for each id that is a posting, a key or both, dealt once by list and range."""
    both = postings.select("list_id", F.col("doc_id").alias("at"), F.lit(_POSTING).alias("kind"))
    both = both.union(probes.select("list_id", F.col("key").alias("at"), F.lit(_ASKED))).where("list_id IS NOT NULL AND at IS NOT NULL")
    dealt = both.repartition("list_id", _range("at", span)).withColumn("range", _range("at", span))
    return dealt.groupBy("list_id", "range", "at").agg(F.bit_or("kind").alias("kind"))


def _doc():
    return F.when(F.col("kind").bitwiseAND(_POSTING) > 0, F.col("at"))


def _ranges(postings: DataFrame, probes: DataFrame, span: int, counted: DataFrame | None) -> DataFrame:
    """(list_id, range, above, below, before) of every range with a posting or a probe; `before` only if there are `counted` events."""
    if counted is None:  # least and greatest need no distinct postings, and so no dealing
        every = postings.select("list_id", _range("doc_id", span).alias("range"), "doc_id").union(probes.select("list_id", _range("key", span), F.lit(None).cast("long")))
        every = every.groupBy("list_id", "range").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.lit(0).alias("n"))
    else:
        doc = _doc()
        every = counted.groupBy("list_id", "range").agg(F.min(doc).alias("low"), F.max(doc).alias("high"), F.count(doc).alias("n"))
    later = Window.partitionBy("list_id").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("list_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("list_id", "range", F.min("low").over(later).alias("above"), F.max("high").over(earlier).alias("below"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def located(postings: DataFrame, probes: DataFrame, span: int = SPAN, ranks: bool = True) -> DataFrame:
    """Distinct probes (list_id, key) with `next_geq` (least posting >= key), `predecessor` (greatest <= key; null if none),
    `rank` (postings < key) and `present`.

    Both may hold rows that repeat. Without `ranks` there is no `rank`, and nothing is dealt to count what comes before a range. What lies at or beyond a key is summed up from the far end, so that each window is one pass.
    """
    events, doc = _events(postings, probes, span), _doc()
    near = Window.partitionBy("list_id", "range").rowsBetween(Window.unboundedPreceding, 0)
    up, down = near.orderBy(F.desc("at")), near.orderBy("at")
    seen = events.withColumns({"up": F.min(doc).over(up), "down": F.max(doc).over(down), "upto": F.count(doc).over(down)}).where(F.col("kind").bitwiseAND(_ASKED) > 0)
    placed = seen.join(_ranges(postings, probes, span, events if ranks else None), ["list_id", "range"])
    rank = F.col("before") + F.col("upto") - F.when(doc.isNotNull(), 1).otherwise(0)
    return placed.select(
        "list_id",
        F.col("at").alias("key"),
        F.coalesce("up", "above").alias("next_geq"),
        F.coalesce("down", "below").alias("predecessor"),
        *([rank.alias("rank")] if ranks else []),
        doc.isNotNull().alias("present"),
    )


def next_geq(postings: DataFrame, probes: DataFrame) -> DataFrame:
    return located(postings, probes, ranks=False).select("list_id", "key", "next_geq")


def next_geq_on(segments: DataFrame, probes: DataFrame) -> DataFrame:
    """(list_id, key, next_geq) on an index, by its lines' bounds: a probe's answer lies in the first line that ends at or beyond it.

    Lines are found by their last postings alone, and the residuals of no other line are read. In an appended index the lines
    of a list's batches may overlap; there the lines between a list's least key and the first line that begins at or after its greatest are
    decoded, and each key is met once, however many batches there are.
    """
    from .decode import _value, decode

    if "batch" in segments.columns:
        ends = probes.groupBy("list_id").agg(F.min("key").alias("least"), F.max("key").alias("key"))
        begins = next_geq(segments.select("list_id", F.col("seg_min_doc").alias("doc_id")), ends.select("list_id", "key"))
        asked = ends.join(begins, ["list_id", "key"]).select("list_id", "least", F.col("next_geq").alias("most"))
        asked = asked.join(segments.select("list_id", "batch").distinct(), "list_id")  # on both, as an appended index is dealt
        lines = segments.join(asked, ["list_id", "batch"]).where("seg_max_doc >= least AND (most IS NULL OR seg_min_doc <= most)")
        return next_geq(decode(lines).select("list_id", "doc_id"), probes)
    ends = next_geq(segments.select("list_id", F.col("seg_max_doc").alias("doc_id")), probes)
    lines = segments.select("list_id", F.col("seg_max_doc").alias("next_geq"), F.col("seg_min_doc"), "intercept", "slope_exponent", "slope_significand", "residual")
    met = ends.join(lines, ["list_id", "next_geq"], "left")
    docs = F.transform("residual", lambda e, j: _value(j, e))
    inside = F.array_min(F.filter(docs, lambda d: d >= F.col("key")))
    found = F.when(F.col("seg_min_doc") >= F.col("key"), F.col("seg_min_doc")).otherwise(inside)
    return met.groupBy("list_id", "key").agg(F.min(found).alias("next_geq"))


def upper_bound(postings: DataFrame, probes: DataFrame) -> DataFrame:
    """The least posting greater than each key."""
    moved = located(postings, probes.select("list_id", (F.col("key") + 1).alias("key")), ranks=False)
    return moved.select("list_id", (F.col("key") - 1).alias("key"), F.col("next_geq").alias("upper_bound"))


def predecessor_index(postings: DataFrame, probes: DataFrame) -> DataFrame:
    """The rank of the greatest posting not above each key, 0 where there is none."""
    found = located(postings, probes)
    return found.select("list_id", "key", F.greatest(F.col("rank") + F.when(F.col("present"), 1).otherwise(0) - 1, F.lit(0)).alias("index"))


def contains(postings: DataFrame, probes: DataFrame) -> DataFrame:
    """The probes (list_id, key) that are postings; an equi-join."""
    return probes.join(postings.select("list_id", F.col("doc_id").alias("key")), ["list_id", "key"], "left_semi")


def count_key(keys: DataFrame, probes: DataFrame) -> DataFrame:
    """How often each distinct probe (key) occurs in `keys` (key), 0 included."""
    counts = keys.groupBy("key").agg(F.count("*").alias("n"))
    return probes.select("key").distinct().join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def search_window(segments: DataFrame, asked: DataFrame) -> DataFrame:
    """`asked` (list_id, pos) with the model's value there and the bounds between which the posting lies."""
    from .decode import BLOCK, approximate

    blocks = F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("covered") - 1) / BLOCK)))
    joined = asked.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(segments.drop("residual").withColumn("block", blocks), ["list_id", "block"])
    inside = joined.where("pos >= first AND pos < first + covered")
    value = approximate(F.col("pos"), F.col("first"), F.col("intercept"), F.col("slope_exponent"), F.col("slope_significand"))
    return inside.select("list_id", "pos", value.alias("value"), (value - F.col("epsilon")).alias("low"), (value + F.col("epsilon") + 1).alias("high"))


def neighbours(postings: DataFrame, span: int = SPAN) -> DataFrame:
    """(list_id, doc_id, previous, following) of every distinct posting; a list of any length is spread over tasks."""
    rows = postings.select("list_id", "doc_id").distinct().withColumn("range", _range("doc_id", span))
    order = Window.partitionBy("list_id", "range").orderBy("doc_id")
    inner = rows.withColumns({"lag": F.lag("doc_id").over(order), "lead": F.lead("doc_id").over(order)})
    along = Window.partitionBy("list_id").orderBy("range")
    edges = rows.groupBy("list_id", "range").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    edges = edges.select("list_id", "range", F.lag("high").over(along).alias("below"), F.lead("low").over(along).alias("above"))
    return inner.join(edges, ["list_id", "range"]).select("list_id", "doc_id", F.coalesce("lag", "below").alias("previous"), F.coalesce("lead", "above").alias("following"))
