"""Links between texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

MinHash proposes and the whole sets decide. Each distinct text has `BANDS` keys of `ROWS` least hashes; texts
with an equal key lie together in one global sort, the likelier ones (by two more least hashes) closer, and
each is proposed with the `NEAR` next ones of its key. So a key that many texts share costs in proportion to
them and lies in as many tasks as it fills. Where the texts of a larger key are not one component after that, the rest is
looked at in tiles of `TILE` by `TILE` texts: those of different components are compared by bounds that no similar pair
fails (sizes, and differing bits of a sketch), then by their whole sets, and a tile gives one link for two components. Thus all texts with an
equal key are linked as all their pairs would link them. A pair at similarity 0.8 shares a key
with probability 1 - (1 - 0.8^ROWS)^BANDS = 0.9998. Shingles are compared by 64-bit hashes.

A text with fewer words than a shingle is one shingle. A null or blank text has none, and is a copy of any other such text.
Repeated rows and copies are one text. Empty tables have no links. Of rows with the least key the one whose text has the least hash is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import checkpoint, pieces, raw_texts
from .components import components

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS, NEAR = 16, 4, 4
#: Texts in a block of a crowded key, words of 64 bits in a sketch, and tasks that a key's texts are dealt to at least.
TILE, SKETCH, SALTS = 1024, 16, 16
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX
    return (x ^ x >> np.uint64(29)) * _MIX


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the word shingles of UTF-8 text, in order."""
    words = raw.lower().split()  # words as in the fingerprints
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    found = np.full(n, width, np.uint64)
    for j in range(width):
        found = _mixed(found ^ own[j : j + n])
    return np.unique(found)


def keys(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each band its key, and the order among the texts of that key."""
    least = np.array([(found * f).min() for f in _FACTORS], np.uint64).reshape(BANDS, ROWS)
    bits = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        bits = _mixed(bits ^ least[:, j])
    high = least[:, 0] >> np.uint64(33)
    return bits, np.roll(high, -1) << np.uint64(32) | np.roll(high, -2)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        found = [shingles(x) for x in raw_texts(batch.column("text"))]
        some = [i for i, x in enumerate(found) if len(x)]
        if not some:
            continue
        both = [keys(found[i]) for i in some]
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate([b[k] for b in both]).view(np.int64))) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("body").take(pa.array(some)), *lists], ["body", "bits", "place"])


def _proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros((2, 0), np.int64)
    for batch in batches:  # sorted by key and place
        rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("bits", "body")])], 1)
        pairs = [np.zeros((2, 0), np.int64)]
        for d in range(1, NEAR + 1):
            a = np.flatnonzero(rows[0, d:] == rows[0, :-d])
            pairs.append(np.stack([rows[1, a], rows[1, a + d]]))
        low, high = np.sort(np.concatenate(pairs, 1), 0)
        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["x", "y"])
        held = rows[:, -NEAR:]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        found = [shingles(x).view(np.int64) for x in raw_texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("body"), pa.array(found, pa.list_(pa.int64()))], ["body", "found"])


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of sets: two sets differ in as many elements at least as their bitmaps in bits."""
    out = np.zeros((len(sets), SKETCH), np.uint64)
    for row, found in zip(out, sets):
        at = _mixed(found.view(np.uint64)) >> np.uint64(32)
        np.bitwise_or.at(row, (at >> np.uint64(6)) % np.uint64(SKETCH), np.uint64(1) << (at & np.uint64(63)))
    return out


def _joined(first: np.ndarray, bodies: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A link for each two components of a tile that have similar texts; `first` marks the texts of the first of its two blocks."""
    label = np.unique(roots, return_inverse=True)[1]
    sizes, sketches, out = np.array([len(x) for x in sets]), _sketches(sets), []
    both = bool(first.all())  # a block with itself
    for i in np.flatnonzero(first).tolist():
        far = (sizes + sizes[i]) * (1 - similarity) / (1 + similarity)
        able = (label != label[i]) & (np.arange(len(label)) > i if both else ~first) & (np.abs(sizes - sizes[i]) <= far)
        at = np.flatnonzero(able)
        at = at[np.bitwise_count(sketches[at] ^ sketches[i]).sum(1) <= far[at]]
        for j in at.tolist():
            if label[i] != label[j]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= similarity * (sizes[i] + sizes[j] - common):
                    out.append(tuple(sorted((int(bodies[i]), int(bodies[j])))))
                    label[label == label[j]] = label[i]
    return out


def _tiles(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[dict]) -> pa.RecordBatch:
            first = np.array([r["own"] == r["low"] for r in rows])
            links = _joined(first, np.array([r["body"] for r in rows]), np.array([r["root"] for r in rows]), [np.asarray(r["found"], np.int64) for r in rows], similarity)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["x", "y"])

        held: list[dict] = []
        for batch in batches:  # sorted by key and tile
            for r in batch.to_pylist():
                if held and any(r[c] != held[-1][c] for c in ("bits", "low", "high")):
                    yield done(held)
                    held = []
                held.append(r)
        if held:
            yield done(held)

    return run


def _decided(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The proposed pairs that are similar enough."""
    sets = checkpoint(_sets_of(rows, pairs.select(F.col("x").alias("body")).union(pairs.select(F.col("y").alias("body")))))
    met = pairs.join(sets.select(F.col("body").alias("x"), F.col("found").alias("fx")), "x").join(sets.select(F.col("body").alias("y"), F.col("found").alias("fy")), "y")
    common = F.size(F.array_intersect("fx", "fy"))
    return met.where(common >= similarity * (F.size("fx") + F.size("fy") - common)).select("x", "y")


def _sets_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
    texts = rows.groupBy("body").agg(F.first("text").alias("text"))  # copies are one before they are sent
    return texts.join(asked.distinct(), "body", "left_semi").mapInArrow(_sets, "body long, found array<long>")


def _rest(rows: DataFrame, dealt: DataFrame, found: DataFrame, similarity: float) -> DataFrame | None:
    """Links between texts of a crowded key that `found` (node, root) does not have in one component."""
    members = checkpoint(dealt.select("bits", "body").join(found, F.col("body") == F.col("node"), "left").select("bits", "body", F.coalesce("root", "body").alias("root")))
    crowded = members.groupBy("bits").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where((F.col("n") > NEAR + 1) & (F.col("a") < F.col("b")))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    crowded = crowded.select("bits", F.ceil(F.col("n") / TILE).alias("blocks"), salts.alias("salt"))
    own = members.withColumn("salt", F.pmod(F.xxhash64("body"), F.lit(SALTS))).join(crowded, ["bits", "salt"]).drop("salt")
    own = checkpoint(own.withColumn("own", F.pmod(F.xxhash64("body", "bits"), F.col("blocks"))))
    if own.isEmpty():
        return None
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.select("bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "body", "root")
    tiles = each.join(checkpoint(_sets_of(rows, own.select("body"))), "body").repartition("bits", "low", "high").sortWithinPartitions("bits", "low", "high", "body")
    return tiles.mapInArrow(_tiles(similarity), "x long, y long")


def links(docs: DataFrame, more: DataFrame | None = None, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Distinct (x, y), x < y: hashes (xxhash64) of two texts that are similar enough, with the components that all such pairs of an equal key have.

    `more` (x, y) proposes further pairs.
    """
    rows = docs.select(F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    signed = rows.mapInArrow(_signed, "body long, bits array<long>, place array<long>")
    signed = signed.groupBy("body").agg(F.first("bits").alias("bits"), F.first("place").alias("place"))
    dealt = checkpoint(signed.select("body", F.explode(F.arrays_zip("bits", "place")).alias("k")).select("k.bits", "k.place", "body"))
    order = ("bits", "place", "body")
    pairs = dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_proposed, "x long, y long")
    if more is not None:
        pairs = pairs.union(more.select(F.least("x", "y"), F.greatest("x", "y")))
    near = checkpoint(_decided(checkpoint(pairs.distinct()), rows, similarity))
    rest = _rest(rows, dealt, components(near.select(F.col("x").alias("a"), F.col("y").alias("b"))), similarity)
    return near if rest is None else near.union(rest).distinct()


def keepers(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, body) of the row with the least key (null last) of each component of linked texts.

    SimHash neighbours (equal fingerprints and the index's stars) are proposed besides the MinHash ones.
    """
    rows = simhash.fingerprints(docs, text=text, key=key)
    bodies = checkpoint(rows.groupBy("body").agg(F.first("fp").alias("fp"), F.min(F.struct(F.col("key").isNull(), "key", "body")).alias("keeper")))
    classes = checkpoint(bodies.groupBy("fp").agg(F.min("body").alias("head")))
    equal = bodies.join(classes, "fp").where("body <> head").select(F.col("body").alias("x"), F.col("head").alias("y"))
    ends = [classes.select(F.col("fp").alias(f), F.col("head").alias(c)) for f, c in (("a", "x"), ("b", "y"))]
    near = simhash.links(classes).join(ends[0], "a").join(ends[1], "b").select("x", "y")
    found = components(links(docs, equal.union(near), text).select(F.col("x").alias("a"), F.col("y").alias("b")))
    rooted = bodies.join(found, bodies.body == found.node, "left").select(F.coalesce("root", "body").alias("root"), "keeper")
    return rooted.groupBy("root").agg(F.min("keeper").alias("keeper")).select("keeper.key", "keeper.body")
