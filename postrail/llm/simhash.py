"""SimHash near-duplicates with a Gray-order hierarchical index.

Each document gets a 64-bit SimHash of its word shingles. Equal fingerprints are one class before
anything else, so copies cost nothing further. Two classes link if at most `distance` bits differ.
The bits are cut into distance + keep bands, of which any linked pair agrees on at least `keep`; each
choice of `keep` bands deals the fingerprints out by those bits (`keep` follows from their number,
so that a bucket stays small at any scale). Within a bucket the fingerprints are sorted by Gray rank,
and runs of them are joined under nodes that hold the bits on which all members agree, each node only
those that its parent lacks. A search goes down from the root, adds up the differing bits and drops
a node, and so its whole group, once they pass `distance`. It also drops groups that are already one component with
the searching fingerprint, so a dense group of near copies costs about its size and not its square.
A bucket gives a star of links for each component, never all pairs; the stars are then contracted to
components over the cluster.

A null or blank text has the fingerprint zero and links like any other. Repeated rows fall in one
class. A null id never becomes a component's id unless the component has no other. Of rows that share the least id the one
whose text has the least hash stands for the component. Texts are read in blocks, so a very long one takes its own size and little
more. An empty table has no rows. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, checkpoint, pieces, raw_texts
from .components import components

SEED = 42
FAN = 16
#: The mean number of fingerprints in a bucket that more bands are kept for.
BUCKET = 2048
#: Parts that the members of components are dealt to, so that a very large one is met in several tasks.
SALTS = 32
#: A class with more than one row in so many is met by broadcast, the others by their fingerprints.
HOT = 1000
#: Leaves that one block of searches may meet at most, unless a single search meets more.
BLOCK = 4 << 20


def fingerprint(raw: bytes, width: int = 4, size: int = BLOCK_BYTES) -> int:
    """SimHash of the word shingles of UTF-8 text, as a signed 64-bit number; the text is read in blocks of `size` bytes."""
    digest = xxhash.xxh64_intdigest
    ones, n, words = np.zeros(64, np.int64), 0, []
    for block in blocks(raw, size):
        words += block.lower().split()  # bytes: A-Z only, and the six ASCII spaces
        if len(words) < width:
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = np.concatenate([[0], ends[: len(words) - width]]).tolist()
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(begins, (ends[width - 1 :] - 1).tolist())], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(hashes)
        words = words[len(words) - width + 1 :]  # the next block's first shingles begin with these
    if not n and words:
        ones, n = np.unpackbits(np.array([digest(b" ".join(words), SEED)], np.uint64).view(np.uint8)).astype(np.int64), 1
    return int(np.packbits(2 * ones > n).view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, body, fp): body tells apart texts that share an id. A narrow map over whole texts."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = pa.array([fingerprint(x, width) for x in raw_texts(batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("body"), found], ["key", "body", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, body long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Forest:
    """For each bucket, a tree over its fingerprints in Gray order; see the module's description.

    `bucket` numbers the buckets from 0, without gaps; `codes` are distinct within one.
    """

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), bucket))
        self.bucket, self.codes = bucket[order], codes[order]
        n = len(codes)
        first = np.searchsorted(self.bucket, np.arange(self.bucket[-1] + 1))
        self.sizes = np.diff(np.append(first, n))
        place = np.arange(n) - first[self.bucket]
        full = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.levels = [(np.arange(n), full, self.codes)]  # leaf where a node begins, its mask, its pattern
        span = 1
        while len(self.levels[-1][0]) > len(first):
            span *= FAN
            begins = np.flatnonzero(place % span == 0)
            ones, any_ = np.bitwise_and.reduceat(self.codes, begins), np.bitwise_or.reduceat(self.codes, begins)
            self.levels.append((begins, ~(ones ^ any_), ones))
        self.kids, self.rest = [], []
        for low, high in zip(self.levels, self.levels[1:]):
            kids = np.append(np.searchsorted(low[0], high[0]), len(low[0]))
            parent = np.repeat(np.arange(len(high[0])), np.diff(kids))
            self.kids.append(kids)
            self.rest.append(low[1] & ~high[1][parent])  # only what the parent does not hold
        self.label = np.arange(n)

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            low = np.minimum(x, y)
            np.minimum.at(self.label, np.concatenate([x, y]), np.concatenate([low, low]))
            while not np.array_equal(jump := self.label[self.label], self.label):
                self.label = jump
            apart = self.label[a] != self.label[b]
            a, b = a[apart], b[apart]

    def _uniform(self) -> list[np.ndarray]:
        """For each node of each level the component that all its leaves are in, or -1."""
        out = [self.label]
        for begins, _, _ in self.levels[1:]:
            low, high = np.minimum.reduceat(self.label, begins), np.maximum.reduceat(self.label, begins)
            out.append(np.where(low == high, low, -1))
        return out

    def _search(self, asks: np.ndarray, distance: int, whole: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (asking leaf, later leaf) within the distance that are not known to be one component."""
        node, met = self.bucket[asks], np.zeros(len(asks), np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            kids = self.kids[level - 1]
            count = kids[node + 1] - kids[node]
            total = int(count.sum())
            if not total:
                return asks[:0], asks[:0]
            asks, met = np.repeat(asks, count), np.repeat(met, count)
            node = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(kids[node], count)
            begins, _, pattern = self.levels[level - 1]
            last = np.append(begins, len(self.codes))[node + 1] - 1
            keep = (last > asks) & (whole[level - 1][node] != self.label[asks])
            asks, met, node = asks[keep], met[keep], node[keep]
            met = met + np.bitwise_count((self.codes[asks] ^ pattern[node]) & self.rest[level - 1][node])
            keep = met <= distance
            asks, met, node = asks[keep], met[keep], node[keep]
        return asks, node

    def link(self, distance: int) -> np.ndarray:
        """The component of each leaf, as its least leaf."""
        a = np.flatnonzero(self.bucket[1:] == self.bucket[:-1])
        near = np.bitwise_count(self.codes[a] ^ self.codes[a + 1]) <= distance
        self._join(a[near], a[near] + 1)
        cost = np.cumsum(self.sizes[self.bucket])
        at, n = 0, len(self.codes)
        whole = self._uniform()
        while at < n:
            upto = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + BLOCK)))
            a, b = self._search(np.arange(at, upto), distance, whole)
            if len(a):
                self._join(a, b)
                whole = self._uniform()
            at = upto
        return self.label


def _links(distance: int):
    def stars(bucket: np.ndarray, codes: np.ndarray) -> pa.RecordBatch | None:
        """Edges from each fingerprint to the least leaf of its component in its bucket."""
        often = np.bincount(bucket)[bucket] > 1
        bucket, codes = bucket[often], codes[often]
        if not len(codes):
            return None
        forest = Forest(np.unique(bucket, return_inverse=True)[1], codes)
        label = forest.link(distance)
        own = np.flatnonzero(label != np.arange(len(label)))
        a, b = forest.codes[own].view(np.int64), forest.codes[label[own]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(own) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:  # sorted by choice of bands and their bits, so a bucket's rows are together
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "bits", "fp")]))
            rows += batch.num_rows
            if rows < 200_000:
                continue
            whole = np.concatenate(held, 1)
            new = np.flatnonzero((whole[:2, 1:] != whole[:2, :-1]).any(0)) + 1
            if len(new):
                done, held = whole[:, : new[-1]], [whole[:, new[-1] :]]
                if (out := stars(*_numbered(done))) is not None:
                    yield out
            else:
                held = [whole]
            rows = held[0].shape[1]
        if held and (out := stars(*_numbered(np.concatenate(held, 1)))) is not None:
            yield out

    return run


def _numbered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = (rows[:2, 1:] != rows[:2, :-1]).any(0)
    return np.concatenate([[0], np.cumsum(new)]), rows[2].view(np.uint64) if rows[2].flags.c_contiguous else rows[2].copy().view(np.uint64)


def choices(distance: int, keep: int) -> list[int]:
    """Masks, as signed numbers, of `keep` out of distance + keep bands of the 64 bits."""
    edges = [round(i * 64 / (distance + keep)) for i in range(distance + keep + 1)]
    bands = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(bands, keep)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(classes: DataFrame, distance: int = 4) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in column fp: the same components as all links have."""
    n = classes.count()
    keep = 1
    while keep < 4 and n > BUCKET << (64 * keep // (distance + keep)):
        keep += 1
    dealt = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(choices(distance, keep))]))
    rows = classes.select(dealt.alias("x"), "fp").select("x.choice", "x.bits", "fp").repartition("choice", "bits").sortWithinPartitions("choice", "bits")
    return rows.mapInArrow(_links(distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, body, fp, component_id, keeper): one row for each row of `docs`.

    component_id is the least key that can be reached over links, itself included; keeper is the
    (key, body) of the row that stands for the component.
    """
    rows = checkpoint(fingerprints(docs, width, text, key))
    classes = checkpoint(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.min(F.struct(F.col("key").isNull(), "key", "body")).alias("keeper")))
    linked = classes.join(components(links(classes, distance)), F.col("fp") == F.col("node")).select("fp", "least", "keeper", "root")
    linked = checkpoint(linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS))))
    heads = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.min("keeper").alias("head"))
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    far = linked.join(heads, ["root", "salt"]).select("fp", "component_id", "head")
    known = checkpoint(classes.join(far, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("head", "keeper").alias("keeper")))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(known.where(F.col("n") * HOT > total))  # fewer than HOT classes can have so large a share
    few = rows.join(F.broadcast(known.where(F.col("n") * HOT > total).select("fp")), "fp", "left_anti").join(known, "fp")
    return rows.join(hot, "fp").unionByName(few).select(F.col("key").alias(key), "body", "fp", "component_id", F.struct("keeper.key", "keeper.body").alias("keeper"))
