"""Language identification by bit-sliced Bloom filters of n-grams.

The filters of all languages lie side by side: position p holds one bit for each language, so that
the AND over a gram's positions is the bitmask of the languages that have it. A text's grams are
looked up at once; the set bits are counted for each language and corrected for that filter's rate
of false positives, (hits - n f) / (1 - f); the largest corrected count decides, ties to the smaller name.

A language has a gram if the share of its training texts with it is at least `SHARE` times the
greatest share over the languages, among its `GRAMS` most widespread. Training takes at most
`SAMPLE_ROWS` labelled rows of each language (those with the least hash of their id); grams of a single row count
only for languages of fewer than `FEW` rows. Every whole text is judged.

The contracted choices that bound the model, not the data judged, are `SAMPLE_ROWS`, `GRAMS` and `SHARE`.

A null text, or one without a letter, is `und` with score 0, as are all if nothing could be learned. A
text whose grams are in no filter has score 0 and the first language. Repeated rows are judged each on its own, and an id
that repeats in one language is learnt from once (its text of least hash); rows without an id are judged and not learnt from.
Texts are read in blocks, so a very long one needs no more memory than a short one. An empty table has no rows. Other columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, pieces

SAMPLE_ROWS, GRAMS, SHARE, SIZE, HASHES = 8192, 20_000, 0.4, 18, 3
FEW = 20
#: Letters of a text that are read at once.
BLOCK = 1 << 17
_OTHER = re.compile(r"[\W\d_]+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def gram_blocks(text: str, size: int = BLOCK) -> Iterator[np.ndarray]:
    """Three-letter windows over lower-cased words set apart by single spaces, as exact 63-bit numbers, some `size` letters at once."""
    last, at = np.array([32], np.uint64), 0
    while at < len(text):
        end = at + size
        if end < len(text):
            end = text.rfind(" ", at, end) + 1 or end
        line = _OTHER.sub(" ", text[at:end].lower())
        if last[-1] == 32:
            line = line.lstrip(" ")
        at = end
        if at >= len(text) and line[-1:] != " " and (line or last[-1] != 32):
            line += " "
        codes = np.concatenate([last, np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)])
        if len(codes) > 2:
            yield codes[:-2] | codes[1:-1] << np.uint64(21) | codes[2:] << np.uint64(42)
        last = codes[-2:]


def grams(text: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *gram_blocks(text)])


def distinct_grams(text: str) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, gram_blocks(text))]))


class Filters:
    def __init__(self, languages: list[str], known: dict[str, np.ndarray]):
        self.languages = languages
        self.planes = np.zeros((max(1, -(-len(languages) // 64)), 1 << SIZE), np.uint64)
        self.false = np.zeros(len(languages))
        for i, name in enumerate(languages):
            plane, bit = self.planes[i // 64], np.uint64(1 << i % 64)
            for at in self._places(known[name]):
                plane[at] |= bit
            self.false[i] = ((plane & bit) > 0).mean() ** HASHES

    @staticmethod
    def _places(values: np.ndarray) -> list[np.ndarray]:
        mixed = values ^ (values >> np.uint64(23))
        return [(mixed * f >> np.uint64(64 - SIZE)).astype(np.int64) for f in _FACTORS]

    def judge(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        hits, n = np.zeros(len(self.languages)), 0
        for found in gram_blocks(text):
            places = self._places(found)
            n += len(found)
            for p, plane in enumerate(self.planes):
                masks = plane[places[0]] & plane[places[1]] & plane[places[2]]
                for i in range(64 * p, min(len(self.languages), 64 * p + 64)):
                    hits[i] += np.count_nonzero(masks & np.uint64(1 << i % 64))
        hits = np.maximum(0, (hits - n * self.false) / np.maximum(1e-9, 1 - self.false))
        best = int(hits.argmax())
        return self.languages[best], float(hits[best] / hits.sum()) if hits.sum() > 0 else 0.0


def fit(docs: DataFrame, trains: Column, rows: int = SAMPLE_ROWS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Filters:
    known = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & trains)
    ids = known.select(F.col(key).alias("key"), F.col(lang).alias("lang")).distinct().withColumn("_order", F.shiftrightunsigned(F.xxhash64("key", "lang"), 32))
    # a large language is thinned to about half as many again before its rows are ordered
    thin = ids.join(F.broadcast(ids.groupBy("lang").agg(F.count("*").alias("n"))), "lang").where((F.col("n") <= 2 * rows) | (F.col("_order") < 1.5 * rows / F.col("n") * 2**32))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_order", "key"))
    chosen = checkpoint(thin.withColumn("place", place).where(F.col("place") <= rows).select("key", "lang"))
    texts = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(chosen), ["key", "lang"])
    texts = texts.groupBy("key", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [distinct_grams(t) for t in batch.column("text").to_pylist() if t] or [np.zeros(0, np.uint64)]
            names = [n for n, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()) if t] or [""]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(at)), pa.array(np.concatenate(found).view(np.int64))], ["lang", "gram"])

    counted = texts.mapInArrow(run, "lang string, gram long").groupBy("lang", "gram").count()
    totals = F.broadcast(texts.groupBy("lang").agg(F.count("*").alias("n")))
    counted = checkpoint(counted.join(totals, "lang").where((F.col("count") >= 2) | (F.col("n") < FEW)))
    rates = counted.withColumn("rate", F.col("count") / F.col("n"))
    rates = rates.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= SHARE * F.col("most"))
    ranked = rates.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "gram"))).where(F.col("place") <= GRAMS)
    kept: dict[str, list[int]] = {}
    for name, gram in ranked.select("lang", "gram").toLocalIterator():
        kept.setdefault(name, []).append(gram)
    return Filters(sorted(kept), {k: np.array(v, np.int64).view(np.uint64) for k, v in kept.items()})


def predict(docs: DataFrame, filters: Filters, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every whole text; a narrow map."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [shared.value.judge(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["key", "lang_pred", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
