"""Toxicity by a counterfactually regularised classifier.

A logistic model over the presence of words, and over how many distinct longer words (1, 2, 3, 5)
begin with the same five letters, which catches inflected and compound insults. Each training text that mentions
identity terms is also read with a term swapped for each other one of its kind, and for a word that no feature knows;
where it has several terms of a kind, also with all of them swapped at once. All features of the swapped text are
derived anew, and the loss adds the mean squared change of the logit over a text's swaps, so that a neutral
mention of a group neither raises nor lowers the score. The vocabulary is chosen, and the model fitted, on a bounded
sample (`sampling.SAMPLE_ROWS` labelled rows, `VOCABULARY` features); every whole text is scored.

Null and empty texts have no words and get the score of the intercept. Without labels of both kinds
the score is the share of label 1, or 0 without any label. Rows without an id are scored and not learnt from, repeated rows are scored
each on its own, an empty table has no scores, and ties between features for the vocabulary go to the lesser word. Texts are
read in blocks, so a very long one needs memory for its distinct words only. Columns other than those asked for are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, pieces, raw_texts

VOCABULARY = 2048
#: Weight of the counterfactual term, of the squared weights, and steps of the fit.
COUNTERFACTUAL, RIDGE, STEPS = 20.0, 1e-5, 300
#: Least G2 statistic of a feature against the label.
LEAST_G2 = 15.0
# Identity terms by kind; fixed values. A term is swapped for the others of its kind.
IDENTITY = {
    "gender": ["woman", "women", "man", "men", "female", "male", "transgender", "frau", "frauen", "mann", "femme", "femmes", "homme", "mujer", "mujeres", "hombre"],
    "faith": ["muslim", "muslims", "christian", "christians", "jew", "jews", "jewish", "hindu", "buddhist", "atheist", "muslime", "christen", "juden", "musulman", "chrétien", "juif", "musulmán", "cristiano", "judío"],
    "origin": ["black", "white", "asian", "african", "american", "european", "arab", "mexican", "chinese", "immigrant", "immigrants", "refugee", "refugees"],
    "orientation": ["gay", "lesbian", "straight", "bisexual", "queer", "homosexual", "heterosexual"],
    "ability": ["deaf", "blind", "disabled", "autistic", "old", "young", "elderly"],
}
_WORD = re.compile(rb"[0-9a-z\x80-\xff']+")


#: Letters of a stem, and the counts of distinct words with it that are features.
STEM, COUNTS = 5, (1, 2, 3, 5)


def words_of(raw: bytes) -> set[bytes]:
    found: set[bytes] = set()
    for block in blocks(raw):
        found.update(_WORD.findall(block.lower()))
    return found


def derived(words: set[bytes]) -> set[bytes]:
    """The words, and `count^stem` for each stem that so many of the distinct longer words have."""
    stems = Counter([w.decode("utf-8", "ignore")[:STEM] for w in words if len(w) > STEM])
    return words.union([f"{n}^{stem}".encode() for stem, count in stems.items() for n in COUNTS if count >= n])


def features_of(raw: bytes) -> set[bytes]:
    return derived(words_of(raw))


#: What a term is swapped for besides the terms of its kind; no feature is made of it.
NOBODY = b""


def swaps_of(words: set[bytes], kinds: list[list[bytes]]) -> Iterator[set[bytes]]:
    """The words of a text with identity terms swapped: each for each other of its kind or `NOBODY`, and all of a kind at once."""
    for kind in kinds:
        own = words.intersection(kind)
        groups = [{term} for term in sorted(own)] + ([own] if len(own) > 1 else [])
        for gone in groups:
            for new in [*kind, NOBODY]:
                if new not in gone or len(gone) > 1:
                    yield words - gone | ({new} - {NOBODY})


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with_, without = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        words = list(with_.keys() | without.keys())
        columns = [pa.array(words, pa.binary()), pa.array([without[w] for w in words], pa.int64()), pa.array([with_[w] for w in words], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["word", "n0", "n1"])

    for batch in pieces(batches, "text"):
        for y, raw in zip(batch.column("y").to_pylist(), raw_texts(batch.column("text"))):
            (with_ if y else without).update(features_of(raw))
        if len(with_) + len(without) > 300_000:
            yield flush()
            with_.clear(), without.clear()
    yield flush()


def encoded(raw: bytes, numbers: dict[bytes, int], kinds: list[list[bytes]]) -> tuple[list[int], list[list[int]]]:
    """A text's features, and for each of its swaps the features gained (as number + 1) and lost (as its negative)."""
    get, words = numbers.get, words_of(raw)
    own = {i for i in map(get, derived(words)) if i is not None}
    changes = []
    for swapped in swaps_of(words, kinds):
        new = {i for i in map(get, derived(swapped)) if i is not None}
        changes.append([i + 1 for i in sorted(new - own)] + [-i - 1 for i in sorted(own - new)])
    return sorted(own), changes


def _features(numbers: dict[bytes, int], kinds: list[list[bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [encoded(raw, numbers, kinds) for raw in raw_texts(batch.column("text"))]
            lists = [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *lists], ["doc_id", "y", "found", "swaps"])

    return run


class Model:
    def __init__(self, weights: dict[bytes, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def scores(self, raws: list[bytes]) -> np.ndarray:
        get = self.weights.get
        logit = np.array([self.intercept + sum(w for w in map(get, features_of(raw)) if w is not None) for raw in raws])
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows], np.int64)
    return np.repeat(np.arange(len(rows)), lengths), np.concatenate([np.zeros(0, np.int64), *(np.asarray(r, np.int64) for r in rows)])


def fit_rows(rows: list[list[int]], swaps: list[list[list[int]]], y: np.ndarray, size: int, counterfactual: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and intercept: Adam on the logistic loss, ridge and the counterfactual term.

    `rows` and `swaps` are as `encoded` gives them. A swap changes the logit by the weights of the features gained less
    those of the features lost; the term is the mean square over a text's swaps, averaged over texts.
    """
    at, feature = _flat(rows)
    share: Counter = Counter()
    for own in swaps:
        for change in own:
            share[tuple(change)] += 1 / (len(own) * len(rows))
    share.pop((), None)
    change, part = _flat(list(map(list, share)))
    sign, part, weight = np.sign(part).astype(float), np.abs(part) - 1, np.array(list(share.values()))
    weights, intercept = np.zeros(size), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        logit = intercept + np.bincount(at, weights[feature], len(rows))
        error = 1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y
        slope = np.append(np.bincount(feature, error[at], size) / len(rows) + RIDGE * weights, error.mean())
        moved = 2 * counterfactual * weight * np.bincount(change, sign * weights[part], len(weight))
        slope[:-1] += np.bincount(part, sign * moved[change], size)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = 0.15 * 0.99**step * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights, intercept = weights - move[:-1], intercept - move[-1]
    return weights, float(intercept)


def fit(sampled: DataFrame, vocabulary: int = VOCABULARY) -> Model:
    """The model of a sample with columns doc_id, y, text; what comes to the driver is bounded by the sample's rows and `vocabulary`."""
    totals = dict(sampled.groupBy("y").count().collect())
    no, yes = totals.get(0, 0), totals.get(1, 0)
    if not no or not yes:
        return Model({}, 50.0 if yes else -50.0)
    counted = sampled.mapInArrow(_counts, "word binary, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    term = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    whole = float(no + yes)
    parts = [term(a), term(b), term(yes - a), term(no - b), -term(a + b), -term(whole - a - b)]
    fixed = sum(sign * n * np.log(n) for sign, n in ((-1, yes), (-1, no), (1, whole)))
    g2 = 2 * (sum(parts[1:], parts[0]) + float(fixed))
    ranked = counted.where("n0 + n1 >= 3").withColumn("g2", g2).where(F.col("g2") >= LEAST_G2)
    chosen = [bytes(r.word) for r in ranked.orderBy(F.round("g2", 9).desc(), "word").limit(vocabulary).collect()]
    terms = [[t.encode() for t in kind] for kind in IDENTITY.values()]
    numbers = {w: i for i, w in enumerate(dict.fromkeys([*chosen, *(t for kind in terms for t in kind)]))}
    kind = sampled.schema["doc_id"].dataType.simpleString()
    rows = sampled.mapInArrow(_features(numbers, terms), f"doc_id {kind}, y int, found array<int>, swaps array<array<int>>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.found))
    weights, intercept = fit_rows([r.found for r in rows], [r.swaps for r in rows], np.array([r.y for r in rows], float), len(numbers))
    return Model({w: float(weights[i]) for w, i in numbers.items()}, intercept)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns `keep` and score (0 to 1, higher: toxic likelier); a narrow map over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = shared.value.scores(raw_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found)], [*names, "score"])

    out = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(text).alias("text")).mapInArrow(run, f"{kinds}, score double")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "score")
