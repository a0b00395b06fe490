"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are runs of [0-9a-z] and non-ASCII characters after A-Z is lower-cased. Each benchmark item
gives its windows of `width` words (one window of all its words if it has fewer). The driver packs
the distinct windows into slices of bounded size, each broadcast: a vocabulary, sorted 64-bit
polynomial hashes, the windows' word ids and the items of each window. Workers number the words of
many documents at once by that vocabulary (a word that no item has is -1 and breaks every window),
roll the hash over what is left, look it up and compare the words themselves, so a hash collision
never counts. Documents are read once for each group of slices; nothing is shuffled. The driver reads the benchmark as a
stream and holds one group of slices.

Null and empty texts have no words and no hits; items without words hit nothing; items that share
an id are one item, and an item with a null id hits but is not listed. Repeated rows are judged each
on its own. The item order of equal windows does not matter: ids are listed once, sorted as strings. Empty tables give
no rows or no hits. A very long text takes some times its own size in a worker. Columns of `keep` may have any names; others are dropped.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, raw_texts, stored

WIDTH = 10
#: Benchmark words in one broadcast slice (some 100 MB unpacked at most), and slices in one pass over the documents.
SLICE_WORDS, PASS_SLICES = 500_000, 8
_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def word_spans(raw: bytes) -> np.ndarray:
    """Byte offsets (begin, end) of the words, one row each."""
    inside = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return edges.reshape(-1, 2)


def roll(ids: np.ndarray, at: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
    """Polynomial hashes of the windows of `width` ids that begin at `at`."""
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        out = out * factor + ids[at + j].astype(np.uint64) + np.uint64(1)
    return out


class WindowSet:
    """Distinct windows of some items, by their length."""

    def __init__(self, rows: list[tuple[str | None, list[bytes]]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        found: dict[int, dict[bytes, set]] = defaultdict(lambda: defaultdict(set))
        for item, words in rows:
            ids = np.array([number(w, len(self.vocabulary)) for w in words], np.int32)
            size = min(width, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found[size][ids[i : i + size].tobytes()].add(item)
        self.tables = {}
        for size, windows in found.items():
            keys = np.frombuffer(b"".join(windows), np.int32).reshape(-1, size)
            items = list(windows.values())
            factor = np.uint64(0x9E3779B97F4A7C15)
            while True:
                hashes = roll(keys.ravel(), np.arange(len(keys)) * size, size, factor)
                if len(np.unique(hashes)) == len(hashes):
                    break
                factor += np.uint64(2)  # distinct windows collide: another factor
            order = np.argsort(hashes)
            self.tables[size] = factor, hashes[order], keys[order], [items[i] for i in order]

    def scan(self, ids: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """(position, length, items) of every occurrence; -1 in `ids` matches nothing."""
        gaps = np.concatenate([[0], np.cumsum(ids < 0)])
        for size, (factor, hashes, keys, items) in self.tables.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(gaps[size:] == gaps[:-size])
            hashed = roll(ids, at, size, factor)
            slot = np.minimum(np.searchsorted(hashes, hashed), len(hashes) - 1)
            hit = hashes[slot] == hashed
            at, slot = at[hit], slot[hit]
            if len(at):
                same = (ids[at[:, None] + np.arange(size)] == keys[slot]).all(1)
                for p, s in zip(at[same].tolist(), slot[same].tolist()):
                    yield p, size, items[s]


def slices(benchmark: DataFrame, width: int, item: str = "item_id", text: str = "text") -> Iterator[WindowSet]:
    """Reads the benchmark partition by partition and packs it into sets of bounded size."""
    rows, held = [], 0
    step = max(1, SLICE_WORDS - width)
    for name, raw in benchmark.select(F.col(item).cast("string"), F.col(text).cast("binary")).toLocalIterator():
        words = words_of(bytes(raw or b""))
        for begin in range(0, max(1, len(words) - width + 1), step):  # pieces of a huge item overlap by a window less a word
            part = words[begin : begin + step + width - 1]
            rows.append((name, part))
            held += len(part)
            if held >= SLICE_WORDS:
                yield WindowSet(rows, width)
                rows, held = [], 0
    if rows:
        yield WindowSet(rows, width)


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep: Iterable[str] = ("doc_id",), item: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """Columns `keep` and n_words, n_hit, items (array of item ids as strings), clean (the text without its hit words)."""
    spark = docs.sparkSession
    keep = list(keep)
    names = [f"k{i}" for i in range(len(keep))]
    frame = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(text).alias("text"), F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names))
    group: list = []
    for one in slices(benchmark, width, item, item_text):
        if len(group) == PASS_SLICES:  # what this pass found is stored before the next slices are read
            frame = stored(frame.mapInArrow(_pass(group, names, False), f"{kinds}, text string, hits binary, items array<string>"))
            for shared in group:
                shared.destroy()
            group = []
        group.append(spark.sparkContext.broadcast(one))
    done = frame.mapInArrow(_pass(group, names, True), f"{kinds}, n_words long, n_hit long, items array<string>, clean string")
    return done.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_words", "n_hit", "items", "clean")


def _pass(group: list, names: list[str], last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            raws = raw_texts(batch.column("text"))
            counts = [0] * len(raws)
            spans = [np.frombuffer(x or b"", np.int32).reshape(-1, 2).tolist() for x in batch.column("hits").to_pylist()]
            items = [set(x or ()) for x in batch.column("items").to_pylist()]
            for share in group or [None]:
                parts, get = [], share.value.vocabulary.get if share else {}.get
                for i, raw in enumerate(raws):
                    words = words_of(raw)
                    counts[i] = len(words)
                    if share:
                        parts += np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)), np.array([-1], np.int32)
                if parts:
                    starts = np.concatenate([[0], np.cumsum([c + 1 for c in counts])])
                    for at, size, who in share.value.scan(np.concatenate(parts)):
                        i = int(np.searchsorted(starts, at, "right")) - 1
                        begin = at - int(starts[i])
                        if spans[i] and spans[i][-1][0] <= begin <= spans[i][-1][1]:
                            spans[i][-1][1] = max(spans[i][-1][1], begin + size)
                        else:
                            spans[i].append([begin, begin + size])
                        items[i] |= who
                if share and len(group) > 1:
                    del share._value  # one slice is held at a time; the next use reads it from the executor's disk
            kept = [batch.column(n) for n in names]
            listed = pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string()))
            if not last:
                packed = pa.array([np.array(x, np.int32).tobytes() for x in spans], pa.binary())
                yield pa.RecordBatch.from_arrays([*kept, batch.column("text"), packed, listed], [*names, "text", "hits", "items"])
                continue
            hit, clean = [], []
            for raw, count, own, whole in zip(raws, counts, spans, batch.column("text")):
                marks = np.zeros(count, bool)
                for a, b in own:
                    marks[a:b] = True
                hit.append(int(marks.sum()))
                clean.append(without(raw, marks) if hit[-1] else whole.as_py())
            columns = [pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), listed, pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*names, "n_words", "n_hit", "items", "clean"])

    return run


def without(raw: bytes, marks: np.ndarray) -> str:
    """The text without the marked words; what stands between them stays."""
    gone = np.zeros(len(raw) + 1, np.int32)
    spans = word_spans(raw)[marks]
    np.add.at(gone, spans[:, 0], 1)
    np.add.at(gone, spans[:, 1], -1)
    return np.frombuffer(raw, np.uint8)[np.cumsum(gone)[:-1] == 0].tobytes().decode("utf-8", "replace")
