"""Substring dedup with sharded automata of repeated phrases.

A window is `width` consecutive words of one document. A word goes if a window over it also starts in
a document with a smaller id. The work is done in steps that each stay linear in the input:

1. Anchors. Every document is winnowed: of the 8-word shingles inside a window the one with the least
   hash is its anchor, so equal windows have equal anchors, and only one position in twenty is an
   anchor. A bucket of documents keeps those of its anchors that two or more ids have.
2. Confirmation. A bucket's windows with a kept anchor are hashed twice, and pre-aggregated to a row for each
   window: its least document and place, and its greatest id. Windows of equal pairs of hashes (128 bits) are laid
   together; the least document of all owns the window, and each bucket with a greater id asks for it.
3. Passages. What is asked for is a stretch of its owner's words, `PIECE_WINDOWS` windows at most. A bucket asks for
   a stretch only if a window of it occurs there, so pieces that merely lie near a hot passage go nowhere else.
4. Automata. Each bucket gets the stretches it asked for. Their cores, of which every window holds one, are
   compiled to Aho-Corasick automata, in shards of bounded size, whose letters are words. Every document of the
   bucket is streamed through them; each hit is compared word by word along its diagonal, and runs of at
   least a window are removed. Hashes thus only propose; words decide.

A bucket is some MB of text chosen by hash of id and text, so a hot passage costs each bucket one copy, and rows that
share an id are spread. A bucket is held by one task, and so is a text of any length.
Ids are whole numbers. Null texts have no words; rows with a null id are kept whole, take nothing from others and are
in no bucket. Rows that share an id never take from each other; repeated rows get equal results. Empty tables give no
rows. There are no ties: of equal windows that of the least id, text and place is the owner's. Other columns than those
of `keep` are dropped, and those may have any names. A window is lost only if both its hashes are those of another (chance n^2 / 2^129).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import checkpoint, pieces, raw_texts, trim

WIDTH, SHINGLE = 50, 8
#: Text of a bucket, windows of a piece, and words of an automaton.
BUCKET_BYTES, PIECE_WINDOWS, SHARD_WORDS = 4 << 20, 128, 500_000
#: Letters that spell a word in an automaton, and bits kept of a window's first hash.
LETTERS, FIRST_BITS = 2, 64
_STEP, _OTHER = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes of a text up to which a table of powers covers all of it.
PREFIX = 1 << 21
_powers: dict[int, np.ndarray] = {}


def powers(n: int, factor: int = _STEP) -> np.ndarray:
    """Powers of an odd factor and of its inverse modulo 2^64."""
    if factor not in _powers or _powers[factor].shape[1] < n:
        size = 1 << max(12, (n - 1).bit_length())
        steps = np.ones((2, size), np.uint64)
        steps[0, 1:], steps[1, 1:] = factor, pow(factor, -1, 1 << 64)
        _powers[factor] = np.multiply.accumulate(steps, axis=1)
    return _powers[factor]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word, the sum of (byte + 1) times powers of a factor by place, from all bytes of the text at once."""
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) <= PREFIX:  # differences of running sums, shifted back to the word's start
        steps = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * steps[0, : len(data)], out=sums[1:])
        return _mix((sums[ends] - sums[starts]) * steps[1, starts])
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    value = data[starts[0] :].astype(np.uint64) + np.uint64(1)
    value *= powers(int(lengths.max()))[0, place]
    value[space[starts[0] :]] = 0
    return _mix(np.add.reduceat(value, starts - starts[0]))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by running minima from both ends of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _runs(words: np.ndarray, width: int, factor: int) -> np.ndarray:
    """A hash of each `width` consecutive words, by differences of running sums."""
    steps = powers(len(words) + 1, factor)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * steps[0, : len(words)])])
    return _mix((sums[width:] - sums[:-width]) * steps[1, : len(words) - width + 1])


def windows(raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, and for each window of `width` words its anchor's hash, as int64; empty for fewer words."""
    words = word_hashes(raw)
    if len(words) < width:
        return words, np.zeros(0, np.int64)
    shingle = min(SHINGLE, width)
    return words, _least(_runs(words, shingle, _STEP), width - shingle + 1).view(np.int64)


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [np.unique(windows(raw, width)[1]) for raw in raw_texts(batch.column("text"))]
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), batch.column("id").take(pa.array(rows)), batch.column("bucket").take(pa.array(rows))], ["anchor", "id", "bucket"])

    return run


_WINDOWS = pa.schema([(n, pa.int32() if n == "pos" else pa.int64()) for n in ("bucket", "one", "two", "id", "body", "pos", "last")])


def _confirm(width: int, bits: int):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        trim()
        known = np.sort(shared.column("anchor").to_numpy())
        if not len(known):
            return _WINDOWS.empty_table()
        ids, bodies = (docs.column(c).to_numpy() for c in ("id", "body"))
        seen: set[tuple[int, int]] = set()
        held: list[tuple] = []
        for i, raw in enumerate(_raws(docs)):
            if (ids[i], bodies[i]) in seen:
                continue
            seen.add((ids[i], bodies[i]))
            words, anchor = windows(raw, width)
            at = np.flatnonzero(_among(anchor, known))
            if len(at):
                one, two = _runs(words, width, _STEP)[at] & np.uint64((1 << bits) - 1), _runs(words, width, _OTHER)[at]
                held.append((one.view(np.int64), two.view(np.int64), np.full(len(at), i), at))
        if not held:
            return _WINDOWS.empty_table()
        one, two, doc, pos = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((pos, bodies[doc], ids[doc], two, one))
        one, two, doc, pos = one[order], two[order], doc[order], pos[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(new)) - 1
        columns = [np.full(len(first), docs.column("bucket")[0].as_py()), one[first], two[first], ids[doc[first]], bodies[doc[first]], pos[first].astype(np.int32), ids[doc[last]]]
        return pa.table(columns, _WINDOWS)

    return run


_PASSAGES = pa.schema([("owner", pa.int64()), ("body", pa.int64()), ("chunk", pa.int32()), ("passage", pa.binary())])


def _passages(width: int):
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        trim()
        wanted: dict[tuple, list] = {}
        for owner, body, *where in zip(*(asked.column(c).to_pylist() for c in ("owner", "body", "chunk", "low", "high"))):
            wanted.setdefault((owner, body), []).append(where)
        out: list[tuple] = []
        keys = zip(docs.column("id").to_pylist(), docs.column("body").to_pylist())
        for key, raw in zip(keys, _raws(docs) if wanted else ()):
            if found := wanted.pop(key, None):
                words = raw.split()
                out += [(*key, chunk, b" ".join(words[low : high + width])) for chunk, low, high in found]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), _PASSAGES.types)], _PASSAGES) if out else _PASSAGES.empty_table()

    return run


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _raws(docs: pa.Table) -> Iterator[bytes]:
    return (x or b"" for chunk in docs.column("text").chunks for x in chunk.cast(pa.binary()).to_pylist())


class Shard:
    """An automaton over the cores of passages; its letters are words.

    A core is what width/2 + 1 consecutive windows of a passage have in common, so each window holds one.
    """

    def __init__(self, passages: list[tuple[int, list[bytes]]], width: int):
        self.width, together = width, width // 2 + 1
        self.numbers: dict[bytes, int] = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable([words for _, words in passages])), 1)}
        number = self.numbers.__getitem__
        self.passages = [(owner, np.fromiter(map(number, words), np.int32, len(words))) for owner, words in passages]
        self.base = max(2, int((len(self.numbers) + 1) ** (1 / LETTERS)) + 1)
        self.letters = {w: self._spell(i) for w, i in self.numbers.items()}
        places: dict[str, list] = {}
        for p, (_, words) in enumerate(passages):
            line = "".join(map(self.letters.__getitem__, words))
            for i in range(0, len(words) - width + 1, together):
                begin = min(i + together, len(words) - width + 1) - 1
                core = line[LETTERS * begin : LETTERS * (i + width)]
                places.setdefault(core, []).append((p, i + width - 1))
        self.automaton = ahocorasick.Automaton()
        for key, value in places.items():
            self.automaton.add_word(key, value)
        self.automaton.make_automaton()

    def _spell(self, number: int) -> str:
        """LETTERS letters for a word, so that no node of the automaton has many children; the first is of an alphabet of its own."""
        out, n = [], number
        for _ in range(LETTERS):
            n, digit = divmod(n, self.base)
            out.append(digit)
        return chr(1 + self.base + out[0]) + "".join([chr(1 + d) for d in out[1:]])

    def mark(self, one: int, words: list[bytes], gone: np.ndarray) -> None:
        """Marks in `gone` what this shard's passages of smaller ids cover in the document."""
        get = self.letters.get
        blank = "\0" * LETTERS
        line = "".join(map(get, words, repeat(blank)))
        numbers, done, width = None, set(), self.width
        for end, places in self.automaton.iter(line):
            for p, last in places:
                owner, passage = self.passages[p]
                shift = end // LETTERS - last
                if owner >= one or (p, shift) in done:
                    continue
                done.add((p, shift))
                low, high = max(0, shift), min(len(words), shift + len(passage))
                if gone[low:high].all():
                    continue
                if numbers is None:
                    numbers = np.array([self.numbers.get(w, 0) for w in words], np.int32)
                breaks = np.flatnonzero(numbers[low:high] != passage[low - shift : high - shift]) + low
                if not len(breaks):
                    if high - low >= width:
                        gone[low:high] = True
                    continue
                begins, ends = np.append(low, breaks + 1), np.append(breaks, high)
                for a, b in zip(begins.tolist(), ends.tolist()):
                    if b - a >= width:
                        gone[a:b] = True


def _remove(width: int, names: list[str], shard_words: int):
    def run(docs: pa.Table, passages: pa.Table) -> pa.Table:
        trim()
        shards, held, size = [], [], 0
        for owner, text in zip(passages.column("owner").to_pylist(), passages.column("passage").to_pylist()):
            held.append((owner, text.split()))
            size += len(held[-1][1])
            if size >= shard_words:
                shards.append(Shard(held, width))
                held, size = [], 0
        if held:
            shards.append(Shard(held, width))
        counts, removed, kept = [], [], []
        for one, raw in zip(docs.column("id").to_pylist(), _raws(docs)):
            words = raw.split()
            gone = np.zeros(len(words), bool)
            if len(words) >= width:
                for shard in shards:
                    shard.mark(one, words, gone)
            counts.append(len(words))
            removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if removed[-1] else words).decode())
        columns = [docs.column(n) for n in names] + [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
        return pa.table(columns, [*names, "n_words", "n_removed", "kept"])

    return run


def _whole(names: list[str]):
    """Rows that keep all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = [raw.split() for raw in raw_texts(batch.column("text"))]
            columns = [pa.array([len(w) for w in words], pa.int64()), pa.array([0] * len(words), pa.int64()), pa.array([b" ".join(w).decode() for w in words], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], [*names, "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, keep: Iterable[str] = ("doc_id",), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns `keep` and n_words, n_removed, kept (the kept words joined by one space), a row for each row of `docs`."""
    keep = list(keep)
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be a whole number")
    names = [f"k{i}" for i in range(len(keep))]
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = int(total // BUCKET_BYTES) + 1
    bucket_of = lambda one, body: F.pmod(F.xxhash64(one, body), F.lit(n).cast("long")).alias("bucket")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"), *[F.col(f"`{c}`").alias(m) for c, m in zip(keep, names)])
    held = rows.where("id IS NOT NULL").select(bucket_of("id", "body"), "*")
    bare = held.select("bucket", "id", "body", "text")

    pairs = bare.mapInArrow(_anchors(width), "anchor long, id long, bucket long").groupBy("anchor", "bucket").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    every = Window.partitionBy("anchor")  # a row for each bucket at most
    spread = checkpoint(pairs.select("bucket", "anchor", F.min("a").over(every).alias("a"), F.max("b").over(every).alias("b")).where("a < b").select("bucket", "anchor"))

    found = bare.groupBy("bucket").cogroup(spread.groupBy("bucket")).applyInArrow(_confirm(width, FIRST_BITS), "bucket long, one long, two long, id long, body long, pos int, last long")
    same = Window.partitionBy("one", "two").orderBy("id", "body", "pos").rowsBetween(Window.unboundedPreceding, 0)
    first = [F.first(c).over(same).alias(m) for c, m in (("id", "owner"), ("body", "from"), ("pos", "at"))]
    late = found.select("bucket", "last", *first).where("owner < last").withColumn("chunk", F.floor(F.col("at") / PIECE_WINDOWS).cast("int"))
    routes = checkpoint(late.groupBy("bucket", "owner", "from", "chunk").agg(F.min("at").alias("low"), F.max("at").alias("high")))

    asked = routes.groupBy("owner", F.col("from").alias("body"), "chunk").agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumn("bucket", bucket_of("owner", "body"))
    passages = checkpoint(bare.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_passages(width), "owner long, body long, chunk int, passage binary"))
    sent = routes.select("bucket", "owner", F.col("from").alias("body"), "chunk").join(passages, ["owner", "body", "chunk"]).select("bucket", "owner", "passage")

    kinds = ", ".join(f"{m} {docs.schema[c].dataType.simpleString()}" for c, m in zip(keep, names))
    schema = f"{kinds}, n_words long, n_removed long, kept string"
    done = held.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(_remove(width, names, SHARD_WORDS), schema)
    done = done.union(rows.where("id IS NULL").select(*names, "text").mapInArrow(_whole(names), schema))
    return done.select(*[F.col(m).alias(c) for c, m in zip(keep, names)], "n_words", "n_removed", "kept")
