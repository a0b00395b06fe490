"""SentencePiece encoding and decoding with offsets.

The normaliser is our own: it walks the model's compiled character map (a double-array trie over
UTF-8 bytes) by longest prefix and records, for each normalised byte, the original byte it came
from. The library's merges then run on normalised text, and each piece is projected through that
alignment to a byte span of the original text. Decoding is the library's decode(ids).

In a BPE vocabulary where no piece has the space mark after another character, no merge can cross
from a word into the space mark that follows it. The normalised text is then cut there, and each
distinct word is merged once per worker and remembered; the merges, and so the ids, are the same.

Null and empty texts have no ids, no spans and decode to the empty text. Ties do not occur; repeated
rows are coded each on its own; an empty table has no rows; other columns than those asked for are dropped. A very long text is coded in
parts that end between words, where the model allows that.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import pieces, raw_texts

SPACE = "▁"
#: A model file beyond this size is refused rather than broadcast.
MODEL_BYTES = 64 << 20
#: Bytes of a text beyond which it is coded in parts, and where a part may end.
LONG, _WORD_END = 1 << 19, re.compile(rb"(?<! )(?<!\xe2\x96\x81) ")  # not after a mark that the text has itself
#: Distinct words that a worker's younger memory holds, an older one of that size being kept beside it, and characters of a word beyond which it is merged anew each time.
REMEMBERED, LONGEST = 50_000, 64
#: Bytes of text that are coded at once, and words that the library merges in one call.
CODED_BYTES, MERGED = 1 << 19, 10_000


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def _put(number: int) -> bytes:
    out = bytearray()
    while number > 0x7F:
        out.append(number & 0x7F | 0x80)
        number >>= 7
    return bytes([*out, number])


def wire(raw: bytes) -> Iterator[tuple[int, int, object, bytes]]:
    """Fields of a protocol buffer message: number, wire type, value, and the field as it stands."""
    at = 0
    while at < len(raw):
        begin = at
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        yield key >> 3, kind, value, raw[begin:at]


class CharacterMap:
    """The compiled character map: u32 size, double-array trie, then null-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :] if blob else b""

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest prefix of raw[at:] in the map, and how many bytes it takes."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        begin, taken = found
        return self.replacements[begin : self.replacements.index(b"\0", begin)], taken

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


@dataclass
class Rules:
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False


class Codec:
    def __init__(self, model: bytes):
        self.rules, kept, symbols, kind = Rules(), [], [], 1
        for number, _, value, whole in wire(model):
            if number == 1:
                piece = {n: v for n, _, v, _ in wire(value)}
                symbols.append((piece.get(1, b"").decode(), piece.get(3, 1)))
            if number == 2:
                trainer = {n: v for n, _, v, _ in wire(value)}
                kind, self.rules.suffix = trainer.get(3, 1), bool(trainer.get(24, 0))
            if number == 3:
                norm = {n: v for n, _, v, _ in wire(value)}
                self.rules.charsmap = norm.get(2, b"")
                self.rules.dummy_prefix, self.rules.squeeze, self.rules.escape = (bool(norm.get(n, 1)) for n in (3, 4, 5))
            else:
                kept.append(whole)
        plain = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"  # no prefix, no squeezing, no escapes
        bare = b"".join(kept) + b"\x1a" + _put(len(plain)) + plain
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=bare)
        self.map = CharacterMap(self.rules.charsmap)
        self.sizes = np.array([1 if k == 6 else len(piece.encode()) for piece, k in symbols], np.int64)
        self.unknown = self.library.unk_id()
        own = [p for p, k in symbols if k in (1, 4, 5)]
        words = kind == 2 and self.rules.escape and not any(k == 4 for _, k in symbols) and not any(SPACE in p.lstrip(SPACE) for p in own)
        self.words = words
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if words else r"(?s:.+)")
        self.known: dict[str, bytes] = {}  # ids as they lie in an int32 array
        self.before: dict[str, bytes] = {}

    def plain(self) -> bool:
        """Whether normalising only writes a mark for each space and one before the text."""
        return not self.map.units and not self.rules.squeeze and self.rules.escape and not self.rules.suffix

    def normalise(self, raw: bytes, begins: bool = True) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each (and their end) the offset of the original byte. `begins` says whether a text begins here."""
        if not raw:
            return b"", np.zeros(1, np.int64)
        if self.plain():
            data = np.frombuffer(raw, np.uint8)
            origin = np.repeat(np.arange(len(raw)), np.where(data == 32, 3, 1))
            head = 3 * (self.rules.dummy_prefix and begins)
            mark = SPACE.encode()
            align = np.concatenate([np.zeros(head, np.int64), origin, [len(raw)]])
            return mark * (head // 3) + raw.replace(b" ", mark), align
        return self._walk(raw)

    def parts(self, raw: bytes) -> list[int]:
        """Where a text can be cut into parts of about `LONG` bytes without a change: before spaces that follow a word."""
        cuts = [0]
        while self.words and self.plain() and len(raw) - cuts[-1] > LONG and (found := _WORD_END.search(raw, cuts[-1] + LONG)):
            cuts.append(found.start())
        return [*cuts, len(raw)]

    def _walk(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        rules, out, align, at = self.rules, bytearray(), [], 0
        mark = SPACE.encode() if rules.escape else b" "

        def emit(piece: bytes, origin: int) -> None:
            out.extend(piece)
            align.extend([origin] * len(piece))

        def step(at: int) -> tuple[bytes, int]:
            if found := self.map.longest(raw, at):
                return found
            size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
            return raw[at : at + size], size

        while rules.squeeze and at < len(raw):
            piece, taken = step(at)
            if piece.strip(b" "):
                break
            at += taken
        if at == len(raw):
            return b"", np.array([at])
        if rules.dummy_prefix and not rules.suffix:
            emit(mark, at)
        spaced = rules.squeeze
        while at < len(raw):
            piece, taken = step(at)
            if spaced and rules.squeeze:
                piece = piece.lstrip(b" ")
            for byte in piece:
                emit(mark if byte == 32 else bytes([byte]), at)
            if piece:
                spaced = piece.endswith(b" ")
            at += taken
        end = len(raw)
        while rules.squeeze and out.endswith(mark):
            end = align[-len(mark)]
            del out[-len(mark) :], align[-len(mark) :]
        if rules.dummy_prefix and rules.suffix:
            emit(mark, end)
        return bytes(out), np.array([*align, end], np.int64)

    def learn(self, words: set[str]) -> None:
        """Merges the words that aren't known. Those not met for a while are forgotten, and `_encode` forgets long ones, so memory is bounded."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        fresh = words.difference(known)
        if before:
            known.update((w, before[w]) for w in fresh.intersection(before))
            fresh.difference_update(before)
        fresh = list(fresh)
        for at in range(0, len(fresh), MERGED):
            some = fresh[at : at + MERGED]
            known.update(zip(some, [array("i", ids).tobytes() for ids in self.merger.encode(some, num_threads=1)]))

    def encode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the original byte at which each piece begins and ends."""
        return self.encode_all([raw])[0]

    def encode_all(self, raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """As `encode` for each; long texts part by part, the others together."""
        long = [i for i, raw in enumerate(raws) if len(raw) > LONG]
        out = self._encode([b"" if len(raw) > LONG else raw for raw in raws])
        for i in long:
            cuts, found = self.parts(raws[i]), []
            for a, b in zip(cuts, cuts[1:]):
                ((ids, begins, ends),) = self._encode([raws[i][a:b]], a == 0)
                found.append((ids, (begins + a).astype(np.int32), (ends + a).astype(np.int32)))
            out[i] = tuple(np.concatenate(x) for x in zip(*found))
        return out

    def _encode(self, raws: list[bytes], begins_text: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        cut, out, texts = self.cut.findall, [], []
        for raw in raws:
            text, align = self.normalise(raw, begins_text)
            texts.append((cut(text.decode("utf-8", "replace")), align))
        met = set(chain.from_iterable([words for words, _ in texts]))
        self.learn(met)
        known = self.known.__getitem__
        for words, align in texts:
            ids = np.frombuffer(b"".join(map(known, words)), np.int32)
            ends = np.cumsum(self._lengths(ids, words))
            begins = np.concatenate([[0], ends[:-1]]) if len(ids) else ends
            out.append((ids, align[begins], align[ends]))
        for word in met:
            if len(word) > LONGEST:
                del self.known[word]
        return out

    def _lengths(self, ids: np.ndarray, words: list[str]) -> np.ndarray:
        """Normalised bytes of each piece; where the model has no byte fallback, unknown runs have their own text's."""
        if not (ids == self.unknown).any():
            return self.sizes[ids]
        return np.array([len(p.surface.encode()) for w in words for p in self.merger.encode(w, return_type="proto").pieces], np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist()) if len(ids) else ""


_codecs: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec for each model in a worker, which Spark reuses between tasks."""
    key = hash(model)
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, ids, span_begin, span_end (bytes of the original), decoded for every row of `docs`.

    A narrow map over whole texts: no shuffle, and a worker holds a few MB of text at once. The model
    file is read by the driver and broadcast; its size is checked.
    """
    with open(model_path, "rb") as file:
        model = file.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"{model_path} has over {MODEL_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in pieces(batches, "text", CODED_BYTES):
            rows = own.encode_all(raw_texts(batch.column("text")))
            lists = []
            for part in range(3):
                offsets = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32)
                flat = np.concatenate([np.asarray(r[part], np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())))
            decoded = pa.array([own.decode(r[0]) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), *lists, decoded], ["key", "ids", "span_begin", "span_end", "decoded"])

    return docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, f"key {kind}, ids array<int>, span_begin array<int>, span_end array<int>, decoded string").withColumnRenamed("key", key)
