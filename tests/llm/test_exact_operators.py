"""Operators with one right answer, against brute force over small texts with odd rows."""

import hashlib
import random
import re
import tracemalloc
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from postrail.llm import common, decontaminate, language, sentencepiece_codec, simhash, topk
from postrail.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, clean string, items int, key string"


def made(seed=1, n=60, vocabulary=30, longest=120):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(vocabulary)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, longest))) for _ in range(n)]
    for i in range(0, n, 5):
        texts[i] = texts[(i + 3) % n]  # copies
        texts[i + 1] = texts[i + 1] + " tail" if i % 2 else " ".join(texts[i + 1].split()[:-1] + ["edit"])
    texts += [None, "", " \t\n", "one", "ONE", "two words", "x " * 3000, "a b\x0bc d e", "日本 語 テスト"]
    return texts


def frame(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, None, "s", 1, "clash", 3, "k") for i, t in zip(ids, texts)], DOCS).repartition(3)


def test_fingerprints_and_components(spark):
    texts = made(2, 40, 12, 60)
    ids = list(range(100, 100 + len(texts)))
    got = simhash.near_duplicates(frame(spark, texts, ids)).collect()
    assert len(got) == len(texts)

    def brute(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    codes = {i: brute(t) for i, t in zip(ids, texts)}
    assert {r.doc_id: r.fp % 2**64 for r in got} == codes
    assert {r.doc_id: r.component_id for r in got} == brute_components(codes, 4)


def brute_components(codes, distance):
    root = {i: i for i in codes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(codes), 2):
        if (codes[a] ^ codes[b]).bit_count() <= distance:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in codes}


@pytest.mark.parametrize("dense", [False, True])
def test_forest_finds_every_component(dense):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 3 if dense else 300, 900)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64))
    codes = np.unique(np.concatenate([base, near]))
    forest = simhash.Forest(np.zeros(len(codes), np.int64), codes)
    label = forest.link(4)
    want = brute_components({i: int(c) for i, c in enumerate(forest.codes)}, 4)
    assert label.tolist() == [want[i] for i in range(len(codes))]


def test_every_choice_of_bands_covers_the_word():
    for keep in (1, 2, 3, 4):
        masks = [m % 2**64 for m in simhash.choices(4, keep)]
        for flips in [(0, 1, 2, 3), (0, 20, 40, 63), (13, 14, 33, 60)]:
            code = sum(1 << f for f in flips)
            assert any(not m & code for m in masks)


def test_empty_table(spark):
    empty = frame(spark, ["x"]).where("false")
    assert simhash.near_duplicates(empty).count() == 0
    assert decontaminate.find(empty, empty, item="doc_id").count() == 0
    assert sentencepiece_codec.encode_decode(empty, tokenizer_path()).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>, score long, rank int")
    assert topk.search(vectors, F.col("vec_id") % 100 == 0).count() == 0
    lone = spark.createDataFrame([(100, [1.0], 7, 7)], vectors.schema)
    assert topk.search(lone, F.col("vec_id") % 100 == 0).count() == 0


def test_block_by_block_is_the_same():
    rng = random.Random(4)
    for t in ["".join(rng.choices("ab Cé\n\t日.", k=rng.randint(0, 80))) for _ in range(400)]:
        raw = t.encode()
        assert b"".join(common.blocks(raw, 7)) == raw
        assert simhash.fingerprint(raw, 4, 9) == simhash.fingerprint(raw)
        whole = language.grams(t)
        for size in (1, 3, 10):
            assert np.array_equal(np.concatenate([whole[:0], *language.gram_blocks(t, size)]), whole)


def test_large_components_are_one(spark):
    """A chain of fingerprints, each one bit off the last, around words that all differ."""
    rng = random.Random(5)
    base = [f"v{rng.randrange(10**9)}" for _ in range(400)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(200)] + [" ".join(base), None]
    got = simhash.near_duplicates(frame(spark, texts)).collect()
    codes = {i: simhash.fingerprint((t or "").encode()) % 2**64 for i, t in enumerate(texts)}
    assert {r.doc_id: r.component_id for r in got} == brute_components(codes, 4)
    assert {r.doc_id: r.keeper.key for r in got} == {r.doc_id: r.component_id for r in got}


def test_very_long_texts(spark):
    long = " ".join(f"word{i % 70_000}" for i in range(300_000))  # 3 MB
    docs = frame(spark, [long, "x" * 3_000_000])
    assert simhash.near_duplicates(docs).count() == 2
    r = {r.doc_id: r for r in sentencepiece_codec.encode_decode(docs.where("doc_id = 0"), tokenizer_path()).collect()}[0]
    assert r.decoded == long and r.span_end[-1] == len(long)
    items = spark.createDataFrame([(1, "word5 word6 word7 word8")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.find(docs, items).collect()} == {0: 20, 1: 0}


def test_clear_removes_what_was_stored(spark, tmp_path):
    before = spark.sparkContext._jsc.sc().getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert common.stored(spark.range(5)).count() == 5 and common.checkpoint(spark.range(5)).count() == 5
    common.clear(spark)
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    spark.sparkContext.setCheckpointDir(before.get() if before.isDefined() else str(tmp_path))


def test_decontamination(spark, monkeypatch):
    texts = made(3, 30, 9, 50)
    items = [(1, "w1 w2 w3"), (1, "W4 w5"), (20, texts[2]), (3, None), (None, "w6 w8 w2"), (4, "..."), (5, " ".join((texts[4] or "").split()[5:30])), (6, "one")]
    table = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    want = {}
    for i, t in enumerate(texts):
        own, hit, found = words(t), set(), set()
        for name, text in items:
            if w := words(text):
                n = min(10, len(w))
                grams = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
                for j in range(len(own) - n + 1):
                    if tuple(own[j : j + n]) in grams:
                        hit |= set(range(j, j + n))
                        found.add(name)
        want[i] = (len(own), len(hit), sorted(str(x) for x in found if x is not None), [w for j, w in enumerate(own) if j not in hit])
    for size, group in ((500_000, 8), (12, 2)):
        monkeypatch.setattr(decontaminate, "SLICE_WORDS", size)
        monkeypatch.setattr(decontaminate, "PASS_SLICES", group)
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"], words(r.clean)) for r in decontaminate.find(frame(spark, texts), table).collect()}
        assert got == want


ODD = ["", " ", "  two  spaces ", "▁", "a▁b ▁▁x", "tab\there\n\nnew", "日本語 テスト😀", "<s> </s> <0x41>", "a\0b", "é" * 40, "x" * 400, "　wide", "mixed   runs     of spaces"]


def test_sentencepiece_round_trip(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    texts = ODD + made(4, 20) + [None]
    rows = {r.doc_id: r for r in sentencepiece_codec.encode_decode(frame(spark, texts), tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        r, raw = rows[i], (t or "").encode()
        assert r.ids == library.encode(t or "")
        assert r.decoded == library.decode(r.ids)
        assert b"".join(raw[a:b] for a, b in zip(r.span_begin, r.span_end)) == raw
        ends = [p.end for p in library.encode(t or "", return_type="proto").pieces]
        assert r.span_end == ends


def test_parts_of_long_texts_are_coded_as_the_whole(monkeypatch):
    own = sentencepiece_codec.Codec(open(tokenizer_path(), "rb").read())
    texts = [(t or "").encode() for t in ODD + made(6, 30) + ["a▁ b▁ c ▁ d▁  e", "▁ x▁ ▁ y  z"]]
    whole = own.encode_all(texts)
    for size in (1, 7, 50):
        monkeypatch.setattr(sentencepiece_codec, "LONG", size)
        assert max(len(own.parts(t)) for t in texts) > 5
        for a, b in zip(whole, own.encode_all(texts)):
            assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_what_a_codec_remembers_is_small():
    """Some bytes besides a word's own for each word, and nothing of very long words, which are as right the second time."""
    own, rng = sentencepiece_codec.Codec(open(tokenizer_path(), "rb").read()), random.Random(5)
    some = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(20_000))
    long = [" ".join(["".join(rng.choices("abcdefgh", k=n)), "one", "x" * n]) for n in (64, 65, 20_000)]
    own.encode(b"warm up")
    tracemalloc.start()
    try:
        own.encode(some.encode())
        held = tracemalloc.get_traced_memory()[0]
        for _ in range(2):
            assert all(own.encode(t.encode())[0].tolist() == own.library.encode(t) for t in long)
        more = tracemalloc.get_traced_memory()[0] - held
    finally:
        tracemalloc.stop()
    assert held < 20_000 * 250 and more < 20_000
    assert max(map(len, own.known)) <= sentencepiece_codec.LONGEST


def test_character_map_walk():
    """A map with A -> a, AB -> xyz and fullwidth space -> space, laid out as a double array by hand."""
    words = {b"A": b"a", b"AB": b"xyz", "　".encode(): b" "}
    texts, places = b"", {}
    for key, value in words.items():
        places[key] = len(texts)
        texts += value + b"\0"
    units = [0] * 4096
    used = {0}
    nodes = [(0, b"")]
    while nodes:
        at, prefix = nodes.pop(0)
        labels = sorted({k[len(prefix)] for k in words if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in words
        base = next(b for b in range(256, 4096, 256) if all(b ^ x not in used for x in labels) and (not leaf or b not in used))
        units[at] |= (at ^ base) << 10 | leaf << 8
        if leaf:
            units[base] = places[prefix] | 1 << 31
            used.add(base)
        for x in labels:
            used.add(base ^ x)
            units[base ^ x] = x
            nodes.append((base ^ x, prefix + bytes([x])))
    blob = (4 * len(units)).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + texts
    own = sentencepiece_codec.Codec.__new__(sentencepiece_codec.Codec)
    own.map, own.rules = sentencepiece_codec.CharacterMap(blob), sentencepiece_codec.Rules()
    assert own.map.longest(b"ABC", 0) == (b"xyz", 2)
    assert own.map.longest(b"AC", 0) == (b"a", 1)
    assert own.map.longest(b"C", 0) is None
    text, align = own.normalise("  AB　 A ".encode())
    assert text.decode() == "▁xyz▁a"
    assert align.tolist() == [2, 2, 2, 2, 2, 2, 4, 4, 4, 8, 9]


def test_topk_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(0, 0.1, 8).tolist()) for i in range(600)]
    rows += [(int(i), rows[7][1]) for i in range(600, 900)]  # ties
    rows += [(200, rows[3][1]), (200, rows[200][1]), (901, None), (902, [1.0] * 7 + [None]), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (905, [0.5] * 3), (1000, [0.25] * 3), (None, rows[5][1]), (1100, []), (906, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "TILE", 64)
    monkeypatch.setattr(topk, "PLAN_BLOCKS", 2)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(table, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_topk(rows, 10)


def brute_topk(rows, k):
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for at, (i, v) in enumerate(good):
        if i % 100 == 0:
            found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j) for other, (j, w) in enumerate(good) if other != at and len(w) == len(v))
            want += [(i, r + 1, j, -lost) for r, (lost, j) in enumerate(found[:k])]
    return sorted(want)


def test_topk_large_components(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**21, 3.0]), (2, [-(2.0**40), 1.0]), (100, [2.0**60, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(table, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_topk(rows, 10)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("width, bits", [(5, 64), (12, 64), (50, 64), (12, 2)])
def test_substring_dedup(spark, monkeypatch, width, bits):
    """With two bits left of the first hash nearly all windows collide in it; the second tells them apart."""
    from postrail.llm import substrings

    rng = random.Random(width)
    words = [f"w{i}" for i in range(400)]
    hot = rng.choices(words, k=70)
    texts = []
    for i in range(80):
        own = rng.choices(words, k=rng.randint(0, 150))
        if i % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = hot
        if i % 7 == 3 and texts:
            own = (texts[-1] or "").split()[: 10 + i]
        if i % 11 == 5 and len(texts) > 4:
            own = texts[-4].split() + [f"e{i}"] + own
        texts.append(("\n" if i % 2 else " ").join(own))
    texts += [None, "", "x " * 400, "x " * 120 + "y", " \t", "a\x0bb é", texts[0], texts[1].upper() * 2]
    ids = [(i * 37) % 101 for i in range(len(texts))]
    ids[5] = ids[6]  # two texts with one id
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 300)
    monkeypatch.setattr(substrings, "PIECE_WINDOWS", 20)
    monkeypatch.setattr(substrings, "FIRST_BITS", bits)
    docs = frame(spark, texts + [texts[3], "n " * 90], ids + [ids[3], None])
    least = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for i, own in zip(ids, split):
        for j in range(len(own) - width + 1):
            key = tuple(own[j : j + width])
            least[key] = min(least.get(key, i), i)
    want = [(None, 90, 0, " ".join(["n"] * 90))]
    for i, own in [*zip(ids, split), (ids[3], split[3])]:
        gone = set()
        for j in range(len(own) - width + 1):
            if least[tuple(own[j : j + width])] < i:
                gone |= set(range(j, j + width))
        want.append((i, len(own), len(gone), " ".join(w for j, w in enumerate(own) if j not in gone)))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs, width).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, *r[1:])) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
    assert sum(r[2] for r in got) > 500


def test_substring_dedup_of_odd_tables(spark):
    from postrail.llm import substrings

    long = " ".join(f"w{i}" for i in range(60_000))
    docs = frame(spark, [long, "head " + long + " tail", "x"], [5, 9, 7]).withColumnRenamed("items", "kept")
    got = {r[0]: r for r in substrings.remove_repeats(docs, keep=("doc_id", "clean")).collect()}
    assert got[5].n_removed == 0 and got[9].n_removed == 60_000 and got[9].kept == "head tail" and got[7].kept == "x" and got[7].clean == "clash"
    assert substrings.remove_repeats(docs.where("false")).count() == 0
    alone = substrings.remove_repeats(frame(spark, [long, long, None], [None, None, None])).collect()
    assert [(r.n_words, r.n_removed) for r in sorted(alone, key=lambda r: -r.n_words)] == [(60_000, 0), (60_000, 0), (0, 0)]
    with pytest.raises(TypeError):
        substrings.remove_repeats(docs, key="clean")
