"""The pipeline against a brute-force version of its stages, over tables with planted cases and odd rows."""

import hashlib
import random
import re

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from postrail.llm import sampling, shingles, simhash, toxicity
from postrail.llm.common import remainder
from postrail.llm.queries import tokenizer_path



def planted(spark, folder):
    rng = random.Random(21)
    words = [f"lo{i}mi" for i in range(300)]
    fresh = lambda n: rng.choices(words, k=n)
    passage, leak = fresh(70), fresh(25)
    rows, labels = [], []
    for i in range(160):
        own = fresh(rng.randint(60, 140))
        if i % 5 == 0:
            own[4:4] = ["grubble", "snarf"]
        if i % 9 == 1:
            own[20:20] = passage
        if i % 11 == 2:
            own[10:10] = leak
        rows.append([i, " ".join(own) if i % 2 else "\n".join([" ".join(own[:30]), " ".join(own[30:])])])
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [[200 + i, rows[i * 3 + 1][1]] for i in range(10)]  # copies
    rows += [[300 + i, rows[i * 4 + 3][1] + " tail"] for i in range(10)]  # near copies
    rows += [[400, None], [401, ""], [402, " \n"], [403, "short"], [404, "short"], [1, rows[1][1]], [None, "no id here"]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, clean string"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.1, 3, "c") for i, t in rows], schema).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(leak)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingle_set(t):
    """Distinct 5-word shingles; all words of a text that has fewer."""
    words = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(sampling.sample(docs, spark.read.parquet(f"{folder}/labels.parquet"), "toxic", remainder(5) > 0))
    rows = [(i, t) for i, t in rows if model.scores([(t or "").encode()])[0] < 0.5]
    sets = [shingle_set(t) for _, t in rows]
    left, kept = set(range(len(rows))), []
    while left:
        group, new = set(), {left.pop()}
        while new:
            group |= new
            new = {j for j in left for k in new if sets[j] == sets[k] or len(sets[j] & sets[k]) >= 0.8 * len(sets[j] | sets[k])}
            left -= new
        kept.append(min(((rows[j][0] is None, rows[j][0] or 0), rows[j][1] or "", j) for j in group))
    rows = [rows[j] for *_, j in kept]
    least = {}
    for i, t in rows:
        for j in range(len(split(t)) - 49):
            if i is not None:
                key = tuple(split(t)[j : j + 50])
                least[key] = min(least.get(key, i), i)
    out = []
    (leak,) = [t for t in [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()] if t]
    grams = {tuple(split(leak)[j : j + 10]) for j in range(len(split(leak)) - 9)}
    for i, t in rows:
        own, gone = split(t), set()
        for j in range(len(own) - 49):
            if i is not None and least[tuple(own[j : j + 50])] < i:
                gone |= set(range(j, j + 50))
        if gone:
            t = " ".join(w for j, w in enumerate(own) if j not in gone)
        spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t or "")]
        own, hit = [t[a:b] for a, b in spans], set()
        for j in range(len(own) - 9):
            if tuple(own[j : j + 10]) in grams:
                hit |= set(range(j, j + 10))
        for j in sorted(hit, reverse=True):
            t = t[: spans[j][0]] + t[spans[j][1] :]
        out.append((i, t or ""))
    return out


def test_pipeline(spark, tmp_path):
    folder = str(tmp_path)
    rows = planted(spark, folder)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in brute(spark, folder, rows):
        ids = library.encode(t)
        want.append((i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)
    ids = {r[0] for r in got}
    assert not ids & set(range(0, 160, 5)) and not ids & set(range(200, 210)) and not ids & set(range(300, 310))
    assert len(ids & {i for i in range(160) if i % 5}) == 128


def test_stages_keep_the_columns(spark, tmp_path):
    folder = str(tmp_path)
    planted(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.dtypes == docs.dtypes
        assert stage(spark, docs.where("false"), folder).count() == 0
    changed = corpus_pipeline.drop_repeats(spark, docs, folder)
    assert changed.where(F.col("text").isNotNull() & (F.col("n_chars") != F.length("text"))).count() == 0


def test_near_copies_down_to_similarity(spark):
    """Planted copies at 0.8 to 0.95 of 5-word shingles go, those below 0.8 stay; the links are all pairs' exact ones."""
    rng = random.Random(33)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    grams = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    similarity = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    rows, gone, wide = [], set(), 0
    for i in range(120):
        own = fresh(rng.randint(150, 400))
        other = list(own)
        while similarity(own, other) > 0.97 - 0.25 * i / 120:
            other[rng.randrange(len(own))] = fresh(1)[0]
        rows += [(i, " ".join(own)), (1000 + i, " ".join(other))]
        if similarity(own, other) >= 0.8:
            gone.add(1000 + i)
            codes = [simhash.fingerprint(" ".join(x).encode()) % 2**64 for x in (own, other)]
            wide += (codes[0] ^ codes[1]).bit_count() > 4
    assert wide > 30 and 50 < len(gone) < 110
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows} - gone


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    """Families that share most of a text, so that keys are crowded, with members below and above the threshold: components are those of all pairs."""
    monkeypatch.setattr(shingles, "TILE", 16)
    monkeypatch.setattr(shingles, "NEAR", 1)
    rng = random.Random(34)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for size in (80, 40):
        common = fresh(200)
        for i in range(size):
            texts.append(" ".join(common + fresh(rng.choice([5, 20, 30, 45, 60]))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    body = {r.body: r.doc_id for r in docs.select("doc_id", F.xxhash64("text").alias("body")).collect()}
    found = [(body[r.x], body[r.y]) for r in shingles.links(docs).collect()]
    sets = [shingle_set(t) for t in texts]
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert found and all(similar(a, b) for a, b in found)

    def parts(edges):
        root = list(range(len(texts)))
        for a, b in edges:
            a, b = root[a], root[b]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    want = parts([(a, b) for a in range(len(texts)) for b in range(a) if similar(a, b)])
    assert parts(found) == want and 2 < len(set(want)) < len(texts)
    assert shingles.links(docs.where("false")).count() == 0
