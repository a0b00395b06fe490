"""URL filters: host word segmentation and naive Bayes over segmented tokens, below exact rules.

Host labels are often words run together; a unigram Viterbi splits them. The unigram counts come from
the path, query and fragment tokens of all urls and from a short list of common words. The multinomial
naive Bayes learns from the urls that the rules decide, and from seed words; it scores the words of
the segmented host and of the path. All counts stay on the cluster, whole: the pieces of the distinct host
labels are joined with the unigram counts, and the tokens of the urls with their weights. A rule, where one fits, has the last word: it fits its host and
all subdomains if the url's path starts with the rule's, and the longest rule wins (ties to the first).

A null url, or one without `://`, has an empty host and path, no rule and the prior's verdict. Equal
scores allow. Ties: of segmentations that cost the same the one with the longest last word wins, and of fitting rules of one length the first.
Repeated urls and pages are judged each on its own, and alike. An empty table has no verdicts. Other columns are dropped, whatever their names. A
very long url takes memory in proportion to it; the pieces of a very long label are listed a stretch at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Letters of a segmenter's word at most, and places of a label whose pieces are listed at once.
LONGEST, STRETCH = 24, 1024
#: What a seed word counts for its verdict.
SEED_COUNT = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Common words for the segmenter, and seed words for each verdict.
COMMON = """the of and to in is that it for on was be with as at by from or an are this not have he she they we you all can more will one
about new news blog shop store home page web site online free best top my go get world daily times post media tech data cloud app code wiki forum
photo video music game sport travel food health book school science art city green red blue big live""".split()
SEEDS = {
    "block": "adult porn xxx sex casino bet betting poker slots gambling viagra pills warez torrent crack malware phishing spam escort nude hack ad ads tracker".split(),
    "allow": "news blog wiki docs school library science health travel university museum open learn article guide help support weather".split(),
}


def host_of(url: str | Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def split_urls(pages: DataFrame, rules: tuple = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, url, host, path, rule, ruled) with native expressions only."""
    empty = F.coalesce(F.col(url), F.lit(""))
    out = pages.select(F.col(key).alias("key"), empty.alias("url"), host_of(empty).alias("host"), path_of(empty).alias("path"))
    rule = ruled = F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked last and so wins
        name, _, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + rest)
        rule, ruled = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return out.withColumn("rule", rule).withColumn("ruled", ruled)


def split(label: str, counts: dict[str, int], total: int) -> list[str]:
    """Unigram Viterbi over the characters of a host label; `counts` has all pieces of it that are words."""
    rest = math.log(total or 1) + 2.0  # an unknown run costs this, and more for each further letter
    costs = {w: -math.log(n / total) for w, n in counts.items()}
    n = len(label)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for begin in range(max(0, end - LONGEST), end):
            cost = costs.get(label[begin:end])
            cost = best[begin] + (rest + 1.5 * (end - begin) if cost is None else cost)
            if cost < best[end]:
                best[end], back[end] = cost, begin
    out, end = [], n
    while end:
        out.append(label[back[end] : end])
        end = back[end]
    return out[::-1]


def _words(text: Column | str) -> Column:
    """Runs of digits, of a-z, and of characters beyond ASCII."""
    return F.regexp_extract_all(text, F.lit("([0-9]+|[a-z]+|[^\\x00-\\x7F]+)"))


def unigrams(urls: DataFrame) -> DataFrame:
    """(w, n) of all path, query and fragment tokens and of the fixed words."""
    spark = urls.sparkSession
    tail = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*(.*)", 1)
    fixed = Counter(dict.fromkeys([*COMMON, *SEEDS["block"], *SEEDS["allow"]], 20))
    tokens = urls.select(F.explode(_words(F.lower(tail))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return checkpoint(tokens.union(spark.createDataFrame(list(fixed.items()), "w string, n long")).groupBy("w").agg(F.sum("n").alias("n")))


def segmented(urls: DataFrame) -> DataFrame:
    """(host, parts): the words of each distinct host that has letters, in order."""
    counts = unigrams(urls)
    total = counts.agg(F.sum("n")).first()[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, x in zip(batch.column("own").to_pylist(), batch.column("label").to_pylist()):
                for at in range(0, len(x), STRETCH):
                    pieces = sorted({x[a:b] for a in range(at, min(len(x), at + STRETCH)) for b in range(a + 1, min(len(x), a + LONGEST) + 1)})
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(pieces), pa.int64()), pa.array(pieces, pa.string())], ["own", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, known = batch.column("label").to_pylist(), batch.column("known").to_pylist()
            parts = [split(x, {k["w"]: k["n"] for k in found or ()}, total) for x, found in zip(labels, known)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(parts, pa.list_(pa.string()))], ["label", "parts"])

    hosts = checkpoint(urls.select("host").distinct().select("host", F.posexplode(_words("host")).alias("place", "label")))
    # pieces go by a hash of their label; two labels of one hash would only know each other's words besides
    labels = checkpoint(hosts.select("label").distinct().withColumn("own", F.xxhash64("label")))
    cuts = labels.mapInArrow(cut, "own long, w string").distinct()
    known = cuts.join(counts, "w").groupBy("own").agg(F.collect_list(F.struct("w", "n")).alias("known"))
    parts = labels.join(known, "own", "left").mapInArrow(run, "label string, parts array<string>")
    placed = hosts.join(parts, "label").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "parts"))).alias("x"))
    return placed.select("host", F.flatten("x.parts").alias("parts"))


def tokenized(urls: DataFrame) -> DataFrame:
    """`urls` with an id of each row and its tokens."""
    rows = checkpoint(urls.withColumn("uid", F.monotonically_increasing_id()))
    tag = lambda side, words: F.transform(words, lambda w: F.concat(F.lit(side), w))
    parts = F.coalesce("parts", F.array().cast("array<string>"))
    return checkpoint(rows.join(segmented(rows), "host", "left").withColumn("tokens", F.concat(tag("h:", parts), tag("p:", _words(F.lower("path"))))).drop("parts"))


def weights(rows: DataFrame) -> tuple[DataFrame, float]:
    """(w, weight) of every token of a decided url or seed, and the prior."""
    spark = rows.sparkSession
    seeds = spark.createDataFrame([(f"{side}:{w}", SEED_COUNT * (v == "block"), SEED_COUNT * (v == "allow")) for v in SEEDS for w in SEEDS[v] for side in "hp"], "w string, block long, allow long")
    decided = rows.where("ruled IS NOT NULL")
    each = [F.count(F.when(F.col("ruled") == v, 1)).alias(v) for v in SEEDS]
    counts = decided.select("ruled", F.explode("tokens").alias("w")).groupBy("w").agg(*each).select("w", "block", "allow").union(seeds)
    counts = checkpoint(counts.groupBy("w").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")))
    block, allow, distinct = counts.agg(F.sum("block"), F.sum("allow"), F.count("*")).first()
    odds = F.log((F.col("block") + 1) / F.lit(block + distinct + 1)) - F.log((F.col("allow") + 1) / F.lit(allow + distinct + 1))
    blocked, allowed = decided.agg(*each).first()
    return counts.select("w", odds.alias("weight")), math.log((blocked + 1) / (allowed + 1))


def judge(pages: DataFrame, rules: tuple = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, words) of every url; words are the segmented tokens."""
    rows = tokenized(split_urls(pages, rules, key, url))
    table, prior = weights(rows)
    asked = rows.where("ruled IS NULL").select("uid", F.explode("tokens").alias("w"))
    sums = asked.join(table, "w").groupBy("uid").agg(F.sum("weight").alias("sum"))
    score = F.lit(prior) + F.coalesce("sum", F.lit(0.0))
    verdict = F.coalesce("ruled", F.when(score > 1e-12, "block").otherwise("allow"))
    return rows.join(sums, "uid", "left").select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), F.array_join("tokens", " ").alias("words"))
