"""The corpus pipeline: toxicity, SimHash near-dedup, substring dedup, benchmark decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs`, and returns what the next one reads.
All but the last keep the columns of documents; n_chars follows the text where a stage changes it.
Rows with null ids or texts pass through; other columns of `docs` are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postrail.llm import decontaminate, sampling, sentencepiece_codec, shingles, substrings, toxicity
from postrail.llm.common import remainder, stored, table
from postrail.llm.queries import tokenizer_path


def _carried(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under names that no operator's own column has."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _restored(rows: DataFrame, names: dict[str, str], text: Column | None = None) -> DataFrame:
    """Under the names of documents again; with `text`, texts and n_chars are replaced."""
    changed = {} if text is None else {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[changed.get(c, F.col(n)).alias(c) for c, n in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the classifier calls toxic. It is fitted on a bounded sample of the labelled rows."""
    model = toxicity.fit(sampling.sample(docs, table(spark, sf_dir, "labels"), "toxic", remainder(5) > 0))
    rows, names = _carried(docs)
    return _restored(toxicity.score(rows, model, tuple(names.values()), names["text"]).where("score < 0.5"), names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component the row with the least id; repeated rows count once.

    Texts link if their sets of 5-word shingles have a Jaccard similarity of at least 0.8; SimHash and MinHash propose the pairs.
    """
    rows, names = _carried(docs)
    key, text = names["doc_id"], names["text"]
    keepers = shingles.keepers(rows, text, key)
    rows = rows.withColumn("own", F.xxhash64(text))
    kept = rows.join(keepers, F.col(key).eqNullSafe(F.col("key")) & (F.col("own") == F.col("body")), "left_semi")
    return _restored(kept.dropDuplicates([key, "own"]), names)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out words of passages that documents with smaller ids have; other texts stay as they are."""
    rows, names = _carried(docs)
    found = substrings.remove_repeats(rows, keep=names.values(), text=names["text"], key=names["doc_id"])
    return _restored(found, names, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(names["text"])))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the words that lie in a benchmark window."""
    rows, names = _carried(docs)
    carried = [n for c, n in names.items() if c not in ("text", "n_chars")]
    found = decontaminate.find(rows, table(spark, sf_dir, "benchmark"), keep=carried, text=names["text"])
    return _restored(found, names, F.col("clean"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    coded = sentencepiece_codec.encode_decode(docs, tokenizer_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("SentencePiece encoding", encode),
]
# Classifier, fingerprints and tokenizer have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
