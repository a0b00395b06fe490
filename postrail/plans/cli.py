"""Command line: build an index of a collection, decode it against the clock, run a query file.

python -m postrail.plans.cli build COLLECTION INDEX [--epsilon 63] [--check] [--log FOLDER]
python -m postrail.plans.cli decode INDEX [--mode simd] [--rounds 3]
python -m postrail.plans.cli query INDEX QUERIES [--type AND] [--rounds 2]
python -m postrail.plans.cli residuals INDEX
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession

from ..operators import decode as decoding
from ..operators import setops, stats
from ..operators.lines import EPSILONS
from ..operators.model import build_index
from ..sources import load_index, read_docs, read_queries, save_index


def timed(rows: DataFrame) -> float:
    began = time.perf_counter()
    rows.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def without_extremes(seconds: list[float]) -> float:
    """The mean but for the first, and but for the greatest and least of what is left if there are three or more."""
    kept = sorted(seconds[1:] or seconds)
    kept = kept[1:-1] if len(kept) > 2 else kept
    return sum(kept) / len(kept)


def statistics(spark: SparkSession, path: str, log: str | None) -> dict:
    index = load_index(spark, path)
    totals = stats.index_statistics(index)
    if log:
        totals.write.mode("overwrite").json(f"{log}/statistics")
        stats.epsilon_histogram(index.lists).write.mode("overwrite").json(f"{log}/epsilons")
        stats.covered(index.segments).write.mode("overwrite").parquet(f"{log}/covered")
    return totals.first().asDict() | {"epsilons": {r.epsilon: r.lists for r in stats.epsilon_histogram(index.lists).collect()}}


def build(spark: SparkSession, args: argparse.Namespace) -> dict:
    rows = read_docs(spark, args.collection, args.drop_last)
    if not args.read_only:
        save_index(build_index(rows, args.epsilon), args.index)
    out = statistics(spark, args.index, args.log)
    if args.check:
        out["unequal"] = decoding.unequal(decoding.decode(load_index(spark, args.index).segments), rows.select("list_id", "doc_id").distinct()).first()[0]
    return out


def decode(spark: SparkSession, args: argparse.Namespace) -> dict:
    index = load_index(spark, args.index)
    n = index.lists.agg({"n": "sum"}).first()[0] or 0
    seconds = without_extremes([timed(decoding.decode(index.segments, args.mode)) for _ in range(args.rounds)])
    return {"integers": n, "seconds": seconds, "ns_per_integer": 1e9 * seconds / max(1, n)}


def query(spark: SparkSession, args: argparse.Namespace) -> dict:
    index, asked = load_index(spark, args.index), read_queries(spark, args.queries)
    results = setops.on_index(index, asked, args.type, args.strict)
    sizes = setops.query_sizes(index.lists, asked).first()
    seconds = without_extremes([timed(results) for _ in range(args.rounds)])
    return {"queries": sizes.queries, "avg_query_total_size": sizes.avg_size, "total": setops.total(results).first()[0], "us_per_query": 1e6 * seconds / max(1, sizes.queries)}


def residuals(spark: SparkSession, args: argparse.Namespace) -> dict:
    index = load_index(spark, args.index)
    if args.log:
        stats.residual_quantiles(index.segments).write.mode("overwrite").json(f"{args.log}/quantiles")
    return stats.second_difference_report(index).first().asDict()


def bound(text: str) -> int | str:
    if text == "adaptive" or int(text) in EPSILONS:
        return text if text == "adaptive" else int(text)
    raise argparse.ArgumentTypeError(f"adaptive or one of {EPSILONS}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="postrail")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("build")
    one.add_argument("collection")
    one.add_argument("index")
    one.add_argument("--epsilon", type=bound, default="adaptive")
    one.add_argument("--read-only", action="store_true")
    one.add_argument("--check", action="store_true")
    one.add_argument("--drop-last", action="store_true")
    two = commands.add_parser("decode")
    two.add_argument("index")
    two.add_argument("--mode", choices=("simd", "normal"), default="simd")
    two.add_argument("--rounds", type=int, default=3)
    three = commands.add_parser("query")
    three.add_argument("index")
    three.add_argument("queries")
    three.add_argument("--type", choices=("AND", "OR"), default="AND")
    three.add_argument("--rounds", type=int, default=2)
    three.add_argument("--strict", action="store_true")
    four = commands.add_parser("residuals")
    four.add_argument("index")
    for x in (one, four):
        x.add_argument("--log")
    args = parser.parse_args(argv)
    out = {"build": build, "decode": decode, "query": query, "residuals": residuals}[args.command](spark or SparkSession.builder.getOrCreate(), args)
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
