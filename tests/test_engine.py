"""The engine over Spark: odd lists, files, stored indexes, queries and properties."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postrail.functions.zorder import next_codes
from postrail.operators import decode, packing, search, setops, spatial, stats
from postrail.operators.model import build_index, chunks, differences
from postrail.sources import files, keys_from, load_index, load_lists, read_docs, read_queries, sample_lists, save_index, settle, write_docs
from postrail.streaming import load_appended, store_batch

from .test_lines import LISTS


@pytest.fixture(scope="module")
def rows():
    return [(i, d) for i, docs in enumerate(LISTS.values()) for d in docs]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows + rows[:50], "list_id long, doc_id long").repartition(3)


def pairs(df):
    return sorted((r.list_id, r.doc_id) for r in df.select("list_id", "doc_id").collect())


@pytest.mark.parametrize("epsilon", [1, 7, 4095, "adaptive"])
@pytest.mark.parametrize("chunk", [1 << 18, 100])
def test_round_trip(table, rows, epsilon, chunk):
    index = build_index(table, epsilon, chunk)
    decoded = decode.decode(index.segments).collect()
    assert sorted((r.list_id, r.doc_id) for r in decoded) == sorted(rows)
    for i, docs in enumerate(LISTS.values()):
        assert [d for _, d in sorted((r.pos, r.doc_id) for r in decoded if r.list_id == i)] == docs
        assert sorted(r.pos for r in decoded if r.list_id == i) == list(range(len(docs)))
    for r in index.lists.collect():
        assert r.n == len(list(LISTS.values())[r.list_id]) and r.size_bytes == r.segment_bytes + r.correction_bytes + r.sign_bytes
    ids = index.segments.groupBy("list_id").agg(F.count("*").alias("n"), F.countDistinct("seg_id").alias("d"), F.max("seg_id").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in ids)


def test_sizes_and_choice(table):
    sized = {}
    for epsilon in (1, 3, 7, 15, 31, 63):
        for r in build_index(table, epsilon).lists.collect():
            sized.setdefault(r.list_id, {})[epsilon] = r
            words = lambda bits: -(-bits // 64)
            b = 0 if epsilon < 3 else 1 if epsilon < 7 else 2
            wide = epsilon.bit_length()
            columns = sum(words(r.n_segments * w) for w in (r.bpc_first, r.bpc_intercept, r.bpc_slope_significand, r.bpc_slope_exponent))
            corrections = words(r.n * (wide - b)) + (words(r.n_exceptions * (wide + 1)) if b else 0)
            assert (r.segment_bytes, r.correction_bytes, r.sign_bytes) == (8 * columns, 8 * corrections, (r.n + r.n_exceptions) // 8)
    for r in build_index(table).lists.collect():
        assert all((r.size_bytes, r.epsilon) <= (x.size_bytes, e) for e, x in sized[r.list_id].items())


def test_differences_rebuild_the_postings(table, rows):
    index = build_index(table, 15)
    assert pairs(decode.decode_differences(differences(index.segments), index.segments)) == sorted(rows)
    counted = {r.list_id: r.n for r in differences(index.segments).where("is_exception").groupBy("list_id").agg(F.count("*").alias("n")).collect()}
    assert {r.list_id: r.n_exceptions for r in index.lists.collect() if r.n_exceptions} == counted


@pytest.mark.parametrize("epsilon", [1, 3, 15, 4095, "adaptive"])
@pytest.mark.parametrize("part", [1 << 18, 128])
def test_packed_storage(spark, tmp_path, monkeypatch, table, rows, epsilon, part):
    monkeypatch.setattr(packing, "PART", part)
    index = settle(build_index(table, epsilon))
    packing.pack_index(index.segments).write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    back = packing.decode_packed(stored).collect()
    assert sorted((r.list_id, r.doc_id) for r in back) == sorted(rows)
    assert sorted((r.list_id, r.pos) for r in back) == [(i, p) for i, docs in enumerate(LISTS.values()) for p in range(len(docs))]
    if part == 1 << 18:
        sizes = {r.list_id: r.size_bytes_with_covered - r.sign_bytes + -(-r.n // 8) + -(-r.n_exceptions // 8) for r in index.lists.collect()}
        assert {r.list_id: r.bytes for r in packing.written_bytes(stored).collect()} == sizes


def test_chunks_go_by_rank(spark):
    """A dense run and one far posting: chunks are cut by counts, however close the postings lie."""
    dense = spark.range(200_000).selectExpr("1L AS list_id", "id AS doc_id").union(spark.sql("SELECT 1L, 4000000000L")).union(spark.range(900).selectExpr("2L", "id * 7"))
    found = chunks(dense, 1000).select("list_id", "chunk", F.size("docs").alias("n")).collect()
    assert max(r.n for r in found if r.list_id == 1) < 2000 and sum(r.n for r in found) == 200_901
    assert [(r.chunk, r.n) for r in found if r.list_id == 2] == [(None, 900)]


def test_nothing_stays_in_memory(spark, table):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    build_index(table).lists.count()
    build_index(table, 7, 100).segments.count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_appended_index(spark, tmp_path):
    """Three batches, among them overlapping ones and one without some list."""
    lists = {0: list(range(3, 900, 3)), 1: [5, 6, 9, 300], 2: [6, 12, 300, 4_000_000_000]}
    rows = [(i, d) for i, docs in lists.items() for d in docs]
    parts = [[r for r in rows if r[1] < 100], [r for r in rows if r[1] >= 100 and r[1] % 2], [r for r in rows if r[1] >= 100 and r[1] % 2 == 0 or r[1] == 6]]
    for number, own in enumerate(parts):
        store_batch(spark.createDataFrame(own, "list_id long, doc_id long"), str(tmp_path), number)
    index = load_appended(spark, str(tmp_path))
    asked = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2), (2, 0), (2, 7)], "query_id long, list_id long")
    sets = {i: set(d) for i, d in lists.items()}
    got = lambda kind: sorted((r.query_id, r.doc_id) for r in setops.on_index(index, asked, kind).collect())
    assert got("AND") == sorted([(0, d) for d in sets[0] & sets[1]] + [(1, d) for d in sets[1] & sets[2]])
    assert got("OR") == sorted([(0, d) for d in sets[0] | sets[1]] + [(1, d) for d in sets[1] | sets[2]] + [(2, d) for d in sets[0]])
    probes = [(i, k) for i in (0, 1, 2, 9) for k in (-1, 0, 5, 6, 7, 100, 101, 299, 300, 301, 2**31, 2**32)]
    found = {(r.list_id, r.key): r.next_geq for r in search.next_geq_on(index.segments, spark.createDataFrame(probes, "list_id long, key long")).collect()}
    assert found == {(i, k): min((d for d in lists.get(i, []) if d >= k), default=None) for i, k in probes}


def test_lines_that_cannot_match_are_not_read(spark, tmp_path):
    """Lists that meet in a few blocks of ids only: other lines are left out, and the answers are whole."""
    far = 1 << 20
    rows = [(1, z * far * 3 + d) for z in range(40) for d in range(0, 300, 3)] + [(2, z * far * 5 + d) for z in range(40) for d in range(0, 300, 2)]
    index = settle(build_index(spark.createDataFrame(rows, "list_id long, doc_id long"), 15), str(tmp_path / "i"))
    asked = spark.createDataFrame([(0, 1), (0, 2)], "query_id long, list_id long")
    lines = setops.meeting(index.segments, index.lists, asked)
    assert 0 < lines.count() < 0.6 * index.segments.count()
    both = {d for i, d in rows if i == 1} & {d for i, d in rows if i == 2}
    assert {r.doc_id for r in setops.on_index(index, asked, "AND").collect()} == both
    share = setops.read_share(index, asked).first()
    assert share.postings == len(rows) and 0 < share.read < 0.6 * len(rows)
    plan = search.next_geq(index.segments.select("list_id", F.col("seg_max_doc").alias("doc_id")), spark.createDataFrame([(1, 5)], "list_id long, key long"))
    assert "residual" not in plan._jdf.queryExecution().executedPlan().toString()


def test_bad_postings_are_refused(spark):
    for bad in (2**32 - 1, -1):
        with pytest.raises(Exception, match="out of range"):
            build_index(spark.createDataFrame([(1, 5), (1, bad)], "list_id long, doc_id long"), 1).segments.collect()
    with pytest.raises(ValueError):
        build_index(spark.createDataFrame([(1, 5)], "list_id long, doc_id long"), 2)


def test_empty(spark):
    none = spark.createDataFrame([], "list_id long, doc_id long")
    index = build_index(none)
    assert index.lists.count() == 0 and decode.decode(index.segments).count() == 0
    assert setops.and_batch(none, spark.createDataFrame([(0, 1)], "query_id long, list_id long")).count() == 0


def test_collection_files(spark, tmp_path, rows):
    table = spark.createDataFrame(rows, "list_id long, doc_id long")
    write_docs(table, str(tmp_path / "c"), universe=123)
    raw = np.fromfile(tmp_path / "c" / "00000.docs", "<u4")
    assert raw[:3].tolist() == [1, 123, 1] and len(raw) == 2 + len(LISTS) + len(rows)
    back = read_docs(spark, str(tmp_path / "c" / "*.docs"))
    assert pairs(back) == sorted(rows)
    assert back.where("list_id = 2 AND pos = 4").first().doc_id == LISTS["arithmetic"][4]
    short = read_docs(spark, str(tmp_path / "c"), compat_drop_last=True)
    assert short.count() == len(rows) - len(LISTS)
    (tmp_path / "bad.docs").write_bytes(b"\x02\0\0\0\1\0\0\0")
    with pytest.raises(Exception, match="no collection"):
        read_docs(spark, str(tmp_path / "bad.docs")).count()


def test_large_collection_files(spark, tmp_path, monkeypatch, rows):
    """Files beyond the bound are read in parts of a few lists; the postings are the same."""
    monkeypatch.setattr(files, "WHOLE", 100)
    monkeypatch.setattr(files, "WINDOW", 700)
    write_docs(spark.createDataFrame(rows, "list_id long, doc_id long"), "file://" + str(tmp_path / "c"), universe=123, parts=2)
    back = read_docs(spark, str(tmp_path / "c"))
    assert sorted((r.doc_id) for r in back.collect()) == sorted(d for _, d in rows)
    one = read_docs(spark, str(tmp_path / "c" / "00000.docs"))
    n = one.agg(F.max("list_id")).first()[0] + 1
    assert pairs(one) == sorted(r for r in rows if r[0] < n)
    assert back.rdd.getNumPartitions() > 1
    files._store("relative/path")
    assert [len(b) for b in files._spans(iter([pa.RecordBatch.from_pydict({"path": [str(tmp_path / "c" / "00000.docs")]})]))][0] > 1
    (tmp_path / "cut.docs").write_bytes((tmp_path / "c" / "00000.docs").read_bytes()[:-4])
    with pytest.raises(Exception, match="ends within list"):
        read_docs(spark, str(tmp_path / "cut.docs")).count()


def test_query_and_key_files(spark, tmp_path):
    (tmp_path / "q").write_text("1 2 3\n 4   4\n\n7 x 8\n9\n")
    got = sorted((r.query_id, r.list_id) for r in read_queries(spark, str(tmp_path / "q")).collect())
    assert got == [(0, 1), (0, 2), (0, 3), (1, 4), (3, 7), (4, 9)]
    np.array([3, 9, -2, 5], "<i8").tofile(tmp_path / "k")
    assert [r.key for r in keys_from(spark, str(tmp_path / "k")).collect()] == [-2, 5, 9]


def test_stored_index(spark, tmp_path, table, rows):
    save_index(build_index(table), str(tmp_path / "i"))
    index = load_index(spark, str(tmp_path / "i"))
    assert pairs(decode.decode(index.segments)) == sorted(rows)
    wanted = spark.createDataFrame([(2,), (5,), (99,)], "list_id long")
    own = load_lists(index, wanted)
    assert {r.list_id for r in own.lists.collect()} == {2, 5}
    plan = own.segments._jdf.queryExecution().toString()
    assert "PushedFilters: [In(list_id" in plan or "PushedFilters: [In(" in plan
    with pytest.raises(ValueError, match="99"):
        load_lists(index, wanted, strict=True)


def test_set_identities(spark):
    rng = random.Random(3)
    lists = {i: set(rng.sample(range(300), rng.randint(0, 200))) for i in range(1, 8)}
    rows = [(i, d) for i, s in lists.items() for d in s]
    table = spark.createDataFrame(rows, "list_id long, doc_id long")
    queries = [(0, 1), (0, 2), (0, 2), (1, 3), (2, 4), (2, 99), (3, 1), (3, 5), (3, 7), (4, 99)]
    asked = spark.createDataFrame(queries, "query_id long, list_id long")
    sets = {}
    for q, i in queries:
        sets.setdefault(q, []).append(lists.get(i, set()))
    both = sorted((q, d) for q, s in sets.items() for d in set.intersection(*s))
    any_ = sorted((q, d) for q, s in sets.items() for d in set.union(*s))
    index = build_index(table)
    for got in (setops.and_batch(table, asked), setops.on_index(index, asked, "AND")):
        assert sorted((r.query_id, r.doc_id) for r in got.collect()) == both
    for got in (setops.or_batch(table, asked), setops.on_index(index, asked, "OR")):
        assert sorted((r.query_id, r.doc_id) for r in got.collect()) == any_
    assert setops.total(setops.batch(table, asked, "OR")).first()[0] == len(any_)
    one = lambda df: {r.doc_id for r in df.collect()}
    assert one(setops.and_query(table, [1, 2, 2])) == lists[1] & lists[2]
    assert one(setops.and_chain(table, [1, 2, 5])) == lists[1] & lists[2] & lists[5]
    assert one(setops.and_query(table, [1, 99])) == set() == one(setops.and_query(table, []))
    assert one(setops.except_query(table, 1, [2])) == lists[1] - lists[2]
    with pytest.raises(ValueError):
        setops.batch(table, asked, "XOR")


@pytest.mark.parametrize("span", [1 << 20, 64])
def test_search_against_sorted_lists(spark, span):
    rng = random.Random(4)
    lists = {i: sorted(rng.sample(range(1000), rng.choice([1, 5, 300]))) for i in range(5)}
    table = spark.createDataFrame([(i, d) for i, s in lists.items() for d in s], "list_id long, doc_id long")
    probes = [(i, k) for i in lists for k in rng.sample(range(-5, 1010), 80)] + [(77, 3)]
    got = {(r.list_id, r.key): r for r in search.located(table, spark.createDataFrame(probes, "list_id long, key long"), span).collect()}
    assert set(got) == set(probes)
    for (i, k), r in got.items():
        s = lists.get(i, [])
        assert r.next_geq == next((d for d in s if d >= k), None)
        assert r.predecessor == next((d for d in reversed(s) if d <= k), None)
        assert r["rank"] == sum(d < k for d in s) and r.present == (k in s)
    near = {(r.list_id, r.doc_id): (r.previous, r.following) for r in search.neighbours(table, span).collect()}
    assert near == {(i, d): (s[j - 1] if j else None, s[j + 1] if j + 1 < len(s) else None) for i, s in lists.items() for j, d in enumerate(s)}


def test_statistics(table):
    index = build_index(table, 15)
    s = stats.index_statistics(index).first()
    assert s.integers == sum(map(len, LISTS.values())) and s.segments == index.segments.count()
    quantiles = {r.list_id: r for r in stats.residual_quantiles(index.segments).collect()}
    steps = {}
    for r in index.segments.collect():
        e = np.array(r.residual)
        steps.setdefault(r.list_id, []).extend(np.abs(np.diff(e, prepend=0)).tolist())
    for i, v in steps.items():
        v.sort()
        for name, (q, p) in stats.QUANTILES.items():
            assert quantiles[i][name] == v[len(v) // q * p]
    h = {r.list_id: r for r in stats.huffman_size(index).collect()}
    assert set(h) == set(steps)
    cost = {r.list_id: r for r in stats.second_difference_cost(index).collect()}
    for i in cost:
        assert cost[i].over_num == sum(int((np.abs(np.diff(np.array(r.residual))) > 15 >> 3).sum()) for r in index.segments.where(F.col("list_id") == i).collect())
    by = stats.gap_statistics_by_segment(index).where("list_id = 2").collect()
    assert all(r.mean_gap == 3.0 and r.var_gap == 0 for r in by)
    chosen = sample_lists(index.lists, 5, replacement=True)
    assert chosen.count() == 5 and sample_lists(index.lists, 3).count() == 3
    assert stats.random_segments(index.segments, chosen).count() == 5


def test_points(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 60), rng.randint(0, 60)) for i in range(400)]
    table = spark.createDataFrame(rows, "id long, x long, y long")
    got = [r.id for r in spatial.nearest(table, {"x": 10, "y": 20}, 7, "id").collect()]
    assert got == [i for _, i in sorted(((x - 10) ** 2 + (y - 20) ** 2, i) for i, x, y in rows)[:7]]
    coded = spatial.with_code(table, ["x", "y"], 8).collect()
    assert all(r.zcode == sum((r.x >> b & 1) << 2 * b | (r.y >> b & 1) << 2 * b + 1 for b in range(8)) for r in coded)


@pytest.mark.parametrize("n, bits", [(2, 4), (3, 3)])
def test_next_code_in_a_box(n, bits):
    rng = random.Random(n)
    codes = np.arange(1 << n * bits)
    of = lambda c: [sum((c >> b * n + d & 1) << b for b in range(bits)) for d in range(n)]
    for _ in range(40):
        low = [rng.randrange(1 << bits) for _ in range(n)]
        high = [rng.randrange(x, 1 << bits) for x in low]
        inside = [c for c in codes.tolist() if all(a <= x <= b for a, x, b in zip(low, of(c), high))]
        want = [next((c for c in inside if c >= z), -1) for z in codes.tolist()]
        assert next_codes(codes, low, high, bits).tolist() == want


def test_entry_without_the_corpus_part(spark):
    import subprocess
    import sys

    import os

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True)
    rest = "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    for gone in ("corpus_pipeline", "postrail.llm"):
        found = run(f"import sys; sys.modules['{gone}'] = None; {rest}")
        assert found.returncode == 0, found.stderr
    broken = run(f"import sys; sys.modules['ahocorasick'] = None; {rest}")
    if os.path.isdir(os.path.join(here, "postrail", "llm")):  # a library that is missing is no reason to go without
        assert broken.returncode and "ahocorasick" in broken.stderr


def test_a_key_is_met_once_in_an_appended_index(spark, tmp_path):
    """However many batches there are, keys aren't multiplied by them, repeated keys give one row, and far lines aren't joined away."""
    docs = {1: list(range(0, 4000, 7)), 2: [5, 2**21, 2**22 + 1, 4_000_000_000]}
    for number in range(5):
        own = [(i, d) for i, v in docs.items() for j, d in enumerate(v) if j % 5 == number or j % 11 == 0]
        store_batch(spark.createDataFrame(own, "list_id long, doc_id long"), str(tmp_path), number, 15)
    segments = load_appended(spark, str(tmp_path)).segments
    keys = [(i, k) for i in (1, 2, 3) for k in (-5, 0, 1, 6, 7, 3990, 3991, 3999, 2**20, 2**21, 2**21 + 1, 2**22 + 1, 2**22 + 2, 2**32)] * 2
    found = [tuple(r) for r in search.next_geq_on(segments, spark.createDataFrame(keys, "list_id long, key long")).collect()]
    assert sorted(found, key=str) == sorted({(i, k, min((d for d in docs.get(i, []) if d >= k), default=None)) for i, k in keys}, key=str)
    asked = spark.range(2000).selectExpr("1L AS list_id", "id AS key")
    plan = search.next_geq_on(segments, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(list_id" not in plan and "array_min" not in plan
