import json

from postrail.operators import decode, setops
from postrail.plans.cli import main, without_extremes
from postrail.sources import write_docs
from postrail.streaming import append, load_appended

LISTS = {0: list(range(3, 900, 3)), 1: [5, 6, 9, 300], 2: [6, 12, 300, 4_000_000_000]}


def test_command_line(spark, tmp_path, capsys):
    rows = [(i, d) for i, docs in LISTS.items() for d in docs]
    write_docs(spark.createDataFrame(rows, "list_id long, doc_id long"), str(tmp_path / "c"), 10)
    (tmp_path / "q").write_text("0 1\n1 2\n0 1 2\n")
    index = str(tmp_path / "i")
    built = main(["build", str(tmp_path / "c"), index, "--check", "--log", str(tmp_path / "log")], spark)
    assert built["integers"] == len(rows) and built["unequal"] == 0 and sum(built["epsilons"].values()) == 3
    assert main(["build", str(tmp_path / "c"), index, "--read-only"], spark)["size_bytes"] == built["size_bytes"]
    assert main(["decode", index, "--mode", "normal", "--rounds", "2"], spark)["integers"] == len(rows)
    assert main(["query", index, str(tmp_path / "q")], spark)["total"] == 3 + 2 + 2
    assert main(["query", index, str(tmp_path / "q"), "--type", "OR"], spark)["queries"] == 3
    assert main(["residuals", index], spark)["original_bits"] > 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["integers"] == len(rows)
    assert without_extremes([9, 1, 2, 6]) == 2


def test_stream_appends(spark, tmp_path):
    rows = [(i, d) for i, docs in LISTS.items() for d in docs]
    for part, own in (("a", [r for r in rows if r[1] < 100]), ("b", [r for r in rows if r[1] >= 100])):
        spark.createDataFrame(own, "list_id long, doc_id long").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("list_id long, doc_id long").parquet(str(tmp_path / "in"))
        append(stream, str(tmp_path / "out"), str(tmp_path / "progress"), availableNow=True).awaitTermination()
    index = load_appended(spark, str(tmp_path / "out"))
    decoded = decode.decode(index.segments)
    assert sorted((r.list_id, r.doc_id) for r in decoded.collect()) == sorted(rows)
    assert [r.doc_id for r in decoded.where("list_id = 0").orderBy("pos").collect()] == LISTS[0]
    assert {r.doc_id for r in setops.and_query(decoded.select("list_id", "doc_id"), [0, 1]).collect()} == {6, 9, 300}
