"""Raw ids, whole task texts, files of any bytes, tolerant lines, upserts and subtotals."""

import json

import pytest

from assayer.operators import report
from assayer.sources import artifacts, cases


def test_long_ids_stay_apart(spark):
    start = "x" * 200
    rows = spark.createDataFrame([(0, start + "a"), (1, start + "b"), (2, "a b")], "pos int, case_id string")
    got = cases.normalize_cases(rows, "kaggledbqa").collect()
    assert {r["case_id"] for r in got} == {start + "a", start + "b", "a b"}
    assert sorted(r["safe_id"] for r in got) == ["a_b", "x" * 140, "x" * 140]
    predictions = spark.createDataFrame([(start + "b", "SELECT 1")], "case_id string, pred_sql string")
    assert cases.normalize_cases(rows, "kaggledbqa").join(predictions, "case_id").count() == 1


def test_task_texts_are_whole(spark):
    files = [("t", "README.md", "r" * 7000), ("u", "a.md", "b" * 6001), ("u", "b.md", "c" * 10)]
    got = {r["task"]: r for r in cases.task_texts(spark.createDataFrame(files, "task string, name string, text string")).collect()}
    assert got["t"]["question"] == "# README.md\n" + "r" * 7000 and got["t"]["shortened"] == "# README.md\n" + "r" * 6000
    assert got["t"]["chars_cut"] == 1000 and got["u"]["chars_cut"] == 1
    assert got["u"]["question"] == "# a.md\n" + "b" * 6001 + "\n\n# b.md\n" + "c" * 10


def test_files_of_any_bytes(spark, tmp_path):
    contents = {"plain": b"SELECT 1\n", "broken": b"a\xffb\xc3", "empty": b"", "cut": "é".encode() + b"\xe2\x82"}
    for case, content in contents.items():
        (tmp_path / "run" / case).mkdir(parents=True)
        (tmp_path / "run" / case / "predicted.sql").write_bytes(content)
    (tmp_path / "run" / "plain" / "other.sql").write_bytes(b"no")
    expected = spark.createDataFrame([("run", c) for c in [*contents, "absent"]], "run_id string, case_id string")
    got = {r["case_id"]: tuple(r)[2:] for r in artifacts.read_case_files(spark, str(tmp_path), "predicted.sql", expected).collect()}
    assert got == {
        "plain": ("SELECT 1\n", 9, False, True),
        "broken": ("a�b�", 4, True, True),
        # Spark's readers pass over empty files
        "empty": (None, None, None, False),
        "cut": ("é�", 4, True, True),
        "absent": (None, None, None, False),
    }


def test_later_lines_win_across_splits(spark, tmp_path):
    line = lambda name, gold: json.dumps({"instance_id": name, "evaluation": {"parameters": {"gold": gold}}, "more": "x" * 50})
    rows = [line(f"t{i % 40}", f"g{i}") if i % 10 else ["{bad", "[1]", "", json.dumps({"instance_id": "t1"}), line("t2", "")][i // 10 % 5] for i in range(1000)]
    (tmp_path / "a.jsonl").write_text("\n".join(rows))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "7000")
    try:
        read = artifacts.read_gold_lines(spark, str(tmp_path))
        starts = read.select("place.start").distinct().count()
        states = {r["state"]: r["n"] for r in read.groupBy("state").count().withColumnRenamed("count", "n").collect()}
        got = {r["instance_id"]: r["gold"] for r in artifacts.read_gold_names(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set(key, before)
    assert starts > 5 and states == {"used": 900, "broken": 40, "incomplete": 40}
    want = {}
    for i in range(1000):
        if i % 10:
            want[f"t{i % 40}"] = f"g{i}"
    assert got == want


def test_manifest_upserts(spark, tmp_path):
    path = str(tmp_path / "manifest")
    put = lambda rows: artifacts.upsert_manifest(spark.createDataFrame(rows, "name string, status string, setup_at bigint"), path)
    put([(f"n{i}", "ready", i) for i in range(200)] + [("n0", "later", 500)])
    put([("n1", "again", 0), ("new", "ready", 7)])
    sources = spark.createDataFrame([("n2", "git", "n2/repo")], "name string, type string, path string")
    listing = spark.createDataFrame([("n2/repo/a", 5)], "path string, bytes bigint")
    errors = spark.createDataFrame([("n2", "boom", 9)], "name string, error string, setup_at bigint")
    artifacts.upsert_manifest(artifacts.failure_records(sources, listing, errors), path)
    got = {r["name"]: r for r in artifacts.read_manifest(spark, path).collect()}
    assert len(got) == 201 and got["n0"]["status"] == "later" and got["n1"]["status"] == "again" and got["n3"]["setup_at"] == 3
    assert got["n2"]["status"] == "failed" and got["n2"]["error"] == "boom" and got["n2"]["artifacts"][0]["bytes"] == 5
    assert got["n1"]["error"] is None and got["new"]["status"] == "ready"


def test_subtotals(spark):
    rows = [("a", "x", 1, 2, 0, 0.5), ("a", "y", 0, 2, 1, 0.25), ("a", "y", 1, 1, 0, 0.25), ("b", None, 0, 0, 0, 0.0)]
    schema = "model string, benchmark string, exact_matches bigint, total_evaluated bigint, prediction_error_count bigint, estimated_cost_usd double"
    got = {(r["level"], r["model"], r["benchmark"]): r for r in report.roll_up_levels(spark.createDataFrame(rows, schema), "model", "benchmark").collect()}
    assert set(got) == {(0, "a", "x"), (0, "a", "y"), (0, "b", None), (1, "a", None), (1, "b", None), (3, None, None)}
    assert got[1, "a", None]["cost_per_exact_match_usd"] == 0.5 and got[3, None, None]["runs"] == 4
    assert round(got[0, "a", "y"]["execution_accuracy_pct"], 6) == 33.333333 and got[0, "b", None]["execution_accuracy_pct"] is None


def test_case_files_are_dealt_over_tasks(spark, tmp_path):
    rows = [("en", f"c{i}", f"text {i}") for i in range(40)] + [("en", "twice", "a")] * 2
    files = spark.createDataFrame(rows, "run string, case string, value string")
    for name, given in (("one_split", files.coalesce(1)), ("many_splits", files.repartition(7))):
        artifacts.write_case_files(given, str(tmp_path / name))
        written = list((tmp_path / name).rglob("*.txt"))
        assert len(written) == 41 and len({f.name.split("-")[1] for f in written}) > 1
        assert next((tmp_path / name / "run=en" / "case=twice").glob("*.txt")).read_text() == "a\na\n"


def test_case_files_are_written_by_their_tasks(spark, tmp_path):
    names = ["a b", "x:y/z%", "it's #1?*[q]{^}=\\", "\t\n\x7f", "", None, "é", "__"]
    rows = [(run, case, f"{run} {case}") for run in names for case in names] + [("r", "none", None), ("r", "two", "1"), ("r", "two", "1")]
    files = spark.createDataFrame(rows, "run string, case string, value string")
    raw = files.unionByName(spark.sql("SELECT 'r' AS run, 'bytes' AS case, CAST(X'FF78' AS STRING) AS value"))
    contents = lambda folder: sorted((str(f.parent.relative_to(folder)), b"\n".join(sorted(f.read_bytes().split(b"\n")))) for f in folder.rglob("*.txt"))
    raw.repartition("run", "case").write.partitionBy("run", "case").text(str(tmp_path / "spark"))
    artifacts.write_case_files(raw, str(tmp_path / "own"))
    assert contents(tmp_path / "own") == contents(tmp_path / "spark")
    # neither checksums nor a commit's mark nor half a file: nothing but the files
    assert all(f.suffix == ".txt" for f in (tmp_path / "own").rglob("*") if f.is_file())
    with pytest.raises(FileExistsError):
        artifacts.write_case_files(raw, str(tmp_path / "own"))


def test_case_files_are_read_by_their_tasks(spark, tmp_path, monkeypatch):
    for place in ("run/c1", "run/c2", "deep/er/run/c1", "run/.hidden", "run/_left", "run/_k=v", "other/c1", "run/c3", "_x/run/c4"):
        (tmp_path / place).mkdir(parents=True)
        for name in ("a.txt", "b.txt", "c.sql", ".d.txt", "_e.txt", "_f=.txt", "empty.txt"):
            (tmp_path / place / name).write_bytes(b"" if name == "empty.txt" else f"{place} {name} \xff".encode("latin-1"))
    rows = [(c, r, n) for n, c in enumerate(["c1", "c1", "c2", "absent", ".hidden", "_left", "_k=v", "c4", None]) for r in ("run", "other", None)]
    expected = spark.createDataFrame(rows, "case_id string, run_id string, more int")
    read = lambda name: artifacts.read_case_files(spark, str(tmp_path), name, expected)
    monkeypatch.setattr(artifacts, "READ_BYTES", 20)
    own = {name: read(name) for name in ("*.txt", "c.sql", "{a,b}.txt", "nothing")}
    # a plan that lists files on the driver has a scan of them
    assert all(("binaryFile" in df._jdf.queryExecution().toString()) == ("{" in name) for name, df in own.items())
    monkeypatch.setattr(artifacts, "_mounted", lambda spark, folder: None)
    in_order = lambda df: sorted(map(repr, df.collect()))
    for name, df in own.items():
        assert df.schema.simpleString() == read(name).schema.simpleString() and in_order(df) == in_order(read(name))
    assert df.count() == len(rows) and own["*.txt"].where("found").count() > 10
