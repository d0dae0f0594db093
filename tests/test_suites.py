"""Suites from a work list: time limits, going on after a break, classes of equal results, cases of runs."""

import time

import pytest
from pyspark.sql import functions as F

from assayer.operators import evaluate, suites
from assayer.session import work_folder

CASES = "case_id string, db_id string, mode string, dialect string, gold_sql string, db_found boolean"
PREDICTIONS = "case_id string, model string, pred_sql string"
ENDLESS = "SELECT id FROM range(1000000000000)"


def tables(session):
    session.range(100).createOrReplaceTempView("numbers")


def suite(spark, rows):
    cases = spark.createDataFrame([(c, "db", "sql", "x", gold, True) for c, gold, _ in rows], CASES)
    return cases, spark.createDataFrame([(c, "m", pred) for c, _, pred in rows], PREDICTIONS)


def test_a_query_that_never_ends_is_stopped(spark):
    rows = [("a", "SELECT count(*) FROM numbers", ENDLESS), ("b", ENDLESS, "SELECT 1"), ("c", "SELECT id FROM numbers", "SELECT id + 0 FROM numbers")]
    start = time.time()
    got = {r["case_id"]: r for r in evaluate.evaluate_suite(spark, *suite(spark, rows), prepare=tables, seconds=6).collect()}
    assert time.time() - start < 90
    assert got["a"]["pred_error"] == suites.TIME_LIMIT and got["b"]["gold_error"] == suites.TIME_LIMIT
    assert got["c"]["exact_match"] and got["c"]["gold_row_count"] == 100


def test_the_suite_has_a_session_of_its_own(spark):
    before = spark.conf.get(suites.FILES_BY_PATH)
    rows = [("a", "SELECT count(*) FROM numbers", "SELECT 100"), ("b", "SELECT 1", "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`")]
    got = {r["case_id"]: r for r in evaluate.evaluate_suite(spark, *suite(spark, rows), prepare=tables).collect()}
    assert got["a"]["exact_match"] and got["b"]["pred_error"]
    assert spark.conf.get(suites.FILES_BY_PATH) == before and not spark.catalog.tableExists("numbers")


def test_a_run_goes_on_where_it_was(spark, monkeypatch):
    folder = work_folder(spark, "t")
    texts = [f"SELECT {i} FROM numbers" for i in range(7)] + ["", "DROP TABLE numbers", "SELECT nothing FROM numbers"]
    work = suites.work_list(spark.createDataFrame([(t,) for t in texts + texts], "sql string"), folder)
    batches = suites._batches

    def two_batches(rows, size):
        for i, batch in enumerate(batches(rows, size)):
            if i == 2:
                raise RuntimeError("broken off")
            yield batch

    with suites.suite_session(spark, tables) as session:
        monkeypatch.setattr(suites, "_batches", two_batches)
        with pytest.raises(RuntimeError):
            suites.run_profiles(session, work, folder, batch=2)
        kept = {r["query_id"]: r for r in spark.read.parquet(f"{folder}/status").collect()}
        monkeypatch.setattr(suites, "_batches", batches)
        # what ran before is not run again, even where its table has changed since
        session.range(5).createOrReplaceTempView("numbers")
        status = {r["query_id"]: r for r in suites.run_profiles(session, work, folder, batch=2).collect()}
    assert len(kept) == 4 and len(status) == 10 and all(status[q] == kept[q] for q in kept)
    assert all(r["rows"] == 5 for q, r in status.items() if q not in kept and r["error"] is None)
    assert {r["error"] for r in status.values() if r["error"]} >= {"empty SQL", "dangerous SQL refused"}


def test_rows_are_made_for_open_pairs_only(spark):
    rows = [("same text", "SELECT 1", "SELECT 1"), ("other count", "SELECT id FROM numbers", "SELECT 5"), ("other rows", "SELECT 2", "SELECT 3")]
    rows += [("empty", "SELECT 1 WHERE false", "SELECT 2 WHERE 1 = 0"), ("open", "SELECT 7 AS a", "SELECT 7.0 AS b"), ("open 2", "SELECT 7 AS a", "SELECT 7 AS c")]
    folder = work_folder(spark, "t")
    got = {r["case_id"]: r["exact_match"] for r in evaluate.evaluate_suite(spark, *suite(spark, rows), folder=folder, prepare=tables).collect()}
    assert got == {"same text": True, "other count": False, "other rows": False, "empty": True, "open": True, "open 2": True}
    assert spark.read.parquet(f"{folder}/rows").select("query_id").distinct().count() == 3


def test_equal_profiles_of_different_rows(spark):
    bags = [("a", ["x"], 2), ("b", ["x"], 2), ("c", ["y"], 2), ("d", ["y"], 2), ("e", ["x"], 1), ("e", ["y"], 1), ("f", ["x"], 2)]
    kinds = [(q, 1) for q in "abcde"] + [("f", 2), ("gone", 1)]
    got = suites.result_classes(
        spark.createDataFrame(bags, suites.BAG_SCHEMA), spark.createDataFrame(kinds, "query_id string, kind int")
    )
    classes = dict(map(tuple, got.collect()))
    assert classes == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e", "f": "f", "gone": "gone"}


def test_cases_of_many_runs(spark):
    cases = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1")], "benchmark string, case_id string")
    runs = [("all", "x", None), ("none", "x", []), ("one", "x", ["2", "2", "9"]), ("other", "y", ["1"]), ("lost", "z", None)]
    got = suites.run_cases(cases, spark.createDataFrame(runs, "run_id string, benchmark string, case_ids array<string>"))
    assert sorted((r["run_id"], r["case_id"]) for r in got.collect()) == [
        ("all", "1"), ("all", "2"), ("none", "1"), ("none", "2"), ("one", "2"), ("other", "1")
    ]


def test_a_short_result_is_run_once(spark, monkeypatch):
    folder, given = work_folder(spark, "t"), []
    texts = ["SELECT id % 2 AS a, 'x' AS b FROM numbers WHERE id < 64", "SELECT id FROM numbers", "SELECT 1 WHERE false", "SELECT repeat('ab', 3000)"]
    texts += ["SELECT CAST(NULL AS INT)", "SELECT nothing FROM numbers"]
    work = suites.work_list(spark.createDataFrame([(t,) for t in texts], "sql string"), folder)
    long, profiles = suites.row_bag, suites.profile
    monkeypatch.setattr(suites, "profile", lambda result: given.append("profile") or profiles(result))
    monkeypatch.setattr(suites, "row_bag", lambda result: given.append("rows") or long(result))
    with suites.suite_session(spark, tables) as session:
        status = suites.run_profiles(session, work, folder)
        assert given == ["profile"] * 2  # of many rows and of a wide row
        found = {r["query_id"]: r for r in status.join(work, "query_id").collect()}
        for row in found.values():
            if row["error"] is None:
                assert (row["rows"], row["print"], row["check"]) == profiles(session.sql(row["sql"]))
        done = work.join(status.where("error IS NULL"), "query_id", "left_semi")
        bags = {(r["query_id"], tuple(r["row"])): r["n"] for r in suites.write_bags(session, done, status, folder).collect()}
        assert given.count("rows") == 2
        for row in found.values():
            if row["error"] is None:
                rows = {tuple(r["row"]): r["n"] for r in long(session.sql(row["sql"])).collect()}
                assert {cells: n for (q, cells), n in bags.items() if q == row["query_id"]} == rows
    assert sorted(r["rows"] for r in found.values() if r["error"] is None) == [0, 1, 1, 64, 100]


def test_a_copy_in_order_of_a_column_keeps_all_rows(spark):
    table = spark.range(1000).selectExpr("if(id % 10 = 0, NULL, id % 7) AS k", "id % 50 AS v")
    copy = suites.in_order_of(table, "k")
    assert copy.schema == table.schema and copy.exceptAll(table).isEmpty() and table.exceptAll(copy).isEmpty()
    # no file's values reach into another file's
    files = copy.where("k IS NOT NULL").groupBy("_metadata.file_path").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    spans = sorted((r["low"], r["high"]) for r in files.collect())
    assert all(before[1] < after[0] for before, after in zip(spans, spans[1:]))


def test_a_query_that_fails_for_its_rows_is_an_error(spark, monkeypatch):
    long, rows_of = "SELECT id FROM numbers", suites.row_bag

    def some_fail(result):
        if "lost" in result.columns:
            raise RuntimeError("gone")
        return rows_of(result)

    monkeypatch.setattr(suites, "row_bag", some_fail)
    rows = [("pred", long, "SELECT id AS lost FROM numbers"), ("gold", "SELECT id + 0 AS lost FROM numbers", long), ("fine", long, "SELECT id * 1 FROM numbers")]
    rows += [("both", "SELECT id AS lost FROM numbers", "SELECT id AS lost FROM numbers")]
    folder = work_folder(spark, "t")
    details = evaluate.evaluate_suite(spark, *suite(spark, rows), folder=folder, prepare=tables)
    got = {r["case_id"]: (r["exact_match"], r["gold_error"], r["pred_error"], r["gold_row_count"], r["pred_row_count"]) for r in details.collect()}
    error = "RuntimeError: gone"
    assert got == {
        "pred": (False, None, error, 100, 0), "gold": (False, error, None, 0, 100), "fine": (True, None, None, 100, 100), "both": (False, error, error, 0, 0)
    }
    summary = evaluate.summarize(details, "model").first()
    assert (summary["total_evaluated"], summary["exact_matches"], summary["prediction_error_count"]) == (2, 1, 1)
    _, status = evaluate.execute_texts(spark, ["SELECT id AS lost FROM range(100)", "SELECT id FROM range(100)"])
    assert sorted(str(r["error"]) for r in status.collect()) == ["None", error]


def test_a_stopped_query_has_a_second_try_for_its_rows(spark, monkeypatch):
    folder, tries = work_folder(spark, "t"), []
    work = suites.work_list(spark.createDataFrame([("SELECT id FROM numbers",), ("SELECT id + 1 FROM numbers",)], "sql string"), folder)
    limited = suites._limited

    def late(session, seconds, job):
        tries.append(seconds)
        return (None, suites.TIME_LIMIT) if len(tries) <= 3 else limited(session, seconds, job)

    with suites.suite_session(spark, tables) as session:
        status = suites.run_profiles(session, work, folder)
        monkeypatch.setattr(suites, "_limited", late)
        bags = suites.write_bags(session, work, status, folder, seconds=60)
        assert bags.groupBy("query_id").agg(F.sum("n").alias("n")).select("n").collect() == [(100,), (100,)]
        # both together, each alone, each alone again
        assert tries == [120, 60, 60, 60, 60] and suites.failures(spark, folder).isEmpty()


def test_a_suite_cuts_files_no_finer_than_cores_need(spark, tmp_path):
    spark.range(0, 400_000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).write.parquet(str(tmp_path / "t"))
    before, cores = spark.conf.get(suites.SPLIT_BYTES), spark.sparkContext.defaultParallelism
    opened = lambda session: session.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("t")
    try:
        for given in ("1m", "512m"):
            spark.conf.set(suites.SPLIT_BYTES, given)
            with suites.suite_session(spark, opened) as session:
                splits = session.sql("SELECT text FROM t").rdd.getNumPartitions()
                assert 1 < splits <= cores + 1 and session.sql("SELECT count(DISTINCT text) FROM t").first()[0] == 400_000
                assert (session.conf.get(suites.SPLIT_BYTES) == str(512 << 20)) == (given == "512m")
            assert spark.conf.get(suites.SPLIT_BYTES) == given
    finally:
        spark.conf.set(suites.SPLIT_BYTES, before)
