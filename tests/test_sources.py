import json

from pyspark.sql import functions as F

from assayer.operators import evaluate
from assayer.sources import artifacts, cases, catalog


def by_id(df):
    return {r["case_id"]: r for r in df.collect()}


def test_json_array_cases(spark, tmp_path):
    rows = [{"question_id": 7, "db_id": "d", "question": "q", "evidence": "", "knowledge": "k", "SQL": "", "query": "SELECT 1", "difficulty": "easy"}, {"question": "r"}]
    path = tmp_path / "set.json"
    path.write_text(json.dumps(rows))
    got = by_id(cases.read_json_array_cases(spark, str(path)))
    assert got["bird_7"]["evidence"] == "k" and got["bird_7"]["gold_sql"] == "SELECT 1"
    assert got["bird_7"]["metadata"] == {"difficulty": "easy", "question_id": "7"}
    assert got["bird_1"]["db_id"] == "" and got["bird_1"]["dialect"] == "sqlite"


def test_json_file_cases(spark, tmp_path):
    (tmp_path / "a_test.json").write_text(json.dumps({"data": [{"question": "q", "sql": {"query": "S1"}}, {"question": "r", "sql": "S2"}]}))
    (tmp_path / "b_test.json").write_text(json.dumps([{"question": "s", "query": "", "SQL": "S3", "sql": {"x": 1}}]))
    (tmp_path / "c_train.json").write_text(json.dumps([{"question": "t"}]))
    got = by_id(cases.read_json_file_cases(spark, str(tmp_path)))
    assert {k: r["gold_sql"] for k, r in got.items()} == {"kaggledbqa_a_test_0": "S1", "kaggledbqa_a_test_1": "S2", "kaggledbqa_b_test_0": "S3"}
    assert len(by_id(cases.read_json_file_cases(spark, str(tmp_path), split="none"))) == 4


def test_csv_cases(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('Prompt,QUERY,db_name\n"line 1\nsays ""hi""",SELECT 1, d \n  ,SELECT 2,d\nlast,,e\n')
    got = by_id(cases.read_csv_cases(spark, [str(path)]))
    assert set(got) == {"defog_x_0", "defog_x_2"}
    assert got["defog_x_0"]["question"] == 'line 1\nsays "hi"' and got["defog_x_0"]["db_id"] == "d"
    assert got["defog_x_2"]["gold_sql"] == "" and got["defog_x_2"]["dialect"] == "postgres"


def test_task_cases(spark):
    files = spark.createDataFrame(
        [("t1", "README.md", " "), ("t1", "b.md", "two"), ("t1", "a.md", " one "), ("t1", "x.duckdb", ""), ("t2", "notes", "x")],
        "task string, name string, text string",
    )
    tasks = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "task string")
    mirror = spark.createDataFrame([("t2", "question.txt", "from mirror")], "task string, name string, text string")
    got = {r["db_id"]: r for r in cases.read_task_cases(tasks, files, mirror).collect()}
    assert got["t1"]["question"] == "# a.md\none\n\n# b.md\ntwo" and got["t1"]["metadata"]["duckdb_files"] == "x.duckdb"
    assert got["t2"]["question"] == "# question.txt\nfrom mirror"
    assert got["t3"]["question"] == "Complete the Spider2-DBT task in t3." and got["t3"]["mode"] == "agentic_dbt"


def test_union_limit_and_projection(spark, tmp_path):
    path = tmp_path / "set.json"
    path.write_text(json.dumps([{"question": str(i), "SQL": "SELECT 1"} for i in range(30)]))
    source = cases.read_json_array_cases(spark, str(path))
    assert {r["question"] for r in cases.union_cases([source], limit=3).collect()} == {"0", "1", "2"}
    assert cases.union_cases([source], limit=0).count() == 30
    assert "gold_sql" not in cases.public_cases(source).columns


def test_lists_and_run_artifacts(spark, tmp_path):
    prices = tmp_path / "prices.json"
    prices.write_text(json.dumps({"models": {"a/b": {"prompt_per_million_usd": 0.1, "completion_per_million_usd": 0.2, "context_length": 5}}}))
    assert artifacts.read_prices(spark, str(prices)).first()["completion_per_million_usd"] == 0.2
    prices.write_text("{broken")
    assert artifacts.read_prices(spark, str(prices)).count() == 0
    models = tmp_path / "models.json"
    models.write_text(json.dumps({"models": ["a/b", "local"]}))
    assert [r["model"] for r in artifacts.read_models(spark, str(models)).collect()] == ["a/b"]
    run = tmp_path / "runs" / "set" / "run-1" / "case-1"
    run.mkdir(parents=True)
    (run.parent / "run_metadata.json").write_text(json.dumps({"benchmark": "set", "total_items": 2, "usage": {"total_tokens": 9}}))
    (run / "predicted.sql").write_text("SELECT 1")
    runs, summaries, audits = artifacts.read_run_artifacts(spark, str(tmp_path / "runs"))
    assert runs.first()["total_tokens"] == 9 and runs.first()["run_id"] == "run-1"
    assert summaries.count() == 0 and audits.count() == 0
    assert artifacts.resolve_run(runs, "results/n-1").first()["run_id"] == "run-1"
    assert tuple(artifacts.read_case_texts(spark, str(tmp_path / "runs"), "predicted.sql").first()) == ("run-1", "case-1", "SELECT 1")
    gold = tmp_path / "gold.jsonl"
    line = lambda name, value: json.dumps({"instance_id": name, "evaluation": {"parameters": {"gold": value}}})
    gold.write_text("\n".join([line("a", "1"), "", "{bad", line("b", ""), line("a", "2")]))
    assert [tuple(r) for r in artifacts.read_gold_names(spark, str(gold)).collect()] == [("a", "2")]


def test_catalog_files(spark, tmp_path):
    path = tmp_path / "tables.json"
    path.write_text(json.dumps({"t": {"column_names": ["a", "b"], "example_rows": [[1, None]], "example_columns": [["x", "nan"], ["y"]]}}))
    entries, values = catalog.read_catalog(spark, str(path))
    assert entries.count() == 2 and values.count() == 5
    assert [r["value"] for r in catalog.flatten_examples(values).orderBy("place").collect()] == ["1", "x", "y"]


def test_sampled_values_agree_across_tables(spark):
    ids = spark.range(5000).selectExpr("id AS k", "CAST(id AS STRING) AS s", "id % 3 AS small")
    # a third of all rows hold one value
    skewed = ids.unionByName(spark.range(2500).selectExpr("1 AS k", "'1' AS s", "1L AS small"))
    found = catalog.sampled_values({"a": (ids, ["k", "small"]), "b": (skewed, ["s"])}).collect()
    pick = lambda t, c: {r["value"] for r in found if (r["table"], r["col_idx"]) == (t, c)}
    assert len(pick("a", 0)) == 8 and pick("a", 0) == pick("b", 1) and pick("a", 2) <= {"0", "1", "2"}


def test_sampled_values_are_unique_when_hashes_collide(spark):
    texts = spark.range(4000).selectExpr("concat('t', id) AS s")
    found = catalog.sampled_values({"a": (texts, ["s"])}, hashing=lambda text: F.length(text)).collect()
    assert len(found) == len({r["pos"] for r in found}) <= 8


def test_manifest_failure_and_restriction(spark):
    sources = spark.createDataFrame([("s", "git", "b/s/repo"), ("s", "url", "b/s/x.zip")], "name string, type string, path string")
    listing = spark.createDataFrame([("b/s/repo/a", 1), ("b/s/repo/c/d", 2), ("b/s/repo2", 9)], "path string, bytes bigint")
    errors = spark.createDataFrame([("s", "boom", 1)], "name string, error string, setup_at bigint")
    row = artifacts.failure_records(sources, listing, errors).first()
    assert [(a["path"], a["exists"], a["files"], a["bytes"]) for a in row["artifacts"]] == [("b/s/repo", True, 2, 3), ("b/s/x.zip", False, 0, 0)]
    all_cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    one = spark.createDataFrame([("a",)], "case_id string")
    assert evaluate.restrict_to_run(all_cases, one, True).count() == 1 and evaluate.restrict_to_run(all_cases, one, False).count() == 2


def test_sampling_moves_no_cells_to_find_the_picked_hashes(spark):
    from assayer.sources.catalog import sampled_values

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = sampled_values({"t": (spark.range(100).selectExpr("id AS a"), ["a"])})
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 8
    finally:
        spark.conf.set(key, before)


def test_distinct_texts_are_hashed_once(spark, capsys):
    rows = [(i % 7 - 3, None if i % 11 == 0 else f"w{i % 40}", str(i % 5)) for i in range(400)] + [(None, " ", "007")]
    frame = spark.createDataFrame(rows, "n bigint, t string, d string").withColumn("x", F.col("n") / 2)
    sample = catalog.sampled_values({"a": (frame, ["t", "n"]), "b": (frame, ["d", "x"]), "c": (frame, ["n"])}, 4, catalog.portable_text_hash)
    sample.explain()
    # both passes over texts read hashes that were worked out before
    assert "md5" not in capsys.readouterr().out
    expected = set()
    for table, columns in (("a", "tn"), ("b", "dx"), ("c", "n")):
        for name in columns:
            kind = frame.schema[name].dataType
            hashes = frame.select(F.col(name).cast("string").alias("v"), catalog._value_hash(F.col(name), kind, catalog.portable_text_hash).alias("h"))
            least = {}
            for v, h in sorted({(v, h) for v, h in map(tuple, hashes.collect()) if v is not None}, key=lambda p: (p[1], p[0])):
                least.setdefault(h % 4, v)
            expected |= {(table, frame.columns.index(name), "col", pos, v) for pos, v in least.items()}
    assert {tuple(r) for r in sample.collect()} == expected


def test_cells_are_not_widened_to_rows_of_all_columns(spark, capsys):
    frame = spark.range(300).selectExpr("if(id % 5 = 0, NULL, id) AS a", "id % 3 AS b", "concat('t', id) AS c", "CAST(NULL AS INT) AS d")
    sample = catalog.sampled_values({"x": (frame, ["a", "b", "c", "d"]), "y": (frame, ["d"])})
    sample.explain()
    assert "Expand" not in capsys.readouterr().out
    counts = {r["col_idx"]: r["count"] for r in sample.groupBy("col_idx").count().collect()}
    assert set(counts) == {0, 1, 2} and counts[0] == 8 and counts[1] == len({i * catalog._FACTOR % catalog._PRIME % 8 for i in range(3)})
    assert catalog.sampled_values({"y": (frame, ["d"])}).isEmpty()
