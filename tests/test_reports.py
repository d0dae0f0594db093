import json

import pytest
from pyspark.sql import functions as F

from assayer.operators import cost, leak, report
from assayer.sources import artifacts

# the published pilot: benchmark, model, exact of 5, cost in USD, SQL errors
PILOT = [
    ("kaggledbqa", "moonshotai/kimi-k2.7-code", 3, 0.011756399, 0),
    ("kaggledbqa", "poolside/laguna-xs-2.1:free", 2, 0.0, 0),
    ("kaggledbqa", "deepseek/deepseek-v4-flash", 2, 0.000370683, 0),
    ("kaggledbqa", "z-ai/glm-5.2", 2, 0.003698265, 0),
    ("kaggledbqa", "minimax/minimax-m2.7", 1, 0.004574263, 1),
    ("kaggledbqa", "minimax/minimax-m3", 1, 0.001301989, 0),
    ("kaggledbqa", "z-ai/glm-4.7-flash", 0, 0.000200178, 0),
    ("kaggledbqa", "deepseek/deepseek-v4-pro", 0, 0.001409858, 0),
    ("bird-mini-dev", "deepseek/deepseek-v4-flash", 4, 0.00077216, 1),
    ("bird-mini-dev", "moonshotai/kimi-k2.7-code", 4, 0.031209126, 0),
    ("bird-mini-dev", "z-ai/glm-4.7-flash", 3, 0.000365424, 0),
    ("bird-mini-dev", "z-ai/glm-5.2", 3, 0.00563176, 0),
    ("bird-mini-dev", "poolside/laguna-xs-2.1:free", 2, 0.0, 0),
    ("bird-mini-dev", "minimax/minimax-m3", 2, 0.003680662, 0),
    ("bird-mini-dev", "deepseek/deepseek-v4-pro", 2, 0.003742484, 0),
    ("bird-mini-dev", "minimax/minimax-m2.7", 1, 0.009489465, 2),
]


@pytest.fixture(scope="module")
def pilot(spark):
    return spark.createDataFrame(
        PILOT, "benchmark string, model string, exact_matches bigint, estimated_cost_usd double, prediction_error_count bigint"
    ).withColumn("total_evaluated", F.lit(5))


def test_published_rollup(pilot):
    rows = {r["model"]: r for r in report.roll_up_models(pilot).collect()}
    kimi, flash, minimax = (rows[m] for m in ("moonshotai/kimi-k2.7-code", "deepseek/deepseek-v4-flash", "minimax/minimax-m2.7"))
    assert (kimi["exact_matches"], kimi["execution_accuracy_pct"], round(kimi["cost_per_exact_match_usd"], 6)) == (7, 70.0, 0.006138)
    assert (flash["exact_matches"], round(flash["estimated_cost_usd"], 6), flash["prediction_error_count"]) == (6, 0.001143, 1)
    assert (minimax["prediction_error_count"], round(minimax["cost_per_exact_match_usd"], 6)) == (3, 0.007032)
    assert rows["poolside/laguna-xs-2.1:free"]["cost_per_exact_match_usd"] == 0.0
    assert round(sum(r["estimated_cost_usd"] for r in rows.values()), 6) == 0.078203


def test_winners_and_tradeoffs(pilot):
    winners = {(r["benchmark"], r["model"]) for r in report.dataset_winners(pilot).collect()}
    assert winners == {
        ("bird-mini-dev", "deepseek/deepseek-v4-flash"),
        ("bird-mini-dev", "moonshotai/kimi-k2.7-code"),
        ("kaggledbqa", "moonshotai/kimi-k2.7-code"),
    }
    labels = {r["label"]: r["model"] for r in report.tradeoffs(report.roll_up_models(pilot)).collect()}
    assert labels == {
        "best": "moonshotai/kimi-k2.7-code",
        "best low-cost": "deepseek/deepseek-v4-flash",
        "best free": "poolside/laguna-xs-2.1:free",
    }


def test_costs(spark):
    usage = [
        (1, 0.5, 1000, None, None, None, "m", 0.5),
        (2, 0.0, 1000, None, None, None, "m", 0.0),
        (3, None, 1000, 500, None, None, "m", 0.00018),
        (4, None, None, None, 1000, None, "m", 0.00009),
        (5, None, 0, None, 1000, None, "m", 0.00009),
        (6, None, None, None, None, None, "m", 0.0),
        (7, None, 1000, 500, None, None, "unknown", 0.0),
    ]
    runs = spark.createDataFrame(
        usage,
        "i int, cost double, prompt_tokens bigint, completion_tokens bigint, input_tokens bigint, output_tokens bigint, model string, want double",
    )
    prices = spark.createDataFrame([("m", 0.09, 0.18)], "model string, prompt_per_million_usd double, completion_per_million_usd double")
    rows = cost.with_costs(runs, prices).collect()
    assert len(rows) == 7 and all(round(r["estimated_cost_usd"], 9) == r["want"] for r in rows)


def test_fairness_classes(spark):
    runs = [
        ("a", "raw", "sql", "openrouter", "fair", True),
        ("b", "schema-plan", "sql", "openrouter", "fair_with_tools", True),
        ("c", "schema-plan", "sql", "openrouter", "diagnostic_contaminated", False),
        ("d", "bounded-agent", "sql", "droid", "fair", True),
        ("e", "schema-plan", "agentic_dbt", "openrouter", "agentic_fair", True),
        ("f", "raw", "sql", "prompt-only", "fair", False),
        ("g", "odd", "sql", "droid", "fair", True),
    ]
    df = spark.createDataFrame(
        [(r, t, m, p, "x") for r, t, m, p, _, _ in runs], "run_id string, track string, mode string, provider string, prompt_set_sha256 string"
    )
    leaks = leak.leak_findings(spark.createDataFrame([("c", "case")], "run_id string, case_id string")).drop("case_id")
    findings = leak.run_findings(df).unionByName(leaks)
    assert {(r["run_id"], r["code"]) for r in findings.collect()} == {
        ("c", "gold_sql_in_prompt"), ("f", "prompt_only"), ("g", "agent_track_unclear"),
    }
    got = {r["run_id"]: (r["classification"], r["score_eligible"]) for r in leak.classify_runs(df, findings).collect()}
    assert got == {r: (c, e) for r, _, _, _, c, e in runs}


def test_matrix_needs_one_scope(spark):
    with pytest.raises(ValueError):
        report.planned_runs(spark.range(1).selectExpr("'x' AS benchmark"), ["a/b"], "raw", 3, True)


def test_report_is_written_in_group_order(spark, tmp_path):
    rows = [(f"r{i}", f"b{i % 3}", ["raw", "plan"][i % 2], None if i == 4 else float(i % 5)) for i in range(20)]
    table = spark.createDataFrame(rows, "run_id string, benchmark string, track string, execution_accuracy_pct double")
    grouped = report.grouped_report(table.repartition(5))
    artifacts.write_report(grouped, str(tmp_path / "report"))
    files = sorted((tmp_path / "report").glob("*.json"))
    stored = [json.loads(line) for file in files for line in file.read_text().splitlines()]
    keys = [(r["benchmark_group"], r["track_group"]) for r in stored]
    assert keys == sorted(keys, reverse=True) and len(keys) == 20
    assert [r["place"] for r in stored] == [p for key in dict.fromkeys(keys) for p in range(1, keys.count(key) + 1)]
    back = artifacts.read_report(spark, str(tmp_path / "report"), grouped.schema)
    assert sorted(back.collect(), key=str) == sorted(grouped.collect(), key=str)


def test_places_within_result_classes(spark):
    rows = [
        ("a", "b1", "raw", "sql", "fair", True, "full", 50.0),
        ("b", "b1", "raw", "sql", "fair", True, "full", 70.0),
        ("c", "b1", "bounded-agent", "sql", "fair", True, "full", 90.0),
        ("d", "b1", "raw", "agentic_dbt", "agentic_fair", True, "full", None),
        ("e", "b1", "raw", "sql", "diagnostic_contaminated", True, "full", 99.0),
        ("f", "b1", "raw", "sql", "fair", None, "full", 99.0),
        ("g", "b1", "raw", "sql", "fair", True, "pilot", 99.0),
    ]
    columns = "run_id string, benchmark string, track string, mode string, fairness_classification string, score_eligible boolean, scope string, execution_accuracy_pct double"
    placed = report.class_places(leak.rankable(spark.createDataFrame(rows, columns)))
    assert {r["run_id"]: (r["result_class"], r["place"]) for r in placed.collect()} == {
        "b": ("raw", 1), "a": ("raw", 2), "c": ("bounded-agent", 1), "d": ("agentic", 1)
    }
