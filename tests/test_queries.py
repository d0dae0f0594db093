import pytest

from parity import compare, oracle_connection

SMALL = "/root/testdata/sf0.001"
CHECKED = (
    "bag_compare_equal bag_compare_diff eval_details report_rows dataset_winners matrix_status leak_keyed leak_corpus fairness_classification "
    "scan_capped setup_scan archive_findings question_tokens question_ngrams question_values required_ops extract_answer plan_keys example_values "
    "table_scores schema_search join_candidates slot_map sql_features join_equalities case_prompts set_digest strict_prompt case_sources "
    "picked_databases artifact_completeness latest_manifest run_index "
    "run_case_filter model_rollup upserted_manifest raw_case_texts gold_lines long_case_ids task_texts value_hits value_scores "
    "plan_context plan_tool_context plans_sink result_classes evaluation_sink report_sink call_metrics json_cases"
).split()


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_oracle(spark, oracle, name):
    ok, note, _ = compare(spark, oracle, name, SMALL)
    assert ok, note


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
