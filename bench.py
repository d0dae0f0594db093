"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assayer.plans.queries import QUERIES  # noqa: E402
from assayer.session import build_session  # noqa: E402

HEADLINE = [
    "bag_compare_equal",
    "exec_accuracy_summary",
    "report_rows",
    "model_leaderboard",
    "leak_keyed",
    "leak_corpus",
    "leak_corpus_by_key",
    "fairness_classification",
    "scan_rule_counts",
    "scan_capped",
    "scan_verdict",
    "question_tokens",
    "question_ngrams",
    "plan_keys",
    "example_values",
    "table_scores",
    "schema_search",
    "join_candidates",
    "schema_plans",
    "sql_features",
    "verify_scores",
    "case_prompts",
    "strict_prompt",
    "prompt_digest",
    "latest_runs",
    "artifact_completeness",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    spark.sparkContext.setLogLevel("ERROR")
    # start the engine before the clock
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
