"""Declared schemas of cases and runs."""

CASE = (
    "case_id string, benchmark string, mode string, dialect string, question string, gold_sql string, db_id string, "
    "db_path string, schema_text string, evidence string, metadata map<string,string>, safe_id string"
)
CASE_COLUMNS = [field.split()[0] for field in CASE.replace("map<string,string>", "map").split(", ")]
PUBLIC_CASE_COLUMNS = ["case_id", "benchmark", "mode", "dialect", "question", "db_id", "db_path", "evidence"]

USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
RUN = (
    "benchmark string, display_name string, mode string, dialect string, model string, provider string, track string, "
    f"split string, total_items bigint, ok bigint, prompted bigint, errors bigint, usage {USAGE}, "
    "estimated_cost_usd double, prompt_set_sha256 string, created_at_utc string, case_ids array<string>"
)
SUMMARY = (
    "total_cases bigint, total_evaluated bigint, skipped bigint, exact_matches bigint, execution_accuracy_pct double, "
    "prediction_error_count bigint, executable_rate double"
)
AUDIT = "classification string, score_eligible boolean"
PRICES = (
    "struct<models:map<string,struct<prompt_per_million_usd:double,completion_per_million_usd:double,"
    "context_length:bigint,created:string,name:string>>>"
)
