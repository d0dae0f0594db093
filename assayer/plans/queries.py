"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import sqltext, text
from assayer.operators import cost, evaluate, joins, leak, linking, plan, prompts, provenance, report, scan, slots, suites, values, verify
from assayer.operators.ranking import spread
from assayer.plans import suite, workload
from assayer.rules import retail
from assayer.session import guard, work_folder
from assayer.sources import artifacts, cases, catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    @wraps(function)
    def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(guard(spark), sf_dir)

    QUERIES[function.__name__] = guarded
    return guarded


def _joined(items, separator: str = ", "):
    return F.array_join(items, separator)


# --- result sets ------------------------------------------------------------------------------------------


@query
def bag_compare_equal(spark, sf_dir):
    lines = workload.table(spark, sf_dir, "lineitem")
    gold = lines.select("l_orderkey", "l_quantity", "l_returnflag", "l_discount")
    pred = lines.select(
        F.col("l_orderkey").cast("double"),
        F.col("l_quantity").cast("decimal(12,3)"),
        F.concat(F.lit(" "), "l_returnflag", F.lit("\t")),
        F.col("l_discount") + F.lit(1e-10),
    )
    return evaluate.compare_results(gold, pred)


@query
def bag_compare_diff(spark, sf_dir):
    orders = workload.table(spark, sf_dir, "orders")
    gold = orders.select("o_orderstatus", "o_orderpriority")
    pred = orders.filter("o_orderkey % 10 <> 3").select("o_orderstatus", "o_orderpriority")
    return evaluate.bag_difference(gold, pred).select(
        F.element_at("row", 1).alias("status_cell"), F.element_at("row", 2).alias("priority_cell"), "gold_n", "pred_n"
    )


def _suite_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    def tables(session: SparkSession) -> None:
        for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
            rows = session.read.parquet(f"{sf_dir}/{name}.parquet")
            # the suite's cases grow with the suppliers, each asks for the items of ten
            (suites.in_order_of(rows, "l_suppkey") if name == "lineitem" else rows).createOrReplaceTempView(name)

    grown = workload.derive(spark, sf_dir, suite.GROWING)
    about = [F.lit("db_main").alias("db_id"), F.lit("sql").alias("mode"), F.lit("duckdb").alias("dialect")]
    more_cases = grown.select("case_id", *about, "gold_sql", F.lit(True).alias("db_found"))
    more = [grown.select("case_id", F.lit(m).alias("model"), F.col(m).alias("pred_sql")).where("pred_sql IS NOT NULL") for m in suite.MODELS]
    suite_cases = spark.createDataFrame(suite.case_rows(), suite.CASE_SCHEMA).unionByName(more_cases)
    predictions = spark.createDataFrame(suite.prediction_rows(), suite.PREDICTION_SCHEMA).unionByName(more[0]).unionByName(more[1])
    return evaluate.evaluate_suite(spark, suite_cases, predictions, prepare=tables, seconds=3600)


@query
def eval_details(spark, sf_dir):
    details = _suite_details(spark, sf_dir)
    return details.select(
        "case_id", "model", "has_prediction", "dangerous_sql", "skipped", "skip_reason", "exact_match",
        F.col("gold_error").isNotNull().alias("gold_failed"), F.col("pred_error").isNotNull().alias("pred_failed"),
        "gold_row_count", "pred_row_count",
    )


@query
def exec_accuracy_summary(spark, sf_dir):
    summary = evaluate.summarize(_suite_details(spark, sf_dir), "model")
    return summary.withColumns(
        {"execution_accuracy_pct": F.round("execution_accuracy_pct", 6), "executable_rate": F.round("executable_rate", 6)}
    )


@query
def run_case_filter(spark, sf_dir):
    """Cases per run: runs of the plain track list the cases they answered, the others take all of their benchmark."""
    calls = workload.case_runs(spark, sf_dir).select("case_id", "benchmark", "run_id", "track", "status")
    answered = F.array_sort(F.collect_set(F.when(F.expr("track = 'raw' AND status = 'ok'"), F.col("case_id"))))
    runs = calls.groupBy("run_id", "benchmark").agg(answered.alias("case_ids"))
    kept = suites.run_cases(calls.select("case_id", "benchmark"), runs)
    return kept.groupBy("run_id", "benchmark").agg(
        F.count("*").alias("cases"), F.min("case_id").alias("first_case"), F.max("case_id").alias("last_case")
    )


# --- cost, reports, matrix -----------------------------------------------------------------------------------


def _costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.with_costs(workload.case_runs(spark, sf_dir), workload.derive(spark, sf_dir, workload.PRICES))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = cost.roll_up_runs(_costed(spark, sf_dir), "run_id", "benchmark", "model", "track")
    return rolled.withColumns(
        {
            "mode": F.lit("sql"),
            "dialect": F.lit("sqlite"),
            "provider": cost.infer_provider(F.lit("auto"), F.col("model")),
        }
    )


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation summaries per run: labelled calls are evaluated, the toxic ones failed."""
    calls = workload.case_runs(spark, sf_dir).select(
        "run_id",
        F.col("exact").isNull().alias("skipped"),
        F.lit(None).cast("string").alias("gold_error"),
        F.when(F.col("failed") == 1, "error").alias("pred_error"),
        ((F.col("exact") == 1) & (F.col("failed") == 0)).alias("exact_match"),
    )
    return evaluate.summarize(calls, "run_id")


def _audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = workload.case_runs(spark, sf_dir)
    runs = workload.derive(spark, sf_dir, workload.FAIRNESS_RUNS, case_runs=calls)
    leaks = workload.derive(spark, sf_dir, workload.FAIRNESS_LEAKS, case_runs=calls)
    findings = leak.run_findings(runs).unionByName(leak.leak_findings(leaks).drop("case_id"))
    return leak.classify_runs(runs, findings)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits = _audits(spark, sf_dir).select("run_id", "classification", "score_eligible")
    # every fourth source is not audited
    audited = audits.filter(~F.col("run_id").rlike(r"src\d*[37]\|"))
    return report.report_rows(_runs(spark, sf_dir), _summaries(spark, sf_dir), audited)


def _rounded(df: DataFrame) -> DataFrame:
    names = ["estimated_cost_usd", "cost_per_exact_match_usd", "execution_accuracy_pct"]
    return df.withColumns({n: F.round(n, 6) for n in names if n in df.columns})


@query
def usage_cost_by_model(spark, sf_dir):
    return _rounded(
        _costed(spark, sf_dir).groupBy("model").agg(
            F.count("*").alias("calls"),
            F.sum("estimated_cost_usd").alias("estimated_cost_usd"),
            F.count_if(F.col("estimated_cost_usd") == 0).alias("free_calls"),
        )
    )


@query
def run_rollup(spark, sf_dir):
    return _rounded(_runs(spark, sf_dir))


@query
def report_rows(spark, sf_dir):
    return _rounded(_report(spark, sf_dir))


@query
def grouped_report(spark, sf_dir):
    ranked = report.grouped_report(_report(spark, sf_dir))
    return ranked.select("benchmark_group", "track_group", "place", "run_id", "exact_matches", "total_evaluated")


@query
def model_leaderboard(spark, sf_dir):
    return _rounded(report.roll_up_models(_report(spark, sf_dir)))


@query
def model_rollup(spark, sf_dir):
    """Runs added up per model and benchmark, per model, and altogether."""
    return _rounded(report.roll_up_levels(_report(spark, sf_dir), "model", "benchmark"))


@query
def dataset_winners(spark, sf_dir):
    return report.dataset_winners(_report(spark, sf_dir)).select("benchmark", "run_id", "exact_matches", "prediction_error_count")


@query
def model_tradeoffs(spark, sf_dir):
    models = report.roll_up_models(_report(spark, sf_dir)).withColumn("estimated_cost_usd", F.round("estimated_cost_usd", 6))
    return report.tradeoffs(models).select("label", "model", "exact_matches", "estimated_cost_usd")


@query
def rankable_runs(spark, sf_dir):
    planned = workload.case_runs(spark, sf_dir).groupBy("benchmark").agg((F.count("*") / 40).alias("planned_items"))
    rows = _report(spark, sf_dir)
    scoped = rows.join(report.scope_coverage(rows, planned).select("run_id", "scope", "not_evaluated"), "run_id")
    return leak.rankable(scoped).select("run_id", "benchmark", "track", "scope", "result_class", "not_evaluated", "exact_matches")


@query
def result_classes(spark, sf_dir):
    """Places on the leaderboards of each benchmark, one per result class, of runs in every mode and by every provider."""
    runs = workload.derive(spark, sf_dir, workload.FAIRNESS_RUNS, case_runs=workload.case_runs(spark, sf_dir))
    planned = workload.case_runs(spark, sf_dir).groupBy("benchmark").agg((F.count("*") / 40).alias("planned_items"))
    rows = _report(spark, sf_dir).drop("mode", "provider").join(runs.select("run_id", "mode", "provider"), "run_id")
    tracked = rows.withColumn("track", cost.effective_track(F.col("provider"), F.col("track")))
    scoped = tracked.join(report.scope_coverage(tracked, planned).select("run_id", "scope"), "run_id")
    placed = report.class_places(leak.rankable(scoped))
    return placed.select("benchmark", "result_class", "place", "run_id", "mode", "track", "exact_matches")


@query
def evaluation_sink(spark, sf_dir):
    """Details by benchmark, summaries and audits written, read back and put side by side per run."""
    folder = work_folder(spark, "evaluation")
    details = workload.case_runs(spark, sf_dir).select(
        "run_id", "case_id", "benchmark", F.expr("exact = 1 AND failed = 0").alias("exact_match"), F.expr("failed = 1").alias("pred_failed")
    )
    artifacts.write_evaluation(details, _summaries(spark, sf_dir), _audits(spark, sf_dir), folder)
    stored, summaries, audits = artifacts.read_evaluation(spark, folder)
    counted = stored.groupBy("run_id", "benchmark").agg(
        F.count("*").alias("cases"), F.count_if("exact_match").alias("exact_cases"), F.count_if("pred_failed").alias("failed_cases")
    )
    whole = counted.join(summaries.select("run_id", "total_evaluated", "exact_matches"), "run_id", "left")
    return whole.join(audits.select("run_id", "classification", "score_eligible"), "run_id", "left")


@query
def report_sink(spark, sf_dir):
    """The grouped report written as JSON lines and read back."""
    path = work_folder(spark, "report")
    rows = report.grouped_report(_report(spark, sf_dir))
    artifacts.write_report(rows, path)
    stored = artifacts.read_report(spark, path, rows.schema)
    return _rounded(stored).select(
        "benchmark_group", "track_group", "place", "run_id", "provider", "exact_matches", "execution_accuracy_pct", "estimated_cost_usd", "fairness_classification"
    )


@query
def scope_coverage(spark, sf_dir):
    planned = workload.case_runs(spark, sf_dir).groupBy("benchmark").agg((F.count("*") / 40).alias("planned_items"))
    return report.scope_coverage(_report(spark, sf_dir), planned)


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = workload.table(spark, sf_dir, "events").select(F.col("event_type").alias("benchmark"))
    return report.planned_runs(sets, [f"vendor/m{i}" for i in range(60)] + ["local-model"], "raw", 25, False)


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = workload.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("benchmark"),
        F.concat(F.lit("vendor/m"), F.col("user_id").cast("string")).alias("model"),
        F.when(F.col("event_id") % 3 == 0, "schema-plan").otherwise("raw").alias("track"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("run_id"),
    )
    return report.latest_runs(index)


@query
def run_matrix(spark, sf_dir):
    return _planned(spark, sf_dir)


@query
def latest_runs(spark, sf_dir):
    return _latest(spark, sf_dir).select("benchmark", "model", "track", "run_id")


@query
def matrix_status(spark, sf_dir):
    codes = workload.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.when(F.col("value") > 30, 1).otherwise(0).alias("run_exit_code"),
        F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 4 - 1).cast("int").alias("eval_exit_code"),
    )
    return report.matrix_status(_planned(spark, sf_dir), _latest(spark, sf_dir).drop("created_at"), codes)


@query
def run_labels(spark, sf_dir):
    """Provider and track labels of model names derived from events."""
    named = workload.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 5 == 0, "glm-5.2")
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit("custom:"), "event_type"))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit("vendor/"), "event_type"))
        .otherwise(F.col("event_type")).alias("model"),
        F.when(F.col("event_id") % 7 == 0, "openrouter").otherwise("auto").alias("given"),
        F.when(F.col("event_id") % 2 == 0, "schema-plan").otherwise("raw").alias("asked"),
    )
    provider = cost.infer_provider(F.col("given"), F.col("model"))
    return named.select("event_id", "model", provider.alias("provider"), cost.effective_track(provider, F.col("asked")).alias("track"))


# --- leaks and fairness ------------------------------------------------------------------------------------------


def _keyed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = workload.derive(spark, sf_dir, workload.LEAK_PROMPTS)
    return leak.keyed_leaks(found, workload.derive(spark, sf_dir, workload.LEAK_GOLD))


@query
def leak_keyed(spark, sf_dir):
    return _keyed_leaks(spark, sf_dir).select("run_id", "case_id")


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = workload.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    passages = workload.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    return documents, passages


@query
def leak_corpus(spark, sf_dir):
    return leak.corpus_leaks(*_corpus(spark, sf_dir))


@query
def leak_corpus_by_key(spark, sf_dir):
    """The way for passage sets too large to send to every task."""
    return leak.corpus_leaks(*_corpus(spark, sf_dir), broadcast_chars=0)


@query
def fairness_classification(spark, sf_dir):
    return _audits(spark, sf_dir).select(
        "run_id", "mode", "provider", "track", "finding_count", "classification", "score_eligible"
    )


# --- scans ---------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.derive(spark, sf_dir, workload.FILES)


@query
def scan_secrets(spark, sf_dir):
    found = scan.text_findings(_files(spark, sf_dir))
    return found.filter("severity = 'critical'")


@query
def scan_injection(spark, sf_dir):
    found = scan.text_findings(_files(spark, sf_dir))
    return found.filter(F.col("rule").startswith("prompt_injection_"))


@query
def scan_shell(spark, sf_dir):
    return scan.shell_findings(_files(spark, sf_dir))


@query
def dependency_lines(spark, sf_dir):
    return scan.listed_dependencies(scan.dependency_findings(_files(spark, sf_dir)))


@query
def lifecycle_scripts(spark, sf_dir):
    found = scan.audit_findings(_files(spark, sf_dir)).filter("line IS NULL")
    return found.select("path", "rule", "severity")


@query
def scan_rule_counts(spark, sf_dir):
    return scan.rule_counts(scan.audit_findings(_files(spark, sf_dir)))


@query
def scan_capped(spark, sf_dir):
    return scan.capped_findings(scan.audit_findings(_files(spark, sf_dir)), per_rule=100)


@query
def scan_verdict(spark, sf_dir):
    return scan.audit_verdict(scan.audit_findings(_files(spark, sf_dir)))


@query
def setup_scan(spark, sf_dir):
    found = scan.setup_findings(_files(spark, sf_dir))
    return found.withColumn("blocks", scan.is_setup_blocking(F.col("severity")))


@query
def suffix_counts(spark, sf_dir):
    return scan.suffix_counts(_files(spark, sf_dir))


@query
def script_inventory(spark, sf_dir):
    return scan.script_inventory(_files(spark, sf_dir))


def _archive_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = workload.derive(spark, sf_dir, workload.ARCHIVES)
    active = archives.filter("bytes % 200 = 0").select("path")
    return scan.archive_report(archives, workload.derive(spark, sf_dir, workload.MEMBERS), active)


@query
def archive_paths(spark, sf_dir):
    return _archive_report(spark, sf_dir)


@query
def archive_findings(spark, sf_dir):
    found = scan.archive_findings(_archive_report(spark, sf_dir))
    blocking = scan.is_blocking(F.col("severity"), F.col("rule"))
    return found.select("path", "rule", "severity", blocking.alias("blocking"))


@query
def archive_scripts(spark, sf_dir):
    return scan.listed_members(workload.derive(spark, sf_dir, workload.MEMBERS), per_archive=50)


# --- text features -----------------------------------------------------------------------------------------------------


def _user_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = workload.table(spark, sf_dir, "conversations").filter("role = 'user'")
    return chats.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))


def _all_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = workload.questions(spark, sf_dir).withColumn("question_id", -F.col("question_id") - 1)
    return spread(asked.unionByName(_user_texts(spark, sf_dir)))


@query
def question_tokens(spark, sf_dir):
    found = text.tokens(F.col("question"), expand=True)
    return _all_questions(spark, sf_dir).select("question_id", _joined(F.array_sort(found), " ").alias("tokens"))


@query
def question_ngrams(spark, sf_dir):
    found = _all_questions(spark, sf_dir).select("question_id", text.ngrams(F.col("question")).alias("grams"))
    return found.select("question_id", F.size("grams").alias("grams"), F.sha2(_joined(F.array_sort("grams"), "|"), 256).alias("digest"))


@query
def question_values(spark, sf_dir):
    found = text.question_values(F.col("question"))
    return workload.questions(spark, sf_dir).select("question_id", _joined(F.array_sort(found), "|").alias("found_values"))


@query
def required_ops(spark, sf_dir):
    found = text.required_operations(F.col("question"))
    return _all_questions(spark, sf_dir).select("question_id", F.posexplode(found).alias("place", "found")).select(
        "question_id", "place", "found.operation", _joined("found.evidence", "|").alias("evidence")
    )


@query
def required_grain(spark, sf_dir):
    found = text.required_grain(F.col("question"))
    return _all_questions(spark, sf_dir).select("question_id", _joined(found, "|").alias("grain")).filter("grain <> ''")


@query
def search_words(spark, sf_dir):
    found = text.search_tokens(F.col("question"))
    return _all_questions(spark, sf_dir).select("question_id", _joined(F.array_sort(found), " ").alias("words"))


@query
def extract_answer(spark, sf_dir):
    outputs = workload.derive(spark, sf_dir, workload.OUTPUTS)
    return outputs.select("output_id", text.extract_answer(F.col("output")).alias("answer"))


@query
def plan_keys(spark, sf_dir):
    outputs = workload.derive(spark, sf_dir, workload.OUTPUTS)
    found = outputs.select("output_id", text.extract_plan(F.col("output")).alias("plan")).filter("plan IS NOT NULL")
    return found.select("output_id", "plan.raw", "plan.parseable", _joined(F.array_sort("plan.missing_keys"), ",").alias("missing_keys"))


@query
def normalized_sql(spark, sf_dir):
    sqls = workload.derive(spark, sf_dir, workload.LEAK_GOLD)
    return sqls.select("case_id", text.normalize_sql(F.col("gold_text")).alias("normalized"))


# --- schema linking ------------------------------------------------------------------------------------------------------


@query
def catalog_text(spark, sf_dir):
    entries = workload.catalog(spark, sf_dir).select(F.lit("main").alias("db_id"), "table", "col_idx", "column", F.lit("").alias("type"))
    # the catalog is metadata: the table sizes tie the row to the data it describes
    sizes = None
    for name in workload.TABLES:
        one = workload.table(spark, sf_dir, name).agg(F.count("*").alias("rows"))
        sizes = one if sizes is None else sizes.unionByName(one)
    return catalog.schema_text(entries).select("schema_text", sizes.agg(F.sum("rows")).scalar().alias("described_rows"))


@query
def example_values(spark, sf_dir):
    return workload.examples(spark, sf_dir).select("table", "col_idx", "pos", "value")


def _linking(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return workload.questions(spark, sf_dir), workload.catalog(spark, sf_dir), workload.examples(spark, sf_dir)


@query
def table_scores(spark, sf_dir):
    return linking.table_scores(*_linking(spark, sf_dir))


def _value_sources(spark: SparkSession, sf_dir: str):
    return {name: (workload.table(spark, sf_dir, name), columns) for name, columns in workload.EXAMPLE_COLUMNS.items()}


@query
def value_hits(spark, sf_dir):
    found = values.value_hits(workload.questions(spark, sf_dir), _value_sources(spark, sf_dir))
    return found.select("question_id", "key", "table", "column", "rows")


@query
def value_scores(spark, sf_dir):
    return values.value_scores(workload.questions(spark, sf_dir), _value_sources(spark, sf_dir))


@query
def table_topk(spark, sf_dir):
    found = linking.table_candidates(*_linking(spark, sf_dir))
    columns = F.transform("matched_columns", lambda m: F.concat_ws(":", m["column"], F.format_string("%.1f", m["score"])))
    return found.select(
        "question_id", "rank", "table", "score", _joined(columns).alias("matched_columns"), _joined("evidence", " | ").alias("evidence")
    )


@query
def schema_search(spark, sf_dir):
    found = linking.schema_search(workload.questions(spark, sf_dir), workload.catalog(spark, sf_dir))
    return found.select("question_id", "rank", "table", "score", "phrase_match")


@query
def column_profiles(spark, sf_dir):
    found = joins.column_profiles(workload.catalog(spark, sf_dir), workload.examples(spark, sf_dir))
    return found.select("table", "column", _joined("tokens", " ").alias("tokens"), _joined("values", "|").alias("example_values"), _joined("prefixes", "|").alias("prefixes"))


@query
def column_compat(spark, sf_dir):
    questions, entries, values = _linking(spark, sf_dir)
    pairs = joins.unordered_pairs(joins.candidate_pairs(linking.top_tables(linking.table_scores(questions, entries, values))))
    found = joins.column_compatibility(pairs, joins.column_profiles(entries, values))
    return found.select("a", "b", "a_column", "b_column", "score", _joined("evidence", " | ").alias("evidence"))


@query
def join_candidates(spark, sf_dir):
    questions, entries, values = _linking(spark, sf_dir)
    top = linking.top_tables(linking.table_scores(questions, entries, values))
    found = joins.join_candidates(top, joins.column_profiles(entries, values))
    return found.select("question_id", "rank", "left", "right", "score")


@query
def distractors(spark, sf_dir):
    """Table families among the ranked tables of a catalog with yearly copies of each table."""
    questions, entries, values = _linking(spark, sf_dir)
    copies = entries.select(
        F.explode(F.array(F.lit("_a"), F.lit("_b"), F.lit("_c"))).alias("copy"), "table", "col_idx", "column", "type"
    ).select(F.concat("table", F.lit("_main"), "copy").alias("table"), "col_idx", "column", "type")
    top = linking.top_tables(linking.table_scores(questions, copies, values))
    return linking.distractor_warnings(top).select("question_id", "place", "family", "warning")


@query
def column_owner(spark, sf_dir):
    questions, entries, values = _linking(spark, sf_dir)
    top = linking.top_tables(linking.table_scores(questions, entries, values))
    wants = questions.select(
        "question_id",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("want"), F.array(F.lit("C_ACCTBAL"), F.lit("s_acctbal")).alias("column_names"),
                         F.array(F.lit("supplier")).alias("preferred"), F.array().cast("array<string>").alias("avoided")),
                F.struct(F.lit(1).alias("want"), F.array(F.lit("text")).alias("column_names"),
                         F.array().cast("array<string>").alias("preferred"), F.array(F.lit("DOCUMENTS")).alias("avoided")),
            )
        ).alias("w"),
    ).select("question_id", "w.*")
    found = joins.column_owners(wants, entries, top)
    others = F.transform("alternatives", lambda a: F.concat_ws(".", a["table"], a["column"]))
    return found.select("question_id", "want", "table", "column", _joined(others).alias("alternatives"))


def _slots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    questions, entries, values = _linking(spark, sf_dir)
    top = linking.top_tables(linking.table_scores(questions, entries, values))
    return questions, slots.slot_map(questions, entries, top, retail.SLOT_RULES)


@query
def slot_map(spark, sf_dir):
    return _slots(spark, sf_dir)[1].select(
        "question_id", "place", "slot", "role", "recommended", F.coalesce("operation", F.lit("")).alias("operation"), "confidence"
    )


@query
def join_map(spark, sf_dir):
    return slots.join_map(*_slots(spark, sf_dir), retail.JOIN_RULES).select("question_id", "left", "right", "role", "confidence")


@query
def blueprint(spark, sf_dir):
    return slots.blueprints(*_slots(spark, sf_dir), retail.BLUEPRINT_RULES).select("question_id", "blueprint", "pattern")


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.build_plans(
        *_linking(spark, sf_dir),
        slot_rules=retail.SLOT_RULES,
        join_rules=retail.JOIN_RULES,
        blueprint_rules=retail.BLUEPRINT_RULES,
    )


@query
def schema_plans(spark, sf_dir):
    return _plans(spark, sf_dir).select(
        "question_id",
        "question_hash",
        _joined("operations.operation").alias("operations"),
        F.size("table_candidates").alias("candidates"),
        F.size("join_candidates").alias("joins"),
        F.size("slot_map").alias("slots"),
        F.size("join_map").alias("required_joins"),
        F.col("blueprint.pattern").alias("pattern"),
    )


@query
def plan_context(spark, sf_dir):
    return plan.plan_context(_plans(spark, sf_dir))


@query
def plans_sink(spark, sf_dir):
    """Plans written as JSON lines and read back, counted and digested."""
    folder = work_folder(spark, "plans")
    plans = _plans(spark, sf_dir)
    artifacts.write_plans(plans, folder)
    stored = artifacts.read_plans(spark, folder, plans.schema)
    brief = stored.select("question_id", "question_hash", "planner", F.size("slot_map").alias("slots"), F.col("blueprint.pattern").alias("pattern"))
    return plan.plan_audit(brief.withColumn("pos", F.col("question_id")), "retail", "pos")


@query
def plan_tool_context(spark, sf_dir):
    """Schema plans as text appended to prompts built from the same questions."""
    built = prompts.prompt_messages(_prompted(spark, sf_dir))
    contexts = plan.plan_context(_plans(spark, sf_dir)).select(F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("chat_id"), "context")
    added = prompts.with_tool_context(built, contexts)
    return added.select("chat_id", "pos", "role", F.char_length("content").cast("bigint").alias("chars"), F.sha2("content", 256).alias("digest"))


# --- static verification ----------------------------------------------------------------------------------------------------


def _sqls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.derive(spark, sf_dir, workload.SQLS)


@query
def sql_features(spark, sf_dir):
    found = verify.sql_features(_sqls(spark, sf_dir), workload.catalog(spark, sf_dir))
    return found.select(
        "sql_id", "parse_error", _joined("tables").alias("tables"), _joined("columns").alias("columns"),
        _joined("functions").alias("functions"), F.col("select_count").cast("int").alias("select_count"), "has_cte",
        "has_group_by", "has_order_by", "has_join", "has_window",
    )


@query
def join_equalities(spark, sf_dir):
    found = _sqls(spark, sf_dir).select("sql_id", F.explode(sqltext.join_equalities(F.col("sql"))).alias("pair"))
    return found.select("sql_id", F.col("pair")[0].alias("left"), F.col("pair")[1].alias("right"))


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.verify(_sqls(spark, sf_dir), _plans(spark, sf_dir), workload.catalog(spark, sf_dir), retail.BLUEPRINT_RULES)


@query
def verify_findings(spark, sf_dir):
    return verify.finding_rows(_verified(spark, sf_dir)).select(
        "sql_id", "code", "severity", "penalty", F.coalesce("subject", F.lit("")).alias("subject")
    )


@query
def verify_scores(spark, sf_dir):
    return _verified(spark, sf_dir).select("sql_id", "score", "should_repair", F.size("findings").alias("findings"))


# --- prompts and provenance -------------------------------------------------------------------------------------------------------


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases from the questions: every eleventh agentic, every third with evidence."""
    asked = workload.questions(spark, sf_dir)
    return asked.select(
        F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("case_id"),
        F.col("question_id").alias("pos"),
        F.lit("bird-mini-dev").alias("benchmark"),
        F.when(F.col("question_id") % 11 == 0, "agentic_dbt").otherwise("sql").alias("mode"),
        F.lit("sqlite").alias("dialect"),
        "question",
        F.when(F.col("question_id") % 4 == 0, "").otherwise("retail").alias("db_id"),
        F.when(F.col("question_id") % 2 == 0, "Table customer: c_custkey bigint, c_name string").otherwise("").alias("schema_text"),
        F.when(F.col("question_id") % 3 == 0, F.concat(F.lit("see customer "), F.col("question_id").cast("string"))).otherwise("").alias("evidence"),
    )


def _prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = prompts.build_prompts(_cases(spark, sf_dir), "schema-plan")
    return built.withColumn("prompt_text", prompts.prompt_text(F.col("prompt")))


@query
def case_prompts(spark, sf_dir):
    return _prompted(spark, sf_dir).select(
        "case_id",
        F.char_length("prompt_text").cast("bigint").alias("prompt_chars"),
        provenance.text_digest(F.col("prompt_text")).alias("prompt_sha256"),
    )


@query
def set_digest(spark, sf_dir):
    hashed = _prompted(spark, sf_dir).select(
        (F.col("pos") % 7).alias("run_id"),
        F.floor(F.col("pos") / 7).alias("pos"),
        "case_id",
        provenance.text_digest(F.col("prompt_text")).alias("prompt_sha256"),
    )
    return provenance.prompt_set_digest(hashed)


@query
def call_metrics(spark, sf_dir):
    """Sizes, digest and time of every model call: a user turn and the turn that answers it."""
    turns = workload.table(spark, sf_dir, "conversations")
    answers = turns.where("role <> 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    calls = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"), ((F.col("conv_id") % 1000) / 7).alias("seconds"))
    found = provenance.case_metrics(calls.join(answers, ["conv_id", "turn"], "left"))
    return found.select("conv_id", "turn", "prompt_sha256", "prompt_chars", "output_chars", "latency_seconds")


@query
def chat_flatten(spark, sf_dir):
    return prompts.flatten_chats(workload.messages(spark, sf_dir))


@query
def prompt_digest(spark, sf_dir):
    parts = prompts.chat_parts(workload.messages(spark, sf_dir))
    return provenance.chat_digest(parts).join(provenance.chat_sizes(parts), "chat_id")


def _with_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats whose user turns carry table blocks, as prompts with schema context do."""
    chats = workload.messages(spark, sf_dir)
    block = F.concat(
        F.lit("\nTable name: t"), F.col("chat_id").cast("string"), F.lit("\nColumns: a, b ,c"), F.col("pos").cast("string"),
        F.lit("\n\nTable name: wide\n| "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " | "),
        F.lit(" |\n| --- | --- |\nTable name: \nTable name: bare\nno columns\n  "),
    )
    return chats.withColumn("content", F.when((F.col("role") == "user") & (F.col("chat_id") % 2 == 0), F.concat("content", block)).otherwise(F.col("content")))


@query
def strict_prompt(spark, sf_dir):
    found = prompts.strict_messages(_with_blocks(spark, sf_dir))
    return found.select("chat_id", "pos", "role", F.char_length("content").cast("bigint").alias("chars"), F.sha2("content", 256).alias("digest"))


@query
def schema_ledger(spark, sf_dir):
    found = _with_blocks(spark, sf_dir).select("chat_id", "pos", prompts.schema_ledger(F.col("content")).alias("ledger"))
    return found.filter("ledger <> ''")


@query
def tool_context(spark, sf_dir):
    """Schema-search results appended to prompts built from the same questions."""
    built = prompts.prompt_messages(_prompted(spark, sf_dir))
    found = linking.schema_search(workload.questions(spark, sf_dir), workload.catalog(spark, sf_dir))
    contexts = prompts.search_context(found).select(
        F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("chat_id"), "context"
    )
    added = prompts.with_tool_context(built, contexts)
    return added.select("chat_id", "pos", "role", F.char_length("content").cast("bigint").alias("chars"))


# --- sources, files, manifests --------------------------------------------------------------------------------------------------------------


@query
def case_sources(spark, sf_dir):
    """Case sets written from the tables in three formats, then read, normalised and united."""
    folder = work_folder(spark, "cases")
    asked = workload.questions(spark, sf_dir)
    numbered = asked.select("question_id", "question", F.concat(F.lit("SELECT "), F.col("question_id").cast("string")).alias("sql"))
    item = F.to_json(F.struct(F.col("question_id"), F.lit("retail").alias("db_id"), "question", F.lit("").alias("SQL"), F.col("sql").alias("query")))
    # one JSON array per segment of the questions
    split = numbered.withColumn("part", F.floor(F.col("question_id") / 500))
    arrays = split.groupBy("part").agg(
        F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(F.struct("question_id", item.alias("item"))))["item"], ","), F.lit("]")).alias("value")
    )
    arrays.select("value").repartition(4).write.text(f"{folder}/json", lineSep="\n")
    numbered.select(F.col("question").alias("Prompt"), F.col("sql").alias("Gold"), F.lit("retail").alias("db_name")).write.csv(
        f"{folder}/csv", header=True, escape='"', quoteAll=True
    )
    lines = spark.read.text(f"{folder}/json").select(F.explode(F.from_json("value", "array<string>")).alias("item"))
    rows = lines.select(
        F.get_json_object("item", "$.question_id").cast("int").alias("pos"),
        F.concat(F.lit("bird_"), F.get_json_object("item", "$.question_id")).alias("case_id"),
        F.get_json_object("item", "$.question").alias("question"),
        F.get_json_object("item", "$.query").alias("gold_sql"),
        F.get_json_object("item", "$.db_id").alias("db_id"),
    )
    united = cases.union_cases([cases.normalize_cases(rows, "bird-mini-dev"), cases.read_csv_cases(spark, [f"{folder}/csv"])])
    return united.select("benchmark", "mode", "dialect", "question", "gold_sql", "db_id", "evidence")


@query
def json_cases(spark, sf_dir):
    """Case files of both JSON shapes, each holding five hundred questions, read with their lineage."""
    folder = work_folder(spark, "json-cases")
    asked = workload.questions(spark, sf_dir)
    number = F.col("question_id")
    sql, none = F.concat(F.lit("SELECT "), number.cast("string")), F.lit(None).cast("string")
    keyed = F.struct(
        number.alias("question_id"), "question", F.lit("retail").alias("db_id"), F.lit("").alias("evidence"),
        F.when(number % 2 == 0, F.concat(F.lit("k"), number.cast("string"))).otherwise("").alias("knowledge"),
        F.when(number % 3 == 0, sql).otherwise("").alias("SQL"), sql.alias("query"),
    )
    nested = F.struct(
        "question", F.lit("retail").alias("db_id"), F.when(number % 2 == 0, sql).otherwise(none).alias("query"), F.struct(sql.alias("query")).alias("sql")
    )
    part = F.floor(number / 500).alias("part")
    listed = lambda item: asked.groupBy(part).agg(F.array_sort(F.collect_list(F.struct(number.alias("at"), item.alias("item"))))["item"].alias("data"))
    listed(keyed).select(F.to_json("data").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/list")
    listed(nested).select("data").write.option("maxRecordsPerFile", 1).json(f"{folder}/data")
    columns = ["benchmark", "dialect", "question", "gold_sql", "db_id", "evidence"]
    first = cases.read_json_array_cases(spark, f"{folder}/list").select(*columns, "pos", "case_id")
    # file names are Spark's own and not part of the result
    second = cases.read_json_file_cases(spark, f"{folder}/data").select(*columns, "pos", F.regexp_replace("case_id", "_.*_", "_").alias("case_id"))
    return first.unionByName(second)


@query
def public_cases(spark, sf_dir):
    full = cases.normalize_cases(_cases(spark, sf_dir).withColumn("gold_sql", F.lit("SELECT 1")), "bird-mini-dev")
    return cases.public_cases(full)


@query
def limited_cases(spark, sf_dir):
    chats = _user_texts(spark, sf_dir)
    found = [
        cases.normalize_cases(
            chats.filter(F.col("question_id") % 4 == i).select(
                F.col("question_id").alias("pos"), F.col("question_id").cast("string").alias("case_id"), "question"
            ),
            name,
        )
        for i, name in enumerate(["bird-mini-dev", "kaggledbqa", "defog-sql-eval", "spider2-dbt"])
    ]
    return cases.union_cases(found, limit=25).select("benchmark", "case_id", "mode", "dialect", "question")


@query
def canonical_names(spark, sf_dir):
    names = workload.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 6 == 0, " BIRD ").when(F.col("event_id") % 6 == 1, "Spider2").when(F.col("event_id") % 6 == 2, "all")
        .when(F.col("event_id") % 6 == 3, "sql-eval").when(F.col("event_id") % 6 == 4, "kaggle").otherwise(F.col("event_type")).alias("name"),
    )
    return names.select("event_id", cases.canonical_name(F.col("name")).alias("benchmark"))


@query
def safe_case_ids(spark, sf_dir):
    pages = workload.table(spark, sf_dir, "pages")
    return pages.select("page_id", cases.safe_case_id(F.col("url")).alias("safe_id"))


@query
def long_case_ids(spark, sf_dir):
    """Cases keyed by long raw ids, many of them equal in their first 140 characters, joined with predictions by the raw id."""
    pages = workload.table(spark, sf_dir, "pages").select(F.left("html", F.lit(300)).alias("case_id"), "url")
    rows = pages.select("case_id").distinct().withColumn("pos", F.lit(0))
    return (
        cases.normalize_cases(rows, "bird-mini-dev")
        .select("benchmark", "case_id", "safe_id")
        .join(pages, "case_id")
        .groupBy("benchmark", "case_id", "safe_id")
        .agg(F.count("*").alias("pages"), F.sum(F.length("url")).alias("predicted_chars"))
    )


@query
def safe_id_collisions(spark, sf_dir):
    pages = workload.table(spark, sf_dir, "pages").select(
        F.lit("web").alias("benchmark"), F.substring_index("url", "/", 3).alias("case_id")
    )
    return cases.case_id_collisions(pages)


@query
def task_texts(spark, sf_dir):
    """Task folders from conversations: the turn decides the file name, some files are blank."""
    chats = workload.table(spark, sf_dir, "conversations")
    name = (
        F.when((F.col("turn") == 0) & (F.col("conv_id") % 3 == 0), "README.md")
        .when((F.col("turn") == 1) & (F.col("conv_id") % 3 == 1), "instruction.txt")
        .when(F.col("turn") % 2 == 0, F.concat(F.lit("n"), F.col("turn").cast("string"), F.lit(".md")))
        .otherwise(F.concat(F.lit("n"), F.col("turn").cast("string"), F.lit(".txt")))
    )
    blank = (F.col("conv_id") % 6 == 0) & (F.col("turn") == 0)
    files = chats.select(
        F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("task"), name.alias("name"),
        F.when(blank, "  ").otherwise(F.col("text")).alias("text"),
    )
    return cases.task_texts(files)


@query
def picked_databases(spark, sf_dir):
    """Database files by place: a listing derived from customers, with several places for each."""
    customers = workload.table(spark, sf_dir, "customer").select(F.concat(F.lit("db"), F.col("c_custkey").cast("string")).alias("db"), "c_custkey")
    key = F.col("c_custkey")
    places = F.array(
        F.when(key % 2 == 0, F.concat(F.lit("databases/"), "db", F.lit("/"), "db", F.lit(".sqlite"))),
        F.when(key % 3 == 0, F.concat(F.lit("databases/"), "db", F.lit(".db"))),
        F.when(key % 5 == 0, F.concat(F.lit("dev_databases/"), "db", F.lit("/sqlite/"), "db", F.lit(".sqlite"))),
        F.when(key % 7 != 0, F.concat(F.lit("z/"), "db", F.lit(".sqlite"))),
        F.when(key % 7 != 0, F.concat(F.lit("a-b/"), "db", F.lit(".db"))),
    )
    listing = customers.select(F.explode(F.filter(places, lambda p: p.isNotNull())).alias("path"))
    return cases.pick_databases(customers.select(F.col("db").alias("db_id")), listing)


@query
def artifact_completeness(spark, sf_dir):
    orders = workload.table(spark, sf_dir, "orders")
    path = F.concat(F.lit("set/"), F.col("o_orderkey").cast("string"), F.lit(".duckdb"))
    expected = orders.select(F.col("o_orderpriority").alias("source"), path.alias("path"))
    lines = workload.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    listing = lines.groupBy("l_orderkey").agg(F.count("*").alias("bytes")).select(
        F.concat(F.lit("set/"), F.col("l_orderkey").cast("string"), F.lit(".duckdb")).alias("path"), "bytes"
    )
    found = provenance.artifact_completeness(expected, listing)
    return found.withColumn("missing", _joined("missing"))


@query
def snapshot_totals(spark, sf_dir):
    files = _files(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("source"), "path", "bytes")
    return provenance.snapshot_totals(files, r"\.(md|sh)$", 60)


@query
def file_digests(spark, sf_dir):
    pages = workload.table(spark, sf_dir, "pages")
    path = F.concat(F.lit("web/"), F.col("page_id").cast("string"))
    files = pages.filter("page_id % 9 <> 4").select(path.alias("path"), F.col("html").cast("binary").alias("content"), F.octet_length("html").cast("bigint").alias("length"))
    wanted = F.when(F.col("page_id") % 3 == 0, F.octet_length("html")).when(F.col("page_id") % 3 == 1, F.lit(17)).cast("bigint")
    return provenance.check_files(files, pages.select(path.alias("path"), wanted.alias("expected_bytes")))


@query
def latest_manifest(spark, sf_dir):
    records = workload.table(spark, sf_dir, "events").select(
        F.concat(F.lit("set"), F.col("user_id").cast("string")).alias("name"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.col("event_id").alias("setup_at"),
    )
    return artifacts.latest_manifest(records)


@query
def upserted_manifest(spark, sf_dir):
    """Two rounds of setups and one of failures, each put in place of the records of its names."""
    path = work_folder(spark, "manifest")
    events = workload.table(spark, sf_dir, "events")
    name = F.concat(F.lit("set"), F.col("user_id").cast("string")).alias("name")
    record = lambda rows, status: rows.select(name, F.lit(status).alias("status"), F.col("event_id").alias("setup_at"))
    artifacts.upsert_manifest(record(events.where("event_id % 2 = 0"), "ok"), path)
    artifacts.upsert_manifest(record(events.where("event_id % 2 = 1 AND event_type <> 'error'"), "ready"), path)
    failed = events.where("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("setup_at"))
    folder = F.concat(F.lit("data/set"), F.col("user_id").cast("string"))
    errors = failed.select(name, F.concat(F.lit("boom "), F.col("user_id").cast("string")).alias("error"), "setup_at")
    listing = events.where("event_type = 'click'").select(F.concat(folder, F.lit("/e"), F.col("event_id").cast("string")).alias("path"), F.lit(1).alias("bytes"))
    sources = failed.select(name, F.lit("git").alias("type"), folder.alias("path"))
    artifacts.upsert_manifest(artifacts.failure_records(sources, listing, errors), path)
    return artifacts.read_manifest(spark, path).select("name", "status", "setup_at", "error", F.col("artifacts")[0]["files"].alias("files"))


@query
def raw_case_texts(spark, sf_dir):
    """A file per document, some with bytes that are no text and some absent, read back per case."""
    folder = work_folder(spark, "texts")
    docs = workload.table(spark, sf_dir, "documents")
    case = F.concat(F.lit("case"), F.col("doc_id").cast("string"))
    broken = F.when(F.col("doc_id") % 7 == 0, F.expr("CAST(X'FF78' AS STRING)")).otherwise("")
    files = docs.where("doc_id % 5 <> 0").select(F.col("lang").alias("run"), case.alias("case"), F.concat("text", broken).alias("value"))
    artifacts.write_case_files(files, folder)
    expected = docs.select(F.concat(F.lit("run="), "lang").alias("run_id"), F.concat(F.lit("case="), case).alias("case_id"))
    read = artifacts.read_case_files(spark, folder, "*.txt", expected)
    plain = lambda name: F.regexp_replace(name, "^[a-z]+=", "").alias(name)
    return read.select(plain("run_id"), plain("case_id"), "text", "bytes", "repaired", "found")


@query
def gold_lines(spark, sf_dir):
    """Gold names of JSON lines written from events, every tenth broken and two in ten incomplete."""
    folder = work_folder(spark, "gold")
    key = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    gold = lambda value: F.struct(F.struct(value.alias("gold")).alias("parameters"))
    line = lambda value: F.to_json(F.struct(key("task", "user_id").alias("instance_id"), gold(value).alias("evaluation")))
    kind = F.col("event_id") % 10
    value = F.when(kind == 3, "{bad").when(kind == 4, F.to_json(F.struct(key("task", "user_id").alias("instance_id"))))
    lines = workload.table(spark, sf_dir, "events").select("event_id", value.when(kind == 5, line(F.lit(""))).otherwise(line(key("gold", "event_id"))).alias("value"))
    lines.orderBy("event_id").select("value").write.text(folder)
    read = artifacts.read_gold_lines(spark, folder)
    counts = read.agg(F.count_if(F.expr("state = 'broken'")).alias("broken_lines"), F.count_if(F.expr("state = 'incomplete'")).alias("incomplete_lines"))
    names = artifacts.read_gold_names(spark, folder)
    # one row of counts stands beside every name
    return names.select("*", *[counts.select(c).scalar().alias(c) for c in ("broken_lines", "incomplete_lines")])


@query
def run_index(spark, sf_dir):
    """Index entries appended in two batches and read back as JSON lines."""
    path = work_folder(spark, "index")
    entries = workload.table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("output_dir"),
        F.col("event_type").alias("benchmark"),
        F.lit("generic-sql").alias("method"),
        F.concat(F.lit("vendor/m"), F.col("user_id").cast("string")).alias("model"),
    )
    artifacts.append_run_index(entries.filter("output_dir LIKE '%0'"), path)
    artifacts.append_run_index(entries.filter("output_dir NOT LIKE '%0'"), path)
    stored = spark.read.schema("benchmark string, method string, model string, output_dir string").json(path)
    return stored.groupBy("benchmark", "method").agg(F.count("*").alias("entries"), F.countDistinct("model").alias("models"))
