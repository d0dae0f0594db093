"""Static checks of SQL text against a question's plan.

A query and its plan meet once, on the question; every check is then an expression on that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import sqltext, text
from assayer.functions.text import strip, text_array
from assayer.operators.joins import is_family
from assayer.operators.ranking import join_index, join_wide, spread
from assayer.rules.vocab import OPERATION_FUNCTIONS

FINDING = "struct<code:string,severity:string,penalty:int,subject:string>"
NO_FINDINGS = f"array<{FINDING}>"
GRAIN_OPERATIONS = ["avg", "sum", "count", "variance", "range"]


def sql_features(sqls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Text features per query, with the catalog tables and columns it names: ``sqls(sql_id, sql, ...)``.

    Only words that are catalog names leave the query's row to be gathered again.
    """
    sqls = spread(sqls)
    names = (
        catalog.select(F.upper("table").alias("word"), F.col("table").alias("table"), F.lit(None).cast("string").alias("column"))
        .unionByName(catalog.select(F.upper("column").alias("word"), F.lit(None).cast("string").alias("table"), F.upper("column").alias("column")))
        .distinct()
    )
    named = (
        join_index(sqls.select("sql_id", F.explode(sqltext.identifiers(F.col("sql"))).alias("word")), names, ["word"])
        .groupBy("sql_id")
        .agg(F.array_sort(F.collect_set("table")).alias("tables"), F.array_sort(F.collect_set("column")).alias("columns"))
    )
    sql = F.col("sql")
    return join_wide(sqls, named, ["sql_id"], "left").select(
        *sqls.columns,
        sqltext.is_broken(sql).alias("parse_error"),
        F.coalesce("tables", text_array([])).alias("tables"),
        F.coalesce("columns", text_array([])).alias("columns"),
        sqltext.functions(sql).alias("functions"),
        sqltext.join_equalities(sql).alias("join_equalities"),
        *[value.alias(name) for name, value in sqltext.flags(sql).items()],
    )


def _finding(code: str, severity: str, penalty: int, subject: Column | None = None) -> Column:
    named = F.lit(None).cast("string") if subject is None else subject
    return F.struct(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(penalty).alias("penalty"), named.alias("subject")
    )


def _when(condition: Column, finding: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(finding)).otherwise(F.array().cast(NO_FINDINGS))


def _satisfied(expected: Column) -> Column:
    return F.exists("tables", lambda used: is_family(expected, used))


def _mentions(sql_upper: Column, left: Column, right: Column) -> Column:
    """All four names of two column references occur somewhere."""
    ends = [F.substring_index(F.upper(e), ".", 1) for e in (left, right)]
    columns = [F.upper(e).substr(F.instr(e, ".") + 1, F.length(e)) for e in (left, right)]
    first, *others = [F.contains(sql_upper, name) for name in (*ends, *columns)]
    for other in others:
        first = first & other
    return first


def _joined(left: Column, right: Column) -> Column:
    """A required equality is there; with no equality read from the text, naming both sides counts."""
    pair = F.array_sort(F.array(F.upper(left), F.upper(right)))
    return F.array_contains("join_equalities", pair) | (
        (F.size("join_equalities") == 0) & _mentions(F.upper("sql"), left, right)
    )


def operation_present(operation: Column) -> Column:
    uses = lambda names: F.arrays_overlap("functions", text_array(names))
    upper = F.upper("sql")
    present = (
        F.when(operation == "range", uses(["MAX"]) & uses(["MIN"]))
        .when(operation == "dense_rank", F.contains(upper, F.lit("DENSE_RANK")))
        .when(operation == "rank", F.contains(upper, F.lit("RANK")))
        .when(operation == "group_by", F.col("has_group_by"))
        .when(operation == "order_by", F.col("has_order_by"))
    )
    for name, functions in OPERATION_FUNCTIONS.items():
        present = present.when(operation == name, uses(functions))
    return present.otherwise(True)


def high_evidence_tables(candidates: Column, max_tables: int = 8) -> Column:
    """Candidates a query should use: those with direct or plural evidence, else the best one.

    Only candidates near the top score with a matched column count; candidates come in score order.
    """
    threshold = F.greatest(F.lit(5.0), F.get(candidates, F.lit(0))["score"] * 0.35)
    strong = F.filter(
        F.slice(candidates, 1, max_tables + 4), lambda t: (t["score"] >= threshold) & (F.size(t["matched_columns"]) > 0)
    )
    direct = F.filter(
        strong,
        lambda t: F.exists(t["evidence"], lambda e: F.contains(e, F.lit("direct")) | F.contains(e, F.lit("plural"))),
    )
    return F.when(F.size(direct) > 0, F.slice(direct, 1, max_tables)).otherwise(F.slice(strong, 1, 1))


def _blueprint_findings(number: int, rule: dict) -> list[Column]:
    here = F.col("blueprint.blueprint") == number
    found = []
    if rule.get("needs_contexts"):
        flat = ~(F.col("has_cte") | (F.col("select_count") >= 2))
        found.append(_when(here & flat, _finding("missing_query_blueprint_structure", "medium", 14)))
    if rule.get("needs_grouped_count"):
        counted = F.array_contains("functions", "COUNT") & F.col("has_group_by")
        found.append(_when(here & ~counted, _finding("missing_blueprint_grouped_count_context", "medium", 12)))
    if rule.get("detail_table"):
        table = F.lit(rule["detail_table"])
        found.append(_when(here & ~_satisfied(table), _finding("missing_blueprint_detail_table", "medium", 12, table)))
    for name in rule.get("detail_columns", []):
        lacking = ~F.array_contains("columns", name.upper())
        found.append(_when(here & lacking, _finding("missing_blueprint_detail_column", "medium", 8, F.lit(name))))
    if rule.get("window_column"):
        grain = "|".join(rule["window_grain"])
        pattern = rf"(?is)AVG\s*\(\s*[^)]*{rule['window_column']}[^)]*\)\s*OVER\s*\([^)]*({grain})"
        found.append(_when(here & ~F.col("sql").rlike(pattern), _finding("missing_blueprint_window_context", "medium", 10)))
    if rule.get("narrow_join_table"):
        clauses = sqltext.join_on_clauses(F.col("sql"), rule["narrow_join_table"])
        both = F.exists(
            clauses,
            lambda c: F.contains(F.upper(c), F.lit(rule["narrow_join_columns"][0].upper()))
            & F.contains(F.upper(c), F.lit(rule["narrow_join_columns"][1].upper())),
        )
        found.append(_when(here & both, _finding("overconstrained_subject_code_context", "medium", 12)))
    if rule.get("lookup_left"):
        left, right = F.lit(rule["lookup_left"]), F.lit(rule["lookup_right"])
        found.append(_when(here & ~_joined(left, right), _finding("missing_blueprint_lookup_join", "medium", 10)))
    return found


def verify(sqls: DataFrame, plans: DataFrame, catalog: DataFrame, blueprint_rules: list[dict]) -> DataFrame:
    """Findings and score per query: ``sqls(sql_id, question_id, sql, preview_rows)``, plans of ``build_plans``.

    ``preview_rows`` is the row count of a trial run, or NULL. Plans are unique per question; a question that holds
    most queries is split by the adaptive join. A query whose question has no plan stays; checks against a plan then
    find nothing.
    """
    row = join_wide(sql_features(sqls, catalog), plans, ["question_id"], "left")
    sql = F.col("sql")
    blank = strip(sql) == ""
    none = F.array().cast(NO_FINDINGS)
    missing_tables = F.slice(F.filter(high_evidence_tables(F.col("table_candidates")), lambda t: ~_satisfied(t["table"])), 1, 2)
    missing_operations = F.filter("operations", lambda o: ~operation_present(o["operation"]))
    used = lambda end: F.array_contains("tables", F.substring_index(end, ".", 1))
    relevant = F.filter(F.slice("join_candidates", 1, 8), lambda j: used(j["left"]) & used(j["right"]))
    shown = F.exists(F.slice(relevant, 1, 3), lambda j: _mentions(F.upper(sql), j["left"], j["right"]))
    slot = lambda s: F.when(
        ~_satisfied(s["table"]), _finding("missing_required_slot_table", "medium", 10, s["recommended"])
    ).when(
        ~F.array_contains("columns", F.upper(s["column"])),
        _finding("missing_required_slot_column", "medium", 10, s["recommended"]),
    )
    counted = lambda confidence: confidence.isin("high", "medium")
    groups = [
        _when(blank, _finding("empty_sql", "high", 80)),
        _when(~blank & ~sqltext.is_select_like(sql), _finding("not_select", "high", 70)),
        _when(F.col("parse_error"), _finding("parse_error", "medium", 20)),
        F.transform(missing_tables, lambda t: _finding("missing_high_evidence_table", "medium", 10, t["table"])),
        F.transform(missing_operations, lambda o: _finding("missing_required_operation", "medium", 12, o["operation"])),
        _when((F.size("tables") >= 2) & (F.size(relevant) > 0) & ~shown, _finding("weak_join_evidence", "medium", 10)),
        F.filter(
            F.transform(F.filter("slot_map", lambda s: counted(s["confidence"])), slot), lambda f: f.isNotNull()
        ),
        F.transform(
            F.filter("join_map", lambda j: counted(j["confidence"]) & ~_joined(j["left"], j["right"])),
            lambda j: _finding("missing_required_join", "medium", 10, F.concat(j["left"], F.lit(" = "), j["right"])),
        ),
        *[f for number, rule in enumerate(blueprint_rules) for f in _blueprint_findings(number, rule)],
        _when(
            F.contains(text.normalize(F.col("question")), F.lit("for each"))
            & ~F.col("has_group_by")
            & F.exists("operations", lambda o: o["operation"].isin(GRAIN_OPERATIONS)),
            _finding("grain_without_group_by", "medium", 12),
        ),
        _when(F.col("preview_rows") == 0, _finding("empty_result", "low", 8)),
    ]
    findings = F.concat(*[F.coalesce(g.cast(NO_FINDINGS), none) for g in groups])
    scored = row.withColumn("findings", findings)
    lost = F.aggregate("findings", F.lit(0), lambda total, f: total + f["penalty"])
    scored = scored.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)))
    serious = F.exists("findings", lambda f: f["severity"].isin("high", "medium"))
    return scored.select(
        "sql_id",
        "question_id",
        "score",
        (serious & (F.col("score") <= 90)).alias("should_repair"),
        "findings",
        "planner",
    )


def finding_rows(verified: DataFrame) -> DataFrame:
    """One row per finding, numbered in order of the checks."""
    return verified.select("sql_id", F.posexplode("findings").alias("place", "finding")).select("sql_id", "place", "finding.*")
