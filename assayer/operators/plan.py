"""Schema plans: all linking results of a question in one row, and as prompt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.operators.joins import column_profiles, join_candidates
from assayer.operators.linking import distractor_warnings, table_candidates
from assayer.operators.provenance import tree_digest
from assayer.operators.ranking import join_wide, spread, top_rows
from assayer.operators.slots import blueprints, join_map, slot_map
from assayer.session import materialize

# fixed value
PLANNER_VERSION = "schema_plan_v3_non_gold_blueprints"
PLAN_JOINS = 80


def _parts(rows: DataFrame, order: str, name: str, fields: list[str]) -> DataFrame:
    """Per question an array of structs in order. Every part has a fixed upper length per question."""
    items = F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("item"))))
    return rows.groupBy("question_id").agg(items["item"].alias(name))


def build_plans(
    questions: DataFrame,
    catalog: DataFrame,
    examples: DataFrame,
    *,
    slot_rules: list[dict],
    join_rules: list[dict],
    blueprint_rules: list[dict],
    top_k: int = 12,
) -> DataFrame:
    """One plan row per question, from the question, names and example values only.

    All parts are grouped by question before they meet, so they share one partitioning.
    """
    # candidates and slots feed most parts: at most top_k and one per rule for each question
    candidates = materialize(table_candidates(questions, catalog, examples, top_k), "candidates")
    joins = join_candidates(candidates, column_profiles(catalog, examples), max_joins=PLAN_JOINS)
    slots = materialize(slot_map(questions, catalog, candidates, slot_rules), "slots")
    required = join_map(questions, slots, join_rules)
    blueprint = blueprints(questions, slots, blueprint_rules)
    parts = [
        _parts(candidates, "rank", "table_candidates", ["table", "score", "matched_columns", "evidence", "columns"]),
        _parts(joins, "rank", "join_candidates", ["left", "right", "score", "evidence"]),
        _parts(
            slots,
            "place",
            "slot_map",
            ["slot", "role", "table", "column", "recommended", "operation", "confidence", "reason", "alternatives"],
        ),
        _parts(required, "place", "join_map", ["left", "right", "role", "confidence", "reason"]),
        _parts(distractor_warnings(candidates), "place", "warnings", ["warning"]),
        blueprint.select("question_id", F.struct(*[c for c in blueprint.columns if c != "question_id"]).alias("blueprint")),
    ]
    plans = spread(questions).select(
        "question_id",
        "question",
        F.sha2("question", 256).alias("question_hash"),
        F.lit(PLANNER_VERSION).alias("planner"),
        text.required_operations(F.col("question")).alias("operations"),
        text.required_grain(F.col("question")).alias("grain"),
    )
    for part in parts:
        plans = join_wide(plans, part, ["question_id"], "left")
    empty = lambda name: F.coalesce(name, F.array().cast(plans.schema[name].dataType)).alias(name)
    lists = ["table_candidates", "join_candidates", "slot_map", "join_map", "warnings"]
    return plans.withColumns({name: empty(name) for name in lists})


def plan_audit(plans: DataFrame, dataset: str, pos: str) -> DataFrame:
    """One row: how many plans, by which planner, and digests of their questions and of the plans in order of ``pos`` (from 0).

    The digests are trees over chunks of plans, so no task reads all plans. No plans give no row.
    """
    body = F.to_json(F.struct(*[c for c in plans.columns if c != pos]))
    # read three times, while the plans behind it are wide
    hashed = materialize(
        plans.select(F.lit(dataset).alias("dataset"), F.col(pos).alias("pos"), "planner", "question_hash", F.sha2(body, 256).alias("plan_hash")),
        "hashes",
    )
    totals = hashed.groupBy("dataset").agg(F.count("*").alias("items"), F.max("planner").alias("planner"))
    digest = lambda piece, name: tree_digest(hashed, "dataset", "pos", piece).withColumnRenamed("digest", name)
    return totals.join(digest("question_hash", "questions_sha256"), "dataset").join(digest("plan_hash", "plans_sha256"), "dataset")


def _has_direct(evidence: Column) -> Column:
    return F.exists(evidence, lambda e: F.contains(e, F.lit("direct")) | F.contains(e, F.lit("plural")))


def context_joins(plans: DataFrame, max_tables: int = 8, max_joins: int = 8) -> DataFrame:
    """The best join per table pair among the leading tables, by the tables' ranks, then score.

    Tables with direct or plural evidence move up five ranks.
    """
    shown = F.slice("table_candidates", 1, max_tables)
    ranks = F.transform(
        shown,
        lambda t, i: F.named_struct(
            F.lit("table"),
            t["table"],
            F.lit("rank"),
            F.greatest(F.lit(1), i + 1 - F.when(_has_direct(t["evidence"]), 5).otherwise(0)),
        ),
    )
    rows = plans.select("question_id", ranks.alias("ranks"), F.posexplode("join_candidates").alias("at", "found")).select(
        "question_id", "ranks", "at", "found.*"
    )
    table = lambda end: F.substring_index(end, ".", 1)
    rank = lambda end: F.get(F.filter("ranks", lambda r: r["table"] == table(end)), F.lit(0))["rank"]
    known = rows.withColumn("rank_sum", rank("left") + rank("right")).filter("rank_sum IS NOT NULL")
    pair = F.array_sort(F.array(table("left"), table("right")))
    best = top_rows(known.withColumn("pair", pair), ["question_id", "pair"], [F.col("score").desc(), F.col("at")], 1)
    order = [F.col("rank_sum"), F.col("score").desc(), F.col("at")]
    return top_rows(best, ["question_id"], order, max_joins, rank="place").select(
        "question_id", "place", "left", "right", "score", "evidence"
    )


def _lines(condition: Column, *lines: Column) -> Column:
    """An array of lines, empty where the condition does not hold."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(*lines)).otherwise(text.text_array([]))


def _number(score: Column) -> Column:
    return score.cast("string")


def plan_context(plans: DataFrame, max_tables: int = 8, max_joins: int = 8) -> DataFrame:
    """Plans as prompt text: ``(question_id, context)``. Plans are read twice, so they are written first."""
    plans = materialize(plans, "plans")
    joins = _parts(context_joins(plans, max_tables, max_joins), "place", "shown_joins", ["left", "right", "score", "evidence"])
    plan = join_wide(plans, joins, ["question_id"], "left")
    filled = lambda name: F.size(name) > 0
    lit = F.lit
    slot_lines = F.flatten(
        F.transform(
            F.slice("slot_map", 1, 18),
            lambda s: F.filter(
                F.array(
                    F.concat(
                        lit("- "), s["slot"], lit(" ("), s["role"],
                        F.coalesce(F.concat(lit("; operation="), s["operation"]), lit("")),
                        lit(") -> "), s["recommended"], lit(" [confidence="), s["confidence"], lit("; "), s["reason"], lit("]"),
                    ),
                    F.when(
                        F.size(s["alternatives"]) > 0,
                        F.concat(
                            lit("  near alternatives to verify/avoid if grain conflicts: "),
                            F.array_join(
                                F.transform(F.slice(s["alternatives"], 1, 3), lambda a: F.concat(a["table"], lit("."), a["column"])), ", "
                            ),
                        ),
                    ),
                ),
                lambda line: line.isNotNull(),
            ),
        )
    )
    join_lines = F.transform(
        "join_map",
        lambda j: F.concat(
            lit("- "), j["left"], lit(" = "), j["right"], lit(" [role="), j["role"], lit("; confidence="), j["confidence"],
            lit("; "), j["reason"], lit("]"),
        ),
    )
    table_lines = F.flatten(
        F.transform(
            F.slice("table_candidates", 1, max_tables),
            lambda t: F.filter(
                F.array(
                    F.concat(lit("- "), t["table"], lit(" (score "), _number(t["score"]), lit("):")),
                    F.when(
                        F.size(t["matched_columns"]) > 0,
                        F.concat(
                            lit("  matched columns: "),
                            F.array_join(
                                F.transform(
                                    F.slice(t["matched_columns"], 1, 8),
                                    lambda m: F.concat(m["column"], lit(" ["), F.array_join(m["evidence"], "; "), lit("]")),
                                ),
                                ", ",
                            ),
                        ),
                    ),
                    F.concat(
                        lit("  columns: "), F.array_join(F.slice(t["columns"], 1, 32), ", "),
                        F.when(F.size(t["columns"]) > 32, " ...").otherwise(""),
                    ),
                    F.when(F.size(t["evidence"]) > 0, F.concat(lit("  evidence: "), F.array_join(t["evidence"], "; "))),
                ),
                lambda line: line.isNotNull(),
            ),
        )
    )
    shown = F.coalesce("shown_joins", F.array().cast(plan.schema["shown_joins"].dataType))
    shown_lines = F.transform(
        shown,
        lambda j: F.concat(
            lit("- "), j["left"], lit(" = "), j["right"], lit(" (score "), _number(j["score"]), lit("): "), F.array_join(j["evidence"], "; ")
        ),
    )
    b = F.col("blueprint")
    there = b.isNotNull()
    numbered = F.transform(b["structure"], lambda s, i: F.concat((i + 1).cast("string"), lit(". "), s))
    none = text.text_array([])
    parts = [
        F.array(
            lit("Tool result: schema_plan over the full dataset schema."),
            lit("This is non-gold schema-linking evidence. Use it to choose tables, joins, output fields, aggregates, and grain."),
        ),
        _lines(
            filled("operations"),
            F.concat(lit("Required operations inferred from question: "), F.array_join(F.col("operations.operation"), ", ")),
        ),
        _lines(filled("grain"), F.concat(lit("Requested row grain hints: "), F.array_join("grain", "; "))),
        _lines(
            filled("slot_map"),
            lit("Required slot map: recommended table.column ownership for outputs, filters, measures, and grain."),
            lit("Prefer these ownership recommendations over broader lexical table matches when they conflict."),
        ),
        slot_lines,
        _lines(
            filled("join_map"),
            lit("Required join map: mandatory join/key relationships implied by the slot map and question grain."),
        ),
        join_lines,
        _lines(
            there,
            F.concat(lit("Query blueprint: "), b["pattern"], lit(" [confidence="), b["confidence"], lit("; "), b["reason"], lit("]")),
            lit("Recommended structure:"),
        ),
        F.coalesce(numbered, none),
        _lines(there & (F.size(b["contexts"]) > 0), lit("Blueprint contexts:")),
        F.coalesce(b["contexts"], none),
        _lines(there, lit("Blueprint grain guardrails:")),
        F.coalesce(F.transform(b["guardrails"], lambda g: F.concat(lit("- "), g)), none),
        _lines(
            there & (F.size(b["skeleton"]) > 0),
            lit("Blueprint SQL skeleton hint; fill expressions, aliases, and selected columns from the slot map:"),
        ),
        F.coalesce(F.transform(b["skeleton"], lambda s: F.concat(lit("  "), s)), none),
        F.array(lit("Candidate tables with matched columns:")),
        table_lines,
        _lines(filled("join_candidates"), lit("Candidate join/key evidence:")),
        shown_lines,
        _lines(filled("warnings"), lit("Distractor warnings:")),
        F.transform("warnings", lambda w: F.concat(lit("- "), w["warning"])),
        F.array(
            lit("Before final SQL, map every requested output/filter/aggregate to one of the candidate columns and keep the grain consistent.")
        ),
    ]
    return plan.select("question_id", F.array_join(F.concat(*parts), "\n").alias("context"))
