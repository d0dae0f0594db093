"""Rule-driven slot maps, join maps and blueprints.

Rules come as plain data (see ``assayer.rules``). A rule set is small and fixed, so it becomes expressions on the
question's row; only wanted columns meet the catalog, by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.functions.text import text_array
from assayer.operators.joins import column_owners, is_family
from assayer.operators.ranking import join_wide, spread, top_rows

ROLE_ORDER = ["grain", "filter", "output", "measure", "window_or_join"]


def _plain(phrase: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in phrase.lower()).split())


def _any(q: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(q, F.lit(_plain(p))) for p in phrases], F.lit(False))


def _all(q: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(q, F.lit(_plain(p))) for p in phrases], F.lit(True))


def _tables_of(rules: list[dict]) -> set[str]:
    fixed = {r["fixed"][0] for r in rules if r.get("fixed")}
    return fixed | {table for r in rules for table, _ in r.get("preferred", [])}


def _want(number: int, rule: dict, q: Column, present: set[str]) -> Column:
    """The rule's wanted column as a struct, or NULL where the question does not trigger it."""
    text_type = "string"
    triggered = _any(q, rule["aliases"]) & _all(q, rule.get("also", [])) & ~_any(q, rule.get("unless", []))
    preferred = F.lit(None).cast(text_type)
    for table, phrases in reversed(rule.get("preferred", [])):
        if not phrases or table in present:
            preferred = F.when(_any(q, phrases) if phrases else F.lit(True), table).otherwise(preferred)
    chosen = preferred.isNotNull()
    active = (_any(q, rule["operation_when"]) if rule.get("operation_when") else F.lit(True)) if rule.get("operation") else F.lit(False)
    confidence = {
        "preferred": F.when(chosen, "high").otherwise("medium"),
        "operation": F.when(active, "high").otherwise("medium"),
    }.get(rule["confidence"], F.lit(rule["confidence"]))
    fixed_table, fixed_column = rule.get("fixed", (None, None))
    avoid = chosen if rule.get("preferred") else F.lit(True)
    return F.when(
        triggered,
        F.struct(
            F.lit(number).alias("want"),
            F.lit(rule["slot"]).alias("slot"),
            F.lit(rule["role"]).alias("role"),
            F.lit(ROLE_ORDER.index(rule["role"])).alias("role_order"),
            text_array(rule["columns"]).alias("column_names"),
            F.lit(fixed_table).cast(text_type).alias("fixed_table"),
            F.lit(fixed_column).cast(text_type).alias("fixed_column"),
            F.when(chosen, F.array(preferred)).otherwise(text_array([])).alias("preferred"),
            F.when(avoid, text_array(rule.get("avoid", []))).otherwise(text_array([])).alias("avoided"),
            F.when(active, F.lit(rule.get("operation")).cast(text_type)).alias("operation"),
            confidence.alias("confidence"),
            F.lit(rule["reason"]).alias("reason"),
        ),
    )


def slot_map(questions: DataFrame, catalog: DataFrame, candidates: DataFrame, rules: list[dict]) -> DataFrame:
    """Required slots with owner columns, best first by role: one row per question and slot."""
    named = _tables_of(rules)
    # at most one row per table the rules name
    present = {r["table"] for r in catalog.filter(F.col("table").isin(*named)).select("table").distinct().collect()} if named else set()
    usable = [r for r in rules if not r.get("fixed") or r["fixed"][0] in present]
    asked = spread(questions).select("question_id", text.normalize(F.col("question")).alias("q"))
    wants = asked.select(
        "question_id",
        F.inline(
            F.filter(
                F.array(*[_want(i, r, F.col("q"), present) for i, r in enumerate(usable)]), lambda w: w.isNotNull()
            )
        ),
    )
    owners = column_owners(wants.filter("fixed_table IS NULL"), catalog, candidates)
    owned = join_wide(wants, owners, ["question_id", "want"], "left").select(
        "question_id",
        "want",
        "slot",
        "role",
        "role_order",
        F.coalesce("fixed_table", "table").alias("table"),
        F.coalesce("fixed_column", "column").alias("column"),
        "operation",
        "confidence",
        "reason",
        F.coalesce("alternatives", F.array().cast("array<struct<table:string,column:string,score:double>>")).alias("alternatives"),
    ).filter("table IS NOT NULL")
    key = owned.withColumn("operation_key", F.coalesce("operation", F.lit("")))
    once = top_rows(key, ["question_id", "slot", "role", "table", "column", "operation_key"], [F.col("want")], 1)
    slots = once.withColumn("recommended", F.concat_ws(".", "table", "column"))
    order = [F.col("role_order"), F.col("slot"), F.col("recommended"), F.col("want")]
    return top_rows(slots, ["question_id"], order, len(rules), rank="place").select(
        "question_id", "place", "slot", "role", "table", "column", "recommended", "operation", "confidence", "reason", "alternatives"
    )


def _slot_tables(questions: DataFrame, slots: DataFrame) -> DataFrame:
    """Questions with the distinct tables of their slots; a question has at most one slot per rule."""
    tables = slots.groupBy("question_id").agg(F.collect_set("table").alias("slot_tables"))
    asked = spread(questions).select("question_id", text.normalize(F.col("question")).alias("q"))
    return join_wide(asked, tables, ["question_id"])


def _applies(rule: dict) -> Column:
    """Whether a rule's tables are all among the slots and the question has and lacks the right phrases."""
    q = F.col("q")
    has = lambda name: F.exists("slot_tables", lambda t: is_family(F.lit(name), t))
    there = [has(name) for name in rule["tables"]]
    worded = _any(q, rule["when"]) if rule.get("when") else F.lit(True)
    return reduce(lambda a, b: a & b, there) & worded & ~_any(q, rule.get("unless", []))


def join_map(questions: DataFrame, slots: DataFrame, rules: list[dict]) -> DataFrame:
    """Required joins; of rules for the same two columns the first holds."""
    found = F.array(
        *[
            F.when(
                _applies(rule),
                F.struct(
                    F.lit(number).alias("place"),
                    *[F.lit(rule[name]).alias(name) for name in ("left", "right", "role", "confidence", "reason")],
                ),
            )
            for number, rule in enumerate(rules)
        ]
    )
    rows = _slot_tables(questions, slots).select("question_id", F.inline(F.filter(found, lambda j: j.isNotNull())))
    pair = F.array_sort(F.array("left", "right"))
    return top_rows(rows.withColumn("pair", pair), ["question_id", "pair"], [F.col("place")], 1).drop("pair")


# fixed values: parts of a context's description, in order, with their separators
_CONTEXT_PARTS = [("tables", "tables", ", "), ("joins", "joins", "; "), ("filters", "filters", "; "), ("outputs", "outputs", ", "), ("group_by", "group by", ", ")]


def _context_lines(rule: dict) -> list[str]:
    lines = []
    for context in rule.get("contexts", []):
        lines.append(f"- {context['name']}: {context['purpose']}")
        lines += [f"  {label}: {between.join(context[key])}" for key, label, between in _CONTEXT_PARTS if context.get(key)]
    return lines


def blueprints(questions: DataFrame, slots: DataFrame, rules: list[dict]) -> DataFrame:
    """The first blueprint that applies to each question, by number and pattern."""
    chosen = F.array(
        *[
            F.when(
                _applies(rule),
                F.struct(
                    F.lit(number).alias("blueprint"),
                    F.lit(rule["pattern"]).alias("pattern"),
                    F.lit("high").alias("confidence"),
                    F.lit(rule["reason"]).alias("reason"),
                    text_array(rule["structure"]).alias("structure"),
                    text_array(_context_lines(rule)).alias("contexts"),
                    text_array(rule["guardrails"]).alias("guardrails"),
                    text_array(rule.get("skeleton", [])).alias("skeleton"),
                ),
            )
            for number, rule in enumerate(rules)
        ]
    )
    first = F.get(F.filter(chosen, lambda b: b.isNotNull()), F.lit(0))
    return _slot_tables(questions, slots).select("question_id", first.alias("b")).filter("b IS NOT NULL").select("question_id", "b.*")
