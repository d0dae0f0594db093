import pytest
from pyspark.sql import functions as F

from assayer.operators import joins, linking, plan, verify
from assayer.rules import campus
from assayer.sources.catalog import CATALOG_SCHEMA, EXAMPLE_SCHEMA


def catalog(spark, tables):
    return spark.createDataFrame([(t, i, c, "") for t, cs in tables.items() for i, c in enumerate(cs)], CATALOG_SCHEMA)


def examples(spark, rows=()):
    return spark.createDataFrame(list(rows), EXAMPLE_SCHEMA)


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "question_id int, question string")


CUSTOMER = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]}


@pytest.mark.parametrize(
    "question,score", [("What is the average account balance per customer?", 11.2), ("Show the balance of all customers", 14.2), ("nothing", None)]
)
def test_table_score(spark, question, score):
    found = linking.table_scores(questions(spark, question), catalog(spark, CUSTOMER), examples(spark)).collect()
    assert [r["score"] for r in found] == ([] if score is None else [score])


def test_long_names_and_values(spark):
    cat = catalog(spark, {"a_very_long_table_name_of_many_words": ["x"], "t": ["dept_key"]})
    ex = examples(spark, [("t", 0, "row", 0, "D_1"), ("t", 0, "row", 1, "Big One"), ("t", 0, "row", 2, None), ("t", 0, "row", 3, "NaN")])
    asked = questions(spark, "all a very long table name of many words's", "a very long table name of many wordses", "is 'big one' or \"Big-One\" in the department?")
    got = {(r["question_id"], r["table"]): r["score"] for r in linking.table_scores(asked, cat, ex).collect()}
    # tokens very, long, table, name, of and many, and the plural of the whole name
    assert got[(1, "a_very_long_table_name_of_many_words")] == round(2.2 * 6 + 12, 3)
    # department of dept, two spellings of one example value, coded values
    assert got[(2, "t")] == round(1.4 + 4 * 2 + 0.4, 3)


def test_described_candidates_add_up(spark):
    cat = catalog(spark, {**CUSTOMER, "orders": ["o_orderkey", "o_custkey", "o_total_price"]})
    asked = questions(spark, "total price of orders per customer name", "customers")
    for r in linking.table_candidates(asked, cat, examples(spark)).collect():
        table = sum({"table-": 2.2 * len(e.split(": ")[1].split(", ")), "direct": 9, "plural": 12}[e[:6]] for e in r["evidence"])
        assert round(table + sum(m["score"] for m in r["matched_columns"]), 3) == r["score"]


def test_column_compatibility(spark):
    cat = catalog(spark, {"orders": ["o_custkey"], "customer": ["c_custkey"], "a": ["dept_name"], "b": ["dlc_key"]})
    shared = [("orders", 0, "col", i, str(i)) for i in range(5)] + [("customer", 0, "col", i, str(i)) for i in range(5)]
    coded = [("a", 0, "col", 0, "D_X"), ("b", 0, "col", 0, "D_Y")]
    pairs = spark.createDataFrame([("customer", "orders"), ("a", "b")], "a string, b string")
    got = {r["a"]: r for r in joins.column_compatibility(pairs, joins.column_profiles(cat, examples(spark, shared + coded))).collect()}
    assert got["customer"]["score"] == 15.5
    # five department words, equal prefixes, department with key, coded name
    assert got["a"]["score"] == 1.5 * 5 + 4 + 5 + 6


def test_hot_word_joins_only_within_table_pairs(spark):
    """A word that every column shares: pairs stay within the tables at hand."""
    cat = catalog(spark, {f"t{i}": [f"key_{j}" for j in range(5)] for i in range(30)})
    pairs = spark.createDataFrame([("t0", "t1")], "a string, b string")
    found = joins.column_compatibility(pairs, joins.column_profiles(cat, examples(spark)))
    assert found.count() == 25
    best = joins.best_columns(found).filter("left_table = 't1'").first()
    assert (best["left"], best["right"]) == ("t1.key_0", "t0.key_0")


CAMPUS = {
    "SIS_DEPARTMENT": ["DEPARTMENT_CODE", "DEPARTMENT_NAME", "SCHOOL_CODE", "DEPT_BUDGET_CODE", "IS_DEGREE_GRANTING"],
    "SIS_SUBJECT_CODE": ["SUBJECT_CODE", "SUBJECT_CODE_DESC", "SCHOOL_CODE", "SCHOOL_NAME", "DEPARTMENT_CODE"],
    "SUBJECT_OFFERED_SUMMARY": ["SUBJECT_OFFERED_SUMMARY_KEY", "SUBJECT_TITLE", "TOTAL_UNITS", "OFFER_DEPT_CODE"],
    "CIS_COURSE_CATALOG": ["SUBJECT_TITLE", "TOTAL_UNITS"],
}
ASKED = "For each subject offered, list the subject title, total units, subject code and the average department budget code within each school name of Mathematics"


def test_campus_plan_and_verification(spark):
    cat, ex, asked = catalog(spark, CAMPUS), examples(spark), questions(spark, ASKED)
    plans = plan.build_plans(
        asked, cat, ex, slot_rules=campus.SLOT_RULES, join_rules=campus.JOIN_RULES, blueprint_rules=campus.BLUEPRINT_RULES
    ).cache()
    p = plans.first()
    slots = {s["slot"]: s for s in p["slot_map"]}
    assert slots["subject title"]["recommended"] == "SUBJECT_OFFERED_SUMMARY.SUBJECT_TITLE"
    assert slots["subject title"]["confidence"] == "high"
    assert slots["subject title"]["alternatives"][0]["table"] == "CIS_COURSE_CATALOG"
    assert slots["department budget code"]["operation"] == "avg"
    assert p["slot_map"][0]["role"] == "grain"
    assert {j["role"] for j in p["join_map"]} == {"grain_join", "school_context_join"}
    assert p["blueprint"]["pattern"] == "multi_context_cte"
    context = plan.plan_context(plans).first()["context"]
    assert "Required slot map:" in context and "Query blueprint: multi_context_cte" in context
    assert "- dept_subject_counts: offered subjects counted by department" in context
    assert "  group by: SIS_DEPARTMENT.DEPARTMENT_CODE" in context
    assert context.endswith("keep the grain consistent.")
    audit = plan.plan_audit(plans.withColumn("pos", F.lit(0)), "campus", "pos").first()
    assert audit["items"] == 1 and len(audit["plans_sha256"]) == 64
    sqls = spark.createDataFrame(
        [
            (0, 0, "", None),
            (1, 0, "UPDATE x", None),
            (2, 0, "SELECT SUBJECT_TITLE FROM SUBJECT_OFFERED_SUMMARY s JOIN SIS_SUBJECT_CODE c ON s.SCHOOL_CODE = c.SCHOOL_CODE AND s.DEPARTMENT_CODE = c.DEPARTMENT_CODE", 0),
        ],
        "sql_id int, question_id int, sql string, preview_rows bigint",
    )
    checked = verify.verify(sqls, plans, cat, campus.BLUEPRINT_RULES)
    codes = {r["sql_id"]: [f["code"] for f in r["findings"]] for r in checked.collect()}
    assert codes[0][:2] == ["empty_sql", "parse_error"] and codes[1][0] == "not_select" and "parse_error" not in codes[1]
    assert "overconstrained_subject_code_context" in codes[2] and codes[2][-1] == "empty_result"
    assert codes[2].count("missing_blueprint_detail_column") == 1
    assert all(r["score"] == 0 and r["should_repair"] for r in checked.collect())


def test_sides_as_long_as_the_questions_are_never_broadcast(spark):
    cat, asked = catalog(spark, CUSTOMER), questions(spark, "customers by customer name", "name of the customer")
    top = linking.top_tables(linking.table_scores(asked, cat, examples(spark)))
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    described = linking.describe_candidates(top, asked, linking.table_profiles(cat, examples(spark)))
    assert "SortMergeJoin [question_id" in plan_of(described)
    wants = asked.selectExpr("question_id", "0 AS want", "array('c_name') AS column_names", "array('customer') AS preferred", "CAST(array() AS array<string>) AS avoided")
    owners = joins.column_owners(wants, cat, top)
    assert "SortMergeJoin [question_id" in plan_of(owners)
    assert {r["question_id"]: r["column"] for r in owners.collect()} == {0: "c_name", 1: "c_name"}


def test_question_words_are_worked_out_in_all_tasks(spark, tmp_path):
    from assayer.plans import queries

    spark.createDataFrame([(1, "n", 1, 1.0, "S")], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 0, "user", "one two")], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.QUERIES["question_ngrams"](spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert {r["question_id"]: r["grams"] for r in found.collect()}[1000] == 3


def test_only_runs_and_endings_as_long_as_names_are_made(spark, monkeypatch):
    from assayer.functions import text
    from assayer.operators import linking
    from assayer.sources.catalog import CATALOG_SCHEMA, EXAMPLE_SCHEMA

    entries = spark.createDataFrame([("big_part", 0, "key", ""), ("big_part", 1, "unit_price", ""), ("city", 0, "a", "")], CATALOG_SCHEMA)
    asked = ["Big parts by unit price", "unit prices of keys in the cityes", "as", "s", "", None, "the big part and the key"]
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id int, question string")
    examples = spark.createDataFrame([("city", 0, "col", 0, "Unit")], EXAMPLE_SCHEMA)
    ngrams, endings, made = text.ngrams, text.plural_keys, []
    scores = lambda: {tuple(r) for r in linking.table_scores(questions, entries, examples).collect()}
    with monkeypatch.context() as whole:
        whole.setattr(text, "ngrams", lambda q, n=4: ngrams(q))
        whole.setattr(text, "plural_keys", lambda q, *lengths: endings(q))
        expected = scores()
    monkeypatch.setattr(text, "ngrams", lambda q, n=4: made.append(n) or ngrams(q, n))
    monkeypatch.setattr(text, "plural_keys", lambda q, *lengths: made.append(lengths) or endings(q, *lengths))
    assert scores() == expected and len(expected) > 4
    assert made == [2, (2, 12)]
