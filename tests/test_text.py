import pytest
from pyspark.sql import functions as F

from assayer.functions import text


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "output,answer",
    [
        ("a<ans>x</ans>b<ans>SELECT 1</ans>", "SELECT 1"),
        ("```sql\nSELECT 1\n```", "SELECT 1"),
        ("Here:\n```\nSELECT 1\n```", "Here:"),
        ("SQL: SELECT 1", "SELECT 1"),
        ("<ANS>SELECT 1</ANS>", "<ANS>SELECT 1</ANS>"),
        ("  SELECT 1\x1c", "SELECT 1"),
    ],
)
def test_answers(spark, output, answer):
    assert one(spark, output, text.extract_answer) == answer


@pytest.mark.parametrize(
    "question,operations",
    [
        ("Show a summary of accounts by country", ["sum", "count"]),
        ("Show the total sales and number of records", ["count", "sum"]),
        ("For each nation, the average balance ordered by name", ["avg", "order_by", "group_by"]),
        ("Dense rank of parts by price", ["dense_rank"]),
        ("Ranked parts", ["rank"]),
        ("the total unit price", []),
        ("how many variances", ["count", "variance"]),
    ],
)
def test_operations(spark, question, operations):
    assert [r["operation"] for r in one(spark, question, text.required_operations)] == operations


def test_grain(spark):
    found = one(spark, "For each store where open, sales per day and per day, by month ordered by year", text.required_grain)
    assert found == ["store", "day", "day by month", "month"]


def test_tokens(spark):
    assert set(one(spark, "The depts and sqft of a bus", text.tokens)) == {"depts", "dept", "sqft", "square", "footage", "feet", "of", "bus"}
    assert "organization" in one(spark, "dept", lambda c: text.tokens(c, expand=True))
    assert one(spark, "", text.tokens) == []


def test_ngrams(spark):
    assert set(one(spark, "the red Car", text.ngrams)) == {"red", "car", "the red", "red car", "the red car"}
    assert one(spark, "", text.ngrams) == []


def test_values(spark):
    found = one(spark, "Is 'a \"b\"' or \"c'd\" in New-York, éAbc Abcé or AB&C?", text.question_values)
    assert set(found) == {'a "b"', "c'd", "New-York", "AB&C"}


@pytest.mark.parametrize("phrase", ["account", "name of a very long table with many words", "s", "x"])
@pytest.mark.parametrize("question", ["Accounts and names of a very long table with many wordses", "buses", "boxes", ""])
def test_plural_keys_find_exactly_what_contains_finds(spark, phrase, question):
    keys = one(spark, question, text.plural_keys)
    body = one(spark, question, text.normalize)
    for plural in (phrase + "s", phrase + "es"):
        key = one(spark, plural, text.plural_key)
        assert (key in keys and plural in body) == (plural in body)


def test_plans(spark):
    plan = lambda value: one(spark, value, text.extract_plan)
    assert plan("none") is None
    full = plan('<PLAN> {"grain":1,"slots":{},"joins":[],"probes_needed":[],"risk_flags":[]} </plan><plan>x</plan>')
    assert full["parseable"] and full["missing_keys"] == []
    assert plan("<plan>[1]</plan>")["missing_keys"] == ["grain", "joins", "probes_needed", "risk_flags", "slots"]
    broken = plan("<plan>{x</plan>")
    assert not broken["parseable"] and broken["missing_keys"] is None


def test_normalize_sql(spark):
    assert one(spark, " SELECT\n 1 ;; ", text.normalize_sql) == "select 1 "
