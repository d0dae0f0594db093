"""Question values found anywhere in a column, however many values it holds."""

from assayer.operators import ranking, values
from assayer.sources import catalog


def tables(spark):
    names = spark.range(20_000).selectExpr("id AS k", "concat('Name', id) AS name", "if(id % 3 = 0, 'Hot Value', NULL) AS kind")
    long = spark.createDataFrame([("x" * 500 + " End",), ("short",)], "body string")
    return {"names": (names, ["name", "kind"]), "texts": (long, ["body"])}


def asked(spark):
    rows = [(1, "Where is 'name12345' and 'Hot value'?"), (2, "who has 'hot VALUE'?"), (3, "nothing here"), (4, f"find '{'x' * 500}  end'"), (5, "'unseen' or '--'")]
    return spark.createDataFrame(rows, "question_id int, question string")


WANT = {(1, "name12345", "names", "name", 1), (1, "hot value", "names", "kind", 6667), (2, "hot value", "names", "kind", 6667), (4, "x" * 500 + " end", "texts", "body", 1)}


def test_values_are_found_beyond_any_sample(spark):
    sources = tables(spark)
    sampled = {r["value"].lower() for r in catalog.sampled_values(sources).collect()}
    assert "name12345" not in sampled
    got = {(r["question_id"], r["key"], r["table"], r["column"], r["rows"]) for r in values.value_hits(asked(spark), sources).collect()}
    assert got == WANT
    scores = {(r["question_id"], r["table"]): r["values"] for r in values.value_scores(asked(spark), sources).collect()}
    assert scores == {(1, "names"): 2, (2, "names"): 1, (4, "texts"): 1}


def test_many_wanted_keys_are_joined_by_key(spark, monkeypatch):
    plain = ranking.join_index
    monkeypatch.setattr(values, "join_index", lambda keyed, index, on: plain(keyed, index, on, max_rows=1))
    got = {(r["question_id"], r["key"], r["table"], r["column"], r["rows"]) for r in values.value_hits(asked(spark), tables(spark)).collect()}
    assert got == WANT
