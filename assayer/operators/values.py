"""Question values in whole columns: an inverted lookup that reads every cell once and moves only hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.operators.ranking import join_index
from assayer.rules import vocab

#: Tables by name, each with the columns that are looked through.
Sources = dict[str, tuple[DataFrame, list[str]]]


def question_value_keys(questions: DataFrame) -> DataFrame:
    """Normalised values of each question, once each: ``(question_id, key)``."""
    keys = F.filter(F.transform(text.question_values(F.col("question")), text.normalize), lambda v: v != "")
    return questions.select("question_id", F.explode(F.array_distinct(keys)).alias("key"))


def cells(sources: Sources) -> DataFrame:
    """Every cell of the listed columns by its normalised text, of any length: ``(table, col_idx, column, key)``."""

    def of(name: str, frame: DataFrame, columns: list[str]) -> DataFrame:
        entries = [
            F.struct(F.lit(frame.columns.index(c)).alias("col_idx"), F.lit(c).alias("column"), text.normalize(F.col(c).cast("string")).alias("key"))
            for c in columns
        ]
        return frame.select(F.lit(name).alias("table"), F.inline(F.array(*entries)))

    return reduce(DataFrame.unionAll, [of(name, *source) for name, source in sources.items()]).where("key <> ''")


def column_hits(keys: DataFrame, sources: Sources) -> DataFrame:
    """Which columns hold a wanted key, anywhere: ``(key, table, col_idx, column, rows)``.

    The distinct wanted keys are counted: few enough go to the tasks that read the tables, so a cell that is not wanted
    never moves; more are joined by key. Either way hits of one key and column are added up before they move, so a value
    that fills a column is one row per task.
    """
    hits = join_index(cells(sources), keys.select("key").distinct(), ["key"])
    return hits.groupBy("key", "table", "col_idx", "column").agg(F.count("*").alias("rows"))


def value_hits(questions: DataFrame, sources: Sources) -> DataFrame:
    """Columns that hold a value of a question: ``(question_id, key, table, col_idx, column, rows)``."""
    wanted = question_value_keys(questions)
    # hits are a row per key and column; questions that share a value meet the same ones
    return wanted.join(column_hits(wanted, sources), "key").select("question_id", "key", "table", "col_idx", "column", "rows")


def value_scores(questions: DataFrame, sources: Sources) -> DataFrame:
    """Tables by the question values that their columns hold: ``(question_id, table, values, score)``.

    A value counts once per table, as a sampled example value does in table scores, but whole columns are looked through.
    """
    found = value_hits(questions, sources).groupBy("question_id", "table").agg(F.countDistinct("key").alias("values"))
    return found.withColumn("score", F.round(F.col("values") * F.lit(vocab.EXAMPLE_VALUE_WEIGHT), 3))
