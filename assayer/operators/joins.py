"""Joinable columns: profiles, compatibility, join candidates and column owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.operators.ranking import join_index, join_wide, top_rows
from assayer.rules import vocab
from assayer.session import materialize


def column_profiles(catalog: DataFrame, examples: DataFrame, max_values: int = 20) -> DataFrame:
    """Words, example values and value prefixes per column, from up to 20 example values of it."""
    is_row = F.col("kind") == "row"
    usable = examples.filter(
        F.col("value").isNotNull() & (F.lower("value") != "nan") & (is_row | (F.col("pos") < 8))
    )
    order = [F.when(is_row, 0).otherwise(1), F.col("pos"), F.col("value")]
    taken = top_rows(usable, ["table", "col_idx"], order, max_values)
    values = taken.groupBy("table", "col_idx").agg(
        F.array_sort(F.collect_set(F.nullif(text.normalize(F.col("value")), F.lit("")))).alias("values"),
        F.array_sort(
            F.collect_set(F.when(F.contains("value", F.lit("_")), F.substring_index("value", "_", 1)))
        ).alias("prefixes"),
    )
    words = text.tokens(F.col("column"), keep_stopwords=True, expand=True)
    return catalog.join(values, ["table", "col_idx"], "left").select(
        "table",
        "col_idx",
        "column",
        F.array_sort(words).alias("tokens"),
        F.coalesce("values", text.text_array([])).alias("values"),
        F.coalesce("prefixes", text.text_array([])).alias("prefixes"),
    )


def candidate_pairs(candidates: DataFrame, max_tables: int = 12) -> DataFrame:
    """Ordered table pairs of each question's first candidates, the better-ranked table on the left.

    At most 66 pairs per question; built inside the question's own row.
    """
    ranked = candidates.filter(F.col("rank") <= max_tables).groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "table")))["table"].alias("tables")
    )
    pairs = F.flatten(
        F.transform(
            "tables",
            lambda left, i: F.transform(
                F.slice("tables", i + 2, F.size("tables")),
                lambda right: F.struct(left.alias("left_table"), right.alias("right_table")),
            ),
        )
    )
    return ranked.select("question_id", F.inline(pairs))


def unordered_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct table pairs whatever the question and order."""
    return pairs.select(
        F.least("left_table", "right_table").alias("a"), F.greatest("left_table", "right_table").alias("b")
    ).distinct()


def _features(profiles: DataFrame) -> DataFrame:
    """What columns can meet on: ``(table, col_idx, kind, key)``."""

    def keyed(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    dept = F.when(
        F.arrays_overlap("tokens", text.text_array(vocab.DEPARTMENT_WORDS)), text.text_array(["dept"])
    ).otherwise(text.text_array([]))
    prefix_set = F.when(F.size("prefixes") > 0, F.array(F.array_join("prefixes", "\u0001"))).otherwise(text.text_array([]))
    return profiles.select(
        "table",
        "col_idx",
        F.inline(
            F.concat(
                keyed("name", F.array("column")),
                keyed("token", F.col("tokens")),
                keyed("value", F.col("values")),
                keyed("prefix", prefix_set),
                keyed("dept", dept),
            )
        ),
    )


def column_compatibility(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Scores of column pairs over given table pairs ``(a, b)``: ``(a, b, a_idx, b_idx, a_column, b_column, score,
    evidence)``.

    Columns meet on a shared key within their table pair, so a word that most columns of a catalog share joins only
    the columns of the two tables at hand. Computed once per table pair, however many questions need it.
    """
    features = _features(profiles)
    left = pairs.join(features.withColumnsRenamed({"table": "a", "col_idx": "a_idx"}), "a")
    right = features.withColumnsRenamed({"table": "b", "col_idx": "b_idx"})
    shared = lambda kind: F.when(F.col("kind") == kind, F.col("key"))
    met = (
        left.join(right, ["b", "kind", "key"])
        .groupBy("a", "b", "a_idx", "b_idx")
        .agg(
            F.bool_or(F.col("kind") == "name").alias("same_name"),
            F.array_sort(F.collect_set(shared("token"))).alias("tokens"),
            F.array_sort(F.collect_set(shared("value"))).alias("values"),
            F.bool_or(F.col("kind") == "prefix").alias("same_prefixes"),
        )
    )

    def has(words: list[str]) -> Column:
        return F.arrays_overlap("tokens", text.text_array(words))

    def side(name: str) -> DataFrame:
        return profiles.select(
            F.col("table").alias(name),
            F.col("col_idx").alias(f"{name}_idx"),
            F.col("column").alias(f"{name}_column"),
            F.struct(
                has(vocab.KEY_WORDS).alias("key"),
                has(vocab.DEPARTMENT_WORDS).alias("dept"),
                has(vocab.NAME_WORDS).alias("name"),
                F.col("prefixes").alias("prefixes"),
            ).alias(f"{name}_is"),
        )

    both = met.join(side("a"), ["a", "a_idx"]).join(side("b"), ["b", "b_idx"])
    a, b = F.col("a_is"), F.col("b_is")
    depts = a["dept"] & b["dept"]
    coded = depts & (a["name"] | b["name"]) & (a["key"] | b["key"]) & ((F.size(a["prefixes"]) > 0) | (F.size(b["prefixes"]) > 0))
    tokens, values = F.size("tokens"), F.size("values")
    parts = [
        # condition, points, evidence
        (F.col("same_name"), F.lit(6.0), F.lit("same column name")),
        (tokens > 0, tokens * 1.5, F.concat(F.lit("column token overlap: "), F.array_join("tokens", ", "))),
        (
            values > 0,
            F.least(F.lit(14.0), values * 4.0),
            F.concat(F.lit("example value overlap: "), F.array_join(F.slice("values", 1, 3), ", ")),
        ),
        (
            F.col("same_prefixes"),
            F.lit(4.0),
            F.concat(F.lit("matching value prefix: "), F.array_join(a["prefixes"], ", ")),
        ),
        (a["key"] & b["key"] & (tokens > 0), F.lit(2.0), F.lit("both columns are key/code/id-like")),
        (depts & (a["key"] | b["key"]), F.lit(5.0), F.lit("department/DLC key compatibility")),
        (coded, F.lit(6.0), F.lit("coded department-name field can join to department/DLC key")),
    ]
    score = sum((F.when(when, points).otherwise(0.0) for when, points, _ in parts), F.lit(0.0))
    evidence = F.filter(F.array(*[F.when(when, words) for when, _, words in parts]), lambda e: e.isNotNull())
    return both.select(
        "a", "b", "a_idx", "b_idx", "a_column", "b_column", score.alias("score"), evidence.alias("evidence")
    ).filter("score > 0")


def best_columns(compatibility: DataFrame, min_score: float = 3.0) -> DataFrame:
    """The best column pair of each ordered table pair, for both orders.

    Equal scores go to the earlier left column, then to the earlier right one, so the order of tables can matter.
    """

    def ordered(left: str, right: str) -> Column:
        return F.struct(
            F.col(left).alias("left_table"),
            F.col(right).alias("right_table"),
            F.col(f"{left}_idx").alias("left_idx"),
            F.col(f"{right}_idx").alias("right_idx"),
            F.concat_ws(".", left, f"{left}_column").alias("left"),
            F.concat_ws(".", right, f"{right}_column").alias("right"),
            F.col("score").alias("score"),
            F.slice("evidence", 1, 5).alias("evidence"),
        )

    both = compatibility.filter(F.col("score") >= min_score).select(F.inline(F.array(ordered("a", "b"), ordered("b", "a"))))
    order = [F.col("score").desc(), F.col("left_idx"), F.col("right_idx")]
    best = top_rows(both, ["left_table", "right_table"], order, 1)
    return best.select("left_table", "right_table", "left", "right", F.round("score", 3).alias("score"), "evidence")


def join_candidates(candidates: DataFrame, profiles: DataFrame, max_tables: int = 12, max_joins: int = 16) -> DataFrame:
    """The strongest joins among each question's candidate tables.

    The best columns per table pair are written: they are few, while the ranked tables behind them are many.
    """
    ranked = materialize(candidates.select("question_id", "rank", "table"), "ranked")
    pairs = candidate_pairs(ranked, max_tables)
    best = materialize(best_columns(column_compatibility(unordered_pairs(pairs), profiles)), "joins")
    found = join_index(pairs, best, ["left_table", "right_table"])
    order = [F.col("score").desc(), F.col("left"), F.col("right")]
    return top_rows(found, ["question_id"], order, max_joins, rank="rank").select(
        "question_id", "rank", "left", "right", "score", "evidence"
    )


def is_family(expected: Column, actual: Column) -> Column:
    """Whether a table is the expected one, a longer name of it, or the base of an expected summary; case-blind."""
    wanted, given = F.upper(expected), F.upper(actual)
    base = F.regexp_extract(wanted, r"(?s)^(.*)_SUMMARY$", 1)
    return (given == wanted) | given.startswith(F.concat(wanted, F.lit("_"))) | (wanted.endswith("_SUMMARY") & (base == given))


def column_owners(wants: DataFrame, catalog: DataFrame, candidates: DataFrame) -> DataFrame:
    """The table that should supply a wanted column, and up to five alternatives.

    ``wants(question_id, want, column_names, preferred, avoided)``; the result has one row per want with an owner.
    """
    named = wants.select("question_id", "want", "preferred", "avoided", F.explode("column_names").alias("name"))
    named = named.select("*", F.upper("name").alias("key")).drop("name").distinct()
    owners = catalog.select("table", "column", F.upper("column").alias("key"))
    ranks = candidates.select("question_id", "table", "rank")
    scored = join_wide(join_index(named, owners, ["key"]), ranks, ["question_id", "table"], "left")
    matches = lambda tables: F.size(F.filter(tables, lambda t: is_family(t, F.col("table"))))
    score = (
        F.coalesce(F.greatest(F.lit(0), 20 - F.col("rank")), F.lit(0))
        + matches("preferred") * 45
        - matches("avoided") * 25
        + F.when(F.col("table").endswith("_SUMMARY"), 3).otherwise(0)
    ).cast("double")
    order = [F.col("score").desc(), F.col("table"), F.col("column")]
    top = top_rows(scored.withColumn("score", score), ["question_id", "want"], order, 6, rank="place")
    listed = F.array_sort(F.collect_list(F.struct("place", "table", "column", "score")))
    return top.groupBy("question_id", "want").agg(listed.alias("owners")).select(
        "question_id",
        "want",
        F.col("owners")[0]["table"].alias("table"),
        F.col("owners")[0]["column"].alias("column"),
        F.transform(
            F.slice("owners", 2, 5),
            lambda o: F.struct(o["table"].alias("table"), o["column"].alias("column"), o["score"].alias("score")),
        ).alias("alternatives"),
    )
