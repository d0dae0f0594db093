"""Schema linking: which tables and columns a question is about.

Questions meet the catalog through keys - tokens, word runs, plural endings, values - never by a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.operators.ranking import join_index, join_wide, spread, top_rows
from assayer.rules import vocab
from assayer.sources.catalog import flatten_examples

_PLURALS = ("s", "es")
_PREFIX_CHARS = 4


def _named(catalog: DataFrame) -> DataFrame:
    """Tables and columns as one list of named things; a table has no column index."""
    # every table has one first column
    tables = catalog.filter("col_idx = 0").select(
        "table", F.lit(None).cast("int").alias("col_idx"), F.col("table").alias("name")
    )
    return tables.unionByName(catalog.select("table", "col_idx", F.col("column").alias("name")))


def table_index(catalog: DataFrame, examples: DataFrame) -> DataFrame:
    """Weights by key: ``(kind, key, table, weight)``, columns of a table already added up."""
    named = _named(catalog)
    of_table = F.col("col_idx").isNull()

    def weight(table_weight: float, column_weight: float) -> Column:
        return F.when(of_table, F.lit(table_weight)).otherwise(F.lit(column_weight))

    tokens = named.select(
        F.lit("token").alias("kind"),
        F.explode(text.tokens(F.col("name"), keep_stopwords=True)).alias("key"),
        "table",
        weight(vocab.TABLE_TOKEN_WEIGHT, vocab.COLUMN_TOKEN_WEIGHT).alias("weight"),
    )
    phrases = named.select(
        F.lit("gram").alias("kind"),
        text.phrase(F.col("name")).alias("key"),
        "table",
        weight(vocab.TABLE_PHRASE_WEIGHT, vocab.COLUMN_PHRASE_WEIGHT).alias("weight"),
    )
    flat = flatten_examples(examples)
    values = (
        flat.filter(F.length("value") <= 80)
        .select(F.lit("value").alias("kind"), text.normalize(F.col("value")).alias("key"), "table")
        .filter("key <> ''")
        .distinct()
        .withColumn("weight", F.lit(vocab.EXAMPLE_VALUE_WEIGHT))
    )
    coded = (
        flat.filter(F.col("value").startswith("D_"))
        .select(F.lit("coded").alias("kind"), F.lit("coded").alias("key"), "table")
        .distinct()
        .withColumn("weight", F.lit(vocab.CODED_EXAMPLE_WEIGHT))
    )
    return (
        tokens.unionByName(phrases)
        .groupBy("kind", "key", "table")
        .agg(F.sum("weight").alias("weight"))
        .unionByName(values)
        .unionByName(coded)
    )


def plural_index(catalog: DataFrame) -> DataFrame:
    """Plural forms of every name by join key: ``(key, plural, table, col_idx, weight)``."""
    named = _named(catalog).withColumn("phrase", text.phrase(F.col("name")))
    forms = named.withColumn("plural", F.explode(F.array(*[F.concat("phrase", F.lit(end)) for end in _PLURALS])))
    return forms.select(
        text.plural_key(F.col("plural")).alias("key"),
        "plural",
        "table",
        F.coalesce("col_idx", F.lit(-1)).alias("col_idx"),
        F.when(F.col("col_idx").isNull(), F.lit(vocab.TABLE_PLURAL_WEIGHT))
        .otherwise(F.lit(vocab.COLUMN_PLURAL_WEIGHT))
        .alias("weight"),
    )


def question_keys(questions: DataFrame, longest_run: int = 4) -> DataFrame:
    """Everything a question can be found by: ``(question_id, kind, key)``; word runs of up to ``longest_run`` words."""
    q = F.col("question")
    found = questions.select("question_id", q, text.tokens(q).alias("tokens"))

    def keyed(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    values = F.filter(F.transform(text.question_values(q), text.normalize), lambda v: v != "")
    coded = F.when(
        F.arrays_overlap("tokens", text.text_array(vocab.CODED_DEPARTMENT_WORDS)), text.text_array(["coded"])
    ).otherwise(text.text_array([]))
    return found.select(
        "question_id",
        F.inline(
            F.concat(
                keyed("token", F.col("tokens")), keyed("gram", text.ngrams(q, longest_run)), keyed("value", values), keyed("coded", coded)
            )
        ),
    )


def table_scores(questions: DataFrame, catalog: DataFrame, examples: DataFrame) -> DataFrame:
    """Relevance of every table with any evidence: ``(question_id, table, score)``."""
    questions = spread(questions)
    index = table_index(catalog, examples)
    # runs and endings of a length that no name has meet none, so they are not made
    words = index.filter("kind = 'gram'").agg(F.max(F.size(F.split("key", " ")))).first()[0]
    direct = join_index(question_keys(questions, min(max(words or 1, 1), 4)), index, ["kind", "key"]).select("question_id", "table", "weight")
    plurals = plural_index(catalog)
    chars = plurals.agg(F.min(F.length("key")).alias("least"), F.max(F.length("key")).alias("most")).first()
    pieces = text.plural_keys(F.col("question"), chars["least"] or 1, chars["most"] or 1)
    ends = questions.select("question_id", F.explode(pieces).alias("key"))
    near = join_index(ends, plurals, ["key"])
    long = F.length("plural") > text.PLURAL_KEY_CHARS
    if plurals.filter(long).limit(1).count():
        # names longer than a key: their last characters occur, the whole is looked up in the question
        bodies = questions.select("question_id", text.normalize(F.col("question")).alias("body"))
        checked = join_wide(near.filter(long), bodies, ["question_id"]).filter(F.contains("body", "plural")).drop("body")
        near = near.filter(~long).unionByName(checked)
    named_once = near.select("question_id", "table", "col_idx", "weight").distinct()
    return (
        direct.unionByName(named_once.select("question_id", "table", "weight"))
        .groupBy("question_id", "table")
        .agg(F.round(F.sum("weight"), 3).alias("score"))
        .filter("score > 0")
    )


def top_tables(scores: DataFrame, k: int = 12) -> DataFrame:
    return top_rows(scores, ["question_id"], [F.col("score").desc(), F.col("table").asc()], k, rank="rank")


def table_profiles(catalog: DataFrame, examples: DataFrame) -> DataFrame:
    """One row per table: its words, columns and example values. As large as the table is wide."""
    columns = catalog.groupBy("table").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "col_idx",
                    "column",
                    text.phrase(F.col("column")).alias("phrase"),
                    text.tokens(F.col("column"), keep_stopwords=True).alias("tokens"),
                )
            )
        ).alias("column_info")
    )
    values = flatten_examples(examples).groupBy("table").agg(
        F.array_distinct(
            F.collect_list(F.when(F.length("value") <= 80, text.normalize(F.col("value"))))
        ).alias("example_values"),
        F.bool_or(F.col("value").startswith("D_")).alias("coded_examples"),
    )
    return columns.join(values, "table", "left").select(
        "table",
        text.phrase(F.col("table")).alias("table_phrase"),
        text.tokens(F.col("table"), keep_stopwords=True).alias("table_tokens"),
        "column_info",
        F.coalesce("example_values", text.text_array([])).alias("example_values"),
        F.coalesce("coded_examples", F.lit(False)).alias("coded_examples"),
    )


def _listed(prefix: str, items: Column) -> Column:
    return F.concat(F.lit(prefix), F.array_join(items, ", "))


def _plural_hit(body: Column, name: Column) -> Column:
    return F.contains(body, F.concat(name, F.lit("s"))) | F.contains(body, F.concat(name, F.lit("es")))


def describe_candidates(top: DataFrame, questions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Candidates with their matched columns (best ten) and evidence texts, from the few chosen pairs only."""
    q = F.col("question")
    features = spread(questions).select(
        "question_id",
        text.tokens(q).alias("q_tokens"),
        text.ngrams(q).alias("q_grams"),
        text.normalize(q).alias("q_body"),
        text.question_values(q).alias("q_values"),
    )
    pairs = join_index(join_wide(top, features, ["question_id"]), profiles, ["table"])

    def matched(column: Column) -> Column:
        overlap = F.array_sort(F.array_intersect("q_tokens", column["tokens"]))
        direct = F.array_contains("q_grams", column["phrase"])
        plural = _plural_hit(F.col("q_body"), column["phrase"])
        score = (
            F.when(direct, F.lit(vocab.COLUMN_PHRASE_WEIGHT)).otherwise(F.lit(0.0))
            + F.when(plural, F.lit(vocab.COLUMN_PLURAL_WEIGHT)).otherwise(F.lit(0.0))
            + F.size(overlap) * F.lit(vocab.COLUMN_TOKEN_WEIGHT)
        )
        reasons = F.array(
            F.when(direct, F.lit("direct column phrase")),
            F.when(plural, F.lit("plural/direct column phrase")),
            F.when(F.size(overlap) > 0, _listed("token overlap: ", overlap)),
        )
        return F.struct(
            (-F.round(score, 3)).alias("order"),
            column["column"].alias("column"),
            F.round(score, 3).alias("score"),
            F.filter(reasons, lambda r: r.isNotNull()).alias("evidence"),
        )

    columns = F.array_sort(F.filter(F.transform("column_info", matched), lambda m: m["score"] > 0))
    overlap = F.array_sort(F.array_intersect("q_tokens", "table_tokens"))
    hits = F.array_sort(F.filter("q_values", lambda v: F.array_contains("example_values", text.normalize(v)) & (text.normalize(v) != "")))
    evidence = F.array(
        F.when(F.size(overlap) > 0, _listed("table-name token overlap: ", overlap)),
        F.when(F.array_contains("q_grams", F.col("table_phrase")), F.concat(F.lit("direct table phrase: "), "table_phrase")),
        F.when(
            _plural_hit(F.col("q_body"), F.col("table_phrase")),
            F.concat(F.lit("plural/direct entity phrase: "), "table_phrase"),
        ),
        F.when(F.size(hits) > 0, _listed("example value hits: ", hits)),
        F.when(
            F.col("coded_examples") & F.arrays_overlap("q_tokens", text.text_array(vocab.CODED_DEPARTMENT_WORDS)),
            F.lit("example values look like DLC/department keys"),
        ),
    )
    return pairs.select(
        "question_id",
        "rank",
        "table",
        "score",
        F.transform(
            F.slice(columns, 1, 10),
            lambda m: F.struct(m["column"].alias("column"), m["score"].alias("score"), m["evidence"].alias("evidence")),
        ).alias("matched_columns"),
        F.slice(F.filter(evidence, lambda e: e.isNotNull()), 1, 8).alias("evidence"),
        F.transform("column_info", lambda c: c["column"]).alias("columns"),
    )


def table_candidates(questions: DataFrame, catalog: DataFrame, examples: DataFrame, top_k: int = 12) -> DataFrame:
    top = top_tables(table_scores(questions, catalog, examples), top_k)
    return describe_candidates(top, questions, table_profiles(catalog, examples))


def schema_search(questions: DataFrame, catalog: DataFrame, top_k: int = 8) -> DataFrame:
    """The light search: shared words, 8 for the table's name in the question and 3 per column name.

    Names count as plain substrings of the lower-cased question. Pairs are found by shared words or by the first four
    characters of a name; each is then scored in full.
    """
    questions = spread(questions)
    lower = F.lower("question")
    spoken = lambda name: F.replace(F.lower(name), F.lit("_"), F.lit(" "))
    profile = catalog.groupBy("table").agg(
        F.array_sort(F.collect_list(F.struct("col_idx", "column")))["column"].alias("columns")
    )
    profile = profile.select(
        "table",
        "columns",
        spoken(F.col("table")).alias("table_phrase"),
        F.transform("columns", spoken).alias("column_phrases"),
        text.search_tokens(F.concat_ws(" ", "table", F.array_join("columns", " "))).alias("tokens"),
    )
    head = lambda name: F.left(name, F.lit(_PREFIX_CHARS))
    index = profile.select(
        "table",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.transform("tokens", lambda t: F.concat(F.lit("w:"), t)),
                    F.transform(
                        F.array_append("column_phrases", F.col("table_phrase")), lambda p: F.concat(F.lit("p:"), head(p))
                    ),
                )
            )
        ).alias("key"),
    )
    pieces = text.bound(
        lower,
        lambda body: F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.length(body)),
                lambda at: F.transform(
                    F.sequence(F.lit(1), F.least(F.lit(_PREFIX_CHARS), F.length(body) - at + 1)),
                    lambda size: F.concat(F.lit("p:"), body.substr(at, size)),
                ),
            )
        ),
    )
    words = text.search_tokens(F.col("question"))
    keys = questions.filter("question <> ''").select(
        "question_id",
        F.explode(
            F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("w:"), w)), pieces))
        ).alias("key"),
    )
    pairs = join_index(keys, index, ["key"]).select("question_id", "table").distinct()
    scored = (
        join_index(
            join_wide(pairs, questions.select("question_id", lower.alias("q_lower"), words.alias("q_words")), ["question_id"]),
            profile,
            ["table"],
        )
        .select(
            "question_id",
            "table",
            "columns",
            F.contains("q_lower", "table_phrase").alias("phrase_match"),
            (
                F.size(F.array_intersect("q_words", "tokens"))
                + F.when(F.contains("q_lower", "table_phrase"), 8).otherwise(0)
                + F.size(F.filter("column_phrases", lambda p: F.contains("q_lower", p))) * 3
            ).alias("score"),
        )
        .filter("score > 0")
    )
    return top_rows(scored, ["question_id"], [F.col("score").desc(), F.col("table").asc()], top_k, rank="rank")


def distractor_warnings(candidates: DataFrame) -> DataFrame:
    """Name families with three or more of a question's first 15 candidates; at most six families."""
    parts = F.split("table", "_")
    family = F.array_join(F.slice(parts, 1, 2), "_")
    grouped = (
        candidates.filter("rank <= 15")
        .groupBy("question_id", family.alias("family"))
        .agg(F.array_sort(F.collect_list(F.struct("rank", "table")))["table"].alias("tables"))
        .filter(F.size("tables") >= 3)
    )
    kept = top_rows(grouped, ["question_id"], [F.col("family")], 6, rank="place")
    return kept.select(
        "question_id",
        "place",
        "family",
        F.slice("tables", 1, 5).alias("tables"),
        F.concat(
            F.lit("Many similar "),
            "family",
            F.lit(" tables ranked high: "),
            F.array_join(F.slice("tables", 1, 5), ", "),
            F.lit(". Choose by required columns and grain, not name similarity alone."),
        ).alias("warning"),
    )
