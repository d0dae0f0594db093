"""Gold text inside prompts and corpora, fairness findings and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import bound, normalize_sql
from assayer.rules.vocab import TOOL_TRACKS
from assayer.session import materialize

# fixed value: shorter gold texts prove nothing
MIN_GOLD_CHARS = 40

# gold sets up to this many characters travel to the texts, larger ones meet them by key
BROADCAST_CHARS = 32 * 1024 * 1024

# places of the filter that keys pass before they move: so many rows of one number are the most that is broadcast
FILTER_PLACES = 1 << 22

SHINGLE_WORDS = 3
LONG_WORD_CHARS = 10
GRAM_CHARS = 8


def keyed_leaks(prompts: DataFrame, gold: DataFrame) -> DataFrame:
    """Prompts that contain their own case's gold text: ``prompts(case_id, prompt)``, ``gold(case_id, gold_text)``."""
    usable = gold.select("case_id", normalize_sql(F.col("gold_text")).alias("gold_norm")).filter(
        F.length("gold_norm") >= MIN_GOLD_CHARS
    )
    held = F.contains(F.coalesce(normalize_sql(F.col("prompt")), F.lit("")), F.col("gold_norm"))
    return prompts.join(usable, "case_id").filter(held).drop("gold_norm")


def _text_keys(texts: DataFrame, *carried: str, grams: bool) -> DataFrame:
    """Hash keys of normalised texts, one row each: every run of three words and, where asked for, every 8-gram of
    the long words. Plain zipping and exploding, which compiles into the scan; a key may repeat within a text.
    """
    split = texts.select(*carried, F.split("text_norm", " ").alias("words"))
    later = lambda n: F.slice("words", F.lit(n), F.size("words"))
    runs = split.select(*carried, F.inline(F.arrays_zip("words", later(2), later(3))).alias("w1", "w2", "w3"))
    keys = runs.filter("w3 IS NOT NULL").select(*carried, F.xxhash64("w1", "w2", "w3").alias("key"))
    if grams:
        long_words = split.select(*carried, F.explode("words").alias("word")).filter(F.length("word") >= LONG_WORD_CHARS)
        starts = F.sequence(F.lit(1), F.length("word") - (GRAM_CHARS - 1))
        placed = long_words.select(*carried, "word", F.explode(starts).alias("start"))
        piece = F.col("word").substr(F.col("start"), F.lit(GRAM_CHARS))
        keys = keys.unionByName(placed.select(*carried, F.xxhash64(piece).alias("key")))
    return keys


def _grams(word: Column) -> Column:
    starts = F.sequence(F.lit(1), F.length(word) - (GRAM_CHARS - 1))
    return F.transform(starts, lambda i: F.xxhash64(word.substr(i, F.lit(GRAM_CHARS))))


def _inner_shingles(text_norm: Column) -> Column:
    """Keys a text must have if it contains this passage.

    The passage's first and last word may be parts of longer words there, so runs use the words between. With
    fewer than five words a passage of 40 characters has a word of ten or more; its 8-grams serve instead.
    """
    return bound(F.split(text_norm, " "), _keys_of_passage)


def _keys_of_passage(text_words: Column) -> Column:
    inner = F.slice(text_words, F.lit(2), F.greatest(F.size(text_words) - 2, F.lit(0)))
    runs = F.transform(
        F.sequence(F.lit(1), F.size(inner) - (SHINGLE_WORDS - 1)),
        lambda i: F.struct(
            F.length(F.array_join(F.slice(inner, i, F.lit(SHINGLE_WORDS)), " ")).alias("chars"),
            F.xxhash64(*[F.get(inner, i + (offset - 1)) for offset in range(SHINGLE_WORDS)]).alias("key"),
        ),
    )
    longest = F.get(F.array_sort(text_words, lambda a, b: F.length(b) - F.length(a)), F.lit(0))
    grams = F.transform(_grams(longest), lambda key: F.struct(F.lit(GRAM_CHARS).alias("chars"), key.alias("key")))
    return F.when(F.size(text_words) >= SHINGLE_WORDS + 2, runs).otherwise(grams)


def filtered_keys(keyed: DataFrame, wanted: DataFrame, places: int = FILTER_PLACES) -> DataFrame:
    """Rows of ``keyed(key, ...)`` whose key may be one of ``wanted(key)``: all that are, and a few others.

    A filter of fixed size goes to the rows: the places, modulo ``places``, that wanted keys take. Rows do not move.
    The more keys are wanted, the more others pass, so a full filter costs time but no result.
    """
    taken = wanted.select(F.pmod("key", F.lit(places)).alias("place")).distinct()
    # at most as many rows as there are places
    return keyed.join(F.broadcast(taken), F.pmod("key", F.lit(places)) == F.col("place"), "left_semi")


def corpus_leaks(texts: DataFrame, passages: DataFrame, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Pairs where a text contains a passage, without a common key.

    ``texts(text_id, text)``, ``passages(passage_id, passage)``; both sides unique by id. Each passage is found by
    one anchor key that every text containing it must have, then checked in full. A passage set of proven small size
    goes to the texts: one scan of the texts, no shuffle of them. Of a larger one a filter of fixed size goes to the
    texts; (key, id) of the hits is written once, meets the passages by their rarest key in the texts, and the few
    candidate pairs fetch their texts.
    """
    usable = (
        passages.select("passage_id", normalize_sql(F.col("passage")).alias("passage_norm"))
        .filter(F.length("passage_norm") >= MIN_GOLD_CHARS)
        .withColumn("anchors", _inner_shingles(F.col("passage_norm")))
    )
    few_words = F.size(F.split("passage_norm", " ")) < SHINGLE_WORDS + 2
    size = usable.agg(
        F.coalesce(F.sum(F.length("passage_norm")), F.lit(0)).alias("chars"),
        F.coalesce(F.bool_or(few_words), F.lit(False)).alias("grams"),
    ).first()
    # never NULL, or a filter on that would work the text out twice
    normalized = texts.select("text_id", F.coalesce(normalize_sql(F.col("text")), F.lit("")).alias("text_norm"))
    if size["chars"] <= broadcast_chars:
        anchored = usable.select("passage_id", "passage_norm", F.array_max("anchors")["key"].alias("key"))
        keyed = _text_keys(normalized, "text_id", "text_norm", grams=size["grams"])
        # size checked above
        found = keyed.join(F.broadcast(anchored), "key").filter(F.contains("text_norm", "passage_norm"))
        return found.select("text_id", "passage_id").distinct()
    keyed = _text_keys(normalized, "text_id", grams=size["grams"])
    wanted = usable.select("passage_id", F.explode("anchors.key").alias("key")).distinct()
    hits = materialize(filtered_keys(keyed, wanted), "leak-hits")
    counts = hits.groupBy("key").agg(F.count("*").alias("texts"))
    anchored = wanted.join(counts, "key").groupBy("passage_id").agg(F.min(F.struct("texts", "key"))["key"].alias("key"))
    candidates = hits.join(anchored, "key").select("text_id", "passage_id").distinct()
    return (
        candidates.join(usable.select("passage_id", "passage_norm"), "passage_id")
        .join(normalized, "text_id")
        .filter(F.contains("text_norm", "passage_norm"))
        .select("text_id", "passage_id")
    )


def run_findings(runs: DataFrame) -> DataFrame:
    """Findings about a run as a whole, one row each: ``(run_id, severity, code)``."""

    def finding(severity: str, code: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))

    track = F.coalesce("track", F.lit(""))
    candidates = F.array(
        finding("medium", "missing_prompt_set_hash", F.coalesce("prompt_set_sha256", F.lit("")) == ""),
        finding("low", "prompt_only", F.col("provider") == "prompt-only"),
        finding(
            "low",
            "agent_track_unclear",
            (F.col("provider") == "droid") & (track != "bounded-agent") & ~F.contains(track, F.lit("schema-plan")),
        ),
    )
    return runs.select("run_id", F.inline(F.filter(candidates, lambda f: f.isNotNull())))


def leak_findings(leaks: DataFrame) -> DataFrame:
    """One critical finding per leaking prompt: ``leaks(run_id, case_id)``."""
    return leaks.select("run_id", F.lit("critical").alias("severity"), F.lit("gold_sql_in_prompt").alias("code"), "case_id")


def classify_runs(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Fairness class and score eligibility per run. A run may have any number of findings; they reduce map-side."""
    blocking = findings.groupBy("run_id").agg(
        F.bool_or(F.col("severity").isin("critical", "high")).alias("has_blocking"), F.count("*").alias("findings")
    )
    bad = F.coalesce("has_blocking", F.lit(False))
    return runs.join(blocking, "run_id", "left").select(
        *runs.columns,
        F.coalesce("findings", F.lit(0)).cast("bigint").alias("finding_count"),
        F.when(bad, "diagnostic_contaminated")
        .when(F.col("mode") == "agentic_dbt", "agentic_fair")
        .when(F.col("track").isin(TOOL_TRACKS), "fair_with_tools")
        .otherwise("fair")
        .alias("classification"),
        (~bad & ~F.coalesce(F.col("provider") == "prompt-only", F.lit(False))).alias("score_eligible"),
    )


def rankable(report: DataFrame) -> DataFrame:
    """Rows fit for a leaderboard, with the group they may be compared in.

    Diagnostic and ineligible rows are out; raw, tool-assisted, bounded-agent and agentic rows, and pilot and full
    runs, never share a group.
    """
    kind = (
        F.when(F.col("mode") == "agentic_dbt", "agentic")
        .when(F.col("fairness_classification") == "fair_with_tools", "tool-assisted")
        .when(F.startswith("track", F.lit("bounded-agent")), "bounded-agent")
        .otherwise("raw")
    )
    fit = F.coalesce("score_eligible", F.lit(False)) & (F.col("fairness_classification") != "diagnostic_contaminated")
    return report.filter(fit & (F.col("scope") == "full")).withColumn("result_class", kind)
