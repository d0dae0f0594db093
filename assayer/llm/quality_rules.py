"""Quality rules with host verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import materialize, words

#: Fewest words, and most words of a hundred inside repeated windows, that the base rule lets pass.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Rules whose failures are counted per host; the base rule is the first.
RULES = {
    "base": f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "long_words": "n_words > 0 AND word_chars > 12 * n_words",
    "dup_lines": "n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines",
}
#: A host is rejected when this rate, shrunk, of its documents fails a rule.
HOST_LIMIT = 0.5


def text_features(docs: DataFrame) -> DataFrame:
    """Word, symbol, line and repetition counts of whole texts, added as columns; a null text has none of them.

    Repeated windows are found inside the row: each run of ``WINDOW`` words is hashed, and only texts with two equal
    hashes sort theirs to find where the repeats stand, so nothing is shuffled and memory follows the longest text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.withColumn("_words", words(F.col("text"))).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    base = base.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    window = ", ".join(f"_hashes[i + {k}]" for k in range(WINDOW))
    base = base.withColumn(
        "_windows",
        F.expr(
            f"CASE WHEN size(_hashes) >= {WINDOW} THEN transform(sequence(0, size(_hashes) - {WINDOW}), i -> xxhash64({window})) "
            "ELSE CAST(array() AS array<bigint>) END"
        ),
    )
    base = base.withColumn(
        "_sorted",
        F.expr("CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i))) END"),
    )
    base = base.withColumn(
        "_places",
        F.expr(
            "CASE WHEN _sorted IS NOT NULL THEN sort_array(transform(filter(transform(_sorted, (s, k) -> struct(s.i AS i, "
            "(k > 0 AND get(_sorted, k - 1).h = s.h) OR (k + 1 < size(_sorted) AND get(_sorted, k + 1).h = s.h) AS r)), "
            "x -> x.r), x -> x.i)) END"
        ),
    )
    repeat = F.expr(
        f"CASE WHEN _places IS NULL THEN 0L ELSE aggregate(transform(_places, (p, k) -> CASE WHEN k + 1 < size(_places) "
        f"THEN least({WINDOW}, get(_places, k + 1) - p) ELSE {WINDOW} END), 0L, (a, x) -> a + x) END"
    )
    counted = base.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeat.cast("long"),
        }
    )
    return counted.drop("_words", "_lines", "_hashes", "_windows", "_sorted", "_places")


def shrunk_rates(hosts: DataFrame, rules: list[str]) -> DataFrame:
    """Add ``rate_<rule>`` to ``hosts(n, bad_<rule>, ...)``: the share of failures, shrunk to what hosts have in common.

    The prior is a beta distribution whose mean is the share of all documents and whose strength is fitted by moments
    to the spread of the hosts' rates. Only its two numbers per rule go through the driver.
    """
    total = F.sum("n")
    first = hosts.agg(total.alias("n"), F.count("*").alias("hosts"), *((F.sum(f"bad_{r}") / total).alias(r) for r in rules)).first()
    if not first["n"]:
        return hosts.withColumns({f"rate_{r}": F.lit(None).cast("double") for r in rules})
    spread = hosts.agg(*((F.sum(F.col("n") * F.pow(F.col(f"bad_{r}") / F.col("n") - F.lit(first[r]), 2)) / total).alias(r) for r in rules)).first()
    rates = {}
    for r in rules:
        mean, var = first[r], spread[r]
        # what chance alone adds to the spread of rates
        noise = mean * (1 - mean) * first["hosts"] / first["n"]
        between = max(var - noise, 0.0)
        strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e4) if between > 1e-12 else 1e4
        rates[f"rate_{r}"] = (F.col(f"bad_{r}") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumns(rates)


def host_rules(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Features of each document, what it fails by itself, and whether its host and it are kept.

    Failures of each rule are summed per host (``host``; null is a host of its own), so a host of any size moves as one
    row per task. A host is rejected if a shrunk rate is above ``limit``. ``kept`` is false for documents that fail the
    base rule and for those of rejected hosts. A document without text has no words and fails; repeated rows count as
    often as they stand there; an empty table gives no rows. Other columns of the input, also such with names of the
    features, are left out.
    """
    rules = list(RULES)
    narrow = docs.select("doc_id", F.col(host).alias("host"), "text")
    made = text_features(narrow).drop("text").withColumns({f"bad_{r}": F.expr(test).cast("long") for r, test in RULES.items()})
    features = materialize(made, "quality-features")
    hosts = materialize(
        features.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(f"bad_{r}").alias(f"bad_{r}") for r in rules)), "hosts"
    )
    rated = shrunk_rates(hosts, rules)
    bad_host = F.greatest(*(F.col(f"rate_{r}") for r in rules), F.lit(0.0)) > F.lit(limit)
    verdicts = rated.select(F.col("host").alias("_host"), F.col("n").alias("host_docs"), *(f"rate_{r}" for r in rules), bad_host.alias("host_rejected"))
    joined = features.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    failed = F.col("bad_base") == 1
    return joined.withColumns({"base_failed": failed, "kept": ~failed & ~F.col("host_rejected")}).drop(*(f"bad_{r}" for r in rules))
