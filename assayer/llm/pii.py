"""Personal data by patterns and by the contexts that they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import materialize, meet

# What counts as a match of each kind, in order. A match begins where none of its first characters stands
# before it, or where the last match ended; so it is the leftmost one, and long runs are read once.
LOCAL = "A-Za-z0-9._%+-"
KINDS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: An unknown identifier: what stands before it, and a run with a digit or groups of digits.
RUN = "A-Za-z0-9@.+_/-"
BEFORE = r"[A-Za-z]++(?:[\t\x20]*[=:]+\s*[\"']?|[\t\x20])"
GROUPS = rf"\+?\(?[0-9]++\)?(?:[\x20-]\(?[0-9]++\)?)+(?![{RUN}])"
CANDIDATE = rf"(?<![A-Za-z]){BEFORE}(?:{GROUPS}|(?=[A-Za-z@.+_/-]*+[0-9])(?=[{RUN}]{{6}})[{RUN}]++)"
#: Fewest characters of an identifier.
SHORTEST = 6
#: Rounds of scoring from one set of known instances.
ROUNDS = 3
#: Fewest different seeds of a pattern, and the confidence that an instance needs.
SUPPORT = 3
CONFIDENCE = 0.8
#: Standard errors that a pattern's share of known instances may lie below what is needed.
ERRORS = 1.96


def _upper(share: str, n: str) -> Column:
    """Upper end of the score interval of a share among n."""
    p, n_, z2 = F.col(share), F.col(n).cast("double"), ERRORS**2
    return (p + z2 / (2 * n_) + ERRORS * F.sqrt(p * (1 - p) / n_ + z2 / (4 * n_ * n_))) / (1 + z2 / n_)


def _with_spans(docs: DataFrame, kind: str, pattern: str, hint: str | None) -> DataFrame:
    """Add ``_<kind>``, the places of all matches; a text is split only if it has one."""
    there = F.col("_text").contains(hint) if hint else F.col("_text").rlike("[0-9]")
    none = F.array().cast("array<string>")
    docs = docs.withColumn("_found", F.when(there, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none))
    gaps = F.when(F.size("_found") > 0, F.transform(F.split("_text", pattern, -1), F.length)).otherwise(F.array().cast("array<int>"))
    docs = docs.withColumn("_gaps", gaps).withColumn("_sizes", F.transform("_found", F.length))
    # ends of all matches: running sums of gaps and lengths, in blocks, since each sum copies the array before it
    docs = docs.withColumn("_steps", F.expr("transform(_sizes, (n, i) -> n + _gaps[i])"))
    docs = docs.withColumn(
        "_blocks",
        F.expr("CASE WHEN size(_steps) > 0 THEN transform(sequence(0, (size(_steps) - 1) div 128), b -> slice(_steps, int(b * 128 + 1), 128)) "
               "ELSE CAST(array() AS array<array<int>>) END"),
    )
    sums = "array(element_at(a, -1) + x)"
    docs = docs.withColumn(
        "_bases", F.expr(f"aggregate(transform(_blocks, b -> aggregate(b, 0, (a, x) -> a + x)), array(0), (a, x) -> concat(a, {sums}))")
    )
    docs = docs.withColumn(
        "_ends", F.expr(f"flatten(transform(_blocks, (b, k) -> slice(aggregate(b, array(_bases[k]), (a, x) -> concat(a, {sums})), 2, 128)))")
    )
    places = F.expr("transform(_found, (m, i) -> struct(_ends[i] - _sizes[i] AS s, _ends[i] AS e, m))")
    return docs.withColumn(f"_{kind}", places).drop("_found", "_gaps", "_sizes", "_steps", "_blocks", "_bases", "_ends")


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(p AS decimal(38, 0)), 0) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + "
    f"CASE WHEN i % 2 = 1 THEN int(substr(reverse({_DIGITS}), i, 1)) "
    f"ELSE 2 * int(substr(reverse({_DIGITS}), i, 1)) - CASE WHEN int(substr(reverse({_DIGITS}), i, 1)) > 4 THEN 9 ELSE 0 END END) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}


def base_spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_<kind>`` and ``base``, an array of ``(kind, s, e)``, of whole texts, with candidates ``_cand``.

    ``_rejected`` has the places ``(s, e)`` of what a pattern matched and its test did not accept.
    """
    spans = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    for kind, pattern in KINDS.items():
        spans = _with_spans(spans, kind, pattern, HINTS[kind])
        spans = spans.withColumn(f"_{kind}", F.expr(f"transform(_{kind}, x -> struct(x.s AS s, x.e AS e, {_VALID[kind]} AS valid))"))
    rejected = F.concat(*(F.expr(f"transform(filter(_{k}, x -> NOT x.valid), x -> struct(x.s AS s, x.e AS e))") for k in KINDS))
    spans = spans.withColumn("_rejected", rejected)
    spans = spans.withColumns({f"_{k}": F.expr(f"filter(_{k}, x -> x.valid)") for k in KINDS})
    spans = _with_spans(spans, "cand", CANDIDATE, None)
    every = F.concat(*(F.expr(f"transform(_{k}, x -> struct('{k}' AS kind, x.s AS s, x.e AS e))") for k in KINDS))
    counts = {f"n_{k}": F.size(f"_{k}").cast("long") for k in KINDS}
    return spans.withColumns({**counts, "base": every}).select("doc_id", *counts, "base", "_rejected", "_cand")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every whole text of ``docs(doc_id, text)``: kinds by pattern, and what shares their contexts.

    1. Matches of each kind that pass its test are base spans, whatever follows.
    2. A candidate is a run of at least six characters with a digit, or groups of digits, behind a word; the word and what
       joins them are its lexical pattern. Candidates inside base spans are the seeds, with confidence 1.
    3. In rounds, a pattern's share is the mean belief in its different instances, where each is judged without that
       pattern: a seed has 1, another one minus the product of what its other patterns leave open. So no pattern
       confirms itself, and one that holds other values too keeps a low share. Its score is the upper end of the share's
       95 % interval: few instances leave it open, many that are not known refute it. Patterns with fewer than three
       different seeds score nothing. An instance has one minus the product of what all its patterns leave open;
       those that then reach the confidence are seeds of the next rounds, until none newly reaches it.
    4. Candidates that reach the confidence and touch no base span become spans of kind ``found``, except numbers without
       a letter that touch a match which the test of its kind rejected.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found``. A null text is an empty one; repeated
    rows give repeated rows; an empty table gives none; other columns are left out.
    """
    base = materialize(base_spans(docs), "personal-data")
    each = base.where(F.size("_cand") > 0).select("doc_id", "base", "_rejected", F.explode_outer("_cand").alias("c"))
    value = F.regexp_replace("c.m", rf"\A{BEFORE}", "")
    cand = each.select(
        "doc_id",
        (F.col("c.e") - F.length(value)).cast("int").alias("s"),
        F.col("c.e").alias("e"),
        value.alias("value"),
        F.lower(F.regexp_replace(F.regexp_extract("c.m", rf"\A{BEFORE}", 0), r"\s+", " ")).alias("pattern"),
        "base",
        "_rejected",
    ).where(F.length("value") >= SHORTEST)
    cand = cand.withColumn("touches", F.expr("exists(base, x -> x.s < e AND s < x.e)"))
    refused = F.expr("NOT touches AND NOT value RLIKE '[A-Za-z]' AND exists(_rejected, x -> x.s < e AND s < x.e)")
    cand = cand.withColumn("refused", refused).drop("base", "_rejected")
    cand = materialize(cand, "candidates")
    # the graph: each pattern and instance once, however often they meet
    graph = materialize(
        cand.groupBy("pattern", "value").agg(F.max("touches").alias("seed"), F.min("refused").alias("refused")), "pattern-graph"
    )
    n_edges = graph.count()
    more_seeds = True
    while more_seeds:
        scored = graph.withColumn("belief", F.col("seed").cast("double"))
        for _ in range(ROUNDS):
            patterns = scored.groupBy("pattern").agg(
                F.sum(F.col("seed").cast("long")).alias("seeds"), F.avg("belief").alias("share"), F.count("*").alias("n")
            )
            score = F.when(F.col("seeds") >= SUPPORT, _upper("share", "n")).otherwise(0.0)
            patterns = patterns.select("pattern", "n", F.log(1 - F.least(score, F.lit(1 - 1e-9))).alias("left_open"))
            met = materialize(meet(graph, patterns, "pattern", ["value"], n_edges), "pattern-scores")
            instances = met.groupBy("value").agg(
                F.sum("left_open").alias("all_open"), F.max("seed").alias("known"), F.count("*").alias("n")
            )
            without = F.when(F.col("known"), 1.0).otherwise(1 - F.exp(F.least(F.col("all_open") - F.col("left_open"), F.lit(0.0))))
            reached = F.when(F.col("known"), 1.0).otherwise(1 - F.exp("all_open"))
            scored = materialize(
                meet(met, instances, "value", ["pattern"], n_edges).select(
                    "pattern", "value", "seed", "refused", without.alias("belief"), reached.alias("confidence")
                ),
                "pattern-graph",
            )
        passed = ~F.col("seed") & ~F.col("refused") & (F.col("confidence") >= CONFIDENCE)
        more_seeds = not scored.where(passed).isEmpty()
        graph = scored.select("pattern", "value", (F.col("seed") | passed).alias("seed"), "refused")
    sure = scored.where(F.col("confidence") >= CONFIDENCE).select("pattern", "value").distinct()
    found = cand.where("NOT touches AND NOT refused").join(sure, ["pattern", "value"]).groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct(F.lit("found").alias("kind"), "s", "e"))).alias("more")
    )
    named = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    out = base.drop("_cand", "_rejected").join(found, "doc_id", "left")
    more = F.coalesce("more", F.array().cast("array<struct<kind:string,s:int,e:int>>"))
    return out.select(
        "doc_id",
        *(f"n_{k}" for k in KINDS),
        F.sha2(named(F.col("base")), 256).alias("base_sha256"),
        named(F.concat("base", more)).alias("spans"),
        F.size(more).cast("long").alias("n_found"),
    )
