"""Report rows, leaderboards, winners and the run matrix.

Every table shows accuracy beside SQL errors and cost beside cost per exact match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.cost import cost_per_exact


def report_rows(runs: DataFrame, summaries: DataFrame, audits: DataFrame) -> DataFrame:
    """One wide row per run; runs without summary or audit stay, marked so."""
    joined = runs.join(summaries, "run_id", "left").join(audits, "run_id", "left")
    return joined.select(
        "run_id",
        "benchmark",
        "mode",
        "dialect",
        "track",
        "provider",
        "model",
        "total_items",
        "total_evaluated",
        "skipped",
        "exact_matches",
        "execution_accuracy_pct",
        "prediction_error_count",
        "estimated_cost_usd",
        cost_per_exact(F.col("estimated_cost_usd"), F.col("exact_matches")).alias("cost_per_exact_match_usd"),
        "total_tokens",
        F.coalesce("classification", F.lit("not-audited")).alias("fairness_classification"),
        "score_eligible",
    )


def report_order() -> list:
    """Benchmark, track and accuracy, all descending, unknown accuracy last; the run id settles ties."""
    return [
        F.coalesce("benchmark", F.lit("")).desc(),
        F.coalesce("track", F.lit("")).desc(),
        F.coalesce("execution_accuracy_pct", F.lit(-1.0)).desc(),
        F.col("run_id").asc(),
    ]


def grouped_report(report: DataFrame) -> DataFrame:
    """Report rows with their (benchmark, track) group and place in it.

    A report has one row per run, so its groups are as small as the list of runs.
    """
    grouped = report.withColumns(
        {
            "benchmark_group": F.coalesce(F.nullif("benchmark", F.lit("")), F.lit("unknown")),
            "track_group": F.coalesce(F.nullif("track", F.lit("")), F.lit("unknown")),
        }
    )
    place = Window.partitionBy("benchmark_group", "track_group").orderBy(*report_order())
    return grouped.withColumn("place", F.row_number().over(place))


def roll_up_models(report: DataFrame, *keys: str) -> DataFrame:
    """Accuracy, errors and cost over all runs of a key (by default the model)."""
    totals = report.groupBy(*(keys or ("model",))).agg(
        F.sum("exact_matches").alias("exact_matches"),
        F.sum("total_evaluated").alias("total_evaluated"),
        F.sum("prediction_error_count").alias("prediction_error_count"),
        F.sum("estimated_cost_usd").alias("estimated_cost_usd"),
    )
    return totals.withColumns(
        {
            "execution_accuracy_pct": F.try_divide(F.col("exact_matches"), F.col("total_evaluated")) * 100,
            "cost_per_exact_match_usd": cost_per_exact(F.col("estimated_cost_usd"), F.col("exact_matches")),
        }
    )


def class_places(rankable: DataFrame) -> DataFrame:
    """Runs fit for a leaderboard with their ``place`` among the runs of their benchmark and result class."""
    best = [F.coalesce("execution_accuracy_pct", F.lit(-1.0)).desc(), F.col("run_id")]
    return rankable.withColumn("place", F.row_number().over(Window.partitionBy("benchmark", "result_class").orderBy(*best)))


def roll_up_levels(report: DataFrame, *keys: str) -> DataFrame:
    """``roll_up_models`` at every level of the keys at once, with the number of runs.

    ``level`` has a bit per key, the first one highest, that is set where the row adds up over that key: 0 is the finest
    level, all bits set the grand total. Keys added up over are null; a null key of a run keeps its bit unset.
    """
    totals = report.rollup(*keys).agg(
        F.grouping_id(*keys).alias("level"),
        F.count("*").alias("runs"),
        F.sum("exact_matches").alias("exact_matches"),
        F.sum("total_evaluated").alias("total_evaluated"),
        F.sum("prediction_error_count").alias("prediction_error_count"),
        F.sum("estimated_cost_usd").alias("estimated_cost_usd"),
    )
    return totals.withColumns(
        {
            "execution_accuracy_pct": F.try_divide(F.col("exact_matches"), F.col("total_evaluated")) * 100,
            "cost_per_exact_match_usd": cost_per_exact(F.col("estimated_cost_usd"), F.col("exact_matches")),
        }
    )


def dataset_winners(report: DataFrame) -> DataFrame:
    """All rows that share the highest number of exact matches of their benchmark."""
    best = report.groupBy("benchmark").agg(F.max("exact_matches").alias("best"))
    return report.join(best, "benchmark").filter(F.col("exact_matches") == F.col("best")).drop("best")


def tradeoffs(models: DataFrame) -> DataFrame:
    """The best, the best low-cost and the best free model of a roll-up.

    Low-cost means a positive cost of at most the median of the paying models.
    """
    paying = models.filter("estimated_cost_usd > 0").agg(F.percentile("estimated_cost_usd", 0.5).alias("median"))
    rated = models.select("*", paying.scalar().alias("median"))
    order = [F.col("exact_matches").desc(), F.col("estimated_cost_usd").asc(), F.col("model").asc()]
    labelled = rated.select(
        "*",
        F.explode(
            F.filter(
                F.array(
                    F.lit("best"),
                    F.when(F.col("estimated_cost_usd").between(1e-12, F.col("median")), "best low-cost"),
                    F.when(F.col("estimated_cost_usd") == 0, "best free"),
                ),
                lambda label: label.isNotNull(),
            )
        ).alias("label"),
    ).drop("median")
    first = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    return labelled.withColumn("_place", first).filter("_place = 1").drop("_place")


def planned_runs(benchmarks: DataFrame, models: list[str], track: str, limit: int | None, full: bool) -> DataFrame:
    """Every benchmark with every listed model (names that contain a slash); exactly one of limit and full."""
    if full == (limit is not None):
        raise ValueError("choose exactly one of limit and full")
    listed = F.array(*[F.lit(m) for m in models if "/" in m])
    return benchmarks.select("benchmark").distinct().select(
        "benchmark",
        F.explode(listed).alias("model"),
        F.lit(track).alias("track"),
        F.lit(limit).cast("int").alias("case_limit"),
        F.lit("full" if full else "bounded").alias("scope"),
    )


def latest_runs(run_index: DataFrame) -> DataFrame:
    """The last run of every (benchmark, model, track); the run id settles equal times.

    The time comes first, as a plain maximum that needs no sort; only rows of that time meet again for their id.
    """
    keys = ["benchmark", "model", "track"]
    last = run_index.groupBy(keys).agg(F.max("created_at").alias("created_at"))
    return run_index.join(last, [*keys, "created_at"]).groupBy(*keys, "created_at").agg(F.max("run_id").alias("run_id"))


def matrix_status(planned: DataFrame, latest: DataFrame, exit_codes: DataFrame) -> DataFrame:
    """Planned runs with their latest actual run; failed if the run or its evaluation has a non-zero code."""
    joined = planned.join(latest, ["benchmark", "model", "track"], "left").join(exit_codes, "run_id", "left")
    failed = F.coalesce(F.col("run_exit_code") != 0, F.lit(False)) | F.coalesce(F.col("eval_exit_code") != 0, F.lit(False))
    return joined.select(
        *planned.columns, "run_id", "run_exit_code", "eval_exit_code", failed.alias("failed"), F.col("run_id").isNull().alias("missing")
    )


def scope_coverage(report: DataFrame, planned_items: DataFrame) -> DataFrame:
    """Planned against evaluated items per run, and whether the run covers the full split."""
    joined = report.join(planned_items, "benchmark", "left")
    return joined.select(
        "run_id",
        "benchmark",
        "total_items",
        "total_evaluated",
        (F.col("total_items") - F.coalesce("total_evaluated", F.lit(0))).alias("not_evaluated"),
        F.when(F.col("total_items") >= F.col("planned_items"), "full").otherwise("pilot").alias("scope"),
    )
