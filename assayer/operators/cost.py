"""Cost of model calls and run roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.rules.vocab import AGENT_MODELS


def infer_provider(provider: Column, model: Column) -> Column:
    return (
        F.when(provider != "auto", provider)
        .when(model.startswith("custom:") | model.isin(AGENT_MODELS), "droid")
        .when(F.contains(model, F.lit("/")), "openrouter")
        .otherwise("prompt-only")
    )


def effective_track(provider: Column, track: Column) -> Column:
    agent = F.when(track == "schema-plan", "bounded-agent+schema-plan").otherwise("bounded-agent")
    return F.when(provider == "droid", agent).otherwise(track)


def estimated_cost(prompt_price: Column, completion_price: Column) -> Column:
    """A stated cost wins, also 0; else tokens by price. A count of 0 gives way to its other name like a missing one."""
    tokens = lambda name, other: F.coalesce(F.nullif(F.col(name), F.lit(0)), F.col(other), F.lit(0))
    priced = (
        tokens("prompt_tokens", "input_tokens") * F.coalesce(prompt_price, F.lit(0.0)) / 1_000_000
        + tokens("completion_tokens", "output_tokens") * F.coalesce(completion_price, F.lit(0.0)) / 1_000_000
    )
    return F.coalesce(F.col("cost"), priced)


def with_costs(case_runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Case runs with ``estimated_cost_usd``; models without a price cost 0 unless a cost is stated.

    The price list's size decides how it is joined; usage rows of a model are never gathered.
    """
    priced = case_runs.join(prices.select("model", "prompt_per_million_usd", "completion_per_million_usd"), "model", "left")
    cost = estimated_cost(F.col("prompt_per_million_usd"), F.col("completion_per_million_usd"))
    return priced.withColumn("estimated_cost_usd", cost).drop("prompt_per_million_usd", "completion_per_million_usd")


def roll_up_runs(case_runs: DataFrame, *keys: str) -> DataFrame:
    """Status counts, token totals and cost per run. Totals read the three plain counters only."""
    status = lambda value: F.count_if(F.col("status") == value)
    total = lambda name: F.coalesce(F.sum(F.coalesce(name, F.lit(0))), F.lit(0)).alias(name)
    return case_runs.groupBy(*keys).agg(
        F.count("*").alias("total_items"),
        status("ok").alias("ok"),
        status("prompted").alias("prompted"),
        status("error").alias("errors"),
        total("prompt_tokens"),
        total("completion_tokens"),
        total("total_tokens"),
        F.sum("estimated_cost_usd").alias("estimated_cost_usd"),
    )


def cost_per_exact(cost: Column, exact: Column) -> Column:
    """Cost by exact match; NULL without a cost or without a match, 0 for a free model."""
    return F.try_divide(cost, F.nullif(exact, F.lit(0)))
