"""Ordered picks and joins that stay flat under skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows per key in a full order; ``rank`` names an optional 1-based position column.

    ``row_number() <= k`` becomes a group limit that cuts every task's input before the shuffle.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def top_rows_of_few_keys(
    df: DataFrame, keys: list[str], order: list[Column], k: int, spread: Column, rank: str | None = None, ways: int = 64
) -> DataFrame:
    """``top_rows`` where a handful of keys hold all rows.

    A first cut per (key, slice of ``spread``) leaves at most ``ways * k`` rows per key, so no task ever sees
    more than that of a hot key. The result is the same as of one cut.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(ways)))
    first = top_rows(sliced, [*keys, "_slice"], order, k).drop("_slice")
    return top_rows(first, keys, order, k, rank)


def join_index(keyed: DataFrame, index: DataFrame, on: list[str], max_rows: int = 1_000_000) -> DataFrame:
    """Join exploded keys with an index of them.

    The index is counted: a small one goes to the keys, which then do not move. Otherwise both sides are shuffled,
    and the adaptive join splits hot keys. Planner estimates do not know how far an explode widens its input, so the
    exploded side must never be the one that is broadcast on an estimate.
    """
    small = index.limit(max_rows + 1).count() <= max_rows
    return keyed.join(F.broadcast(index) if small else index.hint("merge"), on)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Spread compact rows over all tasks before they are widened: evenly, or by keys that must stay together.

    A small file can hold rows that explode a hundredfold; moving them first is cheap and shares the work.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def join_wide(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join sides that both grow with the questions, by shuffle.

    Estimates rest on the size of files: tables that compress well, or are widened after they are read, look small
    enough for a broadcast when they fill the driver.
    """
    return left.join(right.hint("merge"), on, how)
