"""Word rules, tables and connected components shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.session import materialize, work_folder

__all__ = ["SEPARATORS", "WORD", "components", "materialize", "meet", "read_table", "word_count", "words", "work_folder"]

#: Words are runs of other characters than these.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than one in so many of all rows is split; there are fewer such keys than this.
HEAVY = 4096


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; empty without any."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SEPARATORS}|{SEPARATORS}\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATORS))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def meet(rows: DataFrame, keyed: DataFrame, key: str, spread: Sequence[str], total: int) -> DataFrame:
    """Inner join of many ``rows`` with ``keyed``, one row per key with its count ``n`` of the ``total`` rows; drops ``n``.

    A key with more than one in ``HEAVY`` of all rows is dealt over tasks in proportion to its share: its rows draw a
    number from their ``spread`` columns, its keyed row is copied once per number. There are fewer than ``HEAVY`` such
    keys and ``2 * HEAVY`` copies, so the list of them can be broadcast.
    """
    parts = F.ceil(F.col("n") * HEAVY / F.lit(max(total, 1))).cast("int")
    is_heavy = F.col("n") * HEAVY > total
    dealt = rows.join(F.broadcast(keyed.where(is_heavy).select(key, parts.alias("_parts"))), key, "left")
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = F.when(is_heavy, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    return dealt.join(keyed.withColumn("_part", F.explode(copies)), [key, "_part"]).drop("_part", "n")


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """``(node, root)`` for every node in ``edges(a, b)``: root is the smallest node reachable.

    Rounds of large-star and small-star steps: each node tells its larger neighbours, then its smaller ones, of the
    smallest node it knows. A round only regroups edges, so their number does not grow, and a hub needs no special
    care: neighbours meet the minimum of their group by a join, never as a list. Each round is written to the shared
    folder; the rounds end when the edges are stars.
    """
    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        # node, other: large-star groups both directions, small-star only the smaller neighbours
        if large:
            seen = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
                pairs.select(F.col("b").alias("node"), F.col("a").alias("other"))
            )
        else:
            seen = pairs.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
        least = seen.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("m"))
        met = seen.join(least, "node")
        if large:
            return met.where("other > node").select(F.col("other").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        told = met.select(F.col("other").alias("a"), F.col("m").alias("b"))
        return told.union(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()

    def settled(pairs: DataFrame) -> bool:
        # every node with a smaller one has that one only, and that one has no smaller one
        ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            pairs.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return counted.where("up > 1 OR up = 1 AND down = 1").count() == 0

    at = materialize(edges.where("a <> b").select("a", "b").distinct(), purpose)
    done = at.isEmpty()
    while not done:
        at = materialize(stars(stars(at, True), False), purpose)
        done = settled(at)
    tied = at.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # a root has no edge to a smaller node, so it stands for itself
    return tied.union(tied.select(F.col("root").alias("node"), "root").distinct())
