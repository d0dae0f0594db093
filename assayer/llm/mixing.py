"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import materialize, word_count

#: Rows of a source and band of sizes that are numbered together, about.
CELL_ROWS = 50_000


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inner join on equal or equally null columns; keeps the columns of ``left`` once."""
    renamed = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
    on = [left[n].eqNullSafe(renamed[f"_r_{n}"]) for n in names]
    return left.join(renamed, on).drop(*(f"_r_{n}" for n in names))


def targets(sources: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """Add ``target`` to ``sources(_source, _size)``: the share of all sizes by weight, with no source above the cap.

    Sources take the weights in turn, by code point, null last. What a capped source leaves goes to the others by
    weight until none is above: the level of words per weight is the largest of (rest of the share after the first k
    caps) / (weights of the others), sources in order of cap per weight. One row per source, so that a single task
    suffices.
    """
    every = Window.partitionBy()
    place = F.row_number().over(every.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    caps = sources.withColumns({"_weight": weight.cast("long"), "_cap": F.col("_size") * F.lit(cap)})
    order = every.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    level = (
        F.sum("_size").over(every) * F.lit(share)
        - F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    return caps.withColumn("_level", level).select(
        "_source", "_size", F.least("_cap", F.max("_level").over(every) * F.col("_weight")).alias("target")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """How often the mix takes each document: all columns of ``docs(doc_id, text, source, ...)`` and five more.

    ``size`` is the number of words; ``source_size`` and ``target`` belong to the document's source; ``copies`` is how
    often the document is taken and ``taken`` the words of that. Every document of a source expects target /
    source_size copies. In order, these expectations are summed, one random offset per source is added, and a document
    is taken once for each whole number its stretch crosses: ``copies`` is the expectation rounded up or down, and any
    run of documents in that order gets its share but for one. The order runs by bands of sizes, so a source's words
    follow its target closely. The prefix sums have two steps, over cells of about ``cell_rows`` documents and inside
    each cell, so that no task gets a whole source. Nothing depends on partitions; equal runs agree.

    A null text has size 0 and is taken like others (0 words); a null source is a source; a source without words has
    target 0 and is never taken; repeated rows each have their own stretch; columns of the input named like the new
    ones are replaced, all others come back as they are, whatever their names. An empty table gives no rows.
    """
    n_salts = docs.count() // cell_rows + 1
    # the input's columns go by number inside, so that none can clash
    number = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    held = docs.toDF(*number.values())
    keyed = held.withColumns({"size": word_count(F.col(number["text"])), "_source": F.col(number["source"])})
    # a band: the place and the leading four bits of the size
    keyed = keyed.withColumns(
        {
            "_band": F.length(F.bin("size")) * 16 + F.expr("cast(shiftright(size * 16, length(bin(size))) as int)"),
            "_salt": F.coalesce(F.expr(f"pmod(({number['doc_id']} % 1000003) * 48271, {n_salts})"), F.lit(0)).cast("long"),
        }
    )
    key = ["_source", "_band", "_salt"]
    cells = materialize(keyed.groupBy(*key).agg(F.count("*").alias("_n"), F.sum("size").alias("_words")), "mix-cells")
    bands = cells.groupBy("_source", "_band").agg(F.sum("_n").alias("_n"))
    sources = targets(cells.groupBy("_source").agg(F.sum("_words").alias("_size")), weights, share, cap)
    before = (Window.unboundedPreceding, -1)
    prior = lambda *by: Window.partitionBy(*by)
    band_base = bands.select(
        "_source", "_band", F.coalesce(F.sum("_n").over(prior("_source").orderBy("_band").rowsBetween(*before)), F.lit(0)).alias("_b")
    )
    cell_base = cells.select(
        *key, F.coalesce(F.sum("_n").over(prior("_source", "_band").orderBy("_salt").rowsBetween(*before)), F.lit(0)).alias("_c")
    )
    bases = _same(_same(cell_base, band_base, ["_source", "_band"]), sources, ["_source"])
    order = Window.partitionBy(*key).orderBy("size", number["doc_id"])
    ranked = _same(keyed.withColumn("_nth", F.row_number().over(order)), bases, key)
    offset = F.expr(f"cast(conv(substr(md5(concat('{seed}:', coalesce(_source, ''))), 1, 8), 16, 10) as bigint) / 4294967296.0D")
    rate = F.when(F.col("_size") > 0, F.col("target") / F.col("_size")).otherwise(0.0)
    rank = F.col("_b") + F.col("_c") + F.col("_nth")
    copies = F.floor(rate * rank + offset) - F.floor(rate * (rank - 1) + offset)
    taken = ranked.withColumn("copies", F.least(copies, F.ceil(F.lit(cap))).cast("long"))
    new = {"size", "source_size", "target", "copies", "taken"}
    return taken.select(
        *(F.col(c).alias(name) for name, c in number.items() if name not in new),
        "size",
        F.col("_size").cast("long").alias("source_size"),
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def emit(mixed: DataFrame) -> DataFrame:
    """The rows of the mix, each as often as it is taken."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_copy")
