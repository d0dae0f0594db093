"""Schema catalogs and example values.

``catalog(table, col_idx, column, type)`` and ``examples(table, col_idx, kind, pos, value)``; kind is ``row`` for the
cells of example rows and ``col`` for values listed per column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators.ranking import top_rows
from assayer.session import materialize

CATALOG_SCHEMA = "table string, col_idx int, column string, type string"
EXAMPLE_SCHEMA = "table string, col_idx int, kind string, pos int, value string"
TABLE_FILE_SCHEMA = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("column_names", T.ArrayType(T.StringType())),
            T.StructField("example_rows", T.ArrayType(T.ArrayType(T.StringType()))),
            T.StructField("example_columns", T.ArrayType(T.ArrayType(T.StringType()))),
        ]
    ),
)


def catalog_of(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """The catalog of DataFrames, from their schemas alone."""
    rows = [
        (table, idx, field.name, field.dataType.simpleString())
        for table, frame in sorted(frames.items())
        for idx, field in enumerate(frame.schema.fields)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Catalog and examples of schema files that map table names to columns and example values."""
    raw = spark.read.text(path, wholetext=True)
    tables = raw.select(F.explode(F.from_json("value", TABLE_FILE_SCHEMA)).alias("table", "info"))
    catalog = tables.select("table", F.posexplode("info.column_names").alias("col_idx", "column")).withColumn(
        "type", F.lit("")
    )
    cells = tables.select("table", F.posexplode("info.example_rows").alias("pos", "cells")).select(
        "table", "pos", F.posexplode("cells").alias("col_idx", "value")
    )
    listed = tables.select("table", F.posexplode("info.example_columns").alias("col_idx", "cells")).select(
        "table", "col_idx", F.posexplode("cells").alias("pos", "value")
    )
    order = ["table", "col_idx", "kind", "pos", "value"]
    examples = (
        cells.withColumn("kind", F.lit("row")).select(order).unionByName(listed.withColumn("kind", F.lit("col")).select(order))
    )
    return catalog.select("table", "col_idx", "column", "type"), examples


def text_hash(text: Column) -> Column:
    """A non-negative hash of a text; NULL has none."""
    return F.when(text.isNotNull(), F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))


def portable_text_hash(text: Column) -> Column:
    """A slower hash that other engines can work out too: the first digits of the MD5 sum, letters read as 0 to 5."""
    return F.translate(F.substring(F.md5(text), 1, 15), "abcdef", "012345").cast("bigint")


def sampled_values(
    sources: dict[str, tuple[DataFrame, list[str]]], per_column: int = 8, hashing: Callable[[Column], Column] = text_hash
) -> DataFrame:
    """Up to ``per_column`` distinct values of each listed column, as ``col`` examples: table name to (frame, columns).

    Values are dealt into ``per_column`` buckets by hash and the smallest hash of each bucket stays. The pick depends on
    the values only, so two columns of one domain pick the same ones and joinable columns show an overlap. Every column is
    read for itself, so its cells are never widened to rows of all columns. Both passes over whole numbers reduce map-side
    to ``per_column`` rows per column, whatever the size or skew of the data. Hashing a text costs far more than comparing
    it, so texts meet first and each distinct one is hashed once, for both passes.
    """
    keys, parts = ["table", "col_idx"], []
    bucket = (F.col("hash") % per_column).cast("int")
    named = lambda rows, key: rows.select(F.lit(key[0]).alias("table"), F.lit(key[1]).cast("int").alias("col_idx"), "*")
    columns = {(name, frame.columns.index(c)): (frame, c) for name, (frame, listed) in sources.items() for c in listed}
    whole = {key: (frame, c) for key, (frame, c) in columns.items() if isinstance(frame.schema[c].dataType, T.IntegralType)}

    hashes = {key: _value_hash(F.col(c), frame.schema[c].dataType, hashing).alias("hash") for key, (frame, c) in whole.items()}
    least = [
        named(frame.select(hashes[key]).filter("hash >= 0").groupBy(bucket.alias("pos")).agg(F.min("hash").alias("hash")), key)
        for key, (frame, _) in whole.items()
    ]
    picked = {}
    # at most per_column hashes a column
    for row in reduce(DataFrame.unionByName, least).collect() if least else []:
        picked.setdefault((row["table"], row["col_idx"]), []).append(row["hash"])
    for key, chosen in picked.items():
        frame, c = whole[key]
        # columns of few values have all their cells here: copies meet in a hash map first, as the smallest text takes a sort
        found = frame.select(hashes[key], F.col(c).alias("value")).filter(F.col("hash").isin(chosen)).distinct()
        parts.append(named(found.select(bucket.alias("pos"), F.col("value").cast("string").alias("value")), key))

    if len(whole) < len(columns):
        texts = [named(frame.select(F.col(c).cast("string").alias("value")).distinct(), key) for key, (frame, c) in columns.items() if key not in whole]
        hashed = reduce(DataFrame.unionByName, texts).withColumn("hash", _value_hash(F.col("value"), T.StringType(), hashing))
        hashed = materialize(hashed.filter("hash >= 0"), "texts")
        smallest = hashed.groupBy(*keys, bucket.alias("bucket")).agg(F.min("hash").alias("hash")).drop("bucket")
        # at most per_column rows a column are picked, so the texts stay where they are
        found = hashed.join(F.broadcast(smallest), [*keys, "hash"], "left_semi")
        parts.append(found.select(*keys, bucket.alias("pos"), "value"))

    schema = "table string, col_idx int, pos int, value string"
    found = reduce(DataFrame.unionByName, parts) if parts else next(iter(sources.values()))[0].sparkSession.createDataFrame([], schema)
    # values of one hash are few; the smallest of them stays, so a bucket has one value whatever collides
    kept = found.groupBy(*keys, "pos").agg(F.min("value").alias("value"))
    return kept.select("table", "col_idx", F.lit("col").alias("kind"), "pos", "value")


_PRIME, _FACTOR = 2147483647, 48271


def _value_hash(value: Column, dtype: T.DataType, hashing: Callable[[Column], Column]) -> Column:
    """A small hash of a value by its text: whole numbers by arithmetic, also where they are stored as text."""
    number = lambda v: F.pmod(F.pmod(v, F.lit(_PRIME)) * _FACTOR, F.lit(_PRIME))
    if isinstance(dtype, T.IntegralType):
        return number(value.cast("bigint"))
    text = value.cast("string")
    # a failing cast is slow, so only digits are cast
    return F.when(text.rlike(r"^-?[0-9]{1,18}$"), number(text.try_cast("bigint"))).otherwise(hashing(text) % _PRIME)


def flatten_examples(examples: DataFrame, max_values: int = 80) -> DataFrame:
    """The first example values per table: cells row by row, then five per column."""
    is_row = F.col("kind") == "row"
    usable = examples.filter(
        F.col("value").isNotNull() & (F.col("value") != "") & (F.lower("value") != "nan") & (is_row | (F.col("pos") < 5))
    )
    order = [
        F.when(is_row, 0).otherwise(1),
        F.when(is_row, F.col("pos")).otherwise(F.col("col_idx")),
        F.when(is_row, F.col("col_idx")).otherwise(F.col("pos")),
        F.col("value"),
    ]
    return top_rows(usable, ["table"], order, max_values, rank="place").select("table", "place", "value")


def schema_text(catalog: DataFrame, max_tables: int = 40, max_columns: int = 80) -> DataFrame:
    """One text per database: a line per table with its columns and types. ``catalog`` has a ``db_id`` column here."""
    part = F.trim(F.concat_ws(" ", "column", F.nullif("type", F.lit(""))))
    columns = top_rows(catalog, ["db_id", "table"], [F.col("col_idx")], max_columns, rank="place")
    lines = columns.groupBy("db_id", "table").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("place", part.alias("part"))))["part"], ", ").alias("parts")
    )
    tables = top_rows(lines, ["db_id"], [F.col("table")], max_tables, rank="place")
    line = F.concat(F.lit("Table "), "table", F.lit(": "), "parts")
    return tables.groupBy("db_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))["line"], "\n").alias("schema_text")
    )
