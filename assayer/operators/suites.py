"""Query suites: a work list taken in batches, a status table to go on from, long results only where they decide."""

from __future__ import annotations

import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import islice
from multiprocessing.pool import ThreadPool

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions import sqltext
from assayer.functions.canon import ROW, canonical_rows, row_bag
from assayer.functions.text import strip
from assayer.session import materialize, work_folder

BAG_TYPE = "array<struct<row:array<string>,n:bigint>>"
BAG_SCHEMA = "query_id string, row array<string>, n bigint"
#: One row per query text: its error, or the number of its rows and two order-free sums of their hashes; a short result
#: stands there as a whole.
STATUS_SCHEMA = f"query_id string, error string, rows bigint, print decimal(38,0), check decimal(38,0), bag {BAG_TYPE}"
#: Queries that ran at first and failed when they were run again for their rows.
FAILED_SCHEMA = "query_id string, error string"
EMPTY_SQL = "empty SQL"
REFUSED_SQL = "dangerous SQL refused"
NOT_A_QUERY = "not a query"
TIME_LIMIT = "time limit"
FILES_BY_PATH = "spark.sql.runSQLOnFiles"
SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"
#: A suite's own session cuts files no finer than this, unless a table would leave cores without work.
LEAST_SPLIT = 128 << 20
#: Texts that the driver holds at once, and queries whose rows one job writes.
BATCH = 256
TOGETHER = 16
#: A result is short if it has up to this many rows, each of up to this many bytes; others never come to the driver.
SHORT_ROWS, SHORT_BYTES = 64, 4096

Prepare = Callable[[SparkSession], None]


def query_id(sql: Column) -> Column:
    """The key under which a query text is executed once, however many cases share it."""
    return F.sha2(sql, 256)


def refusal(sql: Column) -> Column:
    """Why a text is not executed, or NULL."""
    return (
        F.when(strip(sql) == "", EMPTY_SQL)
        .when(sqltext.is_dangerous(sql) | sqltext.calls_jvm(sql), REFUSED_SQL)
        .when(~sqltext.is_query(sql), NOT_A_QUERY)
    )


@contextmanager
def suite_session(spark: SparkSession, prepare: Prepare | None) -> Iterator[SparkSession]:
    """Where a suite's queries run: they read named tables only, never files by path.

    ``prepare`` registers the suite's tables in a session of its own, with the caller's settings. Without it the
    queries run in the caller's session, which reads no files by path meanwhile.
    """
    if prepare:
        session = spark.newSession()
        for key, value in spark.conf.getAll.items():
            if session.conf.isModifiable(key):
                session.conf.set(key, value)
        prepare(session)
        session.conf.set(FILES_BY_PATH, "false")
        # most texts ask for few rows and pay for every task that looks for them; Spark still cuts a table for all cores
        split = session._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        session.conf.set(SPLIT_BYTES, str(max(split, LEAST_SPLIT)))
        yield session
        return
    before = spark.conf.get(FILES_BY_PATH)
    spark.conf.set(FILES_BY_PATH, "false")
    try:
        yield spark
    finally:
        spark.conf.set(FILES_BY_PATH, before)


def _limited(session: SparkSession, seconds: float | None, job: Callable[[], object]) -> tuple[object, str | None]:
    """What a job gives, or why it failed; its Spark jobs are interrupted by their tag when the time is over.

    The suite goes on at once. A task that does not look up (a nested-loop join within one partition) keeps its core
    until it does; ``spark.task.reaper.enabled`` is the cluster's setting against that.
    """
    # tags of the context, as a session's own are known to the thread alone that set them
    context, tag, done, late = session.sparkContext, f"suite-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            late.set()
            # again, as a job may start after the first call
            while not done.wait(0.5):
                context.cancelJobsWithTag(tag)

    context.addJobTag(tag)
    # tasks that do not look up by themselves are interrupted as well
    context.setLocalProperty("spark.job.interruptOnCancel", "true")
    if seconds is not None:
        threading.Thread(target=watch, daemon=True).start()
    try:
        return job(), None
    except PySparkException as error:
        return None, TIME_LIMIT if late.is_set() else str(error).split("\n")[0]
    except Exception as error:  # an engine error of the query is a result, not a failure of the suite
        return None, TIME_LIMIT if late.is_set() else f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
    finally:
        done.set()
        context.removeJobTag(tag)


def _batches(rows: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of bounded length; the driver holds one partition of the list besides."""
    at = rows.toLocalIterator()
    while batch := list(islice(at, size)):
        yield batch


def profile(result: DataFrame) -> tuple[int, object, object]:
    """Number of rows of a result and two sums of row hashes, whatever their order; no row leaves its task."""
    total = lambda *salt: F.coalesce(F.sum(F.xxhash64(ROW, *salt).cast("decimal(20,0)")).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    row = canonical_rows(result).agg(F.count("*").alias("rows"), total().alias("print"), total(F.lit("check")).alias("check")).first()
    return row["rows"], row["print"], row["check"]


def short_bag(result: DataFrame) -> list[tuple[list[str], int]] | None:
    """The bag of a short result, or None of any other, of which no row beyond the bounds is fetched."""
    size = F.octet_length(F.array_join(ROW, ""))
    rows = canonical_rows(result).select(F.when(size <= SHORT_BYTES, F.col(ROW)).alias(ROW)).limit(SHORT_ROWS + 1).collect()
    if len(rows) > SHORT_ROWS or any(r[ROW] is None for r in rows):
        return None
    return [(list(row), n) for row, n in Counter(tuple(r[ROW]) for r in rows).items()]


def _bag_profile(bag: Column) -> dict[str, Column]:
    """``profile`` of a bag that is one cell."""
    none = F.lit(0).cast("decimal(38,0)")
    total = lambda *salt: F.aggregate(
        bag, none, lambda sum_, b: (sum_ + F.xxhash64(b["row"], *salt).cast("decimal(20,0)") * b["n"]).cast("decimal(38,0)")
    )
    rows = F.aggregate(bag, F.lit(0).cast("bigint"), lambda sum_, b: sum_ + b["n"])
    return {"rows": rows, "print": total(), "check": total(F.lit("check"))}


def work_list(texts: DataFrame, folder: str) -> DataFrame:
    """The distinct ``texts(sql)`` as ``(query_id, sql, refusal)``, written by Spark."""
    listed = texts.select(F.coalesce("sql", F.lit("")).alias("sql")).distinct()
    listed.select(query_id(F.col("sql")).alias("query_id"), "sql", refusal(F.col("sql")).alias("refusal")).write.mode("overwrite").parquet(
        f"{folder}/work"
    )
    return texts.sparkSession.read.parquet(f"{folder}/work")


def run_profiles(
    session: SparkSession, work: DataFrame, folder: str, seconds: float | None = None, batch: int = BATCH, parallel: int = 8
) -> DataFrame:
    """Run each text of a work list and keep its profile and, if it is short, its result: the status table of the folder.

    A short result takes one run, which gives its rows, and is profiled with its batch; any other is profiled by a second.
    A batch's outcomes are appended when it ends, so a run that was cut off goes on behind its last whole batch when
    it is started again with the same folder; what failed or took too long before is not tried again.
    """
    spark, path = work.sparkSession, f"{folder}/status"
    spark.createDataFrame([], STATUS_SCHEMA).write.mode("append").parquet(path)
    status = lambda: spark.read.schema(STATUS_SCHEMA).parquet(path)
    pending = work.join(status().select("query_id"), "query_id", "left_anti")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("rows", "bigint"), ("print", "decimal(38,0)"), ("check", "decimal(38,0)"), ("bag", BAG_TYPE))]
    refused = pending.where("refusal IS NOT NULL").select("query_id", F.col("refusal").alias("error"), *none)

    def job(sql: str) -> tuple:
        result = session.sql(sql)
        bag = short_bag(result)
        return (None, None, None, bag) if bag is not None else (*profile(result), None)

    def run(row) -> tuple:
        found, error = _limited(session, seconds, lambda: job(row["sql"]))
        return (row["query_id"], error, *(found or (None, None, None, None)))

    with ThreadPool(parallel) as pool:
        for rows in _batches(pending.where("refusal IS NULL").select("query_id", "sql"), batch):
            found = pool.map(run, rows, 1)
            # waiting behind another query is no fault of this one: who was stopped has a second try, alone
            found = [run(row) if outcome[1] == TIME_LIMIT else outcome for row, outcome in zip(rows, found, strict=True)]
            outcomes = spark.createDataFrame(found, STATUS_SCHEMA)
            profiled = {name: F.coalesce(name, value) for name, value in _bag_profile(F.col("bag")).items()}
            outcomes.withColumns(profiled).coalesce(1).write.mode("append").parquet(path)
    materialize(refused, "refused").write.mode("append").parquet(path)
    return status()


def write_bags(
    session: SparkSession, work: DataFrame, status: DataFrame, folder: str, seconds: float | None = None, batch: int = BATCH, parallel: int = 8
) -> DataFrame:
    """Row bags ``(query_id, row, n)`` of the texts of a work list; several queries share a job and a folder.

    Short results are taken from the status table, the others are run again. Where one of them fails the others are run
    alone; a query that fails has no rows, and its error is appended to the folder's ``failures``. Those that failed
    before are not tried again.
    """
    spark, path = work.sparkSession, f"{folder}/rows/run={uuid.uuid4().hex}"
    kept = status.where("bag IS NOT NULL")
    kept.join(work, "query_id", "left_semi").select("query_id", F.inline("bag")).write.parquet(f"{path}/part=0")
    spark.createDataFrame([], FAILED_SCHEMA).write.mode("append").parquet(f"{folder}/failed")
    asked = work.join(kept, "query_id", "left_anti").join(failures(spark, folder), "query_id", "left_anti")

    def write(rows: list) -> list[tuple]:
        def job() -> None:
            bags = [row_bag(session.sql(r["sql"])).select(F.lit(r["query_id"]).alias("query_id"), ROW, "n") for r in rows]
            reduce(DataFrame.unionAll, bags).write.mode("overwrite").parquet(f"{path}/part={rows[0]['query_id']}")

        limit = None if seconds is None else seconds * len(rows)
        _, error = _limited(session, limit, job)
        if error and len(rows) > 1:
            return [failed for row in rows for failed in write([row])]
        return [(rows[0], error)] if error else []

    with ThreadPool(parallel) as pool:
        for rows in _batches(asked.select("query_id", "sql"), batch):
            found = [failed for some in pool.map(write, [rows[i : i + TOGETHER] for i in range(0, len(rows), TOGETHER)], 1) for failed in some]
            # who was stopped has a second try, alone, as in run_profiles
            found = [failed for row, error in found for failed in (write([row]) if error == TIME_LIMIT else [(row, error)])]
            if found:
                lost = spark.createDataFrame([(row["query_id"], error) for row, error in found], FAILED_SCHEMA)
                lost.coalesce(1).write.mode("append").parquet(f"{folder}/failed")
    return spark.read.schema(BAG_SCHEMA + ", part string").parquet(path).drop("part")


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """``(query_id, error)`` of queries that ran at first and failed when they were run again for their rows."""
    return spark.read.schema(FAILED_SCHEMA).parquet(f"{folder}/failed").groupBy("query_id").agg(F.min("error").alias("error"))


def errors(status: DataFrame, folder: str) -> DataFrame:
    """``(query_id, error)`` of every query of a status table whose rows have been asked for; a failure of either run counts."""
    again = failures(status.sparkSession, folder).withColumnRenamed("error", "again")
    return status.join(again, "query_id", "left").select("query_id", F.coalesce("error", "again").alias("error"))


def result_classes(bags: DataFrame, kinds: DataFrame) -> DataFrame:
    """``(query_id, result_id)``: queries of one ``kinds(query_id, kind)`` with equal bags share a result.

    Every query of a kind is compared with the kind's first one, so each row moves once however many pairs there are.
    Those that differ from it, which takes equal hashes of different rows, are compared among themselves in a next round.
    """
    settled, left = [], kinds
    while True:
        first = left.groupBy("kind").agg(F.min("query_id").alias("result_id"))
        asked = left.join(first, "kind")
        same_row = Window.partitionBy("kind", ROW)
        met = bags.join(asked, "query_id").withColumn("expected", F.max(F.when(F.col("query_id") == F.col("result_id"), F.col("n"))).over(same_row))
        each = met.groupBy("query_id").agg(F.bool_and(F.col("n").eqNullSafe(F.col("expected"))).alias("fits"), F.sum("n").alias("total"))
        whole = each.select(F.col("query_id").alias("result_id"), F.col("total").alias("wanted"))
        compared = materialize(
            asked.join(each, "query_id", "left")
            .join(whole, "result_id", "left")
            .withColumn("equal", F.coalesce(F.col("fits") & (F.col("total") == F.col("wanted")), F.col("query_id") == F.col("result_id"))),
            "classes",
        )
        settled.append(compared.where("equal").select("query_id", "result_id"))
        left = compared.where("NOT equal").select("query_id", "kind")
        if left.isEmpty():
            return reduce(DataFrame.unionAll, settled)


def compare_results(
    session: SparkSession, pairs: DataFrame, work: DataFrame, status: DataFrame, folder: str, seconds: float | None = None
) -> DataFrame:
    """Distinct ``pairs(gold_id, pred_id)`` with both row counts and whether the results are equal as bags.

    Profiles settle a pair unless they agree. Of the queries of pairs still open, those with long results are run again
    for their rows, once each; if a query then gives other rows than before, it equals none. If it fails then, it counts
    as one that failed at first, in each of its pairs: it equals none and has no rows, and ``errors`` has its error.
    """
    ran = status.where("error IS NULL").drop("error", "bag")
    named = lambda side: ran.select(*[F.col(c).alias(f"{side}_{c}" if c != "query_id" else f"{side}_id") for c in ran.columns])
    alike = reduce(Column.__and__, [F.col(f"gold_{c}") == F.col(f"pred_{c}") for c in ("rows", "print", "check")])
    sides = pairs.join(named("gold"), "gold_id", "left").join(named("pred"), "pred_id", "left").withColumn("alike", F.coalesce(alike, F.lit(False)))
    sides = materialize(sides.withColumn("open", F.expr("alike AND gold_rows > 0 AND gold_id <> pred_id")), "pairs")
    asked = sides.where("open").select(F.explode(F.array("gold_id", "pred_id")).alias("query_id")).distinct()
    kinds = materialize(ran.join(asked, "query_id", "left_semi").select("query_id", F.struct("rows", "print", "check").alias("kind")), "kinds")
    bags = write_bags(session, work.join(kinds, "query_id", "left_semi"), status, folder, seconds)
    failed = failures(session, folder).select("query_id", F.lit(True).alias("failed"))
    classes = result_classes(bags, kinds.join(failed, "query_id", "left_anti"))
    for side in ("gold", "pred"):
        sides = sides.join(classes.withColumnsRenamed({"query_id": f"{side}_id", "result_id": f"{side}_result"}), f"{side}_id", "left")
        sides = sides.join(failed.withColumnsRenamed({"query_id": f"{side}_id", "failed": f"{side}_failed"}), f"{side}_id", "left")
    count = lambda side: F.when(F.col(f"{side}_failed"), 0).otherwise(F.coalesce(f"{side}_rows", F.lit(0))).cast("bigint")
    whole = F.coalesce("gold_failed", "pred_failed").isNull()
    return sides.select(
        "gold_id",
        "pred_id",
        count("gold").alias("gold_row_count"),
        count("pred").alias("pred_row_count"),
        (F.col("alike") & whole & (~F.col("open") | F.coalesce(F.col("gold_result") == F.col("pred_result"), F.lit(False)))).alias("same"),
    )


def in_order_of(table: DataFrame, column: str) -> DataFrame:
    """A copy of a table, written in order of a column: a text that asks for few of its values reads few pages.

    All rows are kept, also those without a value.
    """
    return materialize(table.repartitionByRange(column).sortWithinPartitions(column), "ordered")


def run_cases(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """The cases of each of ``runs(run_id, benchmark, case_ids)``: those it lists, or all of its benchmark if it lists none.

    Listed ids meet the cases by key; a listed id that is no case is left out, one listed twice counts once.
    """
    none = F.coalesce(F.size("case_ids"), F.lit(0)) <= 0
    listed = runs.where(~none).select("run_id", "benchmark", F.explode(F.array_distinct("case_ids")).alias("case_id"))
    whole = runs.where(none).select("run_id", "benchmark")
    return cases.join(listed, ["benchmark", "case_id"]).unionByName(cases.join(whole, "benchmark"))
