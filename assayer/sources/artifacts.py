"""Run artifacts, price and model lists, gold names; indexes, manifests and other outputs."""

from __future__ import annotations

import os
import re
import uuid
from fnmatch import fnmatchcase
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer import schemas
from assayer.operators.ranking import join_wide, spread
from assayer.session import materialize

READ_BYTES = 4 << 20
# fixed values: names that Spark's readers pass over, and patterns that Python's fnmatch reads in another way
_HIDDEN = re.compile(r"^\.|^_(?!metadata|common_metadata)[^=]*$|\._COPYING_$")
_PATTERN = re.compile(r"[\[\]{}?\\]")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Prices per model; a file that is not readable JSON gives none."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.PRICES).alias("file"))
    return raw.select(F.explode("file.models").alias("model", "price")).select("model", "price.*")


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Listed models that name a provider, in order."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<models:array<string>>").alias("file"))
    return raw.select(F.posexplode("file.models").alias("pos", "model")).filter(F.contains("model", F.lit("/")))


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def _read_per_run(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
    parsed = raw.select(_parent(F.col("_metadata.file_path")).alias("run_id"), F.from_json("value", schema).alias("file"))
    return parsed.select("run_id", "file.*")


def read_run_artifacts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run metadata, evaluation summaries and fairness audits below a folder, keyed by run folder name.

    A run may lack a summary or an audit; report rows join them from the left.
    """
    runs = _read_per_run(spark, folder, "run_metadata.json", schemas.RUN)
    runs = runs.select("*", F.col("usage.total_tokens").alias("total_tokens"))
    summaries = _read_per_run(spark, folder, "summary_execution.json", schemas.SUMMARY)
    return runs, summaries, _read_per_run(spark, folder, "fairness_audit.json", schemas.AUDIT)


def resolve_run(runs: DataFrame, wanted: str) -> DataFrame:
    """The run of that name, else the first whose name contains it."""
    name = wanted.rstrip("/").rsplit("/", 1)[-1]
    rank = F.when(F.col("run_id") == name, 0).when(F.contains("run_id", F.lit(name)), 1)
    return runs.withColumn("_rank", rank).filter("_rank IS NOT NULL").orderBy("_rank", "run_id").limit(1).drop("_rank")


def read_case_texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One text per case folder, for example of ``predicted.sql`` or ``prompt.txt``: ``(run_id, case_id, text)``."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
    path = F.col("_metadata.file_path")
    return raw.select(
        F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1).alias("run_id"), _parent(path).alias("case_id"), F.col("value").alias("text")
    )


def _mounted(spark: SparkSession, folder: str) -> str | None:
    """The path under which tasks reach a folder by themselves, or None of one in a store that Spark alone reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


# fixed values: what Spark writes with its code in a partition's folder name, and the name of a missing value
_ESCAPED = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _folder_name(column: str, value: str | None) -> str:
    """A partition's folder as Spark names it."""
    return f"{column}={_ESCAPED.sub(lambda found: f'%{ord(found[0]):02X}', value) if value else _NO_VALUE}"


def write_case_files(files: DataFrame, folder: str) -> None:
    """One text file per case of ``files(run, case, value)``, in a folder ``run=.../case=...``.

    Cases are dealt over all tasks: a compact table may be one split, and a file costs the same whatever its size.
    On a mounted disk tasks write the files themselves. Spark's writer starts a process there for each right it sets, and
    its commit moves the folders one by one. A task that runs again writes the same names; half a file has a hidden name.
    """
    path = _mounted(files.sparkSession, folder)
    if path is None:
        spread(files, "run", "case").write.partitionBy("run", "case").text(folder)
        return
    if os.path.isdir(path) and os.listdir(path):
        raise FileExistsError(f"{folder} is not empty")
    empty_is_none = [F.nullif(F.col(name).cast("string"), F.lit("")).alias(name) for name in ("run", "case")]
    # bytes, as a text may hold some that are no UTF-8
    dealt = spread(files.select(*empty_is_none, F.col("value").cast("binary").alias("value")), "run", "case")

    def write(batches):
        part, count, at, out = TaskContext.get().partitionId(), 0, None, None

        def close() -> None:
            if out:
                out.close()
                os.replace(out.name, f"{at}/part-{part:05d}-{count:07d}.txt")

        for batch in batches:
            for run, case, value in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                place = f"{path}/{_folder_name('run', run)}/{_folder_name('case', case)}"
                if place != at:
                    close()
                    at, count = place, count + 1
                    os.makedirs(at, exist_ok=True)
                    out = open(f"{at}/.{uuid.uuid4().hex}", "xb")
                out.write((value or b"") + b"\n")
        close()
        yield from ()

    dealt.sortWithinPartitions("run", "case").mapInArrow(write, "run string").write.format("noop").mode("overwrite").save()


def _files_below(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Files of that name below a mounted folder as ``(path, bytes)``, listed level by level by tasks.

    The driver never has the list, which is as long as the cases. Empty files and hidden ones are passed over, as Spark does.
    """

    def listed(batches):
        for batch in batches:
            for place in batch.column(0).to_pylist():
                with os.scandir(place) as entries:
                    rows = [(e.path, None if e.is_dir() else e.stat().st_size) for e in entries if not _HIDDEN.search(e.name) and (e.is_dir() or fnmatchcase(e.name, name))]
                for at in range(0, len(rows), 10_000):
                    paths, sizes = zip(*rows[at : at + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    found, folders = [], spark.createDataFrame([(path,)], "path string")
    while True:
        level = materialize(spread(folders).mapInArrow(listed, "path string, bytes bigint"), "listing")
        found.append(level.where("bytes > 0"))
        folders = level.where("bytes IS NULL").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionAll, found)


def _with_contents(rows: DataFrame) -> DataFrame:
    """Rows with ``path`` and the bytes of that file as ``content``, a few MB in memory at a time besides the largest file."""

    def read(batches):
        for batch in batches:
            start, size, contents = 0, 0, []
            for at, path in enumerate(batch.column("path").to_pylist(), 1):
                if path is None:
                    contents.append(None)
                else:
                    with open(path, "rb") as file:
                        contents.append(file.read())
                    size += len(contents[-1])
                if size >= READ_BYTES or at == batch.num_rows:
                    columns = [*batch.slice(start, at - start).columns, pa.array(contents, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "content"])
                    start, size, contents = at, 0, []

    # dealt out anew, as the paths are narrow enough for few tasks and their contents are not
    return spread(rows).mapInArrow(read, T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())]))


def read_case_files(spark: SparkSession, folder: str, name: str, expected: DataFrame) -> DataFrame:
    """Texts of ``expected(run_id, case_id)`` from files of any bytes: ``(run_id, case_id, text, bytes, repaired, found)``.

    Bytes that are no UTF-8 become replacement characters, and ``repaired`` says so; a case without file, or with an empty one, has no text.
    On a mounted disk tasks list the folders and read the files of expected cases only, so texts are not shuffled. Otherwise
    Spark's reader packs small files into tasks by their sizes. One task reads a file, however large.
    """
    path, keys = _mounted(spark, folder), ["run_id", "case_id"]
    names = lambda at: [F.regexp_extract(at, r"([^/]+)/[^/]+/[^/]+$", 1).alias("run_id"), _parent(F.col(at)).alias("case_id")]
    text = F.col("content").cast("string")
    contents = {"text": F.make_valid_utf8(text), "bytes": F.col("bytes"), "repaired": ~F.is_valid_utf8(text), "found": F.col("content").isNotNull()}
    given = [F.col(c) for c in [*keys, *(c for c in expected.columns if c not in keys)]]
    if path is None or _PATTERN.search(name) or _PATTERN.search(folder.replace("*", "[")):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(folder)
        read = expected.join(raw.select(*names("path"), "content", F.col("length").alias("bytes")), keys, "left")
    else:
        found = _files_below(spark, path, name)
        read = _with_contents(join_wide(expected, found.select(*names("path"), "path", "bytes"), keys, "left"))
    return read.select(*given, *[column.alias(c) for c, column in contents.items()])


def read_gold_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON-lines files: ``(place, instance_id, gold, state)``, state ``used``, ``incomplete`` or ``broken``.

    ``place`` orders lines by file, by where the split that holds them starts, and by their order in the split, so it
    does not depend on how the files were split. Blank lines are none.
    """
    schema = "instance_id string, evaluation struct<parameters:struct<gold:string>>, _broken string"
    raw = spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
    gold = F.col("evaluation.parameters.gold")
    whole = (F.coalesce("instance_id", F.lit("")) != "") & (F.coalesce(gold, F.lit("")) != "")
    return raw.select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("place"),
        "instance_id",
        gold.alias("gold"),
        F.when(F.col("_broken").isNotNull(), "broken").when(whole, "used").otherwise("incomplete").alias("state"),
    )


def read_gold_names(spark: SparkSession, path: str) -> DataFrame:
    """Gold database per task of JSON-lines files; broken and incomplete lines are skipped, later lines win."""
    used = read_gold_lines(spark, path).where("state = 'used'")
    return used.groupBy("instance_id").agg(F.max_by("gold", "place").alias("gold"))


def append_run_index(entries: DataFrame, path: str) -> None:
    """Append index entries as JSON lines, keys in order."""
    entries.select(*sorted(entries.columns)).write.mode("append").json(path)


def append_manifest(records: DataFrame, path: str) -> None:
    """Append setup records ``(name, status, setup_at, ...)``; ``latest_manifest`` reads the valid one per name."""
    records.write.mode("append").parquet(path)


def latest_manifest(records: DataFrame) -> DataFrame:
    """The last record of each name."""
    latest = Window.partitionBy("name").orderBy(F.col("setup_at").desc(), F.col("status"))
    return records.withColumn("_place", F.row_number().over(latest)).filter("_place = 1").drop("_place")


#: One row per set up or failed benchmark.
MANIFEST = (
    "name string, status string, setup_at bigint, error string, "
    "artifacts array<struct<path:string,type:string,exists:boolean,files:bigint,bytes:bigint>>"
)
MANIFEST_BUCKETS = 64


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The records of an upserted manifest, one per name."""
    return spark.read.schema(MANIFEST).parquet(path).select(*_fields(MANIFEST))


def _fields(schema: str) -> list[str]:
    return T.StructType.fromDDL(schema).fieldNames()


def upsert_manifest(records: DataFrame, path: str) -> None:
    """Put records in place of those of the same names; of several with one name the last by ``setup_at`` counts.

    The manifest is kept in buckets of names. Only buckets of the new names are read and written anew, by dynamic
    partition overwrite; failures are records like others. Columns that records lack are null.
    """
    spark = records.sparkSession
    kinds = T.StructType.fromDDL(MANIFEST)
    own = [(F.col(f.name) if f.name in records.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds]
    bucket = F.pmod(F.hash("name"), F.lit(MANIFEST_BUCKETS)).alias("bucket")
    new = materialize(latest_manifest(records.select(*own)).select("*", bucket), "records")
    # bucket numbers, of bounded number
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
    try:
        old = spark.read.schema(f"{MANIFEST}, bucket int").parquet(path).where(F.col("bucket").isin(touched))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        old = new.limit(0)
    # written aside first: a bucket is not read while it is replaced
    merged = materialize(new.unionByName(old.join(new.select("name"), "name", "left_anti")), "manifest")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def failure_records(spec_sources: DataFrame, listing: DataFrame, errors: DataFrame) -> DataFrame:
    """Failed setup records with the state of each artifact.

    ``spec_sources(name, type, path)``, ``listing(path, bytes)``, ``errors(name, error, setup_at)``. A path stands for
    the file itself or for all files below it.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    below = listing.select("bytes", F.explode(ancestors).alias("artifact")).join(
        spec_sources.select("name", F.col("path").alias("artifact")), "artifact"
    )
    state = below.groupBy("name", "artifact").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    artifacts = spec_sources.withColumnRenamed("path", "artifact").join(state, ["name", "artifact"], "left")
    listed = artifacts.groupBy("name").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("artifact").alias("path"),
                    "type",
                    F.col("files").isNotNull().alias("exists"),
                    F.coalesce("files", F.lit(0)).alias("files"),
                    F.coalesce("bytes", F.lit(0)).alias("bytes"),
                )
            )
        ).alias("artifacts")
    )
    return errors.join(listed, "name", "left").withColumn("status", F.lit("failed"))


def write_evaluation(details: DataFrame, summary: DataFrame, audits: DataFrame, folder: str) -> None:
    """Details split by benchmark, with the two small tables beside them. ``details`` has a ``benchmark`` column."""
    details.write.mode("overwrite").partitionBy("benchmark").parquet(f"{folder}/details")
    summary.write.mode("overwrite").json(f"{folder}/summary")
    audits.write.mode("overwrite").json(f"{folder}/audit")


def read_evaluation(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Details, summaries and audits as written, the latter two keyed by run."""
    stored = lambda name, schema: spark.read.schema(f"run_id string, {schema}").json(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/details"), stored("summary", schemas.SUMMARY), stored("audit", schemas.AUDIT)


def write_plans(plans: DataFrame, folder: str) -> None:
    plans.write.mode("overwrite").json(f"{folder}/plans")


def read_plans(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Plans as written, in the schema they had."""
    return spark.read.schema(schema).json(f"{folder}/plans")


def write_report(report: DataFrame, path: str) -> None:
    """Report rows by group and place; a report has a row per run."""
    order = [F.col("benchmark_group").desc(), F.col("track_group").desc(), F.col("place")]
    report.orderBy(*order).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Report rows as written, in the schema they had."""
    return spark.read.schema(schema).json(path)
