"""Benchmark case sources, all normalised to one case schema."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.lines import file_name
from assayer.functions.text import strip
from assayer.operators.ranking import top_rows, top_rows_of_few_keys
from assayer.rules import vocab
from assayer.schemas import CASE_COLUMNS, PUBLIC_CASE_COLUMNS

# fixed values: column names of question, gold query and database in CSV case sets, by preference
QUESTION_NAMES = ["question", "prompt", "user_question", "natural_language_question"]
GOLD_NAMES = ["query", "sql", "gold", "gold_query", "answer"]
DATABASE_NAMES = ["db_name", "db_id", "database", "schema", "database_name"]
# fixed values: files that describe a task, the first kind with text counts
TASK_FILES = [r"README\.md", r"question\.txt", r"instruction\.txt", r".*\.md", r".*\.txt"]
TASK_TEXT_CHARS = 6000
SAFE_ID_CHARS = 140


def canonical_name(name: Column) -> Column:
    """The registered benchmark of an alias; ``all`` stays, unknown names give NULL."""
    key = F.lower(strip(name))
    aliases = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in vocab.BENCHMARK_ALIASES.items()))
    return F.when(key == "all", key).otherwise(F.try_element_at(aliases, key))


def safe_case_id(value: Column) -> Column:
    """An id as a file name, cut to its first characters: cases may share it, so it is a label and no key."""
    cleaned = F.regexp_replace(value, "[^A-Za-z0-9_.-]+", "_")
    return F.left(F.regexp_replace(cleaned, "^_+|_+$", ""), F.lit(SAFE_ID_CHARS))


def case_id_collisions(cases: DataFrame) -> DataFrame:
    """Safe ids that more than one case got, with the number of cases."""
    ids = cases.groupBy("benchmark", safe_case_id(F.col("case_id")).alias("safe_id")).agg(F.count("*").alias("cases"))
    return ids.filter("cases > 1")


def benchmarks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(vocab.BENCHMARKS, "benchmark string, display_name string, mode string, dialect string")


def normalize_cases(rows: DataFrame, benchmark: str) -> DataFrame:
    """Rows with ``pos`` and any of the case columns as full cases; what is missing is empty text.

    The raw id stays the case's key, however long; ``safe_id`` is its form as a file name.
    """
    mode, dialect = next((m, d) for name, _, m, d in vocab.BENCHMARKS if name == benchmark)
    fixed = {"benchmark": F.lit(benchmark), "mode": F.lit(mode), "safe_id": safe_case_id(F.col("case_id"))}

    def column(name: str) -> Column:
        if name in fixed:
            return fixed[name]
        if name == "metadata":
            given = F.col(name) if name in rows.columns else F.lit(None)
            return F.coalesce(given.cast("map<string,string>"), F.create_map().cast("map<string,string>"))
        default = F.lit(dialect if name == "dialect" else "")
        return F.coalesce(F.col(name), default) if name in rows.columns else default

    return rows.select("pos", *[column(name).alias(name) for name in CASE_COLUMNS])


def _first_text(*values: Column) -> Column:
    """The first value that is neither missing nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _elements(spark: SparkSession, paths) -> DataFrame:
    """JSON array elements of whole files: ``(path, pos, item)``; an object's ``data`` array counts too."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    listed = F.when(
        F.ltrim("value").startswith("{"), F.from_json(F.get_json_object("value", "$.data"), "array<string>")
    ).otherwise(F.from_json("value", "array<string>"))
    return raw.select("path", F.posexplode(listed).alias("pos", "item"))


def _field(name: str) -> Column:
    return F.get_json_object("item", f"$.{name}")


def read_json_array_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of one JSON array file."""
    rows = _elements(spark, path)
    key = F.coalesce(_field("question_id"), _field("id"), F.col("pos").cast("string"))
    named = {"difficulty": _field("difficulty"), "question_id": _field("question_id")}
    metadata = F.map_filter(
        F.create_map(*chain.from_iterable((F.lit(k), v) for k, v in named.items())), lambda k, v: v.isNotNull()
    )
    return normalize_cases(
        rows.select(
            "pos",
            F.concat(F.lit("bird_"), key).alias("case_id"),
            _field("question").alias("question"),
            _first_text(_field("evidence"), _field("knowledge")).alias("evidence"),
            _first_text(_field("SQL"), _field("query")).alias("gold_sql"),
            _field("db_id").alias("db_id"),
            metadata.alias("metadata"),
        ),
        "bird-mini-dev",
    )


def read_json_file_cases(spark: SparkSession, folder: str, split: str = "test") -> DataFrame:
    """Cases of many JSON files, numbered within each; files of the split where there are any, else all."""
    ending = "test" if split in ("test", "dev") else split
    rows = _elements(spark, f"{folder}/*.json").withColumn("file", file_name(F.col("path")))
    rows = rows.withColumn("of_split", F.col("file").endswith(f"_{ending}.json"))
    # a yes or no over the file names, found when the cases are read; no file is opened for it
    names = spark.read.format("binaryFile").load(f"{folder}/*.json").select("path")
    has_split = names.agg(F.coalesce(F.bool_or(F.col("path").endswith(f"_{ending}.json")), F.lit(False))).scalar()
    rows = rows.filter(F.col("of_split") | ~has_split)
    nested = _field("sql")
    gold = _first_text(
        _field("query"),
        _field("SQL"),
        F.when(nested.startswith("{"), F.get_json_object(nested, "$.query")).otherwise(nested),
    )
    stem = F.regexp_replace("file", r"\.json$", "")
    cases = normalize_cases(
        rows.select(
            "pos",
            F.concat_ws("_", F.lit("kaggledbqa"), stem, F.col("pos").cast("string")).alias("case_id"),
            _field("question").alias("question"),
            gold.alias("gold_sql"),
            _field("db_id").alias("db_id"),
            F.create_map(F.lit("source_file"), F.col("file")).alias("metadata"),
        ),
        "kaggledbqa",
    )
    return cases


def read_csv_cases(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Cases of CSV files with differing headers; a row without a question is dropped but keeps its number.

    Quoted cells may hold line breaks, so one task reads a file in order; a row's number is its running id less the
    file's first.
    """
    return reduce(DataFrame.unionByName, [_csv_cases(spark, path) for path in paths])


def _csv_cases(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    by_name = {name.lower(): name for name in raw.columns}

    def first(names: list[str]) -> Column:
        found = [F.nullif(strip(F.col(f"`{by_name[n]}`")), F.lit("")) for n in names if n in by_name]
        return F.coalesce(*found, F.lit(""))

    rows = raw.select(
        F.monotonically_increasing_id().alias("id"),
        F.col("_metadata.file_name").alias("file"),
        first(QUESTION_NAMES).alias("question"),
        first(GOLD_NAMES).alias("gold_sql"),
        first(DATABASE_NAMES).alias("db_id"),
    )
    start = rows.groupBy("file").agg(F.min("id").alias("start"))
    numbered = rows.join(start, "file").withColumn("pos", (F.col("id") - F.col("start")).cast("int"))
    stem = F.regexp_replace("file", r"\.csv$", "")
    return normalize_cases(
        numbered.filter("question <> ''").select(
            "pos",
            F.concat_ws("_", F.lit("defog"), stem, F.col("pos").cast("string")).alias("case_id"),
            "question",
            "gold_sql",
            "db_id",
            F.create_map(F.lit("source_file"), F.col("file")).alias("metadata"),
        ),
        "defog-sql-eval",
    )


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``(path, text, bytes)``."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("bytes"))


def task_texts(files: DataFrame) -> DataFrame:
    """Task descriptions from ``files(task, name, text)``: the first kind of file that has any text, in name order.

    ``question`` holds the texts whole; ``shortened`` holds the first ``TASK_TEXT_CHARS`` characters of each, as prompts
    of bounded length take them, and ``chars_cut`` how many characters that leaves out.
    """
    kind = F.coalesce(*[F.when(F.col("name").rlike(f"^{pattern}$"), i) for i, pattern in enumerate(TASK_FILES)])
    usable = files.select("task", "name", strip(F.col("text")).alias("text"), kind.alias("kind")).filter(
        "text <> '' AND kind IS NOT NULL"
    )
    best = usable.groupBy("task").agg(F.min("kind").alias("best"))
    chosen = usable.join(best, "task").filter("kind = best")
    chunk = lambda text: F.concat(F.lit("# "), F.col("name"), F.lit("\n"), text)
    files_of = F.array_sort(
        F.collect_list(F.struct("name", chunk(F.col("text")).alias("whole"), chunk(F.left("text", F.lit(TASK_TEXT_CHARS))).alias("short")))
    )
    cut = F.sum(F.greatest(F.length("text") - TASK_TEXT_CHARS, F.lit(0)))
    return chosen.groupBy("task").agg(files_of.alias("files"), cut.alias("chars_cut")).select(
        "task",
        F.array_join("files.whole", "\n\n").alias("question"),
        F.array_join("files.short", "\n\n").alias("shortened"),
        "chars_cut",
    )


def read_task_cases(tasks: DataFrame, files: DataFrame, mirror_files: DataFrame | None = None) -> DataFrame:
    """Agentic cases per task folder: ``tasks(task)``; its own texts, else its mirror's, else a plain sentence."""
    own = task_texts(files).select("task", F.col("question").alias("own"))
    joined = tasks.select("task").distinct().join(own, "task", "left")
    if mirror_files is not None:
        joined = joined.join(task_texts(mirror_files).select("task", F.col("question").alias("mirror")), "task", "left")
    else:
        joined = joined.withColumn("mirror", F.lit(None).cast("string"))
    databases = (
        (files if mirror_files is None else files.unionByName(mirror_files))
        .filter(F.col("name").endswith(".duckdb"))
        .groupBy("task")
        .agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("databases"))
    )
    plain = F.concat(F.lit("Complete the Spider2-DBT task in "), "task", F.lit("."))
    rows = joined.join(databases, "task", "left").select(
        F.lit(0).alias("pos"),
        F.concat(F.lit("spider2_dbt_"), "task").alias("case_id"),
        _first_text(F.col("own"), F.col("mirror"), plain).alias("question"),
        F.col("task").alias("db_id"),
        F.when(
            F.col("databases").isNull(), F.create_map(F.lit("task_dir"), F.col("task"))
        ).otherwise(F.create_map(F.lit("task_dir"), F.col("task"), F.lit("duckdb_files"), F.col("databases"))).alias("metadata"),
    )
    return normalize_cases(rows, "spider2-dbt")


def union_cases(sources: list[DataFrame], limit: int | None = None) -> DataFrame:
    """All sources as one case table; a limit keeps the first cases of each benchmark, 0 or none keeps all."""
    cases = reduce(DataFrame.unionByName, sources)
    if limit:
        cases = top_rows_of_few_keys(cases, ["benchmark"], [F.col("pos"), F.col("case_id")], limit, spread=F.col("case_id"))
    return cases.select(CASE_COLUMNS)


def public_cases(cases: DataFrame) -> DataFrame:
    """What may be published of a case: never its gold query, schema text or metadata."""
    return cases.select(PUBLIC_CASE_COLUMNS)


# fixed values: where a database file may lie below a data set's folder, by preference
DATABASE_PLACES = [
    "databases/{db}/{db}.sqlite",
    "databases/{db}/{db}.db",
    "databases/{db}.sqlite",
    "databases/{db}.db",
    "dev_databases/{db}/{db}.sqlite",
    "dev_databases/{db}/sqlite/{db}.sqlite",
    "mini_dev_data/dev_databases/{db}/{db}.sqlite",
    "mini_dev_data/dev_databases/{db}/sqlite/{db}.sqlite",
]


def pick_databases(databases: DataFrame, listing: DataFrame) -> DataFrame:
    """The file of each database: ``databases(db_id)``, ``listing(path)`` with paths below the data set's folder.

    Known places win in order, then any file of that name in path order.
    """
    named = listing.select("path", F.regexp_extract(file_name(F.col("path")), r"(?s)^(.*)\.(sqlite|db)$", 1).alias("db_id"))
    joined = databases.select("db_id").distinct().join(named.filter("db_id <> ''"), "db_id")
    place = lambda pattern: F.concat(
        *[F.col("db_id") if piece == "{db}" else F.lit(piece) for piece in _pieces(pattern)]
    )
    rank = F.coalesce(
        *[F.when(F.col("path") == place(p), i) for i, p in enumerate(DATABASE_PLACES)], F.lit(len(DATABASE_PLACES))
    )
    best = top_rows(joined.withColumn("place", rank), ["db_id"], [F.col("place"), F.split("path", "/")], 1)
    return databases.select("db_id").distinct().join(best.select("db_id", F.col("path").alias("db_path")), "db_id", "left")


def _pieces(pattern: str) -> list[str]:
    parts = pattern.split("{db}")
    return [p for part in parts[:-1] for p in (part, "{db}") if p] + ([parts[-1]] if parts[-1] else [])


def first_match(listing: DataFrame, patterns: list[str]) -> DataFrame:
    """The first path, in path order, of the first pattern that any path matches."""
    rank = F.coalesce(*[F.when(F.col("path").rlike(p), i) for i, p in enumerate(patterns)])
    ranked = listing.select("path", rank.alias("place")).filter("place IS NOT NULL")
    return ranked.orderBy("place", F.split("path", "/")).limit(1).select("path")
