"""Digests, sizes and completeness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.ranking import top_rows_of_few_keys


def text_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def ordered_digest(
    rows: DataFrame, key: str, pos: str, piece: str, separator: str, per_chunk: int = 1024, short_chunks: int = 64
) -> DataFrame:
    """SHA-256 of each key's pieces joined in order of position: ``(key, digest)``. Positions count from 0.

    Pieces first join into chunks of ``per_chunk`` positions. Keys of up to ``short_chunks`` chunks finish in the JVM.
    SHA-256 has to read a text in order, so a longer key's chunks stream in order through one hash state; no text of
    unbounded length is ever built.
    """
    chunk = F.floor(F.col(pos) / per_chunk)
    joined = F.array_join(F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(piece).alias("piece"))))["piece"], separator)
    chunks = rows.groupBy(key, chunk.alias("chunk")).agg(joined.alias("text"))
    long_keys = rows.filter(F.col(pos) >= per_chunk * short_chunks).select(key).distinct()
    whole = F.array_join(F.array_sort(F.collect_list(F.struct("chunk", "text")))["text"], separator)
    short = chunks.join(long_keys, key, "left_anti").groupBy(key).agg(F.sha2(whole, 256).alias("digest"))
    ordered = chunks.join(long_keys, key, "left_semi").repartition(key).sortWithinPartitions(key, "chunk")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            done = []
            for k, text in zip(batch[key], batch["text"]):
                if state is not None and k == current:
                    state.update(separator.encode())
                else:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    current, state = k, hashlib.sha256()
                state.update(text.encode())
            yield pd.DataFrame(done, columns=[key, "digest"]).astype({key: batch[key].dtype})
        if state is not None:
            yield pd.DataFrame([(current, state.hexdigest())], columns=[key, "digest"])

    schema = f"{key} {rows.schema[key].dataType.simpleString()}, digest string"
    return short.unionByName(ordered.select(key, "text").mapInPandas(stream, schema))


def tree_digest(rows: DataFrame, key: str, pos: str, piece: str, per_chunk: int = 1024) -> DataFrame:
    """SHA-256 of each key's pieces as a tree: ``(key, digest)``. Positions are distinct whole numbers from 0 on.

    Pieces of ``per_chunk`` positions are joined by line feeds and hashed, then so many of these digests, then all that
    are left, so a key of a billion pieces never meets in one task.
    """
    level = rows.select(key, F.col(pos).cast("long").alias("at"), F.col(piece).alias("part"))
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("at", "part")))["part"], "\n")
    for _ in range(2):
        level = level.groupBy(key, F.floor(F.col("at") / per_chunk).alias("up")).agg(F.sha2(joined, 256).alias("part")).withColumnRenamed("up", "at")
    return level.groupBy(key).agg(F.sha2(joined, 256).alias("digest"))


def prompt_set_digest(prompts: DataFrame, run: str = "run_id") -> DataFrame:
    """Digest of a run's prompts, from ``id:digest`` lines in case order: ``prompts(run, pos, case_id, prompt_sha256)``."""
    lines = prompts.withColumn("line", F.concat_ws(":", "case_id", "prompt_sha256"))
    return ordered_digest(lines, run, "pos", "line", "\n").withColumnRenamed("digest", "prompt_set_sha256")


def chat_digest(parts: DataFrame) -> DataFrame:
    """Digest of flattened chats, from their parts."""
    return ordered_digest(parts, "chat_id", "part", "text", "\n\n", per_chunk=1, short_chunks=4)


def chat_sizes(parts: DataFrame) -> DataFrame:
    """Characters of each flattened chat, the blank lines between parts included."""
    return parts.groupBy("chat_id").agg(
        (F.sum(F.char_length("text")) + 2 * (F.count("*") - 1)).alias("prompt_chars")
    )


def case_metrics(case_runs: DataFrame) -> DataFrame:
    """Sizes and digest of each case run: ``case_runs(..., prompt, output, seconds)``."""
    return case_runs.withColumns(
        {
            "prompt_sha256": text_digest(F.col("prompt")),
            "prompt_chars": F.char_length("prompt"),
            "output_chars": F.char_length("output"),
            "latency_seconds": F.round("seconds", 3),
        }
    )


def check_files(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Digest and size check of files: ``files(path, content, length)``, ``expected(path, expected_bytes)``.

    A file is valid if it is not empty and has the expected size where one is given.
    """
    seen = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return expected.join(seen, "path", "left").select(
        "path",
        F.col("bytes").isNotNull().alias("exists"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        "sha256",
        (F.coalesce("bytes", F.lit(0)) > 0).alias("not_empty"),
        F.coalesce((F.col("bytes") > 0) & (F.col("bytes") == F.coalesce("expected_bytes", "bytes")), F.lit(False)).alias("valid"),
    )


def artifact_completeness(expected: DataFrame, listing: DataFrame, max_missing: int = 20) -> DataFrame:
    """Per source: files expected, found and missing, and the first missing ones.

    ``expected(source, path)``, ``listing(path, bytes)``. The list of missing files is cut before it is gathered.
    """
    joined = expected.join(listing, "path", "left")
    totals = joined.groupBy("source").agg(
        F.count("*").alias("expected_files"),
        F.count("bytes").alias("found_files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.count_if(F.col("bytes").isNull()).alias("missing_count"),
    )
    first = top_rows_of_few_keys(
        joined.filter("bytes IS NULL").select("source", "path"), ["source"], [F.col("path")], max_missing, spread=F.col("path")
    )
    missing = first.groupBy("source").agg(F.array_sort(F.collect_list("path")).alias("missing"))
    return totals.join(missing, "source", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))


def snapshot_totals(listing: DataFrame, required: str, minimum: int) -> DataFrame:
    """Files, bytes and required files per source, and whether the minimum is met; ``required`` is a path pattern."""
    return listing.groupBy("source").agg(
        F.count("*").alias("files"),
        F.sum("bytes").alias("bytes"),
        F.count_if(F.col("path").rlike(required)).alias("required_files"),
        (F.count_if(F.col("path").rlike(required)) >= minimum).alias("complete"),
    )
