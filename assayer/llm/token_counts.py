"""Documents and token counts of flat token files that have no index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import flatfiles
from assayer.llm.common import materialize
from assayer.llm.tokens import encode_all

#: Ids in a block; a file of any size is read in so many pieces.
BLOCK = 1 << 22

_FILES = pa.schema([("file", pa.string()), ("size", pa.int64())])
_SEEN_SQL = "file string, block long, first long, ids long, ends long, last_end long"
_SEEN = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("block", "first", "ids", "ends", "last_end"))])
_DOCS_SQL = "file string, document long, start long, n_tokens long, finished boolean"
_DOCS = pa.schema(
    [("file", pa.string()), *((c, pa.int64()) for c in ("document", "start", "n_tokens")), ("finished", pa.bool_())]
)


def write_flat(docs: DataFrame, folder: str, end: int, tokenizer: str = "word_bpe_49k.json", dtype: str = "<u2") -> DataFrame:
    """Write the ids of whole texts, each with the end id behind it, and nothing else; returns ``(file, size)``.

    Names of special tokens inside a text are encoded as ordinary text, so the end id never stands inside a document.
    """
    flatfiles.make_folder(folder)

    def write(batches):
        name, out, at = f"{folder}/{flatfiles.fresh_name(TaskContext.get().partitionId())}.ids", None, 0
        for batch in batches:
            if out is None:
                out = flatfiles.appender(name)
            for ids in encode_all(tokenizer, batch.column(0).to_pylist(), end, literal=True):
                out.write(ids.astype(dtype).tobytes())
                at += len(ids)
        if out is not None:
            out.close()
            yield flatfiles.table({"file": [name], "size": [at]}, _FILES)

    return materialize(docs.select("text").mapInArrow(write, "file string, size long"), "flat-files")


def token_counts(files: DataFrame, end: int, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """One row per document of the files ``(file, size in ids)``, found by searching for the end id.

    Each block of a file is searched by itself, all at once. A prefix scan over the blocks of a file then gives what
    each needs from those before it: the last end seen (where its open document starts) and the number of documents.
    ``document`` counts documents over all files in order of name, from 0; ``start`` is the place in the file;
    ``n_tokens`` holds the end id; ids behind the last end make a document that is not ``finished``. An empty file has
    no documents, an empty document one id. Blocks are read by range, so no file has to fit one task.
    """
    blocks = files.where("size > 0").select(
        "file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {block}"))).alias("block")
    )
    # tasks by the number of blocks: without it, small rows would be put together
    tasks = max(1, (blocks.count() + 1) // 2)
    spread = blocks.repartition(tasks, "file", "block")

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                first = row["block"] * block
                ids = flatfiles.view(row["file"], dtype, first, min(block, row["size"] - first))
                ends = np.flatnonzero(ids == end)
                last = [first + int(ends[-1])] if len(ends) else [None]
                seen = {"file": [row["file"]], "block": [row["block"]], "first": [first], "ids": [len(ids)]}
                yield flatfiles.table(seen | {"ends": [len(ends)], "last_end": last}, _SEEN)

    seen = materialize(spread.mapInArrow(search, _SEEN_SQL), "token-blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the last block also closes what is left open
    per_file = seen.groupBy("file").agg(
        F.sum("ends").alias("closed"), F.max("last_end").alias("stop"), F.sum("ids").alias("size"), F.max("block").alias("last")
    )
    counted = per_file.withColumn("docs", F.col("closed") + (F.coalesce("stop", F.lit(-1)) < F.col("size") - 1).cast("long"))
    # one row per file
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("file", "last", F.coalesce(F.sum("docs").over(earlier), F.lit(0)).alias("base"))
    stitched = seen.select(
        "file",
        "block",
        "first",
        "ids",
        F.coalesce(F.max("last_end").over(before) + 1, F.lit(0)).alias("open"),
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("earlier"),
    ).join(bases, "file")

    def tell(batches):
        for batch in batches:
            for row in batch.to_pylist():
                first = row["first"]
                ids = flatfiles.view(row["file"], dtype, first, row["ids"])
                ends = first + np.flatnonzero(ids == end)
                stop, done = first + row["ids"], len(ends)
                if row["block"] == row["last"] and (ends[-1] if done else row["open"] - 1) < stop - 1:
                    ends = np.append(ends, stop - 1)
                starts = np.concatenate([[row["open"]], ends[:-1] + 1])[: len(ends)]
                for k in range(0, len(ends), 65536):
                    part = slice(k, k + 65536)
                    n = len(ends[part])
                    at = np.arange(k, k + n)
                    yield flatfiles.table(
                        {
                            "file": [row["file"]] * n,
                            "document": row["base"] + row["earlier"] + at,
                            "start": starts[part],
                            "n_tokens": ends[part] - starts[part] + 1,
                            "finished": at < done,
                        },
                        _DOCS,
                    )

    return stitched.repartition(tasks, "file", "block").mapInArrow(tell, _DOCS_SQL)
