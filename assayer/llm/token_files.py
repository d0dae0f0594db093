"""Token ids as flat binary files with 64-bit document offsets."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import flatfiles
from assayer.llm.common import materialize
from assayer.llm.tokens import END_ID, encode_all

_FILES = pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
_FILES_SQL = "part int, file string, docs long, ids long"
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_ROWS_SQL = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: In the file of document ids, which holds 64-bit integers, this stands for a null id.
NO_ID = -(1 << 63)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", dtype: str = "<u2") -> DataFrame:
    """Write ids of ``docs(doc_id, text)`` below ``folder`` in ascending order of doc_id; returns the table of files.

    The documents are dealt by ranges of doc_id and sorted inside each, so files in order of ``part`` hold all
    documents in order. Each part has three flat little-endian files: ``.ids`` (``dtype``), ``.off`` (64-bit offsets
    in ids, one more than documents) and ``.doc`` (64-bit document ids). ``base`` is the number of ids in all earlier
    parts, a prefix sum over parts. A null text is an empty one; a null doc_id comes first; rows with equal ids follow
    each other; an empty table gives no files. A task that runs again writes files of new names, and only those whose
    rows Spark kept are in the table.
    """
    flatfiles.make_folder(folder)

    def write(batches):
        part = TaskContext.get().partitionId()
        name = f"{folder}/{flatfiles.fresh_name(part)}"
        at, offsets, ids = 0, [0], []
        out = None
        for batch in batches:
            if out is None:
                out = flatfiles.appender(f"{name}.ids")
            ids += [NO_ID if i is None else i for i in batch.column(0).to_pylist()]
            for tokens in encode_all(tokenizer, batch.column(1).to_pylist()):
                out.write(tokens.astype(dtype).tobytes())
                at += len(tokens)
                offsets.append(at)
        if out is None:
            return
        out.close()
        for kind, values in (("off", offsets), ("doc", ids)):
            with flatfiles.appender(f"{name}.{kind}") as f:
                f.write(np.array(values, "<i8").tobytes())
        yield flatfiles.table({"part": [part], "file": [name], "docs": [len(ids)], "ids": [at]}, _FILES)

    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = materialize(dealt.mapInArrow(write, _FILES_SQL), "token-files")
    # one row per file, so that a single task adds them up
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame, dtype: str = "<u2") -> DataFrame:
    """One row per document of the files: where its ids start among all, how many they are, and their checksum.

    ``ids_crc32`` is taken over the ids as little-endian unsigned 32-bit integers, whatever the width in the file.
    """

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = flatfiles.view(f"{row['file']}.ids", dtype)
                offsets = flatfiles.view(f"{row['file']}.off", "<i8")
                names = flatfiles.view(f"{row['file']}.doc", "<i8")
                for k in range(0, len(names), 4096):
                    part, edges = names[k : k + 4096], offsets[k : k + 4097]
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                    yield flatfiles.table(
                        {
                            "doc_id": pa.array(part, mask=part == NO_ID),
                            "start": row["base"] + edges[:-1],
                            "n_tokens": np.diff(edges),
                            "ids_crc32": np.array(sums, np.int64),
                        },
                        _ROWS,
                    )

    # one task per file: without the number, small rows would be put together
    return files.repartitionByRange(max(1, files.count()), "part").mapInArrow(read, _ROWS_SQL)


__all__ = ["END_ID", "read_token_files", "write_token_files"]
