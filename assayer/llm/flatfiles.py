"""Flat files of integers in the shared folder, by any URI that pyarrow knows."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def make_folder(uri: str) -> None:
    files, path = place(uri)
    files.create_dir(path, recursive=True)


def fresh_name(part: int) -> str:
    """Every attempt of a task writes a file of its own; the table of files names the one whose task succeeded."""
    return f"part-{part:05d}-{uuid.uuid4().hex[:12]}"


def appender(uri: str):
    files, path = place(uri)
    return files.open_output_stream(path)


def view(uri: str, dtype: str, start: int = 0, count: int | None = None) -> np.ndarray:
    """Values of a file, memory-mapped where it lies on a mounted disk, else read by range."""
    files, path = place(uri)
    kind = np.dtype(dtype)
    if isinstance(files, fs.LocalFileSystem):
        if files.get_file_info(path).size == 0:
            return np.zeros(0, kind)
        data = np.memmap(path, kind, "r")
        return data[start:] if count is None else data[start : start + count]
    with files.open_input_file(path) as f:
        size = f.size() // kind.itemsize
        n = size - start if count is None else min(count, size - start)
        return np.frombuffer(f.read_at(n * kind.itemsize, start * kind.itemsize), kind)


def id_type(largest: int) -> str:
    """Little-endian unsigned type for ids up to ``largest``."""
    return "<u2" if largest < 1 << 16 else "<u4"


def table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def table_of(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([table(columns, schema)])
