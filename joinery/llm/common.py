"""Shared folder, written tables and Arrow batch helpers of the operators in this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


@functools.cache
def local_root(app: str) -> str:
    """A temporary folder of a local run, removed when the driver's Python ends."""
    root = "file://" + tempfile.mkdtemp(prefix="joinery-")
    atexit.register(drop, root)
    return root


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local run (one process) gets a temporary folder; a cluster has none that would do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return local_root(spark.sparkContext.applicationId)
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def drop(path: str) -> None:
    """Delete a folder of the shared store."""
    with contextlib.suppress(FileNotFoundError, OSError):
        fs, p = open_fs(path)
        fs.delete_dir(p)


class Workspace:
    """A folder of its own under the shared root, removed when the driver's Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(drop, self.path)

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write a table and read it again: cuts the lineage, survives lost executors."""
        at = f"{self.path}/{name}"
        df.write.option("compression", codec).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def folder(self, name: str) -> str:
        at = f"{self.path}/{name}"
        fs, p = open_fs(at)
        fs.create_dir(p, recursive=True)
        return at

    def drop(self, *names: str) -> None:
        for name in names:
            drop(f"{self.path}/{name}")

    def drop_but(self, *names: str) -> None:
        """Delete all tables and folders but those named; nothing may read them any more."""
        fs, p = open_fs(self.path)
        for f in fs.get_file_info(pafs.FileSelector(p)):
            if f.base_name not in names:
                drop(f"{self.path}/{f.base_name}")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI of the shared store, for tasks that write or read plain files."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = Path(uri).absolute().as_uri()
    if uri.startswith("file:") and not uri.startswith("file:///"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def mapped(uri: str) -> np.ndarray:
    """The bytes of a file of the shared store: memory-mapped if it is a local path, else read."""
    fs, p = open_fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(p, dtype=np.uint8, mode="r") if Path(p).stat().st_size else np.zeros(0, np.uint8)
    with fs.open_input_stream(p, compression=None) as f:
        return np.frombuffer(f.read(), np.uint8)


def put(uri: str, data: bytes) -> None:
    fs, p = open_fs(uri)
    with fs.open_output_stream(p, compression=None) as f:
        f.write(data)


def by_bytes(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; one long text is a slice alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes.astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each span of ``values``; spans lie end to end."""
    offsets = np.append(0, ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length-1 of each span, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
