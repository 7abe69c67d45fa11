"""Token counts: find end-of-document ids in flat token files that have no index.

Files are cut into blocks of a fixed number of ids. Pass one finds the
separators of each block by an array comparison and keeps three numbers: how
many, and the places of the first and the last. A prefix scan over a file's
blocks gives each block the number of documents before it and the place of the
last separator before it, so pass two can name the documents that end in a
block although they may begin many blocks before.

A file without a separator, or ids after the last one, give one document that
is not ``closed``. Empty files give none. Two separators side by side give an
empty document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, by_bytes, mapped, open_fs, texts
from .tokens import encoder

COUNTS = "file string, ordinal long, start long, n_tokens long, closed boolean"
COUNTS_ARROW = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("closed", pa.bool_())])
SUMMARY = "file string, size long, at long, width int, separators long, last long"
SUMMARY_ARROW = pa.schema([("file", pa.string()), ("size", pa.int64()), ("at", pa.int64()), ("width", pa.int32()), ("separators", pa.int64()), ("last", pa.int64())])


def block_ids(row: dict, block: int) -> np.ndarray:
    """The ids of one block, which alone are read."""
    fs, path = open_fs(row["file"])
    with fs.open_input_file(path) as f:
        f.seek(row["at"] * row["width"])
        return np.frombuffer(f.read(min(block, row["size"] - row["at"]) * row["width"]), f"<u{row['width']}")


def count_tokens(files: DataFrame, separator: int, block: int = 4 << 20) -> DataFrame:
    """Documents of ``files`` (file, size in ids, width in bytes): their order in the file, first id, ids without the separator, and whether a separator ends them."""
    blocks = files.filter("size > 0").select("file", "size", F.explode(F.expr(f"sequence(0L, size - 1, {block}L)")).alias("at"), F.col("width").cast("int").alias("width"))
    tasks = max(1, files.sparkSession.sparkContext.defaultParallelism * 4)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = np.flatnonzero(block_ids(row, block) == separator)
                yield pa.RecordBatch.from_pylist([row | {"separators": len(found), "last": row["at"] + int(found[-1]) if len(found) else None}], SUMMARY_ARROW)

    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        blocks.repartition(tasks)
        .mapInArrow(scan, SUMMARY)
        .withColumn("documents", F.coalesce(F.sum("separators").over(before), F.lit(0)))
        .withColumn("begin", F.coalesce(F.max("last").over(before) + 1, F.lit(0)))
    )

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                end = np.flatnonzero(block_ids(row, block) == separator) + row["at"]
                closed = np.ones(len(end), bool)
                if row["at"] + block >= row["size"] and (end[-1] if len(end) else row["begin"] - 1) < row["size"] - 1:
                    end, closed = np.append(end, row["size"]), np.append(closed, False)
                start = np.concatenate([[row["begin"]], end[:-1] + 1]).astype(np.int64)[: len(end)]
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(end), pa.string()), pa.array(row["documents"] + np.arange(len(end))), pa.array(start), pa.array(end - start), pa.array(closed)], schema=COUNTS_ARROW)

    return stitched.repartition(tasks).mapInArrow(name, COUNTS)


WROTE = "file string, ordinal long, doc_id long, size long, width int"
WROTE_ARROW = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64()), ("width", pa.int32())])


def write_flat(docs: DataFrame, tokenizer: str, separator: int, work: Workspace) -> DataFrame:
    """Flat files of the ids of ``docs`` (doc_id, text), one a partition, a separator after each document. A row per document says where it went; rows with ``ordinal`` null say a file's size. Strings of added tokens in a text are ordinary text here, so no text holds a separator. Null text: empty."""
    folder = work.folder("flat")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, specials=False)
        path, size, ordinal = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin", 0, 0
        fs, p = open_fs(path)
        with fs.open_output_stream(p, compression=None) as out:
            for batch in batches:
                for some in by_bytes(batch):
                    ids, _ = enc.flat(texts(some), separator)
                    out.write(ids.tobytes())
                    size += len(ids)
                    n = some.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(ordinal, ordinal + n), pa.int64()), some.column("doc_id"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], schema=WROTE_ARROW)
                    ordinal += n
        yield pa.RecordBatch.from_pylist([{"file": path, "ordinal": None, "doc_id": None, "size": size, "width": enc.dtype.itemsize}], WROTE_ARROW)

    return work.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, WROTE), "wrote")


def document_token_counts(docs: DataFrame, tokenizer: str, separator: int) -> DataFrame:
    """``doc_id, n_tokens`` (without the separator), and ``file_no, ordinal, start``: where the scan found the document. Null or repeated ``doc_id``s are passed through."""
    wrote = write_flat(docs, tokenizer, separator, Workspace(docs.sparkSession, "token-counts"))
    counts = count_tokens(wrote.filter("ordinal is null").select("file", "size", "width"), separator)
    named = wrote.filter("ordinal is not null").select("file", "ordinal", "doc_id")
    number = F.regexp_extract("file", r"/(\d+)-[^/]*$", 1).cast("int").alias("file_no")
    return counts.hint("merge").join(named, ["file", "ordinal"]).select("doc_id", "n_tokens", number, "ordinal", "start")
