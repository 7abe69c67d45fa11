"""Token-ID files: flat unsigned integers with 64-bit document offsets, memory-mapped.

A shard is two files. ``.bin`` holds the ids of its documents end to end,
little-endian unsigned integers of 16 bits where the vocabulary allows and 32
otherwise. ``.idx`` holds, in this order: the number of documents n (uint64),
n + 1 offsets into the shard (uint64, in ids), n document ids (int64) and n
bytes that are 1 where the document id is null.

Documents are range-partitioned by ``doc_id``, so shards in shard order are in
ascending order; a shard's place in the whole (its base) is the prefix sum of
the ids in the shards before it, from the manifest that the writing tasks
return. Files have names of one attempt each and only those of the committed
manifest are read, so lost or repeated tasks leave nothing wrong behind.

Null texts count as empty (the end id alone). Null ``doc_id``s come first and
stay null; rows with equal ids stay apart, in the order of their texts' hashes.
No rows give no shards with documents. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, by_bytes, mapped, open_fs, texts
from .tokens import encoder

MANIFEST = "shard long, bin string, idx string, docs long, ids long, width int"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write(docs: DataFrame, tokenizer: str, work: Workspace, end_id: int = 0, name: str = "tokens") -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shards in ascending ``doc_id`` order; the manifest, with each shard's ``base``."""
    folder = work.folder(f"{name}-files")
    shards = max(1, docs.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        stem = f"{folder}/{shard:06d}-{uuid.uuid4().hex}"
        fs, path = open_fs(f"{stem}.bin")
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        null: list[np.ndarray] = []
        with fs.open_output_stream(path, compression=None) as out:
            for batch in batches:
                for part in by_bytes(batch):
                    flat, ends = enc.flat(texts(part), end_id)
                    out.write(flat.tobytes())
                    lengths.append(np.diff(ends, prepend=0))
                    key = part.column("doc_id")
                    null.append(key.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
                    ids.append(key.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        n = np.concatenate([np.zeros(1, np.int64), *lengths]).cumsum()
        fs, path = open_fs(f"{stem}.idx")
        with fs.open_output_stream(path, compression=None) as out:
            for part in ([np.array([len(n) - 1], "<u8"), n.astype("<u8")], ids, null):
                out.write(b"".join(x.tobytes() for x in part))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "bin": [f"{stem}.bin"], "idx": [f"{stem}.idx"], "docs": [len(n) - 1], "ids": [int(n[-1])], "width": [enc.dtype.itemsize]}, MANIFEST_ARROW)

    # the hash and a fixed random number let the rows of one id, even equal rows, go to several shards
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"), F.rand(7).alias("spread"))
        .repartitionByRange(shards, "doc_id", "mark", "spread")
        .sortWithinPartitions("doc_id", "mark", "spread")
        .select("doc_id", "text")
    )
    manifest = work.save(ordered.mapInArrow(run, MANIFEST), f"{name}-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


MANIFEST_ARROW = pa.schema([("shard", pa.int64()), ("bin", pa.string()), ("idx", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())])
DOCS_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def documents_of(index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, document ids and null marks of an index file's bytes."""
    n = int(index[:8].view("<u8")[0])
    offsets = index[8 : 16 + 8 * n].view("<u8").astype(np.int64)
    ids = index[16 + 8 * n : 16 + 16 * n].view("<i8")
    return offsets, ids, index[16 + 16 * n : 16 + 17 * n] == 1


def read(manifest: DataFrame, tasks: int) -> DataFrame:
    """One row per document, from the files: its id, place in the whole, length and CRC-32 of its ids as unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                offsets, ids, null = documents_of(mapped(row["idx"]))
                flat = mapped(row["bin"]).view(f"<u{row['width']}")
                for a in range(0, len(ids), 4096):
                    cut = offsets[a : a + 4097]
                    wide = flat[cut[0] : cut[-1]].astype("<u4")
                    at = (cut - cut[0]).tolist()
                    crc = [zlib.crc32(wide[x:y]) for x, y in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a : a + 4096], pa.int64(), mask=null[a : a + 4096]), pa.array(cut[:-1] + row["base"]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())], schema=DOCS_ARROW
                    )

    return manifest.repartition(max(1, tasks)).mapInArrow(run, DOCS)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the files and read them back: ``doc_id, start, n_tokens, ids_crc32`` (see the module)."""
    work = Workspace(docs.sparkSession, "token-files")
    return read(write(docs, tokenizer, work, end_id), max(1, docs.rdd.getNumPartitions()))
