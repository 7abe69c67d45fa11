"""Packing: concatenate all token ids and cut them into fixed windows.

Pass one encodes each partition's documents and stores their ids with their
place in the partition; the prefix sums of the partitions' totals give each
partition's place in the whole. Pass two cuts every document at multiples of
``length``; a document over a boundary gives a record on either side of it. No
text or id is shuffled, and only the last sequence can need padding.

Null texts count as empty (the end id alone); null or repeated ``doc_id``s are
passed through, each row packed by itself; no rows give no pieces. A document
of any length is one stream of pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, binaries, by_bytes, texts
from .tokens import encoder

#: Rows of partition bases up to which they are broadcast (16 bytes each); beyond, they are joined by shuffle.
MOST_BROADCAST = 1_000_000
IDS = "part long, before long, doc_tokens long, doc_id long, ids binary"
IDS_ARROW = pa.schema([("part", pa.int64()), ("before", pa.int64()), ("doc_tokens", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in by_bytes(batch):
                ids, ends = enc.flat(texts(some), end_id)
                first = np.append(0, ends[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), part)), pa.array(before + first), pa.array(ends - first), some.column("doc_id"), binaries(ids, ends)], schema=IDS_ARROW)
                before += int(ends[-1])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, IDS)


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): ``doc_id, start`` (its ids before the piece), ``length, ids_crc32`` (of unsigned 32-bit ids), ``doc_tokens, sequence_id, offset`` and, ``with_ids``, the ids as little-endian unsigned integers as narrow as the vocabulary allows."""
    from .tokens import SpecialSplit

    work = Workspace(docs.sparkSession, "packing")
    width = 2 if SpecialSplit(tokenizer).size <= 1 << 16 else 4
    ids = work.save(encoded(docs, tokenizer, end_id), "ids")
    totals = work.save(ids.groupBy("part").agg(F.sum("doc_tokens").alias("n")), "totals")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if totals.count() <= MOST_BROADCAST:
        bases = F.broadcast(bases)
    placed = ids.join(bases, "part").select("doc_id", (F.col("base") + F.col("before")).alias("first"), "doc_tokens", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, "ids"):
                first = some.column("first").to_numpy()
                n = some.column("doc_tokens").to_numpy()
                pieces = (first + n - 1) // length - first // length + 1
                row = np.repeat(np.arange(len(n)), pieces)
                k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                sequence = first[row] // length + k
                start = np.maximum(sequence * length, first[row]) - first[row]
                size = np.minimum((sequence + 1) * length - first[row], n[row]) - start
                data = some.column("ids").to_pylist()
                own = [data[r][width * a : width * (a + s)] for r, a, s in zip(row.tolist(), start.tolist(), size.tolist())]
                crc = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4")) for x in own]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(pa.array(row)), *map(pa.array, (start, size)), pa.array(crc, pa.int64()), *map(pa.array, (n[row], sequence, first[row] + start - sequence * length)), pa.array(own if with_ids else [None] * len(own), pa.binary())],
                    schema=PIECES_ARROW,
                )

    pieces = placed.mapInArrow(cut, PIECES)
    return pieces if with_ids else pieces.drop("ids")
