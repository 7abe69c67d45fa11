"""Media columns: payloads as content-defined chunks, stored once each.

A payload is cut where a rolling gear hash of its last 32 bytes has its top
bits clear, between a least and a most size. Each writing task appends the
chunks it has not seen to a pack and keeps a recipe (an ordered list of chunk
digests) for every payload. Spark joins on the digests choose one copy of each
chunk among all packs; the packs are then rewritten without the other copies, in
rounds after each of which the packs it has read are deleted, so there is never a
second copy of them all.
Readers follow a pack's recipes in order, so most chunks are read where the
recipe is; every chunk and every payload is verified by its digest.

The stored form of a payload is its recipe (a fixed header, then digest and
length of each chunk) followed by the chunks as stored (zstd frames), which
depends on the payload alone. Packs are named for one attempt of one task and
only those of the committed tables are read.

A text's payload is its UTF-8 bytes and then bytes 255 up to a positive
multiple of ``unit``; null counts as empty. Null and repeated ids are passed
through, each row by itself. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, by_bytes, open_fs, texts

UNIT, TAIL = 576, 32
#: Least size of a chunk, bits that must be clear at a cut (mean size: least + 2^bits), most size.
LEAST, BITS, MOST = 512, 11, 16384
WINDOW = 32
LEVEL = 15
#: Rounds in which packs are rewritten.
ROUNDS = 4


def gear() -> np.ndarray:
    """A fixed random number for each byte value."""
    return np.frombuffer(hashlib.shake_128(b"gear").digest(1024), "<u4")


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the last 32 bytes at each place: sums of doubled windows."""
    h, width = gear()[data], 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)  # the right side is taken from h before the addition
        width *= 2
    return h


def cuts(payloads: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each payload. A window never reaches over a payload's start, for chunks are longer than it."""
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    marks = np.flatnonzero(rolling(joined) >> np.uint32(32 - BITS) == 0) + 1 if len(joined) else np.zeros(0, np.int64)
    out, base = [], 0
    for p in payloads:
        own = (marks[np.searchsorted(marks, base) : np.searchsorted(marks, base + len(p))] - base).tolist()
        ends, at = [], 0
        for m in [*own, len(p)]:
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST or m == len(p) and m > at:
                at = m
                ends.append(at)
        out.append(ends)
        base += len(p)
    return out


def payload(text: str) -> tuple[bytes, int]:
    """A text's payload and the size before padding."""
    data = text.encode()
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data)), len(data)


def recipe(size: int, digests: list[bytes], lengths: list[int]) -> bytes:
    return b"CDC1" + struct.pack("<QI", size, len(digests)) + b"".join(d + struct.pack("<I", n) for d, n in zip(digests, lengths))


RECIPES = "pack long, row long, doc_id long, n_bytes long, sha binary, digests array<binary>, lengths array<int>, added array<struct<k: int, at: long, size: int>>"
ADDED = pa.struct([("k", pa.int32()), ("at", pa.int64()), ("size", pa.int32())])
RECIPES_ARROW = pa.schema([("pack", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("added", pa.list_(ADDED))])


def new_pack() -> int:
    """A number for a pack of one attempt of one task; its file's name."""
    return uuid.uuid4().int >> 65


def store(docs: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Recipes of all payloads, and the chunks: ``digest, pack, at, size``, each digest once. Packs are files of the folder ``packs``."""
    raw, packs = work.folder("raw-packs"), work.folder("packs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = new_pack()
        press = zstandard.ZstdCompressor(level=LEVEL)
        seen: set[bytes] = set()
        at = row = 0
        fs, p = open_fs(f"{raw}/{pack}")
        with fs.open_output_stream(p, compression=None) as out:
            for batch in batches:
                for some in by_bytes(batch):
                    rows, bodies = [], [payload(t) for t in texts(some)]
                    for key, (data, n), ends in zip(some.column("doc_id").to_pylist(), bodies, cuts([b for b, _ in bodies])):
                        pieces = [data[a:b] for a, b in zip([0, *ends], ends)]
                        digests = [hashlib.blake2b(x, digest_size=20).digest() for x in pieces]
                        added = []
                        for k, (d, x) in enumerate(zip(digests, pieces)):
                            if d not in seen:
                                seen.add(d)
                                frame = press.compress(x)
                                out.write(frame)
                                added.append({"k": k, "at": at, "size": len(frame)})
                                at += len(frame)
                        rows.append({"pack": pack, "row": row, "doc_id": key, "n_bytes": n, "sha": hashlib.sha256(data).digest(), "digests": digests, "lengths": list(map(len, pieces)), "added": added})
                        row += 1
                    yield pa.RecordBatch.from_pylist(rows, RECIPES_ARROW)

    recipes = work.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RECIPES), "recipes")
    held = recipes.select("pack", "digests", F.explode("added").alias("c")).select(F.col("digests")[F.col("c.k")].alias("digest"), "pack", "c.at", "c.size")
    one = work.save(held.groupBy("digest").agg(F.min(F.struct("pack", "at", "size")).alias("c")).select("digest", "c.*"), "chosen")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = target = opened = None
        at = 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if r["pack"] != source:
                        for f in opened or ():
                            f.close()
                        source, target, at = r["pack"], new_pack(), 0
                        fs, p = open_fs(raw)
                        to, q = open_fs(packs)
                        opened = [fs.open_input_file(f"{p}/{source}"), to.open_output_stream(f"{q}/{target}", compression=None)]
                    opened[0].seek(r["at"])
                    opened[1].write(opened[0].read(r["size"]))
                    rows.append({"digest": r["digest"], "pack": target, "at": at, "size": r["size"]})
                    at += r["size"]
                yield pa.RecordBatch.from_pylist(rows, CHUNKS_ARROW)
        finally:
            for f in opened or ():
                f.close()

    rounds = []
    for k in range(ROUNDS):
        own = one.filter(F.pmod("pack", F.lit(ROUNDS)) == k)
        rounds.append(work.save(own.repartition("pack").sortWithinPartitions("pack", "at").mapInArrow(rewrite, CHUNKS), f"chunks-{k}"))
        fs, p = open_fs(raw)
        for f in fs.get_file_info(FileSelector(p)):
            if int(f.base_name) % ROUNDS == k:
                fs.delete_file(f.path)
    work.drop("raw-packs")
    work.drop("chosen")
    return recipes.drop("added"), reduce(DataFrame.unionAll, rounds)


CHUNKS = "digest binary, pack long, at long, size int"
CHUNKS_ARROW = pa.schema([("digest", pa.binary()), ("pack", pa.int64()), ("at", pa.int64()), ("size", pa.int32())])
MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, payload binary"
MEDIA_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("payload", pa.binary())])


def feature(data: bytes, chunks: int) -> str:
    """Chunks, mean sample in thousandths, and counts of samples in eight equal ranges."""
    ranges = np.bincount(np.frombuffer(data, np.uint8) >> 5, minlength=8)
    total = int(np.frombuffer(data, np.uint8).sum(dtype=np.int64))
    return f"{chunks}:{1000 * total // len(data)}:" + ",".join(map(str, ranges.tolist()))


def load(recipes: DataFrame, chunks: DataFrame, packs: str, with_payload: bool = True) -> DataFrame:
    """Payloads from their recipes and the packs of a folder, verified, with their features. Rows of one raw pack are read together, as most of their chunks lie together."""
    used = recipes.select(F.col("pack").alias("part"), F.explode("digests").alias("digest")).distinct()
    places = used.hint("merge").join(chunks, "digest").select("part", F.lit(-1).cast("long").alias("row"), "digest", "pack", "at", "size")
    rows = recipes.select(F.col("pack").alias("part"), "row", "doc_id", "n_bytes", "sha", "digests", "lengths")
    together = places.unionByName(rows, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, files = None, {}, {}
        unpack = zstandard.ZstdDecompressor()

        def stored(digest: bytes) -> bytes:
            pack, at, size = place[digest]
            if pack not in files:
                if len(files) >= 64:
                    files.pop(next(iter(files))).close()
                fs, p = open_fs(f"{packs}/{pack}")
                files[pack] = fs.open_input_file(p)
            files[pack].seek(at)
            return files[pack].read(size)

        for batch in batches:
            done, held = [], 0
            for r in batch.to_pylist():
                if r["part"] != part:
                    part, place = r["part"], {}
                if r["row"] < 0:
                    place[r["digest"]] = (r["pack"], r["at"], r["size"])
                    continue
                frames = [stored(d) for d in r["digests"]]
                pieces = [unpack.decompress(f) for f in frames]
                for d, x in zip(r["digests"], pieces):
                    if hashlib.blake2b(x, digest_size=20).digest() != d:
                        raise ValueError(f"a chunk of document {r['doc_id']} differs from its digest")
                data = b"".join(pieces)
                sha = hashlib.sha256(data)
                if sha.digest() != r["sha"]:
                    raise ValueError(f"the payload of document {r['doc_id']} differs from its digest")
                media = recipe(len(data), r["digests"], r["lengths"]) + b"".join(frames)
                done.append({"doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "payload_bytes": len(data), "payload_sha256": sha.hexdigest(), "tail_crc32": zlib.crc32(data[-TAIL:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(data, len(frames)), "payload": data if with_payload else None})
                held += len(data)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(done, MEDIA_ARROW)
                    done, held = [], 0
            yield pa.RecordBatch.from_pylist(done, MEDIA_ARROW)

    out = together.mapInArrow(run, MEDIA)
    return out if with_payload else out.drop("payload")


def media(docs: DataFrame, with_payload: bool = True) -> DataFrame:
    """Store the payloads of ``docs`` (doc_id, text) and read them back."""
    work = Workspace(docs.sparkSession, "media")
    return load(*store(docs, work), f"{work.path}/packs", with_payload)
