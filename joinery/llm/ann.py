"""Nearest neighbours by randomly rotated one-bit codes.

A vector is taken relative to its nearest centre, scaled to length one and
rotated by a random orthogonal matrix; the signs of the result are its code,
packed into 64-bit words. Two scalars go with it: its distance to the centre
and the inner product of its code with itself, which corrects the estimate.
The inner product of a query with a vector is estimated from the packed bits
(bit planes of the quantised query, counted with AND) and is off by more than
``BOUND / sqrt(dims - 1)`` times the code's own error only with tiny chance
(6e-5 at four deviations, both sides together). For ``k`` neighbours the ``4 k``
nearest by estimate are reranked with their original components, then every
vector whose lower bound does not exceed the k-th smallest distance found.

Vectors are dealt into blocks at random (by a fixed seed), so no repeated row
makes a block large, and every query is streamed past every block: the codes are
scanned in full, memory holds one block and one batch of queries, and only each
block's nearest leave it.

Vectors that are null, zero, of other than the common length, or hold null or
non-finite components take no part. Null ids take no part. Rows that repeat an id
are vectors of their own, each a query with its own ranks (equal vectors of one id
are one query), and none of them is a candidate of that id's queries. Ties go to
the smaller id. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the centres are fitted on, at most; number of centres; rows of a block, about.
SAMPLE, CENTRES, BLOCK = 16384, 16, 32768
#: Bits of a quantised query component; width of the error bound in standard deviations.
PLANES, BOUND = 8, 4.0


def valid(column: str = "embedding") -> Column:
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def centres(x: np.ndarray, k: int = CENTRES, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """k-means centres of the sample."""
    at = np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)
    c = x[at].copy()
    for _ in range(rounds):
        near = nearest_centre(x, c)
        for i in range(len(c)):
            if (own := near == i).any():
                c[i] = x[own].mean(axis=0)
    return c


def nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint64)


class Index:
    """Codes and correction scalars of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, c: np.ndarray, turn: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.c, self.turn = ids[order], vectors[order], c, turn
        self.centre = nearest_centre(self.vectors, c)
        off = self.vectors - c[self.centre]
        self.far = np.linalg.norm(off, axis=1)
        unit = off @ turn / np.maximum(self.far, 1e-300)[:, None]
        up = unit > 0
        dims = vectors.shape[1]
        self.code = packed(up)
        self.ones = up.sum(axis=1)
        self.own = np.where(self.far > 0, np.abs(unit).sum(axis=1) / np.sqrt(dims), 1.0)  # <code, vector>
        self.error = np.sqrt(np.maximum(0, 1 - self.own**2)) / self.own * BOUND / np.sqrt(max(1, dims - 1))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of a query from all vectors."""
        dims = len(q)
        low, high = np.empty(len(self.ids)), np.empty(len(self.ids))
        off = q - self.c
        length = np.linalg.norm(off, axis=1)
        turned = off @ self.turn / np.maximum(length, 1e-300)[:, None]
        base, top = turned.min(axis=1), turned.max(axis=1)
        step = np.maximum(top - base, 1e-12) / ((1 << PLANES) - 1)
        levels = np.rint((turned - base[:, None]) / step[:, None]).astype(np.int64)
        for i in range(len(self.c)):
            own = np.flatnonzero(self.centre == i)
            if not len(own):
                continue
            planes = packed((levels[i] >> np.arange(PLANES)[:, None] & 1).astype(bool))
            code = self.code[own]
            counted = sum((1 << b) * np.bitwise_count(code & planes[b]).sum(axis=1, dtype=np.int64) for b in range(PLANES))
            # <code, q> with code components of +-1 / sqrt(dims)
            dot = (2 * (base[i] * self.ones[own] + step[i] * counted) - (base[i] * dims + step[i] * levels[i].sum())) / np.sqrt(dims)
            estimate = dot / self.own[own]
            slack = self.error[own] + step[i] * np.sqrt(dims) / 2 / self.own[own]
            squares, cross = self.far[own] ** 2 + length[i] ** 2, 2 * self.far[own] * length[i]
            low[own], high[own] = squares - cross * (estimate + slack), squares - cross * (estimate - slack)
        return low, high

    def search(self, qid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest ids but the query's own, with exact distances, ties to smaller ids."""
        low, high = self.bounds(q)
        place = np.flatnonzero(self.ids != qid)
        if not len(place):
            return place, np.zeros(0)
        low, guess = low[place], low[place] + high[place]
        first = np.argpartition(guess, min(4 * k, len(place)) - 1)[: 4 * k]
        exact = np.full(len(place), np.inf)
        exact[first] = distances(self.vectors[place[first]], q)
        limit = np.partition(exact, min(k, len(place)) - 1)[min(k, len(place)) - 1]
        rest = np.flatnonzero((low <= limit**2 * (1 + 1e-9)) & np.isinf(exact))
        exact[rest] = distances(self.vectors[place[rest]], q)
        best = np.lexsort((self.ids[place], exact))[: min(k, len(place))]
        return self.ids[place[best]], exact[best]


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in order."""
    total = np.zeros(len(x))
    for column, value in zip(x.T, q):
        total += (column - value) ** 2
    return np.sqrt(total)


FOUND = "query_id long, mark long, vec_id long, score double"
FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("mark", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def fitted(drawn: DataFrame, dims: int) -> np.ndarray:
    """The centres, fitted by one task on the bounded sample ``drawn``; only they reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("vec_id").to_numpy(), matrix(b.column("embedding"))) for b in batches if b.num_rows]
        x = np.concatenate([v for _, v in held] or [np.zeros((0, dims))])
        x = x[np.lexsort((*x.T[::-1], np.concatenate([i for i, _ in held])))] if len(x) else x
        yield pa.RecordBatch.from_arrays([pa.array([(centres(x) if len(x) else np.zeros((1, dims))).tobytes()], pa.binary())], names=["centres"])

    got = drawn.coalesce(1).mapInArrow(run, "centres binary").first()
    return np.frombuffer(got["centres"]).reshape(-1, dims) if got else np.zeros((1, dims))


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest of ``vectors`` (vec_id, embedding) to each row that ``is_query`` names."""
    spark = vectors.sparkSession
    usable = vectors.filter(valid() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    sizes = usable.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims, rows = (sizes[0]["dims"], sizes[0]["count"]) if sizes else (1, 0)
    usable = usable.filter(F.size("embedding") == dims)
    place = F.xxhash64("vec_id").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    drawn = usable.filter(place <= min(1.0, SAMPLE / max(1, rows))).select("vec_id", "embedding").limit(SAMPLE)
    model = spark.sparkContext.broadcast((fitted(drawn, dims), rotation(dims)))  # CENTRES + dims rows
    blocks = max(1, -(-rows // BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, turn = model.value
        ids, held, index = [], [], None
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            if len(own := np.flatnonzero(~asks)):
                some = batch.take(pa.array(own))
                ids.append(some.column("vec_id").to_numpy())
                held.append(matrix(some.column("embedding")))
            if not len(own := np.flatnonzero(asks)):
                continue
            if index is None:
                index = Index(np.concatenate(ids), np.concatenate(held), c, turn) if ids else False
                ids, held = [], []
            if not index:
                continue
            some = batch.take(pa.array(own))
            out = [index.search(qid, q, k) for qid, q in zip(some.column("vec_id").to_pylist(), matrix(some.column("embedding")))]
            row = pa.array(np.repeat(np.arange(len(out)), [len(v) for v, _ in out]))
            yield pa.RecordBatch.from_arrays([some.column("vec_id").take(row), some.column("mark").take(row), pa.array(np.concatenate([v for v, _ in out]), pa.int64()), pa.array(np.concatenate([s for _, s in out]), pa.float64())], schema=FOUND_ARROW)

    mark = F.xxhash64("embedding").alias("mark")
    data = usable.select(F.floor(F.rand(5) * blocks).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", mark, "embedding")
    asking = usable.filter("asks").select("vec_id", mark, "embedding").dropDuplicates(["vec_id", "mark"])
    queries = asking.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "mark", "embedding")
    found = data.unionByName(queries).repartitionById(blocks, "block").sortWithinPartitions("block", "asks").select("asks", "vec_id", "mark", "embedding").mapInArrow(run, FOUND)
    best = Window.partitionBy("query_id", "mark").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
