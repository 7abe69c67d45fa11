"""Language ID by error-correcting output codes.

Each language has a codeword of bits. For every bit a logistic regression on
hashed byte n-grams says how likely it is set; the language whose codeword
costs the least logistic loss over all bits is chosen, so a few wrong bits are
corrected. The share of the best codeword against the others is the score; a
text whose second-best codeword comes close is flagged as ambiguous.

Up to seven languages get all different splits into two groups as bits; more
get random splits. The classifiers are fitted by one task on a bounded sample
with as many rows of each language as there are, up to its share; the driver
gets the model alone.

Texts that are null or have no letter (Unicode category L) are ``und`` with score
0, as are all texts when nothing is labelled. Rows with null ``lang`` are not
learned from. With a single language every text with a letter gets it. Null ids
are predicted, never learned from, and not held out. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes
from .quality import held_out, scored, scored_schema, with_row

BINS = 4096
#: Rows that the classifiers are fitted on, about; twice as many at most.
SAMPLE = 4000
LETTER = regex.compile(r"\p{L}")
#: A text is ambiguous when its best language's share is not above this.
CLEAR = 0.6
#: Values of ``lang`` up to which their rates are broadcast; beyond, they are joined by shuffle.
MOST_BROADCAST = 100_000
#: Texts whose vectors are made at a time.
ROWS = 512


def vectors(docs: list[str | None]) -> np.ndarray:
    """A row per text: square roots of the counts of its hashed 1-, 2- and 3-byte grams, of length one. Callers give ``ROWS`` texts at most."""
    out = np.zeros((len(docs), BINS), np.float32)
    group, size, first = [], 0, 0
    for i, t in enumerate([*docs, None]):
        if i == len(docs) or size > 1 << 18 or len(group) == ROWS // 4:
            data = np.frombuffer(b"".join(group), np.uint8).astype(np.uint32)
            if len(data) > 2:
                row = np.repeat(np.arange(len(group), dtype=np.int64), [len(g) for g in group])[:-2] * BINS
                one, two = data[:-2] * np.uint32(0x9E3779B1), data[1:-1] * np.uint32(0x85EBCA77)
                three = data[2:] * np.uint32(0xC2B2AE3D)
                ends = np.cumsum([len(g) for g in group])
                inside = np.ones(len(row), bool)
                for back in (1, 2):
                    inside[ends[ends - back < len(row)] - back] = False
                counts = np.zeros(len(group) * BINS, np.int64)
                for h in (one, one ^ (two >> np.uint32(1)), one ^ (two >> np.uint32(1)) ^ (three >> np.uint32(2))):
                    counts += np.bincount((row + (h * np.uint32(0x27D4EB2F) >> np.uint32(20)))[inside], minlength=len(counts))
                out[first : first + len(group)] = np.sqrt(counts.reshape(len(group), BINS))
            group, size, first = [], 0, i
        if i < len(docs):
            group.append(b"  " + (t or "").lower().encode() + b"  ")
            size += len(group[-1])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def code(languages: int, seed: int = 11) -> np.ndarray:
    """Codewords of +1 and -1, a row per language, no two columns the same split."""
    if languages <= 7:
        splits = range(1, 1 << max(0, languages - 1))
        return np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(languages)]).reshape(languages, -1)
    rng = np.random.default_rng(seed)
    tries = [rng.choice([-1, 1], (languages, int(15 * np.log2(languages)))) for _ in range(50 if languages <= 256 else 1)]
    return tries[0] if len(tries) == 1 else max(tries, key=lambda m: ((m[:, None] != m[None]).sum(axis=2) + m.shape[1] * np.eye(languages)).min())


def fit(x: np.ndarray, bits: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 40.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic regressions of all bits at once by accelerated gradient steps; the last row is the intercept. ``x`` are 16-bit shares of one, widened a block of rows at a time."""
    w = past = np.zeros((x.shape[1] + 1, bits.shape[1]), np.float32)
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    for k in range(steps):
        ahead = w + k / (k + 3) * (w - past)
        slope = np.zeros_like(ahead)
        for at in range(0, len(x), ROWS):
            own, said = x[at : at + ROWS].astype(np.float32) / np.float32(65535), bits[at : at + ROWS]
            margin = own @ ahead[:-1] + np.float32(0.1) * ahead[-1]
            error = (-said / (1 + np.exp(np.clip(said * margin, -30, 30))) * weight[at : at + ROWS]).astype(np.float32)
            slope[:-1] += own.T @ error
            slope[-1] += np.float32(0.1) * error.sum(axis=0)
        past, w = w, ahead - np.float32(rate) * (slope + np.float32(decay) * ahead)
    return w


def decode(margins: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best and second codeword of each row by logistic loss, and the best one's share."""
    loss = np.stack([np.logaddexp(0, -margins * w).sum(axis=1) for w in words], axis=1)
    order = np.argsort(loss, axis=1, kind="stable")
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return order[:, 0], order[:, min(1, len(words) - 1)], 1 / share.sum(axis=1)


LEARNED = "languages array<string>, weights binary"


def learned(docs: DataFrame, most: int) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """Languages, their codewords and the weights of the bits, fitted by one task on at most ``2 * most`` rows; None if no row is labelled."""
    own = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("lang", F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    languages = counts.count()
    rates = counts.select("lang", (F.lit(most / max(1, languages)) / F.col("rows")).alias("rate"))
    if languages <= MOST_BROADCAST:
        rates = F.broadcast(rates)
    place = (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                x = (vectors(some.column("text").to_pylist()) * 65535).astype("<u2")
                yield pa.RecordBatch.from_arrays([some.column("lang"), some.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "doc_id", "x"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        lang = [k for batch in held for k in batch.column("lang").to_pylist()]
        ids = [i for batch in held for i in batch.column("doc_id").to_pylist()]
        x = np.concatenate([np.frombuffer(b"".join(batch.column("x").to_pylist()), "<u2").reshape(-1, BINS) for batch in held] or [np.zeros((0, BINS), "<u2")])
        languages = sorted(set(lang))
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], lang[i], x[i].tobytes())), np.int64)
        y = np.searchsorted(languages, np.array(lang, dtype=object)[order]) if languages else np.zeros(0, np.int64)
        per = np.maximum(np.bincount(y, minlength=len(languages)), 1)
        w = fit(x[order], code(len(languages))[y].astype(np.float32), 1 / per[y]) if languages else np.zeros(0, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([languages], pa.list_(pa.string())), pa.array([w.astype("<f4").tobytes()], pa.binary())], names=["languages", "weights"])

    drawn = own.withColumn("place", place).join(rates, "lang").filter("place < rate").orderBy("place", "lang", F.xxhash64("text")).limit(2 * most)
    sample = drawn.select("lang", "doc_id", "text").mapInArrow(run, "lang string, doc_id long, x binary")
    got = sample.coalesce(1).mapInArrow(one, LEARNED).first()
    if not got or not got["languages"]:
        return None
    languages = list(got["languages"])
    return languages, code(len(languages)), np.frombuffer(got["weights"], "<f4").reshape(BINS + 1, -1)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with bounded bytes of text and at most ``ROWS`` rows, so that many short texts take no more memory than few long ones."""
    for some in by_bytes(batch, most=1 << 20):
        for at in range(0, some.num_rows, ROWS):
            yield some.slice(at, ROWS)


def identify(docs: DataFrame, most: int = SAMPLE, whole: bool = False) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, runner_up, ambiguous`` of every row of ``docs`` (doc_id, text, lang); with ``whole``, the row itself goes along as the struct ``row``."""
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, most))  # (BINS + 1) x bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                text = some.column("text").to_pylist()
                letters = np.array([bool(t and LETTER.search(t)) for t in text])
                n = len(text)
                if model.value is None:
                    best, second, score, languages = np.zeros(n, int), np.zeros(n, int), np.zeros(n), ["und"]
                else:
                    languages, words, w = model.value
                    best, second, score = decode(vectors(text) @ w[:-1] + np.float32(0.1) * w[-1], words)
                named = [languages[b] if x else "und" for b, x in zip(best, letters)]
                other = [languages[b] if x and len(languages) > 1 else None for b, x in zip(second, letters)]
                score = np.where(letters, score, 0.0)
                yield scored(some, {"lang_pred": pa.array(named, pa.string()), "score": pa.array(score, pa.float64()), "runner_up": pa.array(other, pa.string()), "ambiguous": pa.array(score <= CLEAR)})

    rows = with_row(docs, whole)
    return rows.mapInArrow(run, scored_schema(rows, "lang_pred string, score double, runner_up string, ambiguous boolean"))
