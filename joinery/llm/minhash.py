"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

A document's set is its distinct five-word shingles. Its SuperMinHash signature
takes, for each shingle, a random permutation of the signature's places with
increasing ranks; a place keeps the least rank seen. Ranks of one shingle are
spread over different places, so the signature varies less than independent
minima, and a document stops as soon as every place holds less than the next
rank. Signatures are cut into bands; documents that agree on a band meet.

Equal sets count once: each set has a number, and the row with the smallest id
stands for it by that id and a hash of its text, for an id can stand on rows with
different texts. Each bucket has a centre, the first of its members by one of a
few orders that hold for all buckets, so that the many buckets of one group have
few centres. Pairs of a member with a centre whose signatures agree far too
little are dropped. A member is first compared with the centre that
agrees with it most and the one after. Where the links found leave a bucket with
more than one component, the members outside the centre's component go past all
others in blocks that hold their whole sets, which are compared by an inverted
index; of the links, the best with each component leaves the block, and pairs
with a document too long for a block leave it to be verified. So no bucket is
capped and none is expanded into pairs, yet each pair of a bucket is linked,
refuted, or already in one component. Links are confirmed on the full sets of
64-bit shingle hashes; only the texts of members of a bucket move for that.

With 40 bands of 5 rows a pair at the threshold of 0.75 meets with a chance of
at least 1 - (1 - 0.75^5)^40 = 0.99998.

Null and empty texts, or texts of white space, have an empty set and are linked
with nothing. Rows that share a ``doc_id`` count as linked if they have words, and
join the components of their texts; ``copies`` judges each text by itself. A
null ``doc_id`` has a null component, is kept and links with nothing. No rows
give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, by_bytes, ragged, texts
from .components import components

WORDS, PLACES, ROWS = 5, 200, 5
#: Share of equal signature places under which a pair is dropped: five standard deviations under the threshold.
LEAST_AGREEMENT = 0.75 - 5 * (0.75 * 0.25 / PLACES) ** 0.5
#: Shingles up to which a document's whole set is compared in a block; longer ones are compared there by signature.
WHOLE = 2048
#: Members of a block of one bucket, and documents compared with one that stand together.
BLOCK = 1024
#: Orders by which centres are picked; a bucket's key says which is used.
ORDERS = 3
#: Centres that a document is compared with first.
FIRST = 2
RANK = 56
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(docs: list[str], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text."""
    words = [t.encode().lower().split() for t in docs]
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for own in words for w in own]
    if not flat:
        return [np.zeros(0, np.uint64) for _ in docs]
    each = pd.util.hash_array(np.array(flat, dtype=object), categorize=False)
    del flat, words

    def joined(first: np.ndarray, count: int) -> np.ndarray:
        h = np.full(len(first), count, np.uint64) * GOLDEN
        for j in range(count):
            h = mix((h ^ each[first + j]) + GOLDEN)
        return h

    h = joined(np.arange(max(0, len(each) - k + 1)), k)
    ends = np.cumsum(n).tolist()
    out = []
    for size, end in zip(n.tolist(), ends):
        if size >= k:
            out.append(np.unique(h[end - size : end - k + 1]))
        else:
            out.append(joined(np.array([end - size]), size) if size else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash signatures, a row per set: the step in the top bits, the random rank of that step below. Empty sets keep the largest value."""
    sig = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    if not sets:
        return sig
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = sig.reshape(-1)
    swaps: list[np.ndarray] = []
    order, steps = None, np.arange(1, places + 1, dtype=np.uint64) * GOLDEN
    for j in range(places):
        if not len(h):
            break
        x = mix(h + steps[j])
        k = (j + ((mix(x ^ GOLDEN) >> np.uint64(32)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)).astype(np.uint8)
        if j == 8:  # few shingles are left: hold their permutations
            order = np.tile(np.arange(places, dtype=np.uint8), (len(h), 1))
            row = np.arange(len(h))
            for i, s in enumerate(swaps):
                order[row, s] = order[:, i]  # place i itself is not read again
        if order is None:
            at = k
            for i in range(j - 1, -1, -1):
                at = np.where(swaps[i] == at, np.uint8(i), at)
            swaps.append(k)
        else:
            row = np.arange(len(h))
            at = order[row, k]
            order[row, k] = order[:, j]
        np.minimum.at(flat, doc * places + at, (np.uint64(j) << np.uint64(RANK)) | (x >> np.uint64(64 - RANK)))
        left = (sig.max(axis=1) >> np.uint64(RANK) > j)[doc]
        if not left.all():
            h, doc, swaps = h[left], doc[left], [s[left] for s in swaps]
            order = None if order is None else order[left]
    return sig


SKETCH = "doc_id long, mark long, n_shingles long, digest binary, agree binary, bands array<long>"
SKETCH_ARROW = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("agree", pa.binary()), ("bands", pa.list_(pa.int64()))])


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: size and digest of its set, a byte per signature place, a key per band; null where the set is empty."""
    for batch in batches:
        for some in by_bytes(batch, most=2 << 20):
            sets = shingle_sets(texts(some))
            sig = signatures(sets)
            bands = np.full((len(sets), PLACES // ROWS), 0, np.uint64) + np.arange(PLACES // ROWS, dtype=np.uint64) * GOLDEN
            for r in range(ROWS):
                bands = mix((bands ^ sig[:, r::ROWS]) + GOLDEN)
            agree = (mix(sig) >> np.uint64(56)).astype(np.uint8)
            full = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("doc_id"),
                    some.column("mark"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s, digest_size=16).digest() if f else None for s, f in zip(sets, full)], pa.binary()),
                    pa.array([a.tobytes() if f else None for a, f in zip(agree, full)], pa.binary()),
                    pa.array([b if f else None for b, f in zip(bands.view(np.int64), full)], pa.list_(pa.int64())),
                ],
                schema=SKETCH_ARROW,
            )


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def pairs_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=PAIR)


def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures agree often enough, and in how many places."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in ("x", "y"))
        same = (x == y).sum(axis=1)
        keep = same >= LEAST_AGREEMENT * PLACES
        kept = batch.select(["a", "b", "most"]).filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(same[keep], pa.int32())], names=["a", "b", "most", "same"])


OPEN_SET = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("agree", pa.binary()), ("hashes", pa.binary())])


def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and sorted shingle hashes of each document, null for long documents; the signature only of those that are long or can link with a long one."""
    for batch in batches:
        for some in by_bytes(batch):
            sets = shingle_sets(texts(some))
            agree = [a if 4 * len(s) >= 3 * WHOLE else None for a, s in zip(some.column("agree").to_pylist(), sets)]
            held = [s.tobytes() if len(s) <= WHOLE else None for s in sets]
            yield pa.RecordBatch.from_arrays([some.column("doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array(agree, pa.binary()), pa.array(held, pa.binary())], schema=OPEN_SET)


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])


class Block:
    """Residents of a block of one bucket, with an inverted index of their hashes."""

    def __init__(self, rows: list[dict]):
        self.doc, self.n, self.component = (np.array([r[c] for r in rows]) for c in ("doc", "n", "component"))
        self.agree = np.frombuffer(b"".join(r["agree"] or bytes(PLACES) for r in rows), np.uint8).reshape(-1, PLACES)
        self.whole = np.array([r["hashes"] is not None for r in rows])
        sets = [np.frombuffer(r["hashes"] or b"", np.uint64) for r in rows]
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(rows)), [len(s) for s in sets])[order]
        self.hash, self.first = np.unique(every[order], return_index=True)
        self.last = np.append(self.first[1:], len(every))

    def matches(self, v: dict) -> tuple[np.ndarray, int]:
        """Residents in other components than a visitor: those of its links by whole sets that are the best in their component, how many they are, and then those whose signatures agree, where one of the two is long."""
        fits = (self.component != v["component"]) & (4 * np.minimum(self.n, v["n"]) >= 3 * np.maximum(self.n, v["n"]))
        if not fits.any():
            return np.zeros(0, np.int64), 0
        by_hash = fits & self.whole if v["hashes"] is not None else np.zeros(len(fits), bool)
        long = np.flatnonzero(fits & ~by_hash)
        if len(long):
            long = long[(self.agree[long] == np.frombuffer(v["agree"], np.uint8)).mean(axis=1) >= LEAST_AGREEMENT]
        if not by_hash.any():
            return long, 0
        own = np.frombuffer(v["hashes"], np.uint64)
        at = np.minimum(np.searchsorted(self.hash, own), len(self.hash) - 1)
        at = at[self.hash[at] == own]
        both = np.bincount(self.owner[ragged(self.first[at], self.last[at] - self.first[at])], minlength=len(fits))
        best = np.flatnonzero(by_hash & (both > 0) & (100 * both >= 75 * (self.n + v["n"] - both)))
        best = best[np.lexsort((self.doc[best], -both[best] / (self.n[best] + v["n"] - both[best])))]
        best = best[np.unique(self.component[best], return_index=True)[1]]
        return np.concatenate([best, long]), len(best)


def blockwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each block's residents with its visitors (``sure``), and pairs with long documents to verify. Residents come first."""
    block, resident, index = None, [], None
    for batch in batches:
        for some in by_bytes(batch, "hashes"):
            a, b, sure = [], [], []
            for row in some.to_pylist():
                if (row["key"], row["block"]) != block:
                    block, resident, index = (row["key"], row["block"]), [], None
                if not row["visits"]:
                    resident.append(row)
                    continue
                if index is None and resident:
                    index = Block(resident)
                if index:
                    at, links = index.matches(row)
                    found = index.doc[at]
                    a.append(np.minimum(found, row["doc"]))
                    b.append(np.maximum(found, row["doc"]))
                    sure.append(np.arange(len(at)) < links)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64()), pa.array(np.concatenate(sure))], schema=FOUND)


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (owner, salt, kind, doc, text) in that order: an owner's own text, then those to compare with it."""
    of, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        for some in by_bytes(batch):
            sets = shingle_sets(texts(some))
            a, b = [], []
            owner, salt, kind, doc = (some.column(c).to_pylist() for c in ("owner", "salt", "kind", "doc"))
            for i, s in enumerate(sets):
                if kind[i] == 0:
                    of, own = (owner[i], salt[i]), s
                elif of == (owner[i], salt[i]):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if both and 100 * both >= 75 * (len(own) + len(s) - both):
                        a.append(owner[i])
                        b.append(doc[i])
            yield pairs_of(np.array(a, np.int64), np.array(b, np.int64))


def verified(pairs: DataFrame, members: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that are links on the full sets of the texts in ``members`` (doc, text). Those with one ``a`` are dealt over as many keys as they have blocks."""
    many = work.save(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("salts")).filter("salts > 1"), f"{name}-hot")
    dealt = pairs.join(many, "a", "left").select(F.col("a").alias("owner"), F.expr("pmod(xxhash64(b), coalesce(salts, 1L))").alias("salt"), F.col("b").alias("doc"))
    own = dealt.select("owner", "salt", F.col("owner").alias("doc")).distinct()
    wanted = dealt.withColumn("kind", F.lit(1)).unionByName(own.withColumn("kind", F.lit(0)))
    with_text = wanted.hint("merge").join(members, "doc").select("owner", "salt", "kind", "doc", "text")
    dealt_out = with_text.repartition("owner", "salt").sortWithinPartitions("owner", "salt", "kind")
    return work.save(dealt_out.mapInArrow(confirmed, "a long, b long"), name)


def apart(work: Workspace, members: DataFrame, group: DataFrame, signature: DataFrame, texts_of: DataFrame) -> DataFrame:
    """Pairs (a, b, sure) of members of one bucket that are in different components: links, and pairs to verify (see ``Block``)."""
    known = members.filter("members > 2").hint("merge").join(group.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    known = work.save(known, "known")
    mixed = work.save(known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key"), "mixed")
    blocks = F.expr(f"(members + {BLOCK - 1}) div {BLOCK}")
    leads = F.coalesce("leading", "center") == F.col("component")
    rows = known.join(mixed, "key").join(group.toDF("center", "leading"), "center", "left").select("key", "doc", "component", blocks.alias("blocks"), leads.alias("leads"))
    rows = work.save(rows, "open")
    wanted = rows.select("doc").distinct().hint("merge").join(texts_of, "doc").hint("merge").join(signature, "doc")
    sets = work.save(wanted.select("doc", "agree", "text").mapInArrow(whole_sets, "doc long, n long, agree binary, hashes binary"), "open-sets")
    home = F.expr("array(struct(pmod(xxhash64(doc), blocks) as block, false as visits))")
    visits = F.expr("transform(sequence(0L, blocks - 1), x -> struct(x as block, true as visits))")
    placed = rows.select("key", "doc", "component", F.explode(F.when(F.col("leads"), home).otherwise(F.concat(home, visits))).alias("at")).select("key", "at.*", "doc", "component")
    return placed.hint("merge").join(sets, "doc").repartition("key", "block").sortWithinPartitions("key", "block", "visits").mapInArrow(blockwise, "a long, b long, sure boolean").distinct()


def grouped(docs: DataFrame, work: Workspace) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id``, ``mark`` (hash of the text), ``n_shingles`` and ``first``, the smallest id of the texts linked with its own; null without words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    sketch = work.save(docs.mapInArrow(sketches, SKETCH), "sketch")
    solid = sketch.filter("doc_id is not null and digest is not null")
    least = solid.groupBy("digest").agg(F.min(F.struct("doc_id", "mark", F.col("n_shingles").alias("n"), "agree", "bands")).alias("r")).sortWithinPartitions("digest")
    reps = work.save(least.select("digest", F.monotonically_increasing_id().alias("doc"), "r.*"), "reps")
    signature, places = reps.select("doc", "agree"), reps.select("doc", "doc_id", "mark")

    # tables are written where a join follows an aggregate by its key, so that adaptive execution can split hot keys
    rows = reps.select("doc", "n", F.explode("bands").alias("key"))
    picked = F.struct(F.xxhash64(F.pmod("key", F.lit(ORDERS)), "doc").alias("h"), "doc", "n")
    buckets = work.save(rows.groupBy("key").agg(F.min(picked).alias("c"), F.count(F.lit(1)).alias("members")).filter("members > 1"), "buckets")
    members = work.save(rows.hint("merge").join(buckets, "key").select("key", "doc", "n", F.col("c.doc").alias("center"), F.col("c.n").alias("center_n"), "members"), "members")
    places_in = members.select("doc").distinct().hint("merge").join(places, "doc")
    texts_of = work.save(places_in.hint("merge").join(docs, ["doc_id", "mark"]).dropDuplicates(["doc"]).select("doc", "text"), "texts")

    fits = "doc <> center and 4 * least(n, center_n) >= 3 * greatest(n, center_n)"
    pairs = members.filter(fits).groupBy("center", "doc").agg(F.max("members").alias("most"))
    both = pairs.hint("merge").join(signature.toDF("center", "x"), "center").hint("merge").join(signature.toDF("doc", "y"), "doc")
    candidates = both.select(F.col("center").alias("a"), F.col("doc").alias("b"), "most", "x", "y").mapInArrow(agreeing, "a long, b long, most long, same int")
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("same"), "a"))  # of a row per band at most
    ranked = work.save(candidates.select("a", "b", "most", place.alias("place")), "candidates")
    links = verified(ranked.filter(F.col("place") <= FIRST).select("a", "b"), texts_of, work, "links")
    group = work.save(components(links, work, "first"), "first")
    found = work.save(apart(work, members, group, signature, texts_of), "apart")
    # of the other pairs, those that have a bucket alone are in no block
    alone = ranked.filter((F.col("place") > FIRST) & (F.col("most") == 2)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    unsure = work.save(alone.unionByName(found.filter("not sure").drop("sure")).distinct(), "unsure")
    links = group.filter("node <> component").toDF("a", "b").unionByName(found.filter("sure").drop("sure")).unionByName(verified(unsure, texts_of, work, "more-links"))
    group = work.save(components(links, work, "all"), "groups")

    named = group.withColumnRenamed("node", "doc").hint("merge").join(places, "doc")
    first = work.save(named.groupBy("component").agg(F.min("doc_id").alias("first")), "firsts")
    by_doc = group.hint("merge").join(first, "component").select(F.col("node").alias("doc"), "first")
    by_set = reps.select("digest", "doc", "doc_id").join(by_doc, "doc", "left").select("digest", F.coalesce("first", "doc_id").alias("first"))
    # rows without a set have keys of their own, longer than digests
    keyed = sketch.select("doc_id", "mark", "n_shingles", F.coalesce("digest", F.encode(F.lpad(F.xxhash64("doc_id", "mark").cast("string"), 24, " "), "UTF-8")).alias("digest"))
    out = work.save(keyed.join(by_set, "digest", "left").drop("digest"), "rows")
    work.drop_but("rows")
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` (smallest linked id) and ``kept`` (it is the document's own) of ``docs`` (doc_id, text)."""
    work = Workspace(docs.sparkSession, "minhash")
    rows = grouped(docs, work)
    spread = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("first").alias("low"), F.max("first").alias("high")).filter("low < high").select("doc_id")
    shared = work.save(rows.join(spread, "doc_id").filter("first is not null").select("doc_id", "first").distinct(), "shared-ids")
    if shared.isEmpty():
        linked = F.col("first")
    else:
        rows = rows.join(components(shared, work, "ids").toDF("first", "across"), "first", "left")
        linked = F.coalesce("across", "first")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(linked, "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def copies(docs: DataFrame) -> DataFrame:
    """``copy_id, copy_mark`` (xxhash64 of the text) of the rows of ``docs`` (doc_id, text) whose text is linked with one under a smaller id."""
    rows = grouped(docs, Workspace(docs.sparkSession, "minhash"))
    return rows.filter("first < doc_id").select(F.col("doc_id").alias("copy_id"), F.col("mark").alias("copy_mark")).distinct()
