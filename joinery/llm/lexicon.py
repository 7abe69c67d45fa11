"""BPE encoding and decoding with a minimal acyclic transducer.

The words of all documents are counted; the most frequent are compiled into a
minimal acyclic automaton whose arcs carry numbers that add up to a word's
place in the lexicon, which points to the word's ids. Suffixes are shared: words
with the same rest share states. The automaton is one file of plain arrays that
every worker memory-maps. All words of a batch walk through it together, a byte
a step; words that fall out are merged exactly by the tokenizer's merge ranks.

The lexicon decides only how fast a word is encoded, never its ids. Ids equal
``Tokenizer.encode(text, add_special_tokens=False).ids`` of the library, and
decoding equals its ``decode(ids, skip_special_tokens=False)``.

Null texts count as empty and have no ids. Null and repeated ids of documents
are passed through, each row by itself. No rows give no rows; the lexicon may
be empty. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, by_bytes, mapped, put, ragged, texts
from .tokens import SpecialSplit, byte_letters, split_words

#: Words in the lexicon, and their bytes, at most.
WORDS, LONGEST = 1 << 16, 32


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        back = {c: b for b, c in enumerate(letters)}
        self.special = SpecialSplit(path)
        self.bytes = [b""] * self.special.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.ids.items():
            self.bytes[i] = token.encode()

    def ids(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of the lowest rank is merged, the leftmost first, until no pair has a rank."""
        ids = [self.first[b] for b in word]
        if len(ids) > 256:
            return self.long(ids)
        rank, never = self.rank.get, len(self.made)
        ranks = [rank(p, never) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < never:
            at = ranks.index(best)
            ids[at : at + 2] = [self.made[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), never)
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), never)
        return ids

    def long(self, ids: list[int]) -> list[int]:
        """The same for a long word, with a heap of pairs and links between neighbours."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(ids) and (p := (ids[i], ids[after[i]])) in self.rank:
                heapq.heappush(heap, (self.rank[p], i, p))

        while heap:
            r, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[r], -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [x for x in ids if x >= 0]


def minimal(words: list[bytes]) -> list[tuple[bool, tuple[tuple[int, int], ...]]]:
    """States of the minimal acyclic automaton of sorted words, each (final, arcs of (byte, state)); targets come first and the start is last."""
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    known: dict[tuple, int] = {}
    path: list[list] = [[False, []]]  # states of the last word that can still grow
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            state = (final, tuple(arcs))
            if (at := known.get(state)) is None:
                at = known[state] = len(states)
                states.append(state)
            path[-1][1].append((last[len(path) - 1], at))

    for w in words:
        same = next((i for i, (a, b) in enumerate(zip(w, last)) if a != b), min(len(w), len(last)))
        close(same)
        path += [[False, []] for _ in range(len(w) - same)]
        path[-1][0] = True
        last = w
    close(0)
    states.append((path[0][0], tuple(path[0][1])))
    return states


class Automaton:
    """The transducer as arrays. State s and byte c lead to slot base[s] + c, which is theirs if ``owner`` there is s; words that end in the state are counted in ``final``."""

    FIELDS = (("base", "<i4"), ("final", "<i4"), ("owner", "<i4"), ("target", "<i4"), ("number", "<i4"), ("place", "<i4"), ("ids", "<u4"))

    def __init__(self, data: np.ndarray):
        sizes = data[: 8 * len(self.FIELDS)].view("<u8").astype(int)
        at = 8 * len(self.FIELDS)
        for (name, kind), n in zip(self.FIELDS, sizes):
            setattr(self, name, data[at : at + 4 * n].view(kind))
            at += 4 * n

    @classmethod
    def build(cls, lexicon: dict[bytes, list[int]]) -> bytes:
        words = sorted(lexicon)
        states = minimal(words)
        below = np.zeros(len(states), np.int64)  # words that end in or after a state
        for s, (final, arcs) in enumerate(states):
            below[s] = final + sum(below[t] for _, t in arcs)
        base, used, free = np.zeros(len(states), "<i4"), bytearray(1024), 256  # the lowest slot that any byte can take
        slots: list[tuple[int, int, int, int]] = []
        last: dict[int, int] = {}  # where a state with so many arcs was put: the places before are too full for the next
        for s in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
            arcs = states[s][1]
            if not arcs:
                continue
            low = arcs[0][0]
            b = max(free - low, last.get(len(arcs), 0) if len(arcs) > 1 else 0)
            while True:
                if len(used) < b + 512:
                    used.extend(bytes(len(used)))
                if not any(used[b + c] for c, _ in arcs):
                    break
                b += 1
            base[s] = last[len(arcs)] = b
            number = int(states[s][0])
            for c, t in arcs:
                used[b + c] = 1
                slots.append((b + c, s, t, number))
                number += int(below[t])
            while used[free]:
                free += 1
                if free >= len(used):
                    used.extend(bytes(len(used)))
        n = len(used) + 256
        owner, target, count = np.full(n, -1, "<i4"), np.zeros(n, "<i4"), np.zeros(n, "<i4")
        for at, s, t, number in slots:
            owner[at], target[at], count[at] = s, t, number
        each = [lexicon[w] for w in words]
        place = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype("<i4") if each else np.zeros(1, "<i4")
        ids = np.array([i for x in each for i in x], "<u4")
        fields = (base, np.array([f for f, _ in states], "<i4"), owner, target, count, place, ids)
        return np.array([len(x) for x in fields], "<u8").tobytes() + b"".join(x.tobytes() for x in fields)

    def find(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each word's place in the sorted lexicon, or -1."""
        found = np.full(len(start), -1, np.int64)
        at = np.flatnonzero(length <= LONGEST)
        begin, left = start[at], length[at]
        state = np.full(len(at), len(self.base) - 1, np.int32)
        number = np.zeros(len(at), np.int32)
        k = 0
        while len(at):
            over = left == k
            if over.any():
                done = over & (self.final[state] > 0)
                found[at[done]] = number[done]
                on = ~over
                at, begin, left, state, number = at[on], begin[on], left[on], state[on], number[on]
            slot = self.base[state] + data[begin + k]
            own = self.owner[slot] == state
            if not own.all():
                at, begin, left, number, slot = at[own], begin[own], left[own], number[own], slot[own]
            state, number = self.target[slot], number + self.number[slot]
            k += 1
        return found


class Codec:
    """Encodes and decodes batches with a transducer file."""

    def __init__(self, tokenizer: str, automaton: str, cache_words: int = 200_000):
        self.merges = Merges(tokenizer)
        self.automaton = Automaton(mapped(automaton))
        self.cache: dict[bytes, list[int]] = {}
        self.cache_words = cache_words
        self.decimal = [str(i).encode() for i in range(len(self.merges.bytes))]

    def unseen(self, word: bytes) -> list[int]:
        ids = self.cache.get(word)
        if ids is None:
            ids = self.merges.ids(word)
            if len(word) <= 64:
                if len(self.cache) >= self.cache_words:
                    self.cache.clear()
                self.cache[word] = ids
        return ids

    def encode(self, docs: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not docs:
            return []
        segments, between = self.merges.special(docs)
        data, at, closing = split_words(segments)
        start, length = at[:-1], np.diff(at)
        flat = np.frombuffer(data, np.uint8)
        place = self.automaton.find(flat, start, length)
        closes = np.zeros(len(start), bool)
        closes[closing] = True
        known = (place >= 0) & ~closes
        count = np.zeros(len(start), np.int64)
        of = self.automaton.place
        count[known] = of[place[known] + 1] - of[place[known]]
        lost = np.flatnonzero(~known & ~closes)
        own = [self.unseen(data[a:b]) for a, b in zip(start[lost].tolist(), (start[lost] + length[lost]).tolist())]
        count[lost] = [len(x) for x in own]
        added = [[*x, None] for x in between]  # the id that follows each segment
        count[closing] = [i is not None for x in added for i in x]
        ends = np.cumsum(count)
        ids = np.empty(int(ends[-1]), np.uint32)
        ids[ragged((ends - count)[known], count[known])] = self.automaton.ids[ragged(of[place[known]].astype(np.int64), count[known])]
        if len(lost):
            ids[ragged((ends - count)[lost], count[lost])] = [i for x in own for i in x]
        ids[ends[closing[count[closing] > 0]] - 1] = [i for x in between for i in x]
        last = np.cumsum([len(x) for x in added]) - 1
        return np.split(ids, ends[closing[last]][:-1])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.merges.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def joined(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return b",".join(map(self.decimal.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def codec(tokenizer: str, automaton: str) -> Codec:
    return Codec(tokenizer, automaton)


def count_words(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``word, n`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = SpecialSplit(tokenizer)
        counts: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for some in by_bytes(batch):
                data, at, closing = split_words(special(texts(some))[0])
                short = np.diff(at) <= LONGEST
                short[closing] = False
                counts.update(data[a:b] for a, b in zip(at[:-1][short].tolist(), at[1:][short].tolist()))
                if len(counts) > 400_000:
                    yield told()
        yield told()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, tokenizer: str, work: Workspace, words: int = WORDS) -> str:
    """The transducer file of the most frequent words of ``docs``, at most ``words``; its path.

    The least count is found from how many words have each count, so that only the chosen words reach the driver; of the words with that count, the first in byte order are taken.
    """
    counts = work.save(count_words(docs, tokenizer), "counts")
    classes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("c"))  # no more rows than the root of twice the corpus
    upward = classes.withColumn("total", F.sum("c").over(Window.orderBy(F.desc("n"))))
    edge = upward.filter(F.col("total") >= words).orderBy(F.desc("n")).limit(1).collect()
    if edge:
        least, rest = edge[0]["n"], words - (edge[0]["total"] - edge[0]["c"])
        chosen = counts.filter(F.col("n") > least).select("word").unionAll(counts.filter(F.col("n") == least).select("word").orderBy("word").limit(rest))
    else:
        chosen = counts.select("word")
    frequent = [bytes(r.word) for r in chosen.collect()]
    merges = Merges(tokenizer)
    path = f"{work.folder('lexicon')}/automaton.bin"
    put(path, Automaton.build({w: merges.ids(w) for w in frequent}))
    return path


def encode(docs: DataFrame, tokenizer: str, words: int = WORDS, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, ``with_ids``, ``ids`` and ``decoded`` of every row of ``docs`` (doc_id, text)."""
    path = compile_lexicon(docs, tokenizer, Workspace(docs.sparkSession, "lexicon"), words)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, path)
        for batch in batches:
            for some in by_bytes(batch, most=2 << 20):
                ids = own.encode(texts(some))
                text = [own.decode(x) for x in ids]
                columns = [
                    some.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(own.joined(x)).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text], pa.string()),
                ]
                if with_ids:
                    columns += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(text, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)
