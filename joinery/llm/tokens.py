"""Token ids of whole texts by the ``tokenizers`` library, word by word.

The library encodes a byte-level BPE text by splitting it into words and merging
each word alone, so the ids of a text are the ids of its words end to end. The
split is done here over whole batches with array operations, as is the search for
the words in a bounded table of those that the library has encoded before; the
library encodes each other word once. The ids
equal ``Tokenizer.encode(text, add_special_tokens=False)``: the strings of the
tokenizer's added tokens become their ids as they do there.
"""

from __future__ import annotations

import functools
import json

import numpy as np

from .common import ragged

LETTER, NUMBER, SPACE, END, UNKNOWN = 1, 2, 3, 4, 255


#: Code points whose classes are asked for at once.
PAGE = 256


@functools.cache
def class_table() -> np.ndarray:
    """Class of each code point as far as texts have needed it, else ``UNKNOWN``."""
    return np.full(0x110000, UNKNOWN, np.uint8)


def char_classes(points: np.ndarray) -> np.ndarray:
    """Class of each code point (0 other), asked of the library's own regular expressions a page of code points at a time, when a text first has one of them."""
    table = class_table()
    kind = table[points]
    new = np.flatnonzero(kind == UNKNOWN)
    if len(new):
        pages = np.flatnonzero(np.bincount(points[new] // PAGE))
        ask_classes((pages[:, None] * PAGE + np.arange(PAGE)).ravel(), table)
        kind[new] = table[points[new]]
    return kind


def ask_classes(points: np.ndarray, table: np.ndarray) -> None:
    from tokenizers import Regex, pre_tokenizers

    table[points] = 0
    points = points[(points < 0xD800) | (points > 0xDFFF)]  # surrogates are in no text
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        cut = pre_tokenizers.Split(Regex(f"[^{pattern[:-1]}]+"), "removed").pre_tokenize_str(text)
        for _, (a, b) in cut:
            table[points[a:b]] = kind


def word_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the first code points of words. ``ends`` are positions of text ends, one code point each, words of their own.

    The words are those of the byte-level pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|S+(?!not S)|S+``.
    """
    kind = char_classes(points)
    kind[ends] = END
    start = np.empty(len(kind), bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[ends] = True
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
    start[last] = True  # the last white space before a word is left to that word or stands alone
    start[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero((points[:-1] == 0x27) & (kind[1:] == LETTER) & start[:-1])
    if len(quote):
        one = points[quote + 1]
        two = points[np.minimum(quote + 2, len(points) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long] + 3] = True
    return start


def split_words(segments: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 bytes of the segments, each closed by a zero byte; byte positions of words (with one for the end of all); index of each closing word."""
    joined = "\0".join(segments) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)) + 1) - 1
    start = word_starts(points, ends)
    at = np.flatnonzero(start)
    closing = np.searchsorted(at, ends)
    data = joined.encode()
    if len(data) != len(points):
        size = np.ones(len(points), np.int64) + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        at = (np.cumsum(size) - size)[at]
    return data, np.append(at, len(data)), closing


@functools.cache
def byte_letters() -> str:
    """Letter of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100 in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in own else next(rest)) for b in range(256))


class SpecialSplit:
    """Cuts texts at the strings of added tokens, as the library does before it splits words."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*spec["model"]["vocab"].values(), *self.ids.values()]) + 1
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.ids, key=len, reverse=True))) + ")") if self.ids else None

    def __call__(self, texts: list[str]) -> tuple[list[str], list[list[int]]]:
        """Segments of all texts in order, and for each text the added ids between its segments."""
        segments: list[str] = []
        between: list[list[int]] = []
        for t in texts:
            parts = self.cut.split(t) if self.cut and any(s in t for s in self.ids) else [t]
            segments += parts[::2]
            between.append([self.ids[s] for s in parts[1::2]])
        return segments, between


#: Bytes of the words that a table holds; longer words are encoded anew.
SHORT = 16
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class WordTable:
    """Places and numbers of ids of words of at most ``SHORT`` bytes, by open addressing in arrays. A word is its own key, two 64-bit numbers and its length, so what is found is exact."""

    def __init__(self, bits: int):
        n = 1 << bits
        self.bits, self.words = bits, 0
        self.low, self.high, self.size = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint8)
        self.at, self.count = np.zeros(n, np.int64), np.zeros(n, np.uint8)

    @staticmethod
    def keys(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes as numbers; ``data`` goes on for ``SHORT`` bytes after the last word."""
        eight = np.ndarray(len(data) - 7, "<u8", buffer=data, strides=(1,))
        low = eight[start] & MASKS[np.minimum(length, 8)]
        high = np.zeros(len(start), np.uint64)
        more = np.flatnonzero(length > 8)
        high[more] = eight[start[more] + 8] & MASKS[length[more] - 8]
        return low, high

    def slots(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        h = (low ^ length.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = ((h ^ (h >> np.uint64(29))) + high) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each word's slot, or -1."""
        slot = self.slots(low, high, length)
        same = (self.low[slot] == low) & (self.high[slot] == high) & (self.size[slot] == length)
        found = np.where(same, slot, -1)
        on = np.flatnonzero(~same & (self.size[slot] > 0))
        slot = slot[on]
        while len(on):
            slot = (slot + 1) & (len(self.low) - 1)
            same = (self.low[slot] == low[on]) & (self.high[slot] == high[on]) & (self.size[slot] == length[on])
            found[on[same]] = slot[same]
            left = ~same & (self.size[slot] > 0)
            on, slot = on[left], slot[left]
        return found

    def add(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take in words that are not there, maybe more than once: the slot of each, and which are the first of their kind."""
        out, first = np.empty(len(low), np.int64), np.zeros(len(low), bool)
        on, slot = np.arange(len(low)), self.slots(low, high, length)
        while len(on):
            free = np.flatnonzero(self.size[slot] == 0)
            self.at[slot[free]] = on[free]  # of the words that want a slot, one stays
            free = free[self.at[slot[free]] == on[free]]
            to, new = slot[free], on[free]
            self.low[to], self.high[to], self.size[to] = low[new], high[new], length[new]
            first[new] = True
            same = (self.low[slot] == low[on]) & (self.high[slot] == high[on]) & (self.size[slot] == length[on])
            out[on[same]] = slot[same]
            on, slot = on[~same], (slot[~same] + 1) & (len(self.low) - 1)
        self.words += int(first.sum())
        return out, first


class Encoder:
    """Ids of texts as unsigned integers (``dtype``: 16 bits where the vocabulary allows, else 32)."""

    def __init__(self, path: str, cache_words: int = 1 << 20, specials: bool = True):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.words = Tokenizer(whole.model)  # the library's model alone, for words as they are
        vocab = whole.get_vocab(with_added_tokens=False)
        self.letters = np.zeros(max(vocab.values()) + 1, np.int64)
        self.letters[list(vocab.values())] = [len(t) for t in vocab]
        self.special = SpecialSplit(path)
        if not specials:
            self.special.ids, self.special.cut = {}, None
        self.dtype = np.dtype("<u2") if self.special.size <= 1 << 16 else np.dtype("<u4")
        self.table = WordTable((2 * cache_words - 1).bit_length())
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by the library's model, which takes bytes as the byte-level letters: end to end, and how many each has."""
        letters = np.frombuffer(byte_letters().encode("utf-32-le"), "<u4")
        said = letters[np.frombuffer(b"".join(words), np.uint8)].tobytes().decode("utf-32-le")
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        cut = ends.tolist()
        spelt = [said[a:b] for a, b in zip([0, *cut], cut)]
        parts = [np.zeros(0, self.dtype)]
        for a in range(0, len(words), 1 << 12):
            (some,) = self.words.encode_batch_fast([spelt[a : a + (1 << 12)]], is_pretokenized=True, add_special_tokens=False)
            parts.append(np.array(some.ids, self.dtype))
        ids = np.concatenate(parts)
        last = np.searchsorted(np.cumsum(self.letters[ids]), ends) + 1  # the id that reaches a word's end is its last
        return ids, np.diff(last, prepend=0)

    def hold(self, ids: np.ndarray, at: int) -> None:
        """Put ids at a place of the array of all ids."""
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[at : at + len(ids)] = ids

    def room(self, words: int, place: np.ndarray, count: np.ndarray) -> None:
        """Forget what is known if so many more words would fill the table; ids that the batch has found stay."""
        if 4 * (self.table.words + words) <= 3 << self.table.bits:
            return
        kept = self.ids[ragged(place, count)]
        self.table = WordTable(max(self.table.bits, (2 * words).bit_length()))
        self.ids, self.used = np.zeros(1 << 16, self.dtype), len(kept)
        self.hold(kept, 0)
        place[:] = np.cumsum(count) - count

    def flat(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each closed by ``end_id`` if there is one; where each ends."""
        if not texts:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        segments, between = self.special(texts)
        data, at, closing = split_words(segments)
        start, length = at[:-1], np.diff(at)
        closes = np.zeros(len(start), bool)
        closes[closing] = True
        place, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)

        short = np.flatnonzero((length <= SHORT) & ~closes)
        low, high = WordTable.keys(np.frombuffer(data + bytes(SHORT), np.uint8), start[short], length[short])
        slot = self.table.find(low, high, length[short])
        known, new = short[slot >= 0], np.flatnonzero(slot < 0)
        place[known], count[known] = self.table.at[slot[slot >= 0]], self.table.count[slot[slot >= 0]]
        self.room(len(new), place, count)
        slot, first = self.table.add(low[new], high[new], length[short[new]])
        new = short[new]

        once, long = new[first], np.flatnonzero(length > SHORT)
        ids, size = self.learn([data[a:b] for x in (once, long) for a, b in zip(start[x].tolist(), (start[x] + length[x]).tolist())])
        self.hold(ids, self.used)
        began = self.used + np.cumsum(size) - size
        self.table.at[slot[first]], self.table.count[slot[first]] = began[: len(once)], size[: len(once)]
        place[new], count[new] = self.table.at[slot], self.table.count[slot]
        place[long], count[long] = began[len(once) :], size[len(once) :]
        tail = self.used + len(ids)
        self.used += int(size[: len(once)].sum())

        after = [[*x, end_id] for x in between]  # the id that follows each segment
        own = [i for x in after for i in x]
        self.hold(np.array([0 if i is None else i for i in own], self.dtype), tail)
        place[closing], count[closing] = tail + np.arange(len(own)), [i is not None for i in own]
        ends = np.cumsum(count)
        last = np.cumsum([len(x) for x in after]) - 1
        return self.ids[ragged(place, count)], ends[closing[last]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        ids, ends = self.flat(texts)
        width, data, ends = self.dtype.itemsize, ids.tobytes(), ends.tolist()
        return [data[width * a : width * b] for a, b in zip([0, *ends], ends)]


@functools.lru_cache(maxsize=2)
def encoder(path: str, specials: bool = True) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path, specials=specials)
