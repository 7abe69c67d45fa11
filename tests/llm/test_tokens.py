"""Token ids and what is made of them: packing, counts, files, the lexicon."""

from __future__ import annotations

import hashlib
import unicodedata
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from joinery.llm import lexicon, packing, token_counts, token_files
from joinery.llm.common import Workspace, mapped, put
from joinery.llm.tokens import LETTER, NUMBER, SPACE, Encoder, char_classes, class_table
from tests.llm.conftest import ODD_TEXTS


@pytest.fixture(scope="session")
def library(tokenizer):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


@pytest.fixture(scope="session")
def own(tokenizer):
    return Encoder(tokenizer, cache_words=50)


@pytest.fixture(scope="session")
def small_codec(tokenizer, tmp_path_factory):
    merges = lexicon.Merges(tokenizer)
    words = {w: merges.ids(w) for w in (b" the", b"the", b"a", b" a", b"'s", b" then", b" than", b"han", "é".encode(), b"!!!")}
    path = str(tmp_path_factory.mktemp("lexicon") / "automaton")
    put(path, lexicon.Automaton.build(words))
    return lexicon.Codec(tokenizer, path, cache_words=20)


LETTERS = st.sampled_from([*"abstmdrevl'' \n\t.,!09é漢　  Ⅷ½😀\x00", "<|endoftext|>", "'re", " the", "!!!"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(LETTERS, max_size=25).map("".join), max_size=5))
def test_ids_equal_the_librarys(library, own, small_codec, texts):
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == want
    got = small_codec.encode(texts)
    assert [x.tolist() for x in got] == want
    assert [small_codec.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_decoding_of_ids_that_are_no_text(library, small_codec):
    for ids in ([222, 50256, 5099], list(range(120, 260)), [158]):
        assert small_codec.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


@given(st.lists(st.sampled_from("aZ09 \t\n'.é½²٣あ中\u3000\u00a0\U0001d7d8\U0001f600\U0010ffff"), max_size=20))
def test_classes_do_not_depend_on_what_was_asked_before(text):
    class_table.cache_clear()
    points = np.array([ord(c) for c in text], "<u4")
    want = [{"L": LETTER, "N": NUMBER, "Z": SPACE}.get(unicodedata.category(c)[0], SPACE if c in "\t\n" else 0) for c in text]
    assert char_classes(points[::-1]).tolist() == want[::-1] and char_classes(points).tolist() == want


def test_long_words(library, small_codec):
    for text in ("ab" * 3000, "x" * 5000, "the" * 400 + "!" * 700):
        assert small_codec.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=40), st.sets(st.binary(min_size=1, max_size=6), max_size=20))
def test_the_automaton_knows_its_words_and_no_others(words, others):
    found = lexicon.Automaton(np.frombuffer(lexicon.Automaton.build({w: [1] for w in words}), np.uint8))
    asked = [*words, *others]
    data = np.frombuffer(b"".join(asked) + b"\0", np.uint8)
    n = np.array([len(w) for w in asked], np.int64)
    order = {w: i for i, w in enumerate(sorted(words))}
    assert found.find(data, np.cumsum(n) - n, n).tolist() == [order.get(w, -1) for w in asked]


def test_the_automaton_shares_suffixes():
    assert len(lexicon.minimal(sorted([b"taps", b"tops", b"laps", b"lops"]))) == 5


def brute(library, docs, end):
    return [(i, library.encode(t or "", add_special_tokens=False).ids + end) for i, t in docs]


def test_packing(spark, sf, documents, library, tokenizer):
    table = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    want = dict(brute(library, zip(table["doc_id"], table["text"]), [0]))
    pieces = packing.pack(documents, tokenizer).collect()
    by_doc: dict[int, list] = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = np.frombuffer(p.ids, "<u2").astype("<u4")
        assert p.length == len(ids) and p.ids_crc32 == zlib.crc32(ids.tobytes()) and p.doc_tokens == len(want[p.doc_id])
        assert p.start == len(by_doc.setdefault(p.doc_id, []))
        by_doc[p.doc_id] += ids.tolist()
    assert by_doc == want
    filled: dict[int, list] = {}
    for p in pieces:
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    total = sum(map(len, want.values()))
    assert set(filled) == set(range(-(-total // 1024)))
    for s, spans in filled.items():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at == 1024 or s == max(filled) and at == total - 1024 * s


def test_packing_odd_rows(odd, none, library, tokenizer):
    got = packing.pack(odd, tokenizer, 64).collect()
    want = sorted((-1 if i is None else i, len(x)) for i, x in brute(library, [(r.doc_id, r.text) for r in odd.collect()], [0]))
    assert sorted((-1 if p.doc_id is None else p.doc_id, p.doc_tokens) for p in got if p.start == 0) == want
    assert packing.pack(none, tokenizer).collect() == []


def test_token_files(spark, sf, documents, library, tokenizer):
    table = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    at, want = 0, []
    for i, ids in brute(library, sorted(zip(table["doc_id"], table["text"])), [0]):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.token_files(documents.repartition(3), tokenizer).collect())) == want


def test_token_files_odd_rows(odd, none, library, tokenizer):
    got = sorted(token_files.token_files(odd, tokenizer).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, *range(4, len(ODD_TEXTS))]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert token_files.token_files(none, tokenizer).collect() == []


def test_token_counts(spark, odd, none, library, tokenizer):
    library.encode_special_tokens = True
    try:
        want = sorted((-1 if r.doc_id is None else r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    finally:
        library.encode_special_tokens = False
    got = token_counts.document_token_counts(odd, tokenizer, 50256).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == want
    assert token_counts.document_token_counts(none, tokenizer, 50256).collect() == []


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_separators_across_blocks(spark, block):
    work = Workspace(spark, "counts-test")
    files = {"a": [9, 9, 5, 9, 7, 7, 7, 7, 7, 7, 7, 9, 1], "b": [1, 2, 3], "c": [9], "d": [], "e": [1] * 20 + [9] + [2] * 5 + [9]}
    folder = work.folder("flat")
    for name, ids in files.items():
        put(f"{folder}/{name}", np.array(ids, "<u4").tobytes())
    listed = spark.createDataFrame([(f"{folder}/{n}", len(x), 4) for n, x in files.items()], "file string, size long, width int")
    want = []
    for name, ids in files.items():
        start = 0
        for k, end in enumerate([i for i, x in enumerate(ids) if x == 9]):
            want.append((name, k, start, end - start, True))
            start = end + 1
        if start < len(ids):
            want.append((name, sum(x == 9 for x in ids), start, len(ids) - start, False))
    got = token_counts.count_tokens(listed, 9, block).collect()
    assert sorted((r.file[-1], r.ordinal, r.start, r.n_tokens, r.closed) for r in got) == sorted(want)


def test_lexicon_query(odd, none, documents, library, tokenizer):
    for docs in (odd, documents.limit(40)):
        rows = docs.collect()
        want = []
        for r in rows:
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want.append((-1 if r.doc_id is None else r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        got = lexicon.encode(docs, tokenizer, words=500).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert lexicon.encode(none, tokenizer).collect() == []


def test_rows_of_one_id_go_to_several_shards(spark, tokenizer):
    docs = spark.createDataFrame([(7, "hot text of one id")] * 500 + [(1, "a"), (9, "z")], "doc_id long, text string").repartition(6)
    manifest = token_files.write(docs, tokenizer, Workspace(spark, "hot-id"))
    assert max(r.docs for r in manifest.collect()) < 400
    got = token_files.read(manifest, 3).orderBy("start").collect()
    assert [r.doc_id for r in got] == [1] + [7] * 500 + [9]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))


def test_the_class_of_the_least_count_fills_the_lexicon(spark, tokenizer):
    docs = spark.createDataFrame([(1, "aa aa aa bb cc dd ee ff")], "doc_id long, text string")
    path = lexicon.compile_lexicon(docs, tokenizer, Workspace(spark, "lexicon-test"), 4)
    automaton = lexicon.Automaton(mapped(path))
    words = [b" aa", b"aa", b" bb", b" cc", b" dd", b" ee"]
    data = np.frombuffer(b"".join(words), np.uint8)
    length = np.array([len(w) for w in words])
    assert (automaton.find(data, np.cumsum(length) - length, length) >= 0).tolist() == [True, False, True, True, True, False]


def test_words_of_every_length_and_a_table_that_fills_up(tokenizer):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(list("abcé\0 ñ漢"), rng.integers(1, 40))) for _ in range(60)) for _ in range(40)]
    whole = Tokenizer.from_file(tokenizer)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for words in (10, 1000, 1 << 20):
        own = Encoder(tokenizer, cache_words=words)
        for _ in range(2):
            ids, ends = own.flat(texts, 5)
            assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*x, 5] for x in want]
            assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == want
