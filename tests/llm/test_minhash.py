"""Near duplicates against a brute-force join of full shingle sets; components against plain union-find."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from joinery.llm import minhash
from joinery.llm.common import Workspace
from joinery.llm.components import components


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs):
    """doc_id -> (set size, component) of (doc_id, text) with ids once each."""
    sets = {}
    for i, t in docs:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    at = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            at[s].append(i)
    shared = defaultdict(int)
    for own in at.values():
        for k, b in enumerate(own):
            for a in own[:k]:
                shared[a, b] += 1
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def ours(docs):
    got = {}
    for r in minhash.near_duplicates(docs).collect():
        assert r.kept == (r.doc_id == r.component_id)
        got[r.doc_id] = (r.n_shingles, r.component_id)
    return got


def test_equals_brute_force(spark, sf, documents):
    table = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    want = brute(zip(table["doc_id"], table["text"]))
    assert any(i != c for i, (_, c) in want.items())
    assert ours(documents) == want


def test_copies_of_a_template_and_of_passages(spark):
    """Chains of edits, so that many pairs in a bucket are no links; groups that share a passage and are none; exact copies."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    template, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = []
    for _ in range(70):
        t = list(template)
        for _ in range(rng.randrange(1, 7)):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    texts += [passage + [word() for _ in range(rng.randrange(5, 60))] for _ in range(40)]
    texts += [texts[0]] * 15 + [[w.upper() for w in texts[1]]]
    texts += [[word()] * n for n in range(1, 7)] + [["a", "b"], ["a", "b"], ["b", "a"]]
    docs = list(enumerate(" ".join(t) for t in texts))
    rng.shuffle(docs)
    assert ours(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)) == brute(docs)


def test_one_id_on_different_texts(spark, sf):
    import corpus_pipeline

    rng = random.Random(7)
    a, b, c, d = ([f"{rng.randrange(10**6)}" for _ in range(80)] for _ in range(4))
    near = lambda t, k: " ".join([*t, f"x{k}"])
    firsts = [(3, near(a, 0)), (5, near(b, 0)), (2, near(c, 0)), (2, near(d, 0))]
    later = [(5, near(a, 0)), (9, near(b, 1)), (6, near(c, 1)), (7, near(d, 1)), (8, near(d, 0))]
    docs = spark.createDataFrame(firsts + later, "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, 3 if i in (3, 5, 9) else 2) for i, _ in firsts + later)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert sorted(map(tuple, corpus_pipeline.distinct(spark, docs, sf).collect())) == sorted(firsts)


def test_odd_rows(spark, odd, none):
    got = {(-1 if r.doc_id is None else r.doc_id): r for r in minhash.near_duplicates(odd).collect()}
    assert got[-1].component_id is None and got[-1].kept
    for i in (0, 1, 2):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[9].component_id == 8 and not got[9].kept and got[8].kept
    assert got[6].n_shingles == 9  # nine words over and over
    assert minhash.near_duplicates(odd).count() == odd.count()
    assert minhash.near_duplicates(none).collect() == []


def one_by_one(h: int, places: int) -> list[int]:
    """SuperMinHash of a single hash, as the sequential algorithm has it."""
    order, out = list(range(places)), [0] * places
    for j in range(places):
        x = minhash.mix(np.array([h], np.uint64) + (np.arange(j + 1, j + 2, dtype=np.uint64) * minhash.GOLDEN))
        k = j + ((int(minhash.mix(x ^ minhash.GOLDEN)[0]) >> 32) * (places - j) >> 32)
        order[j], order[k] = order[k], order[j]
        out[order[j]] = (j << minhash.RANK) | (int(x[0]) >> (64 - minhash.RANK))
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sets(st.integers(0, 2**64 - 1), max_size=30), min_size=1, max_size=4))
def test_signatures_equal_the_sequential_algorithm(sets):
    got = minhash.signatures([np.array(sorted(s), np.uint64) for s in sets], 40)
    for row, s in zip(got.tolist(), sets):
        if s:
            assert row == [min(c) for c in zip(*(one_by_one(h, 40) for h in s))]


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    pairs = [(pool[:1000], pool[k : 1000 + k]) for k in (50, 150, 300)]
    for a, b in pairs:
        sig = minhash.signatures([np.unique(a), np.unique(b)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.12


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(100)], "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(150)], "none": []}[shape]
    if edges:
        edges += [(None, 3), (7, 7)]
    up: dict[int, int] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3), Workspace(spark, "cc-test"))
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in list(up)}
