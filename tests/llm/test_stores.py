"""WARC archives and media chunks: exact round trips, ranges, revisits, damage."""

from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from joinery.llm import media, queries, warc
from joinery.llm.common import Workspace


def archive(n=40, seed=0):
    rng = random.Random(seed)
    members = []
    for i in range(n):
        data = warc.record(i, "http://x/é y", rng.randbytes(rng.randrange(0, 4000)), "", None)
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        members.append((data, packer.compress(data) + packer.flush()))
    return members


@pytest.mark.parametrize("split", [1, 97, 1000, 5000, 10**7])
def test_every_member_has_one_owner(split):
    members = archive()
    whole = b"".join(m for _, m in members)
    if split == 1:
        whole = b"".join(m for _, m in members[:4])
    got = []
    for a in range(0, len(whole), split):
        got += list(warc.members(io.BytesIO(whole), a, min(len(whole), a + split)))
    assert [d for _, d, _ in got] == [d for d, m in members if whole.startswith(m, 0) or m in whole][: len(got)]
    assert len(got) == (4 if split == 1 else 40)


def test_magic_inside_payloads_and_damage():
    inner = archive(1)[0][1]
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    data = stored.compress(warc.record(1, None, b"x" * 50 + warc.MAGIC * 20 + inner, "", None)) + stored.flush()
    after = archive(1, 5)[0]
    got = list(warc.members(io.BytesIO(data + after[1]), 0, len(data + after[1])))
    assert [g[0] for g in got] == [0, len(data)] and got[1][1] == after[0]
    cut = list(warc.members(io.BytesIO(after[1][:-20]), 0, 10**6))
    assert len(cut) == 1 and cut[0][1] is None and cut[0][2]
    assert list(warc.members(io.BytesIO(b"no archive" + warc.MAGIC * 3), 0, 100)) == []


def test_warc_query_equals_sql(same):
    same(queries.op5_warc, queries.ORACLE_SQL["op5_warc"])


def test_warc_odd_pages(spark):
    long = "<p>very ö long</p>" * 100
    pages = [(1, "u", long), (2, None, long), (3, "http://a b\r\n", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", long), (None, None, None), (8, "v", "z" * 300_000), (9, "v", "other" * 300), (9, "v", "other" * 300)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record_type string").repartition(3)
    got = warc.read_warc(warc.write_warc(df, Workspace(spark, "warc-test")), split=500).collect()
    key = lambda x: -1 if x is None else x
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = html == long and i != 3
        want.append((key(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert sorted((key(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda w: w[:4])
    assert all(r.error is None for r in got)
    assert {key(r.page_id): r.payload for r in got}[8] == b"z" * 300_000
    none = warc.read_warc(warc.write_warc(df.limit(0), Workspace(spark, "warc-test")))
    assert none.collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60), max_size=4), st.integers(0, 3))
def test_cuts_depend_on_the_payload_alone(seeds, k):
    payloads = [b"".join(random.Random(s).randbytes(6000) + s * 90 for s in seeds[i:]) for i in range(len(seeds))]
    together = media.cuts(payloads)
    for p, ends in zip(payloads, together):
        assert media.cuts([p]) == [ends]
        assert not p or ends[-1] == len(p)
        sizes = np.diff([0, *ends])
        assert all(media.LEAST <= s <= media.MOST for s in sizes[:-1]) and all(0 < s <= media.MOST for s in sizes)


def test_gear_hash_is_the_rolling_one():
    data = np.frombuffer(random.Random(2).randbytes(300), np.uint8)
    h, table = 0, media.gear().tolist()
    for i, b in enumerate(data.tolist()):
        h = (h << 1) + table[b] & 0xFFFFFFFF
        assert i < 31 or media.rolling(data)[i] == h


def expected(text):
    data = (text or "").encode()
    body = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
    return len(data), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:])


def test_media_round_trip(spark, odd, none, documents):
    for docs in (odd, documents):
        rows = docs.collect()
        got = media.media(docs).collect()
        key = lambda x: -1 if x is None else x
        assert sorted((key(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted((key(r.doc_id), *expected(r.text)) for r in rows)
        assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_sha256 for r in got)
        forms = {}
        for r in got:
            assert forms.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert media.media(none).collect() == []


def test_each_chunk_is_stored_once(spark, odd):
    work = Workspace(spark, "media-test")
    recipes, chunks = media.store(odd.unionAll(odd).repartition(4), work)
    rows = chunks.collect()
    assert len({r.digest for r in rows}) == len(rows)
    used = {bytes(d) for r in recipes.collect() for d in r.digests}
    assert used == {bytes(r.digest) for r in rows}


def test_a_passage_shared_by_different_texts_is_stored_once():
    words = lambda seed, n: " ".join(random.Random(seed + k).randbytes(3).hex() for k in range(n)).encode()
    shared, found = 0, 0
    for k in range(10):
        passage = words(10**6 * k, 900)  # about 6 KB
        payloads = [words(10**6 * k + 10**4 * j, 150 * j) + b" " + passage + b" " + words(10**6 * k + 10**5 * j, 400) for j in (1, 2)]
        chunks = [{p[a:b] for a, b in zip([0, *ends], ends)} for p, ends in zip(payloads, media.cuts(payloads))]
        shared, found = shared + len(passage), found + sum(map(len, chunks[0] & chunks[1]))
    assert found > 0.3 * shared


def test_shared_root(monkeypatch):
    from joinery.llm import common

    class Context:
        master, applicationId = "local[2]", "app-1"

    class Session:
        sparkContext = Context()
        conf = {}

    root = common.shared_root(Session())
    assert root.startswith("file:///") and common.shared_root(Session()) == root
    Context.master = "spark://host:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_root(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://host/shared/"}
    assert common.shared_root(Session()) == "hdfs://host/shared"


def test_a_hot_payload_and_small_ones(spark):
    html = "<p>" + "hot " * 400
    rows = [(i, "u", html) for i in range(300)] + [(1000 + i, "u", "small") for i in range(300)] + [(5000, "u", html + "x"), (None, "u", html), (299, "u", html)]
    files = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), Workspace(spark, "warc-test"))
    got = warc.read_warc(files, 2000).collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    hot = [r for r in got if r.page_id is None or r.page_id < 300]
    assert sum(r.record_type == "response" for r in hot) == 2 and all(r.refers_to == 299 for r in hot if r.record_type == "revisit")
    assert all(r.record_type == "response" for r in got if r.page_id and r.page_id >= 300)
