"""Registered queries that SQL can't express, on the smallest tables against plain loops."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from chronopanel.llm import byte_bpe, packing, queries, sharding, simhash

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_packing(spark, texts):
    got = queries.op1_packing(spark, DATA).toPandas()
    enc = byte_bpe.encoder(P.path("byte_bpe_50k.tiktoken"))
    for doc, g in got.sort_values("start").groupby("doc_id"):
        ids = np.append(enc.encode(texts[doc]), 0).astype("<u4")
        assert g.start.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() == len(ids) and (g.doc_tokens == len(ids)).all()
        assert g.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g.start, g.length, strict=True)]
    assert set(got.doc_id) == set(texts)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 1024


def test_lowest_cost_choice():
    """Each piece of a block goes to the open sequence of lowest cost that has room."""
    lengths = np.random.default_rng(3).integers(1, 1024, 300).tolist()
    placed = packing.assign(lengths, 1024, 1.0, 1 / 256)
    cost, room = [0.0] * -(-sum(lengths) // 1024), [1024] * -(-sum(lengths) // 1024)
    for _, _, size, k, offset in placed:
        assert offset == 1024 - room[k]
        fits = [c for c, r in zip(cost, room, strict=True) if r >= size]
        assert fits and (cost[k] == min(fits) or room[k] == size == max(room))
        room[k] -= size
        cost[k] += size + size * size / 256


def test_byte_bpe(spark, texts):
    enc = byte_bpe.encoder(P.path("byte_bpe_50k.tiktoken")).encoding
    for r in queries.op4_byte_bpe(spark, DATA).collect():
        ids = np.array(enc.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_sharding(spark, texts):
    got = queries.op5_sharding(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(sharding.SHARDS)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(n)) for k, n in counts.items())


def test_simhash(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, DATA).collect()}
    ids = sorted(texts)
    prints = {d: simhash.fingerprint(texts[d]) for d in ids}
    group = {d: d for d in ids}
    for a in ids:
        for b in ids:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    assert got == {d: (f"{prints[d]:016x}", group[d]) for d in ids}
