"""The trie against one built by plain loops, in many small blocks and segments; odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from chronopanel.llm import prefix_trie

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType())])


def sym(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def brute_force(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, sym(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h, p = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5 if c > 0 else -(abs(c) % 5))
        turns = tuple(own.get(p, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    kids = defaultdict(list)
    for v in members:
        if v:
            kids[v[:-1]].append(v)
    leaves, saved = {}, {}
    for v in sorted(members, key=len, reverse=True):
        leaves[v] = sum(leaves[k] for k in kids[v]) or 1
        saved[v] = sum(saved[k] for k in kids[v]) + (len(members[v]) - 1) * (len(v[-1][1].encode()) if v else 0)
    sha = lambda v: hashlib.sha256(",".join(map(str, sorted(ends[v]))).encode()).hexdigest()
    return [(m[0], len(v), members[v[:-1]][0] if v else None, len(m), len(kids[v]), leaves[v], saved[v], sha(v)) for v, m in members.items()]


def check(spark, rows, length):
    df = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA).repartition(3)
    got = prefix_trie.trie(df, length=length)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_force(rows), key=str)


@pytest.mark.parametrize(("length", "seed"), [(64, 1), (1, 2), (2, 3), (5, 4)])
def test_many_blocks(spark, monkeypatch, length, seed):
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", 60)
    monkeypatch.setattr(prefix_trie, "RUN", 2)
    rng, rows = random.Random(seed), []
    for c in [*range(-6, 0), *range(1, 150)]:  # few words, so that much is shared
        n = rng.choice([1, 2, 3, 6, 9, 12, 20])
        rows += [(c, rng.choice([None, k, k]), rng.choice(["user", "user", None]), rng.choice(["a", "a", "a", "b", "é", None])) for k in range(n)]
    for c in range(200, 320):  # a large group of copies
        rows += [(c, k, "user", f"same {k}") for k in range(11)]
    rows += [(400, 1, "user", "again")] * 40 + [(None, 1, "user", "no id")]  # a turn that repeats in one conversation
    check(spark, rows, length)


def test_long_conversation(spark, monkeypatch):
    """One conversation holds most rows and its copies differ at their ends."""
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", 64)
    monkeypatch.setattr(prefix_trie, "RUN", 4)
    rows = [(c, k, "user", f"turn {k}" if k < 250 + c else f"other {k}") for c in (5, 10, 15) for k in range(300)] + [(6, 0, "user", "x")]
    check(spark, rows, 8)


def test_few_rows(spark):
    check(spark, [(7, None, None, None)], 64)
    check(spark, [(1, 0, "user", "only"), (2, 0, "user", "only")], 64)  # shorter than their h, whose family has no first: turnless
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_common():
    head, syms = bytes(24), [bytes([k]) * 16 for k in range(9)]
    key = lambda ks: head + b"".join(syms[k] for k in ks)
    assert prefix_trie.common(key([1, 2, 3]), key([1, 2, 4])) == 2 and prefix_trie.common(key([]), key([1])) == 0
    assert prefix_trie.common(key([1]), key([1, 5])) == 1 and prefix_trie.common(key([1]), b"\1" + key([1])[1:]) == -1
    assert prefix_trie.common(head + b"\1" * 15 + b"\2", key([1])) == 0 and prefix_trie.common(None, key([1])) == -1
