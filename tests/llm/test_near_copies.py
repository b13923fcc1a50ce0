"""Near copies against brute force on sets of words."""

import numpy as np
import pytest

import corpus_pipeline
from chronopanel.llm import near_copies
from chronopanel.llm.common import table

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sets(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def kept(rows):
    """The smallest id of each group by brute force."""
    found = [(d, sets(t or "")) for d, t in rows]
    group = {d: d for d, _ in found}
    for i, (a, x) in enumerate(found):
        for b, y in found[:i]:
            if len(x & y) >= 0.8 * len(x | y) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    return sorted(set(group.values()))


def edited(text, share, seed):
    words, rng = text.split(), np.random.default_rng(seed)
    for at in rng.choice(len(words), int(share * len(words)), replace=False):
        words[at] = f"w{rng.integers(1 << 30)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for k in range(12):
        text = " ".join(f"v{x}" for x in rng.integers(0, 5000, 400))
        out += [text, text.upper()] + [edited(text, s, 100 * k + i) for i, s in enumerate((0.005, 0.01, 0.02, 0.03, 0.1))]
    chain = [f"c{x}" for x in range(300)]
    out += [" ".join(chain[k : k + 200]) for k in range(0, 90, 9)]  # neighbours are near copies, ends are not
    return list(enumerate([*out, "", None, "  ", "one", "One", "one two"]))


@pytest.mark.parametrize("block_rows", [256, 4])
def test_groups(spark, rows, block_rows):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs, block_rows=block_rows).collect()) == kept(rows)


def test_empty(spark):
    assert near_copies.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stage(spark):
    docs = table(spark, DATA, "documents")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect())
    assert got == kept([(r.doc_id, r.text) for r in docs.collect()])


def test_short_texts_are_exact(spark):
    """All pairs of texts of 8 to 16 words with a similarity of 0.8 or more, among them ones that differ in a few places."""
    rng, rows = np.random.default_rng(11), []
    for k in range(60):
        words = [f"s{x}" for x in rng.integers(0, 10_000, int(rng.integers(8, 16)))]
        rows.append(words)
        for _ in range(3):
            other = list(words)
            change = rng.integers(0, 4)
            if change == 0:
                other[-1] = f"t{k}"
            elif change == 1:
                other.append(f"u{k}")
            elif change == 2:
                other = other[1:]
            else:
                other = [f"a{k}", *other, f"b{k}"]
            rows.append(other)
    rows += [[*(f"core{i}" for i in range(12)), f"end{k}"] for k in range(200)]  # one rest of many texts
    docs = [(d, " ".join(w)) for d, w in enumerate(rows)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], SCHEMA)
    assert sorted(r.doc_id for r in near_copies.one_of_each(df).collect()) == kept(docs)


def test_rests():
    """Sets that are similar share a rest if one is short; sets that are not similar rarely do."""
    rng = np.random.default_rng(12)
    for _ in range(2000):
        pool = rng.integers(0, 1 << 62, 13).astype(np.uint64)
        a, b = (np.unique(pool[rng.random(13) < p]) for p in (0.7, 0.7))
        if len(a) and len(b) and min(len(a), len(b)) < near_copies.SHORT and near_copies.similarity(a, b) >= 0.8:
            assert set(near_copies.rests(a)) & set(near_copies.rests(b))


def test_full_shards_in_blocks(spark):
    """The same links whether a shard is one tree or many blocks; fingerprints that repeat; families of near copies."""
    rng = np.random.default_rng(13)
    centres = rng.integers(-(1 << 63), 1 << 63, (6, 3))
    prints = np.array([c ^ (1 << rng.integers(0, 62, 3)) for c in centres for _ in range(40)])
    prints[5] = prints[4]
    nodes = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(prints)], "node bigint, p0 bigint, p1 bigint, p2 bigint")
    whole = near_copies.simhash.components(near_copies.candidates(nodes)).collect()
    blocks = near_copies.simhash.components(near_copies.candidates(nodes, tree_nodes=7)).collect()
    assert sorted(whole) == sorted(blocks) and {r.root for r in whole} == {40 * k for k in range(6)} and len(whole) == 240


def test_linked_against_all_pairs():
    rng = np.random.default_rng(14)
    for radius in (2, 4, 8):
        values = [int(x) for x in rng.integers(0, 1 << 16, 150)]
        group = list(range(150))
        for i in range(150):
            for j in range(i):
                if (values[i] ^ values[j]).bit_count() <= radius and group[i] != group[j]:
                    old, new = max(group[i], group[j]), min(group[i], group[j])
                    group = [new if g == old else g for g in group]
        assert sorted(near_copies._linked(list(range(150)), values, [True] * 150, radius)) == [(i, g) for i, g in enumerate(group) if g != i]
