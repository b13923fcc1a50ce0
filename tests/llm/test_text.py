"""Tokenising, packing, sharding, secrets, quality rules, fingerprints: small cases and brute force."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken  # noqa: F401
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronopanel.llm import byte_bpe, packing, quality_rules, secrets, sharding, simhash

RANKS = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, shard string, spans int, kept string, ids string"
LONG = "the quick brown fox. " * 5000


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "s", 1, "k", "x") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "no id here."), (None, None), (4, LONG), (5, " \n\t "), (6, "é" * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


@pytest.mark.parametrize("wide", [1 << 16, 8])
def test_tree_encoding_equals_plain(monkeypatch, wide):
    monkeypatch.setattr(byte_bpe, "WIDE", wide)
    own, other = byte_bpe.TreeEncoder(RANKS, leaf=16), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    parts = ["a", "b", "the ", "  ", "\n", "\t", "1", "23", "'s", "'", "!", "é", "\x1c", "　", " x", "日本", "😀", "'ll", " "]
    for _ in range(400):
        s = "".join(rng.choice(parts[: rng.randint(1, len(parts))]) for _ in range(rng.randint(0, 200)))
        ids = own.encode(s)
        assert ids.tolist() == own.encoding.encode_ordinary(s) == other.encode(s, add_special_tokens=False).ids
        assert own.decode(ids) == s.encode()


def test_long_unbroken_texts():
    own = byte_bpe.TreeEncoder(RANKS)
    for s in ("a" * 70_000, " " * 70_000 + "x", "=-" * 40_000):
        assert own.decode(own.encode(s)) == s.encode()


def test_round_trip(spark, odd, empty):
    got = byte_bpe.round_trip(odd, RANKS).collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in got) == Counter((i, t or "") for i, t in ODD)
    assert byte_bpe.round_trip(empty, RANKS).count() == 0
    again = byte_bpe.decode(byte_bpe.round_trip(odd, RANKS).select("ids", "decoded"), RANKS).where("decoded is null").count()
    assert again == 0


def test_packing(spark, odd, empty):
    got = packing.pack(odd, RANKS, block_tokens=3000).toPandas()
    enc = byte_bpe.TreeEncoder(RANKS)
    want = [np.append(enc.encode(t or ""), 0) for _, t in ODD]
    assert got.length.sum() == sum(map(len, want))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 1024 and g.offset.tolist() == [0, *g.length.cumsum()[:-1]]
    four = got[got.doc_id == 4].sort_values("start")
    assert b"".join(map(bytes, four.ids)) == want[6].astype("<u4").tobytes() and (four.doc_tokens == len(want[6])).all()
    assert packing.pack(empty, RANKS).count() == 0
    marked = packing.pack(docs(spark, [(1, "a<|endoftext|>b")]), RANKS).first()
    assert np.frombuffer(marked.ids, "<u4").tolist() == [64, 50256, 65, 0]


def test_assignment_balances_and_fills():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1024, 500).tolist()
    placed = packing.assign(lengths, 1024, 1.0, 1 / 256)
    total = sum(lengths)
    used = Counter()
    for item, _, n, k, offset in sorted(placed, key=lambda x: (x[3], x[4])):
        assert offset == used[k] and n > 0
        used[k] += n
    assert max(used.values()) <= 1024 and len(used) == -(-total // 1024) and sum(used.values()) == total


def test_sharding(spark, odd, empty, tmp_path):
    many = docs(spark, [(i, f"t{i % 40}" * (i % 7)) for i in range(500)] + [(None, "same")] * 200)
    got = sharding.shuffle_shards(many, shards=16, bucket_bytes=512).toPandas()
    sizes = got.groupby("shard").slot.agg(["count", "max", "nunique"])
    assert len(got) == 700 and sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()
    order = got.sort_values(["shard", "slot"]).doc_id.dropna().tolist()
    assert order != sorted(order)
    assert sharding.shuffle_shards(odd, shards=4).count() == len(ODD) and sharding.shuffle_shards(empty).count() == 0
    few = sharding.shuffle_shards(docs(spark, [(1, "a"), (2, "b")]), shards=16).toPandas()
    assert sorted(few.slot) == [0, 0] and few.shard.nunique() == 2
    sharding.write_shards(many, str(tmp_path / "shards"), shards=4)
    assert spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().count() == 4


TEXTS = [
    "password = hunter22 and token:token:abcdefgh", "AKIA" + "A1" * 9 + " AKIAAKIA", "é token='deadbeefdeadbeefdeadbeefdead'", "API_KEY=x API-KEY=abcdefg api_key : 'abc.def'",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "tOkEn=abc", "secret=secret=1", "0" * 23 + " " + "f" * 24, "", "passwdpasswd=123456", "abc" * 9,
]


def test_trigram_queries():
    assert secrets.trigram_query(secrets.BASE[2].regex) == []
    words = {"password", "passwd", "secret", "token", "apikey", "api_key"}
    (stretch,) = secrets.trigram_query(secrets.BASE[0].regex)
    assert set(stretch) == {frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words}
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [[frozenset({"aki", "kia"})]]
    assert secrets.trigram_query("ab?c*") == []


def test_secrets(spark, odd, empty):
    got = {r.text: [tuple(x) for x in r.spans] for r in secrets.scan(docs(spark, list(enumerate(TEXTS)))).collect()}
    for text in TEXTS:
        want = []
        for k, rule in enumerate(secrets.RULES):
            want += [(m.start(), k, m.end(), rule.kind) for m in re.finditer(rule.regex, text) if len(m[rule.group]) >= rule.least]
        assert got[text] == [(a, e, kind) for a, _, e, kind in sorted(want)], text
    assert secrets.scan(odd).count() == len(ODD) and secrets.scan(empty).count() == 0
    assert secrets.scan(odd).where("text is null and size(spans) = 0").count() == 2
    red = {r.doc_id: r.text for r in secrets.redact(secrets.scan(docs(spark, list(enumerate(TEXTS))))).collect()}
    assert red[0] == "[SECRET] and token:token:abcdefgh" and red[9] == "" and red[2] == "é [SECRET]'"


def rules_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = list(zip(w, w[1:], w[2:], strict=False))
    n = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd, empty):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("a b c dd e.\n f\n ## é".split(" ")) for _ in range(rng.randint(0, 80))) for _ in range(60)] + [LONG, "x\n\nx\nx", "a b c a b c a"]
    got = {r.doc_id: r for r in quality_rules.clean(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], rules_of(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    prose = " ".join(f"word{i}" + "." * (i % 9 == 8) for i in range(90)) + "."
    rows = [(1, prose), (2, prose + "\nAll rights reserved."), (3, "\n".join(" | ".join(f"c{i}{k}" for i in range(9)) + "." for k in range(9))), (4, " ".join(f"w{i}***" for i in range(80)) + ".")]
    r = {x.doc_id: x for x in quality_rules.clean(docs(spark, rows)).collect()}
    assert [r[i].kept for i in (1, 2, 3, 4)] == [True, True, False, False] and r[2].cleaned == prose and r[1].cleaned == prose
    kept = quality_rules.clean(docs(spark, rows)).where("kept")
    assert kept.count() == 2
    assert quality_rules.clean(odd).count() == len(ODD) and quality_rules.clean(empty).count() == 0
    assert quality_rules.clean(odd).where("text is null and not kept and n_words = 0").count() == 2


def test_fingerprint():
    for t in ("", "one two", "a b c d E", "x y z " * 50):
        w = t.lower().split()
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(values, radius=3):
    group = list(range(len(values)))
    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return group


def test_bk_tree_finds_all():
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(50)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values for _ in range(4)]
    tree = simhash.BKTree(3)
    for v in values:
        tree.add(v)
    for q in values[:80]:
        assert set(tree.near(q)) == {v for v in values if (v ^ q).bit_count() <= 3}


@pytest.mark.parametrize("shard_rows", [4096, 8])
def test_groups(spark, shard_rows):
    rng = random.Random(4)
    values = []
    for _ in range(12):  # chains, so that groups are wider than the radius
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.append(v)
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    values = list(dict.fromkeys(values))
    signed = [v - (v >> 63 << 64) for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    got = {r.node: r.root for r in simhash.components(simhash.links(nodes, shard_rows=shard_rows)).collect()}
    label = [got.get(v, v) for v in signed]
    want = brute_groups(values)
    assert {(a, b) for a, b in zip(label, want, strict=True)} == set(dict(zip(label, want, strict=True)).items()) and len(set(label)) == len(set(want))


def test_near_duplicates(spark, odd, empty):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(9, base), (7, base), (8, base.upper()), (5, base + " tail"), (2, "something else entirely."), (1, None), (3, ""), (None, ""), (None, "alone and without id"), (2, "something else entirely.")]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    by = {d: c for (d, _), c in got.items() if d is not None}
    assert by[9] == by[7] == by[8] and by[1] == by[3] == 1 and by[2] == 2
    left = simhash.one_of_each(docs(spark, rows)).collect()
    assert sum(r.doc_id == 2 for r in left) == 1 and sum(r.doc_id is None for r in left) == 1 and len(left) == len({c for c in got.values()})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    assert simhash.near_duplicates(odd).count() == len(ODD)
    assert simhash.one_of_each(odd).select(F.count("*")).first()[0] <= len(ODD)
