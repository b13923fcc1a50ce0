"""Neighbours, the classifier, archives and conversations."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.llm import ann, chat, quality_cnn, warc


def brute(ids, x, q, k):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    d[ids == q] = np.inf
    o = np.lexsort((ids, d))[:k]
    return ids[o].tolist(), d[o]


def test_search(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (1500, 16)), np.repeat(rng.normal(0, 1, (1, 16)), 300, axis=0)])
    ids = np.arange(len(x))
    rows = [(int(i), v.tolist(), 1.0) for i, v in zip(ids, x, strict=True)]
    odd = [(9001, None, 1.0), (9002, [], 1.0), (9003, [0.0] * 16, 1.0), (9004, [float("nan")] * 16, 1.0), (9005, [None] + [1.0] * 15, 1.0), (9006, [1.0] * 3, 1.0), (9100, [float("inf")] * 16, 1.0), (None, [1.0] * 16, 1.0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, score double")
    got = ann.search(df, F.col("id") % 50 == 0, leaf_rows=32, block_rows=100).toPandas()
    found = total = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        want, _ = brute(ids, x, q, 10)
        assert g["rank"].tolist() == list(range(1, 11)) and g.vec_id.max() < 9000
        assert g.score.tolist() == pytest.approx([float(np.linalg.norm(x[v] - x[q])) for v in g.vec_id], abs=1e-12)
        found, total = found + len(set(want) & set(g.vec_id)), total + 10
    assert got.query_id.nunique() == 36 and found / total >= 0.9
    same = got[got.query_id == 1700].sort_values("rank")
    assert same.vec_id.tolist() == list(range(1500, 1510)) and (same.score == 0).all()  # ties to the smaller id


def test_search_of_few(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert ann.search(spark.createDataFrame([], schema), F.col("id") == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)
    assert [(r.rank, r.vec_id) for r in ann.search(few, F.col("id") == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert ann.search(few.limit(1), F.col("id") == 0).count() == 0


def test_pooling_covers_whole_texts():
    rng = np.random.default_rng(1)
    m = quality_cnn.train([bytes(rng.integers(97, 123, 900).tolist()) for _ in range(8)], np.array([0, 1] * 4, np.float32), 0.5)
    for n in (0, 1, 7, 8, 255, 256, 257, 511, 512, 513, 2000, 300_000):
        t = bytes(rng.integers(97, 123, n).tolist())
        step = quality_cnn.CELL * quality_cnn.STRIDE
        cells = max(1, -(-max(n - quality_cnn.WIDTH + quality_cnn.STRIDE, 1) // step))
        data = np.full(cells * step + quality_cnn.WIDTH, quality_cnn.PAD)
        data[:n] = np.frombuffer(t, np.uint8)
        r = np.array([m.table[data[p : p + quality_cnn.WIDTH]].reshape(-1) @ m.filters for p in range(0, cells * step, quality_cnn.STRIDE)]) + m.offset
        r = np.maximum(r.reshape(cells, quality_cnn.CELL, -1).max(axis=1), 0)
        chunks = np.maximum(r[:-1], r[1:]) if cells > 1 else r
        assert m.pooled(t) == pytest.approx(np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]), abs=1e-4)


def test_classifier(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality_cnn.fit(docs, labels)
    p = quality_cnn.score(docs, model).join(labels, "doc_id").where(quality_cnn.held_out()).select("score", "quality").toPandas()
    r, n1 = p.score.rank(), (p.quality == 1).sum()
    assert (r[p.quality == 1].sum() - n1 * (n1 + 1) / 2) / n1 / (len(p) - n1) > 0.95
    odd = spark.createDataFrame([(1, None, 0.5), (1, None, 0.5), (None, "", 0.1), (2, "x" * 200_000, 0.1)], "doc_id bigint, text string, score double")
    s = [x.score for x in quality_cnn.score(odd, model).collect()]
    assert len(s) == 4 and all(0 <= x <= 1 for x in s) and s[0] == s[1]
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality_cnn.fit(odd, none) == 1.0 and [x.score for x in quality_cnn.score(odd, 1.0).collect()] == [1.0] * 4
    assert quality_cnn.score(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("records", [4096, 2])
def test_archives(spark, tmp_path, records):
    big = "é" * 600
    rows = [(1, "http://a/ b\r\nx", big, 1), (2, None, big, 1), (3, "u", big, 1), (4, "u", "small", 1), (5, "u", "small", 1), (6, "u", None, 1), (None, "u", big, 1), (7, "u", "y" * 300_000, 1), (3, "u", big, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    at = str(tmp_path / "a")
    warc.write_archives(pages.coalesce(1), at, records=records)
    got = warc.read_archives(spark, at).collect()
    assert len(got) == len(rows) and all(r.problem is None for r in got)
    if records == 2:
        assert len(list((tmp_path / "a").glob("*.txt"))) >= len(rows) / 2
    for r in got:
        html = next(x[2] for x in rows if x[0] == r.page_id) or ""
        assert r.payload_digest == hashlib.sha1(html.encode()).hexdigest() and r.payload_bytes == len(html.encode())
        revisit = html == big and r.page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None)), r
        assert (r.payload is None) if revisit else bytes(r.payload) == html.encode()
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_damaged_archives(spark, tmp_path):
    import zstandard

    words = zstandard.ZstdCompressionDict(b"HTTP/1.1 WARC-Type: response" * 10)
    made = zstandard.ZstdCompressor(dict_data=words)
    good = warc.record(1, "response", "u", None, b"abc", hashlib.sha1(b"abc").hexdigest(), 3)
    lead = warc.DICTIONARY_MAGIC + len(words.as_bytes()).to_bytes(4, "little") + words.as_bytes()
    files = {"ok": lead + made.compress(good), "length": lead + made.compress(good[:-1]) + made.compress(good), "digest": lead + made.compress(good.replace(b"abc\r", b"abd\r")), "lead": made.compress(good), "cut": (lead + made.compress(good))[:-3]}
    for name, data in files.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    found = {name: [r.problem is None for r in warc.read_archives(spark, str(tmp_path / f"{name}.txt")).collect()] for name in files}
    assert found == {"ok": [True], "length": [False, True], "digest": [False], "lead": [False], "cut": [False]}


@pytest.mark.parametrize("block", [1024, 2])
def test_chats(spark, block):
    talks = {1: "abc", 2: "ab", 3: "abc", 4: "abd", 5: "a", 6: "x", 7: "xyzxyz", 8: "xyz", 9: "yz"}
    rows = [(c, i, "user" if i % 2 == 0 else None, t, "r") for c, s in talks.items() for i, t in enumerate(s)]
    rows += [rows[0], (None, 0, "user", "lost", "r"), (10, 0, "user", None, "r"), (11, 0, None, "", "r"), (12, None, "user", "q", "r")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, rendered string")
    got = chat.format_chats(df, block).orderBy("conv_id", "part").toPandas()
    assert set(got.conv_id) == {1, 4, 7, 9, 10, 11, 12}
    assert got[got.conv_id == 1].n_copies.iloc[0] == 2 and got[got.conv_id == 7].n_turns.iloc[0] == 6
    whole = "".join(got[got.conv_id == 7].rendered)
    assert whole == "".join(f"<|im_start|>{'user' if i % 2 == 0 else 'unknown'}\n{t}<|im_end|>\n" for i, t in enumerate("xyzxyz"))
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chats_numbered_otherwise(spark):
    """Snapshots match by the places of their turns, whatever their numbers: from 0 or 1, with gaps, over blocks."""
    talk = [(k, "user", f"t{k}") for k in range(7)]
    rows = [(1, *x) for x in talk] + [(2, k + 1, r, x) for k, r, x in talk[:5]] + [(3, 5000 + 3 * k, r, x) for k, r, x in talk[:3]] + [(4, None, r, x) for _, r, x in talk]
    rows += [(5, k, "user", x) for k, x in enumerate(["t1", "t0", "t0", "t1"])] + [(6, k, "user", x) for k, x in enumerate(["t0", "t1", "t1", "t0"])]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    for block in (2, 3, 1024):
        got = chat.format_chats(df, block).toPandas()
        assert sorted(set(got.conv_id)) == [1, 5, 6]
        assert got[got.conv_id == 1].n_copies.iloc[0] == 2 and sorted(got[got.conv_id == 1].part) == list(range(-(-7 // block)))
        assert got.rendered.str.count("start").max() <= block
    import duckdb

    from chronopanel.llm import oracle

    conversations = df.toPandas().astype({"turn": "Int64"})  # noqa: F841 (a table of the SQL)
    want = duckdb.sql(oracle.chat_sql()).df()
    keys = ["conv_id", "part"]
    assert got.sort_values(keys)[list(want.columns)].values.tolist() == want.sort_values(keys).values.tolist()
