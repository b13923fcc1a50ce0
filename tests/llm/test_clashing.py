"""Columns of the caller that have the names of the operators' own keep their values; the registered op2 and op3."""

import numpy as np
import pytest

from chronopanel.llm import near_copies, quality_cnn, quality_rules, queries, secrets, sharding, simhash

DATA = "/root/testdata/sf0.001"
NAMES = ["__text", "__hash", "__words", "__row", "__chunks", "__kinds", "__id", "__lines", "own__text", "__assign"]
ROWS = [(1, "password = hunter2secret and more words here."), (2, None), (3, "plain text of a few words."), (3, "plain text of a few words.")]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame([(*r, *[f"{n} of {k}" for n in NAMES]) for k, r in enumerate(ROWS)], schema)


def own(df):
    return sorted(tuple(r[n] for n in NAMES) for r in df.collect())


OPERATORS = {
    "score": lambda d: quality_cnn.score(d, 0.5), "clean": quality_rules.clean, "scan": secrets.scan, "redact": lambda d: secrets.redact(secrets.scan(d)), "shards": sharding.shuffle_shards,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_stay(docs, name):
    found = OPERATORS[name](docs)
    assert own(found) == own(docs) and found.columns[: len(docs.columns)] == docs.columns


@pytest.mark.parametrize("name", OPERATORS)
def test_text_column_of_that_name(docs, name):
    """The operator's text may itself be a column with two underscores."""
    d = docs.withColumnRenamed("__text", "__gone").withColumnRenamed("text", "__text")
    of = {"score": lambda: quality_cnn.score(d, 0.5, "__text"), "clean": lambda: quality_rules.clean(d, "__text"), "scan": lambda: secrets.scan(d, "__text"),
          "redact": lambda: secrets.redact(secrets.scan(d, "__text"), "__text"), "shards": lambda: sharding.shuffle_shards(d, text_col="__text")}
    found = of[name]()
    assert set(d.columns) <= set(found.columns) and found.count() == len(ROWS)
    if name == "redact":
        assert "hunter2secret" not in {r["__text"] for r in found.collect()} and "[SECRET]" in " ".join(r["__text"] or "" for r in found.collect())


@pytest.mark.parametrize("one_of_each", [simhash.one_of_each, near_copies.one_of_each])
def test_one_of_each(docs, one_of_each):
    found = one_of_each(docs)
    assert found.columns == docs.columns and sorted(r.doc_id for r in found.collect()) == [1, 2, 3] and set(own(found)) <= set(own(docs))


def test_buckets_count_all_columns(spark):
    """Wide rows with short texts need as many buckets as their bytes ask for."""
    wide = spark.createDataFrame([(i, "t", "x" * 5000, [1, 2]) for i in range(40)], "doc_id bigint, text string, html string, more array<int>")
    total = wide.agg({"doc_id": "count"}).count() and wide.select(sharding.whole_bytes(wide).alias("n")).agg({"n": "sum"}).first()[0]
    assert 40 * 5000 < total < 40 * 5200
    placed = sharding.shuffle_shards(wide, 3, bucket_bytes=10_000).collect()
    assert sorted(r.doc_id for r in placed) == list(range(40)) and all(r.html == "x" * 5000 for r in placed)
    sizes = [sum(r.shard == k for r in placed) for k in range(3)]
    assert max(sizes) - min(sizes) <= 1


def test_registered_ann(spark):
    """Recall of the registered query against all distances."""
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    got = queries.op2_ann(spark, DATA).collect()
    hits = 0
    asked = [v for v in rows if v % 100 == 0]
    for a in asked:
        far = sorted((float(np.linalg.norm(rows[a] - x)), b) for b, x in rows.items() if b != a)
        own_rows = sorted((r for r in got if r.query_id == a), key=lambda r: r.rank)
        assert [r.rank for r in own_rows] == list(range(1, 11)) and all(abs(r.score - np.linalg.norm(rows[a] - rows[r.vec_id])) < 1e-12 for r in own_rows)
        hits += len({b for _, b in far[:10]} & {r.vec_id for r in own_rows})
    assert {r.query_id for r in got} == set(asked) and hits >= 0.9 * 10 * len(asked)


def test_registered_quality(spark):
    """Every document has a score; those of held-out labels are ranked right."""
    got = {r.doc_id: r for r in queries.op3_quality_cnn(spark, DATA).collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    assert set(got) == docs and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    marks = [(r.quality, got[r.doc_id].score) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out and r.quality is not None]
    good, bad = ([s for q, s in marks if q == k] for k in (1, 0))
    assert good and bad and np.mean([a > b for a in good for b in bad]) > 0.9
