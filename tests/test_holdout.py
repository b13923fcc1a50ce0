"""The rows of region_holdout_rows by invariants."""

from chronopanel.operators import splits
from chronopanel.plans import queries

DATA = "/root/testdata/sf0.1"


def test_rows(spark):
    got = queries.QUERIES["region_holdout_rows"](spark, DATA)
    rows = {r.doc_id: (r.lang, r.split) for r in got.collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    assert {d: lang for d, (lang, _) in rows.items()} == {r.doc_id: r.lang for r in docs.collect()}
    assert all((split == "test") == (lang in ("fr", "de")) for lang, split in rows.values())
    rest = [split for _, split in rows.values() if split != "test"]
    assert rest.count("validation") == int(len(rest) * 0.1) and set(rest) == {"train", "validation"}
    again = splits.hold_out(docs.repartition(13), "lang", ["fr", "de"], "doc_id")
    assert {r.doc_id: (r.lang, r.split) for r in again.collect()} == rows
