"""Archives are bounded in bytes, whatever the records' sizes are."""

import random

from chronopanel.llm import warc


def test_long_records_begin_new_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LINE_BYTES", 1000)
    monkeypatch.setattr(warc, "LINES", 4)
    rng = random.Random(0)
    rows = [(k, "u", "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice((0, 10, 700, 9000))))) for k in range(120)]
    # pages of many sizes, in one task; every archive holds 4 lines of 1000 bytes and one record's excess
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), str(tmp_path / "a"))
    files = list((tmp_path / "a").glob("*.txt"))
    lead = len(warc.fit_dictionary(spark.createDataFrame(rows, "page_id bigint, url string, html string")))
    assert len(files) > 20 and max(f.stat().st_size for f in files) < lead + 4 * 1000 + 9500
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == [(k, html) for k, _, html in rows] and all(r.problem is None for r in got)
