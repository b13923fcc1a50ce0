"""The pipeline's stages on odd rows: nulls in each column, empty and very long texts, ties, repeated rows, empty
tables and columns whose names clash, each against a plain loop over the rows."""

import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from chronopanel.llm import byte_bpe, quality_cnn, quality_rules, secrets
from chronopanel.llm.common import table

DATA = "/root/testdata/sf0.001"
EXTRA = ["score", "kept", "cleaned", "lost", "n_words", "spans", "id", "key", "node", "root", "hash", "fingerprint", "text_hash", "ids", "start", "length", "sequence_id", "label", "quality", "y"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in EXTRA)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, words):
    return " ".join(f"w{seed}x{k}" + "." * (k % 11 == 10) for k in range(words)) + "."


ODD = [
    (1, None), (1, None), (2, ""), (3, " \n\t "), (4, "few words."), (None, prose(1, 80)), (None, None),
    (5, prose(2, 120)), (5, prose(2, 120)), (6, prose(2, 120)), (7, prose(2, 120) + " End."),
    (8, prose(3, 60) + "\nHome | News | About | Contact\n" + prose(4, 60)), (9, prose(5, 60) + "\nWe use cookies."),
    (10, "\n".join(" | ".join(f"c{i}{k}" for i in range(9)) for k in range(9))),
    (11, prose(6, 30_000)), (12, prose(7, 60) + " password: abcdef12 and AKIA" + "B2" * 9 + ". " + "0f" * 20 + "."),
    (13, "é😀 " * 60 + "."), (14, prose(8, 30) + "\n" + "# $ % & " * 40), (15, "same same same " * 40 + "."),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None if k % 5 == 0 else len(t or ""), *["x"] * len(EXTRA)) for k, (d, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    assert df.columns == corpus_pipeline.COLUMNS
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty(spark, empty, name, stage):
    assert stage(spark, empty, DATA).count() == 0


def test_other_columns_stay(spark, docs):
    """Rows are found again with their lang, source and, where the text is as it was, n_chars."""
    given = {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for r in stage(spark, docs, DATA).collect():
            same = {g for g in given if g[0] == r.doc_id and g[2:4] == (r.lang, r.source)}
            assert (r.doc_id, r.text, r.lang, r.source, r.n_chars) in same or (same and r.n_chars == len(r.text))


def test_classifier(spark, docs):
    known = table(spark, DATA, "documents")
    both = known.unionByName(docs.select(*known.columns))
    model = quality_cnn.fit(both, table(spark, DATA, "labels"))
    given = [(r.doc_id, r.text) for r in both.collect()]
    assert rows_of(corpus_pipeline.quality_classifier(spark, both, DATA)) == Counter(x for x in given if model.score((x[1] or "").encode()) >= 0.5)


def passes(line):
    """A line's verdict by the four rules."""
    marks = len(re.findall(quality_rules.SYMBOLS, line)) + 2 * line.count("!!")
    separators, words = len(re.findall(quality_rules.SEPARATOR, line)), line.count(" ") + 1
    boilerplate = words <= 20 and re.search(quality_rules.PHRASES, line)
    return bool(re.search(quality_rules.SENTENCE_END, line)) and marks <= 0.05 * len(line) and (separators < 3 or separators * 6 < words) and not boilerplate


def ruled(text):
    """The cleaned text, or None for a document that is rejected."""
    words = WORD.findall(text or "")
    grams = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(grams)
    repeated = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return None
    lines = [x for x in text.split("\n") if WORD.search(x)]
    good = [x for x in lines if passes(x)]
    whole = sum(map(len, lines))
    return None if 1 - sum(map(len, good)) / whole > 0.3 else text if good == lines else "\n".join(good)


def test_rules(spark, docs):
    known = table(spark, DATA, "documents")
    for given in (docs, known):
        want = Counter((r.doc_id, t) for r in given.collect() if (t := ruled(r.text)) is not None)
        assert rows_of(corpus_pipeline.rules(spark, given, DATA)) == want and want


def test_near_dedup(spark, docs):
    """One row of each group; ties and repeated rows leave one, and a null id goes before any other only alone."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for _, t in ODD for w in [(t or "").lower().split()]]
    group = list(range(len(ODD)))
    for a in range(len(ODD)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {}
    for g, (d, _) in zip(group, ODD, strict=True):
        first[g] = min(first.get(g, (True, 0)), (d is None, d or 0))
    got = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(first.values())
    assert set(rows_of(got)) <= set(ODD)


def redacted(text):
    spans = sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.regex, text) if len(m[r.group]) >= r.least)
    out, at = [], 0
    for a, e in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def test_secret_scans(spark, docs):
    want = Counter((d, None if t is None else redacted(t)) for d, t in ODD)
    assert rows_of(corpus_pipeline.secret_scans(spark, docs, DATA)) == want
    assert sum("[SECRET]" in (t or "") for _, t in want) == 1


def test_packing(spark, docs):
    enc = byte_bpe.TreeEncoder(P.path("byte_bpe_50k.tiktoken"))
    ids = Counter((d, np.append(enc.encode(t or ""), 0).astype("<u4").tobytes()) for d, t in ODD)
    got = corpus_pipeline.pack(spark, docs, DATA).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == np.concatenate([[0], s.length.cumsum()[:-1]]).astype(int).tolist()
    whole = Counter()  # pieces of rows that share an id are told apart by their length alone
    for (d, n), g in got.groupby([got.doc_id.fillna(-1), "doc_tokens"]):
        copies = int(g.length.sum() // n)
        assert g.length.sum() == copies * n
        whole[(None if d == -1 else int(d), int(n))] += copies
    assert whole == Counter((d, len(x) // 4) for d, x in ids.elements())
