"""Secrets in texts with very many matches, and in odd ones."""

import re
import time

from chronopanel.llm import secrets

SCHEMA = "doc_id bigint, text string"


def spans_of(text):
    found = [(m.start(), k, m.end(), r.kind) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.regex, text) if len(m[r.group]) >= r.least]
    return [(a, e, kind) for a, _, e, kind in sorted(found)]


def redacted(text, mark="[SECRET]"):
    out, at = [], 0
    for a, e, _ in spans_of(text):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def test_many_matches(spark):
    text = "".join(f"token=abcdef{k % 10} é" for k in range(100_000))
    docs = spark.createDataFrame([(1, text)], SCHEMA)
    began = time.time()
    scanned = secrets.scan(docs)
    assert [tuple(x) for x in scanned.first().spans] == spans_of(text)
    assert secrets.redact(scanned).first().text == redacted(text)
    assert time.time() - began < 60


def test_unbroken_runs(spark):
    texts = ["eyJ" * 100_000 + " x.eyJ", "token" + " " * 200_000, "AKIA" * 50_000, "f" * 300_000, "a-eyJab.eyJcd.ef eyJab.eyJcd.ef"]
    began = time.time()
    got = {r.text: [tuple(x) for x in r.spans] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert all(got[t] == spans_of(t) for t in texts)
    assert time.time() - began < 60


def test_redaction_keeps_all_else(spark):
    texts = ["﻿secret=abcdefgh﻿", "😀 token=abcdefgh😀 AKIA" + "B2" * 12, "secret=deadbeefdeadbeefdeadbeefdeadbeef!", "passwd=abcdef" * 3, "", "nothing here"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None), (9, None)], SCHEMA)
    got = {(r.doc_id, r.text) for r in secrets.redact(secrets.scan(docs)).collect()}
    assert got == {(i, redacted(t)) for i, t in enumerate(texts)} | {(9, None)}


def test_copies_meet_in_many_tasks(spark):
    docs = spark.createDataFrame([(i, "the password: abcdef1") for i in range(2000)] + [(5000, "plain")], SCHEMA)
    got = secrets.scan(docs).where("size(spans) = 1 and spans[0].kind = 'assign'")
    assert got.count() == 2000
    plan = secrets.scan(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
