"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import re

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from chronopanel.llm import byte_bpe, quality_cnn, secrets
from chronopanel.llm.common import stored, table

DATA = "/root/testdata/sf0.001"


def groups(texts):
    """Groups of texts linked by a Jaccard similarity of 0.8 or more of their sets of five words."""
    words = [t.encode().lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    return group


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    steps = [docs.orderBy("doc_id").toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), name)
        steps.append(docs.toPandas())
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            assert (steps[-1].n_chars == steps[-1].text.str.len()).all()
    given, good, ruled, alone, clean, packed = steps

    model = quality_cnn.fit(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
    assert set(good.doc_id) == {r.doc_id for r in given.itertuples() if model.score(r.text.encode()) >= 0.5}

    texts = dict(zip(good.doc_id, good.text, strict=True))
    assert 0 < len(ruled) <= len(good)
    for r in ruled.itertuples():
        lines = texts[r.doc_id].split("\n")
        assert len(texts[r.doc_id].split()) >= 50 and all(x in lines for x in r.text.split("\n"))

    ruled = ruled.sort_values("doc_id")
    first = {}
    for g, d in zip(groups(ruled.text.tolist()), ruled.doc_id, strict=True):
        first.setdefault(g, d)
    assert sorted(alone.doc_id) == sorted(first.values())

    before = dict(zip(alone.doc_id, alone.text, strict=True))
    assert set(clean.doc_id) == set(before)
    for r in clean.itertuples():
        spans = sorted((m.start(), m.end()) for rule in secrets.RULES for m in re.finditer(rule.regex, before[r.doc_id]) if len(m[rule.group]) >= rule.least)
        assert ("[SECRET]" in r.text) == bool(spans) or "[SECRET]" in before[r.doc_id]
        assert spans or r.text == before[r.doc_id]

    enc = byte_bpe.TreeEncoder(P.path("byte_bpe_50k.tiktoken"))
    pieces = {d: b"".join(map(bytes, g.sort_values("start").ids)) for d, g in packed.groupby("doc_id")}
    assert pieces == {r.doc_id: np.append(enc.encode(r.text), 0).astype("<u4").tobytes() for r in clean.itertuples()}
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
