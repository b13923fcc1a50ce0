"""Secret scans through a trigram inverted index, in DataFrame functions alone.

From each rule's regex a Boolean trigram query is derived: in every match some alternative of each literal
stretch occurs, and so do all its trigrams. The index lists, for the trigrams of all queries, the texts
that hold them (in lower case; a text by its hash, so copies are indexed once). Postings of an
alternative's trigrams are intersected, alternatives of a stretch are united, stretches are intersected.
The texts that remain are candidates, and only there the rule's regex runs. A rule without mandatory
trigrams scans every text.

Copies of one text may be many, so the candidates meet the rows under one of `SALTS` salts.

A text may have any number of matches: running sums go in blocks, so n matches take n^1.5 small steps, and
a text is redacted from chunks of it, so that a place is found without reading up to it.

Hashes that collide only add candidates. Spans count code points, with exclusive ends; matches of one rule
are leftmost and do not overlap, and matches that are too short are dropped after matching. Null texts
count as empty and have no spans. Repeated rows and all other columns stay; a column named `spans` is
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import kept_apart


@dataclass(frozen=True)
class Rule:
    """A regex; of its matches those count whose group `group` has at least `least` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    # begins where a run of its characters does, else each eyJ of a run would read on to the run's end
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + ADDED
_MOST = 64
SALTS = 32
_CHUNK = 4096


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """Stretches, each a list of alternatives, each a set of trigrams in lower case. Empty: scan all."""
    from re import _constants as c
    from re import _parser

    stretches: list[list[frozenset[str]]] = []

    def close(words: set[str]) -> set[str]:
        if all(len(w) >= 3 for w in words):
            stretches.append(sorted((frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words), key=sorted))
        return {""}

    def exact(items: list) -> set[str] | None:
        """All strings that items match, if they are few."""
        words = {""}
        for op, value in items:
            if op is c.LITERAL:
                more = {chr(value).lower()}
            elif op is c.IN and all(x[0] is c.LITERAL for x in value):
                more = {chr(x[1]).lower() for x in value}
            elif op is c.SUBPATTERN:
                more = exact(list(value[3]))
            elif op is c.BRANCH:
                parts = [exact(list(x)) for x in value[1]]
                more = None if None in parts else set().union(*parts)
            elif op is c.MAX_REPEAT and value[1] <= 1:
                inner = exact(list(value[2]))
                more = inner if inner is None or value[0] else inner | {""}
            else:
                more = None
            if more is None or len(words) * len(more) > _MOST:
                return None
            words = {a + b for a, b in product(words, more)}
        return words

    words = {""}
    for item in _parser.parse(regex):
        more = exact([item])
        if more is None:
            words = close(words)
        elif len(words) * len(more) > _MOST or ("" in more and len(more) > 1 and all(len(w) >= 3 for w in words)):
            words = close(words)  # what may be absent adds nothing mandatory
        else:
            words = {a + b for a, b in product(words, more)}
    close(words)
    return stretches


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(hash, kinds) of the texts in column `text` that fulfil some rule's trigram query."""
    parts = [
        (rule.kind, len(query), s, b, len(branch), t)
        for rule in rules
        for query in [trigram_query(rule.regex)]
        for s, stretch in enumerate(query)
        for b, branch in enumerate(stretch)
        for t in sorted(branch)
    ]
    grams = sorted({p[-1] for p in parts})
    row = "named_struct('kind', '{}', 'stretches', {}, 'stretch', {}, 'branch', {}, 'need', {}, 'gram', '{}')"
    queries = texts.sparkSession.range(1).selectExpr("inline(array(" + ", ".join(row.format(*(str(x).replace("'", "\\'") for x in p)) for p in parts) + "))")
    lower = texts.select(F.xxhash64("text").alias("hash"), F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    held = lower.select("hash", present.alias("grams")).groupBy("hash").agg(F.array_distinct(F.flatten(F.collect_set("grams"))).alias("grams"))
    postings = held.select("hash", F.explode("grams").alias("gram"))
    branches = postings.join(F.broadcast(queries), "gram").groupBy("hash", "kind", "stretches", "stretch", "branch", "need").agg(F.count("*").alias("n")).where("n = need")
    stretches = branches.groupBy("hash", "kind", "stretches").agg(F.count_distinct("stretch").alias("n")).where("n = stretches")
    return stretches.groupBy("hash").agg(F.collect_set("kind").alias("kinds"))


def _running(items: str, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What step (of a state and an item: the next state, and a value of type `kind` or null) gives for the
    items in turn, without nulls. items: a column. Values gather in blocks, as to add to an array copies it."""
    size, none = F.size(items), F.expr(f"cast(array() as array<{kind}>)")
    width = F.greatest(F.lit(64), F.ceil(F.sqrt(size)).cast("int"))
    starts = F.when(size > 0, F.sequence(F.lit(1), F.greatest(size, F.lit(1)), width))

    def one(t: Column, x: Column) -> Column:
        after, value = step(t["state"], x)
        return F.struct(after.alias("state"), F.when(value.isNull(), t["out"]).otherwise(F.concat(t["out"], F.array(value))).alias("out"))

    def block(done: Column, at: Column) -> Column:
        begun = F.struct(F.element_at(done, -1)["state"].alias("state"), none.alias("out"))
        return F.concat(done, F.array(F.aggregate(F.slice(items, at, width), begun, one)))

    blocks = F.aggregate(starts, F.array(F.struct(state.alias("state"), none.alias("out"))), block)
    return F.coalesce(F.flatten(F.transform(blocks, lambda x: x["out"])), none)


def _with_spans(texts: DataFrame, text: str, rules: tuple[Rule, ...], wanted: Callable[[Rule], Column | None]) -> DataFrame:
    """texts with, for each rule, start and end of each match that is long enough in column __<kind>, where
    wanted (a condition, or None for all rows) holds. Only texts with a match are gone through again."""
    pattern = {r.kind: F.lit(r.regex if r.group else _at_least(r)) for r in rules}
    found, marks, spans = {}, {}, {}
    for r in rules:
        p, f, m = pattern[r.kind], f"__found_{r.kind}", f"__marks_{r.kind}"
        matches, condition = F.regexp_extract_all(text, p, F.lit(0)), wanted(r)
        found[f] = matches if condition is None else F.when(condition, matches)
        sizes = F.transform(f, F.length)
        held = F.transform(F.regexp_extract_all(text, p, F.lit(r.group)), F.length) if r.group else sizes
        zipped = F.arrays_zip(F.transform(F.split(text, p, -1), F.length).alias("gap"), sizes.alias("size"), held.alias("held"))
        marks[m] = F.when(F.size(f) > 0, zipped)

        def step(at: Column, x: Column, least: int = r.least) -> tuple[Column, Column]:
            start = at + x["gap"]
            end = start + F.coalesce(x["size"], F.lit(0))
            return end, F.when(x["held"] >= least, F.struct(start.alias("start"), end.alias("end")))

        spans[f"__{r.kind}"] = _running(m, F.lit(0), step, "struct<start:int,end:int>")
    return texts.withColumns(found).withColumns(marks).withColumns(spans)


def _at_least(rule: Rule) -> str:
    """The same matches, without those that are too short, where the regex ends in a greedy class: a short
    match there takes the whole run, in which no longer one can begin."""
    fixed = re.match(r"^((?:[A-Za-z]*))(\[[^\]]+\])\+$", rule.regex)
    return f"{fixed[1]}{fixed[2]}{{{rule.least - len(fixed[1])},}}" if fixed and rule.least > len(fixed[1]) else rule.regex


def scan(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with `spans`: array of (start, end, kind) in order of start, then of the rules."""
    return kept_apart(docs.drop("spans"), lambda d, text: _scanned(d, text, rules), text_col)


def _scanned(docs: DataFrame, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = candidates(docs.select(own.alias("text")), rules).select(F.col("hash").alias("__hash"), F.col("kinds").alias("__kinds"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    keyed = docs.withColumns({"__text": own, "__hash": F.xxhash64(own), "__salt": salt}).join(found, ["__hash", "__salt"], "left")
    matched = _with_spans(keyed, "__text", rules, lambda r: F.array_contains("__kinds", r.kind) if trigram_query(r.regex) else None)

    def ranked(kind: str, rank: int) -> Column:
        return F.transform(f"__{kind}", lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rule"), x["end"].alias("end")))

    names = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform(F.array_sort(F.concat(*[ranked(r.kind, i) for i, r in enumerate(rules)])), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(names, x["rule"]).alias("kind")))
    return matched.withColumn("spans", spans).select(*docs.columns, "spans")


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """What scan() returned, without `spans`, and with each stretch of spans in the text replaced by mark."""
    return kept_apart(scanned, lambda d, text: _redacted(d, text, mark), text_col)


def _redacted(scanned: DataFrame, text_col: str, mark: str) -> DataFrame:
    text = F.col(text_col)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        before = F.struct(at.alias("start"), x["start"].alias("end"))
        return F.greatest(at, x["end"]), F.when(x["start"] >= at, before)

    some = F.size("spans") > 0
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    rest = F.struct(F.array_max(F.transform("spans", lambda x: x["end"])).alias("start"), F.length(text).alias("end"))
    d = scanned.withColumns({"__chunks": F.when(some, chunks), "__between": F.when(some, F.concat(_running("spans", F.lit(0), step, "struct<start:int,end:int>"), F.array(rest)))})

    def piece(x: Column) -> Column:
        first, last = (F.floor(at / _CHUNK).cast("int") for at in (x["start"], F.greatest(x["start"], x["end"] - 1)))
        one = F.coalesce(F.get("__chunks", first), F.lit(""))
        held = F.when(first == last, one).otherwise(F.array_join(F.slice("__chunks", first + 1, last - first + 1), ""))
        return F.substring(held, x["start"] - first * _CHUNK + 1, x["end"] - x["start"])

    changed = F.array_join(F.transform("__between", piece), mark)
    return d.withColumn(text_col, F.when(some, changed).otherwise(text)).drop("spans", "__chunks", "__between")
