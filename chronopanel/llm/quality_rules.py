"""Line-first quality rules, in DataFrame functions alone.

Each line that holds a word is judged by itself and fails by any of these rules:

* punctuation: nowhere in it does a sentence end;
* marks: symbols and doubled exclamation marks are more than `most_marks` of its characters;
* navigation: it has at least three separators of menus and tables, one for every six words or more;
* boilerplate: it has at most twenty words, among them a phrase of site furniture or licences.

Lines that fail are removed. A document is rejected if more than `most_lost` of its characters in lines
with words are lost, if it has fewer than `least_words` words, or if more than half of its words lie in
windows of three words that the text holds twice.

Null texts count as empty: no words, so rejected. Repeated rows each stay with their verdict. All columns
stay; columns named as a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import kept_apart

SENTENCE_END = r"""[.!?…。！？]["')\]»”’]*(?:\s|$)"""
MARKS = r"[#*$%&|<>]|!!"
SYMBOLS = r"[#*$%&|<>]"
SEPARATOR = r"(?: \| | » | › | · | > )"
BLANKS = r"[\x20\x09-\x0D]+"
PHRASES = (
    r"(?i)\b(?:enable javascript|javascript is disabled|we use cookies|accept (?:all )?cookies|cookie policy|privacy policy"
    r"|terms of (?:use|service)|all rights reserved|licensed under|sign in|log in|subscribe (?:now|to our)|share this"
    r"|read more|skip to (?:main )?content|lorem ipsum)\b"
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LEAST_WORDS = 50


def line_passes(line: Column, most_marks: float = 0.05) -> Column:
    size = F.length(line)
    words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    marks = size - F.length(F.regexp_replace(line, MARKS, ""))
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    return (
        F.rlike(line, F.lit(SENTENCE_END))
        & (marks <= most_marks * size)
        & ((separators < 3) | (separators * 6 < words))
        & ((words > 20) | ~F.rlike(line, F.lit(PHRASES)))
    )


def clean(docs: DataFrame, text_col: str = "text", least_words: int = LEAST_WORDS, most_lost: float = 0.3, most_marks: float = 0.05) -> DataFrame:
    """docs with MEASURES (bigint), base_failed, lost (share of characters in failed lines), kept (boolean)
    and cleaned (the text without failed lines)."""
    made = [*MEASURES, "base_failed", "lost", "kept", "cleaned"]
    return kept_apart(docs.drop(*made), lambda d, text: _cleaned(d, text, made, least_words, most_lost, most_marks), text_col)


def _cleaned(docs: DataFrame, text_col: str, made: list[str], least_words: int, most_lost: float, most_marks: float) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.withColumns({"__words": F.array_remove(F.split(text, BLANKS), ""), "__lines": F.split(text, "\n", -1)})
    window = lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2))
    with_word = F.filter("__lines", lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    some = F.size("__words") >= 3
    d = d.withColumns({
        "__windows": F.when(some, F.transform(F.sequence(F.lit(0), F.when(some, F.size("__words") - 3).otherwise(0)), window)).otherwise(F.expr("cast(array() as array<bigint>)")),
        "__lines": with_word,
        "word_chars": F.length(F.array_join("__words", "")).cast("bigint"),
    })
    # Windows are sorted only where some occur twice: neighbours are compared, then the words that they cover counted.
    repeated = F.size(F.array_distinct("__windows")) < F.size("__windows")
    d = d.withColumn("__sorted", F.when(repeated, F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    same = lambda x, i: F.coalesce(F.get("__sorted", i)["h"] == x["h"], F.lit(False))
    twice = F.filter("__sorted", lambda x, i: F.when(i > 0, same(x, i - 1)).otherwise(False) | same(x, i + 1))
    d = d.withColumns({"__at": F.array_sort(F.transform(twice, lambda x: x["at"])), "__good": F.filter("__lines", lambda x: line_passes(x, most_marks))})
    covered = F.aggregate(
        "__at",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("before")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["before"])).alias("n"), p.alias("before")),
    )["n"]
    chars = lambda c: F.length(F.array_join(c, ""))
    d = d.withColumns({
        "n_words": F.size("__words").cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
        "lost": F.coalesce(F.lit(1.0) - F.try_divide(chars("__good"), chars("__lines")), F.lit(0.0)),
        "cleaned": F.when(F.size("__good") == F.size("__lines"), text).otherwise(F.array_join("__good", "\n")),
        "__row": F.monotonically_increasing_id(),
    })
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # Filters on `kept` stay above the row number. Pushed below it they would compute all measures once for each use.
    d = d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= most_lost) & (F.col("__row") >= 0))
    return d.select(*docs.columns, *made)
