"""Main text of web pages by the distribution of text over their lines.

A page is read tag by tag. Each block (a paragraph, an item, a cell, what stands between two line breaks) is a line;
inline markup goes, character references are decoded, white space becomes one space. Text in scripts, styles, heads,
comments and in what a page says to be a menu, header, footer, sidebar, notice, advert, form or reader comment (by
element, role, class or id) is stripped, and its lines stay behind as lines of length zero.

Then lengths are summed over sliding windows of `WINDOW` lines. A surge is a line with text whose window reaches the
threshold, the dive after it the first line whose window is empty; the text between them is kept, in page order. On a
page that marks its article (an article or main element, or a block of such a class) lines outside it have length zero
and the threshold is one character, so all of the article stays, however short. On others link texts and lines that are
mostly links have no length,
the threshold is `SURGE` characters or half the page's largest window, and stretches with less than a quarter of the
largest one's text (notices outside any marked element) go.

A null or empty page has the empty text, as has one without text outside the stripped elements. Rows are rows: those
that repeat an id or a page each get theirs, and rows without an id or url too. Unclosed and misplaced tags are taken
as browsers do, an unclosed comment or script reaches to the end. Every step is linear in the page's length. Columns
other than the id, the url and the page are not passed on, so that no name can clash.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 86
#: Pages that are extracted before their texts are handed on.
ROWS = 64

# Names of HTML elements, and words of classes and ids by which pages mark what is not their article.
RAW = frozenset("script style title textarea template noscript iframe noembed noframes xmp svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav"
    " ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
SCOPES = frozenset("html table td th caption button object template".split())
STRIPPED = frozenset("aside audio canvas datalist footer head menu nav object search video".split())
STRIPPED_UNLESS_AROUND = frozenset("button dialog fieldset form header label select".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion related recommended recommendations".split())
OUTSIDE = frozenset(
    "sidebar aside breadcrumb breadcrumbs nav navbar navigation menu submenu pagination pager footer share sharing social contentinfo complementary hidden".split()
)
HEADERS = frozenset("header masthead".split())
NOTICES = frozenset(
    "ad ads adsbygoogle leaderboard advert adverts advertisement advertisements advertising adsense adbox adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup login search form topbar toolbar widget".split()
)
ARTICLE_WORDS = frozenset("article articlebody content entry maincontent post story".split())
NOT_A_MARK = frozenset("has no non not with without".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_END = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in RAW}
_CLOSED_BY = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
_WITHIN = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",), "option": ("select",)}


def _marks(name: str, attributes: str) -> tuple[int, int]:
    """How an element is stripped (0 not, 1 unless an article is in it, 2 always), and how it marks the article (0 to 3)."""
    strip = 2 if name in STRIPPED else 1 if name in STRIPPED_UNLESS_AROUND else 0
    article = 3 if name == "article" else 2 if name == "main" else 0
    if not attributes or attributes.isspace():
        return strip, article
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key == "hidden" or (key == "style" and "display:none" in re.sub(r"\s", "", value.lower())) or (key == "aria-hidden" and value.lower() == "true"):
            strip = 2
        elif key == "role" and value.lower() in ("article", "main"):
            article = max(article, 3 if value.lower() == "article" else 2)
        elif key == "itemprop" and value.lower() == "articlebody":
            article = 3
        elif key in ("class", "id", "role") and name not in ("html", "body"):
            for token in value.split():
                words = [w.lower() for w in _WORD.findall(token)]
                if NOT_A_MARK.intersection(words):
                    continue
                words += [a + b for a, b in zip(words, words[1:], strict=False)]
                about = ARTICLE_WORDS.intersection(words)
                if name == "main" or (name == "article" and not COMMENTS.intersection(words)):
                    continue
                if (COMMENTS | OUTSIDE).intersection(words):
                    strip = 2
                elif HEADERS.intersection(words) or NOTICES.intersection(words):
                    strip = strip if about and HEADERS.intersection(words) else max(strip, 1)
                elif about and name in ("div", "section", "td"):
                    article = max(article, 1)
    return strip, article


class _Page:
    """Lines of a page: their text, its length without links, and how strongly the article is marked there."""

    def __init__(self, source: str):
        self.lines: list[tuple[str, int, int]] = []
        self.piece: list[str] = []
        self.links = 0
        self.stripped = False
        #: Open elements: name, strip, article, whether in a link, and the last block and scope before them.
        self.open: list[tuple[str, int, int, bool, int, int]] = []
        self.where: dict[str, list[int]] = defaultdict(list)
        self.strip, self.article, self.link, self.block, self.scope = 0, 0, False, -1, -1
        self._read(source)
        self._line()

    def _read(self, source: str) -> None:
        at, end, no_more = 0, len(source), set()
        while at < end:
            lt = source.find("<", at)
            if lt < 0:
                return self._text(source[at:])
            after = source[lt + 1 : lt + 2]
            tag = _TAG.match(source, lt)
            if not tag and after not in ("!", "?", "/"):
                self._text(source[at : lt + 1])
                at = lt + 1
                continue
            if lt > at:
                self._text(source[at:lt])
            if not tag:
                comment = source.startswith("<!--", lt)
                stop = source.find("-->", lt + 2) if comment else source.find(">", lt)
                at = end if stop < 0 else stop + (3 if comment else 1)
                continue
            stop = tag.end()
            while (m := _STOP.search(source, stop)) and m[0] != ">":
                stop = m.end()
                before = m.start() - 1
                while source[before].isspace():
                    before -= 1
                if source[before] == "=" and m[0] not in no_more:
                    close = source.find(m[0], stop)
                    if close < 0:
                        no_more.add(m[0])
                    else:
                        stop = close + 1
            at = m.end() if m else end
            name = tag[2].lower()
            if tag[1]:
                self._end(name)
            elif name in RAW:
                close = _END[name].search(source, at)
                at = close.start() if close else end
                if name not in ("script", "style", "template", "svg"):
                    self._break(name)
            else:
                self._start(name, source[tag.end() : at].rstrip(">"))

    def _text(self, raw: str) -> None:
        if self.strip:
            self.stripped = self.stripped or not raw.isspace()
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.piece.append(text)
        if self.link:
            self.links += len(" ".join(text.split()))

    def _line(self) -> None:
        text = " ".join("".join(self.piece).split())
        if text or self.stripped:
            self.lines.append((text, 0 if 2 * self.links > len(text) else len(text) - self.links, self.article))
        self.piece, self.links, self.stripped = [], 0, False

    def _break(self, name: str) -> None:
        if name in BLOCKS:
            self._line()

    def _start(self, name: str, attributes: str) -> None:
        self._break(name)
        if name in VOID:
            return
        if self.where["head"] and name != "head":
            self._pop(self._last("head"))
        if name in BLOCKS and self._last("p") > self.scope:
            self._pop(self._last("p"))
        if name in _CLOSED_BY:
            within = max(map(self._last, _WITHIN[name]))
            if (at := min((x for x in map(self._last, _CLOSED_BY[name]) if x > within), default=-1)) >= 0:
                self._pop(at)
        strip, article = _marks(name, attributes)
        if name == "header" and strip == 1 and self.article >= 2:
            strip = 0  # the article's own
        self.where[name].append(len(self.open))
        self.open.append((name, self.strip, self.article, self.link, self.block, self.scope))
        if article >= 2 and self.strip == 1:
            self.strip = 0
        self.strip, self.article, self.link = max(self.strip, strip), max(self.article, article), self.link or name == "a"
        if name in BLOCKS:
            self.block = len(self.open) - 1
        if name in SCOPES:
            self.scope = len(self.open) - 1

    def _last(self, name: str) -> int:
        at = self.where.get(name)
        return at[-1] if at else -1

    def _end(self, name: str) -> None:
        self._break(name)
        at = self._last(name)
        if at > (self.scope - (name in SCOPES) if name in BLOCKS or name in SCOPES else self.block):
            self._pop(at)
        elif at >= 0 and name in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
            self._pop(at)

    def _pop(self, at: int) -> None:
        while len(self.open) > at:
            name, self.strip, self.article, self.link, self.block, self.scope = self.open.pop()
            self.where[name].pop()


def between(lengths: list[int], window: int, surge: float) -> list[tuple[int, int]]:
    """Stretches from a surge to the last line with text before the dive."""
    sums, found, at = [sum(lengths[i : i + window]) for i in range(len(lengths))], [], 0
    while at < len(lengths):
        if lengths[at] and sums[at] >= surge:
            first = last = at
            while at < len(lengths) and sums[at]:
                last = at if lengths[at] else last
                at += 1
            found.append((first, last + 1))
        else:
            at += 1
    return found


def main_text(source: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = _Page(source or "").lines
    mark = max((article for text, _, article in lines if text), default=0)
    if mark >= 2:
        lengths, least = [len(text) if article >= mark else 0 for text, _, article in lines], 1
    else:
        lengths = [size if article >= mark else 0 for _, size, article in lines]
        least = min(surge, max((sum(lengths[i : i + window]) for i in range(len(lengths))), default=0) / 2)
    found = between(lengths, window, least)
    if not mark:
        weight = {s: sum(lengths[s[0] : s[1]]) for s in found}
        found = [s for s in found if 4 * weight[s] >= max(weight.values())]
    return " ".join(lines[i][0] for a, b in found for i in range(a, b) if lines[i][0] and lines[i][2] >= mark)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id and url of each page, text and n_chars (its code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
