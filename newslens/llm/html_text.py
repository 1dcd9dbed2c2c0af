"""HTML extraction: the main text of a page, by the text-to-tag ratio of its lines.

The standard library's streaming parser sends events; block-level tags cut the text into lines. Each line knows its length,
how many tags stood in it, how much of it is link text, the elements around it, and whether one of them is boilerplate by
its kind (nav, footer, form, script ...), role, or a word of its class or id (see the fixed lists). Such a word doesn't count
on an element that holds most of the page's text, if no article or main element stands outside it, nor if nothing were left;
inside an article or main element a word that names no advert only lowers the ratio to WORDED of what it is, and text that reaches
the threshold even so stays, with its headings.
Boilerplate lines have ratio 0. The ratios, in page order, are smoothed by a Gaussian; lines at or above the standard deviation of the smoothed
ratios form clusters, and the clusters' text votes for the element that holds the content: the article or main element
around most of it, with the article elements beside it whose mean smoothed ratio reaches the threshold, else the innermost element that holds nearly all of it. All other lines of that element which aren't
boilerplate belong to the content too, however short. Outside an article or main element, lines under the threshold count
only as headings, paragraphs, list items, quotes and the like, and not when links make up most of them.

Cases: null, empty and text-free pages give an empty text; broken markup is read as far as the parser goes, p, li and the
like being closed where HTML implies it; pages of any length and depth are read whole, without recursion; repeated rows
repeat; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from newslens.llm.common import as_text, byte_chunks

CHUNK_BYTES = 4 << 20
SIGMA = 1.0
RADIUS = 3
#: Share of the clusters' text that the content element must hold.
HOLDS = 0.9
LINK_SHARE = 0.6
#: What a word of class or id leaves of the ratio of lines inside an article or main element.
WORDED = 0.5

# --- fixed values: kinds of elements and words that name boilerplate --------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead title tr ul noscript template".split())
SKIPPED = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input menu nav noscript object option script search "
    "select style svg template textarea title video".split())
TEXT_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre dd dt td th caption figcaption summary".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"body", "caption", "head", "html", "legend", "li", "noscript", "summary", "tbody", "td", "template", "tfoot", "th", "thead", "title", "tr", "dd", "dt"}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMED = BLOCK - {"html", "body", "main"}
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
ADVERT_WORDS = frozenset("ad ads adbox adsense advert adverts advertisement advertisements advertising adslot".split())
WORDS = COMMENT_WORDS | ADVERT_WORDS | frozenset(
    "banner breadcrumb breadcrumbs byline "
    "consent cookie cookies copyright disclaimer donate footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination paywall popup privacy promo promoted promotion "
    "recommendations recommended related share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "tags teaser toolbar widget widgets".split())
#: Words that don't mark boilerplate inside an article or main element, where they name its own head.
HEAD_WORDS = frozenset("header banner byline masthead".split())
# --- end fixed values ---------------------------------------------------------------------------------------

_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])").findall
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I).search


class Lines(HTMLParser):
    """Cuts a page into lines: (text, tags, link characters, kind of the innermost block, skipped). ``spans`` has, for each
    element in order of its start, its kind and the lines from and up to which it reaches."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, str, bool]] = []
        self.open: list[tuple[str, int, str]] = []  # kind, number of the element, why it is skipped
        self.spans: list[list] = []
        self.parents: list[int] = []  # of each span, the number of the element around it, or -1
        self.worded: list[int] = []  # numbers of the elements that only a word of class or id marks
        self.adverts: set[int] = set()  # those of them that a word names an advert
        self.skips = self.words = self.mains = self.links = 0
        self.text: list[str] = []
        self.tags = self.link_chars = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.link_chars, self.open[-1][0] if self.open else "", self.skips > self.words))
        if self.text:
            self.text = []
            self.tags = self.link_chars = 0

    def why_skipped(self, tag: str, attrs: list) -> str:
        if tag in SKIPPED or (tag == "header" and not self.mains):
            return tag
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _hidden(value or "")):
                return "hidden"
            if name == "role" and value in ROLES:
                return "role"
            if name in ("class", "id") and value and tag in NAMED:
                words = {w.lower() for w in _word(value)}
                if words & COMMENT_WORDS:
                    return "comments"
                if words & (WORDS - HEAD_WORDS if self.mains else WORDS) and tag != "article":
                    return "words"
        return ""

    def close_to(self, at: int) -> None:
        while len(self.open) > at:
            kind, number, why = self.open.pop()
            self.spans[number][2] = len(self.lines)
            self.skips -= bool(why)
            self.words -= why == "words"
            self.mains -= kind in ("article", "main")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        block = tag in BLOCK
        if block:
            self.flush()
            self.tags = 1
            closes = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            while closes and self.open and self.open[-1][0] in closes:
                self.close_to(len(self.open) - 1)
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        why = self.why_skipped(tag, attrs)
        if tag in ("article", "main") and not why and self.skips:
            # the content can't stand in a menu: something before it was never closed
            first = next(i for i, e in enumerate(self.open) if e[2])
            if not any(e[2] in ("comments", "hidden", "template", "noscript") for e in self.open):
                self.close_to(first)
        if tag == "a":
            self.links += 1
        if block or why:
            if why and not block:
                self.flush()
            self.parents.append(self.open[-1][1] if self.open else -1)
            if why == "words":
                self.worded.append(len(self.spans))
                if any(name in ("class", "id") and value and ADVERT_WORDS & {w.lower() for w in _word(value)} for name, value in attrs):
                    self.adverts.add(len(self.spans))
            self.open.append((tag, len(self.spans), why))
            self.spans.append([tag, len(self.lines), 0])
            self.skips += bool(why)
            self.words += why == "words"
            self.mains += tag in ("article", "main")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self.flush()
                self.close_to(at)
                return
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.text.append(" ")

    def handle_data(self, data: str) -> None:
        if self.skips and self.open[-1][0] in ("script", "style"):
            return
        self.text.append(data)
        if self.links:
            self.link_chars += len(data)


def smoothed(ratios: list[float], sigma: float = SIGMA, radius: int = RADIUS) -> list[float]:
    """Gaussian smoothing; at the ends the weights that remain are scaled up."""
    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(radius + 1)]
    out = []
    for i in range(len(ratios)):
        lo, hi = max(0, i - radius), min(len(ratios), i + radius + 1)
        own = [weights[abs(i - k)] for k in range(lo, hi)]
        out.append(sum(w * r for w, r in zip(own, ratios[lo:hi])) / sum(own))
    return out


def judged(parser: Lines) -> list[tuple[str, int, int, str, bool]]:
    """The lines, those in elements that a word of class or id marks skipped as well; not by an element that holds most of
    the page's own text, unless an article or main element stands outside it."""
    lines = parser.lines
    own = [0, *accumulate(0 if skipped else max(0, len(text) - linked) for text, _, linked, _, skipped in lines)]
    contents = [(a, b) for kind, a, b in parser.spans if kind in ("article", "main") and own[b] > own[a]]
    marked = [False] * len(lines)
    for number in parser.worded:
        _, a, b = parser.spans[number]
        if (own[b] - own[a]) * 2 < own[-1] or any(d <= a or c >= b for c, d in contents):
            marked[a:b] = [True] * (b - a)
    if all(m or line[4] for m, line in zip(marked, lines)):
        return lines
    return [(*line[:4], line[4] or m) for line, m in zip(lines, marked)]


def _deviation(values: list[float]) -> float:
    mean = sum(values) / len(values)
    return math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


def unmarked(parser: Lines, lines: list[tuple[str, int, int, str, bool]], threshold: float) -> tuple[list[tuple[str, int, int, str, bool]], bool]:
    """The lines, without the marks of elements inside an article or main element that only a word marks and whose lowered mean
    ratio reaches the threshold; and whether there are such."""
    contents = [(a, b) for kind, a, b in parser.spans if kind in ("article", "main")]
    free = set()
    for number in parser.worded:
        _, a, b = parser.spans[number]
        own = [k for k in range(a, b) if not parser.lines[k][4]]  # not skipped for another reason
        if not own or number in parser.adverts or not any(c <= a and b <= d for c, d in contents):
            continue
        chars, linked = sum(len(lines[k][0]) for k in own), sum(lines[k][2] for k in own)
        if linked <= LINK_SHARE * chars and WORDED * chars / max(1, sum(lines[k][1] for k in own)) >= threshold:
            free.update(k for k in own if lines[k][4])
    return ([(*line[:4], line[4] and k not in free) for k, line in enumerate(lines)], True) if free else (lines, False)


def main_text(html: str) -> str:
    """The blocks of the page's content, joined by two line feeds."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    parser.close_to(0)
    lines = judged(parser)
    ratio = [0.0 if skipped else len(text) / max(1, tags) for text, tags, _, _, skipped in lines]
    if not any(ratio):
        return ""
    smooth = smoothed(ratio)
    threshold = _deviation(smooth)
    lines, changed = unmarked(parser, lines, threshold)
    if changed:
        ratio = [0.0 if skipped else len(text) / max(1, tags) for text, tags, _, _, skipped in lines]
        smooth = smoothed(ratio)
        threshold = _deviation(smooth)
    inside = [r > 0 and s >= threshold for r, s in zip(ratio, smooth)]
    if not any(inside):
        inside = [r > 0 for r in ratio]
    votes = [0, *accumulate(len(line[0]) * chosen for line, chosen in zip(lines, inside))]
    first, end, strict, others = 0, len(lines), True, []
    named = [(votes[b] - votes[a], i) for i, (kind, a, b) in enumerate(parser.spans) if kind in ("article", "main")]
    if named and max(named)[0] * 2 >= votes[-1]:
        best = max(named)[1]
        (kind, first, end), strict = parser.spans[best], False
        for i, (other, a, b) in enumerate(parser.spans):
            # an article may be set in several elements side by side
            if i != best and kind == other == "article" and parser.parents[i] == parser.parents[best] and votes[b] > votes[a]:
                shown = [k for k in range(a, b) if not lines[k][4]]
                linked, chars = sum(lines[k][2] for k in shown), sum(len(lines[k][0]) for k in shown)
                if sum(smooth[k] for k in shown) >= threshold * len(shown) and linked <= LINK_SHARE * chars:
                    others.append((a, b))
    else:
        for _, a, b in parser.spans:  # a later one that holds the text lies within the earlier ones
            if votes[b] - votes[a] >= HOLDS * votes[-1]:
                first, end = a, b
    blocks = []
    for i in (i for a, b in sorted([(first, end), *others]) for i in range(a, b)):
        text, _, linked, kind, skipped = lines[i]
        if not skipped and not (strict and (linked > LINK_SHARE * len(text) or not (inside[i] or kind in TEXT_BLOCKS))):
            blocks.append(text)
    return "\n\n".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars bigint) of every page; see the module's head."""

    def run(batches):
        for part in byte_chunks(batches, "html", CHUNK_BYTES):
            texts = [main_text(page) if page else "" for page in as_text(part.column("html"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["id", "url", "text", "n_chars"])

    given = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    out = given.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
