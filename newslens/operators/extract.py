"""Article extraction from a table of fetched pages.

Two stages, as Spark joins: cover pages -> candidate (newspaper, link,
headline) rows; candidates joined to article pages on link -> body.

* native path: regex column expressions (``page_anchors``, ``page_headline``,
  ``page_body``) that reproduce ``get_text(strip=True)`` on the fixture layout;
* rule path: per-site selector rules are *data* (one row per site, see
  ``SITE_RULES``); pages are parsed with the standard-library HTML parser in
  ``mapInPandas`` (one small helper per page, Arrow batches).
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.functions import text as T

BASE_RE = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)"
HOST_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)"
ANCHOR_RE = r'<a\s[^>]*href="([^"]*)"'
H1_RE = r"(?s)<h1[^>]*>(.*?)</h1>"
ARTICLE_RE = r"(?s)<article[^>]*>(.*?)</article>"
P_OPEN_RE = r"<p(?:\s[^>]*)?>"
NAV_RE = r"(?s)<nav[^>]*>(.*?)</nav>"
NOT_FOUND = "N/A"


def base_url(url) -> F.Column:
    return F.regexp_extract(T.col_(url), BASE_RE, 1)


def host(url) -> F.Column:
    return F.regexp_extract(T.col_(url), HOST_RE, 1)


def resolve(link, base) -> F.Column:
    """Root-relative links are prefixed with the site base."""
    link, base = T.col_(link), T.col_(base)
    return F.when(link.startswith("/"), F.concat(base, link)).otherwise(link)


def clean_url(url) -> F.Column:
    """Drop query and fragment."""
    return F.regexp_replace(T.col_(url), r"[?#].*$", "")


def page_anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href) of every anchor with an href."""
    return pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR_RE), 1)).alias("pos", "href"))


def resolved_links(pages: DataFrame) -> DataFrame:
    """X9."""
    a = page_anchors(pages)
    return a.select("page_id", F.col("pos").cast("bigint").alias("pos"), resolve("href", base_url("url")).alias("link"), "url")


def own_domain(links: DataFrame, domain_col: str = "domain") -> DataFrame:
    """Keep links that contain the site's own domain (drops ads / foreign links)."""
    return links.filter(F.col("link").contains(F.col(domain_col)))


def headline(html) -> F.Column:
    """Stripped text of the first h1."""
    return T.tag_text(F.regexp_extract(T.col_(html), H1_RE, 1))


def page_headline(pages: DataFrame) -> DataFrame:
    """Stripped text of the first h1."""
    return pages.select("page_id", headline("html").alias("headline"))


def paragraphs(html) -> F.Column:
    """Paragraph texts of the article: split on <p ...>, drop the lead piece, cut at </p>."""
    art = F.regexp_extract(T.col_(html), ARTICLE_RE, 1)
    pieces = F.split(art, P_OPEN_RE)
    ps = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(ps, lambda p: T.tag_text(F.substring_index(p, "</p>", 1)))


def page_body(pages: DataFrame, joiner: str = " ", also: tuple[F.Column, ...] = ()) -> DataFrame:
    """X11: paragraphs joined by ``joiner``; no paragraph -> 'N/A'. ``also``: more columns of the same page."""
    ps = paragraphs("html")
    return pages.select("page_id", "url", *also, F.size(ps).cast("bigint").alias("n_paragraphs"),
                        F.when(F.size(ps) > 0, F.array_join(ps, joiner)).otherwise(F.lit(NOT_FOUND)).alias("body"))


def drop_empty_bodies(bodies: DataFrame) -> DataFrame:
    """Drop 'N/A' and blank bodies (a body of only newlines is blank too)."""
    return bodies.filter((F.col("body") != NOT_FOUND) & F.col("body").rlike(r"\S"))


def article_rows(cands: DataFrame, crawl_date: str) -> DataFrame:
    """Attach constants; id = md5(link) (deterministic)."""
    fecha = F.date_format(F.lit(crawl_date).cast("date"), "dd/MM/yy")
    return cands.select(F.md5("link").alias("id"), "headline", "body", "link", fecha.alias("fecha"),
                        F.lit("N").alias("sesgo"), "newspaper")


def yield_counts(articles: DataFrame) -> DataFrame:
    """X20."""
    return articles.groupBy("newspaper").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def join_bodies(cands: DataFrame, bodies: DataFrame) -> DataFrame:
    """Candidate links left-joined to article pages (the nested fetch as a join).

    A link is fetched once: of several pages with one clean URL the smallest page_id counts.
    """
    b = bodies.groupBy(clean_url("url").alias("_u")).agg(F.min_by("body", "page_id").alias("body"))
    return cands.join(b, cands["link"] == b["_u"], "left").drop("_u")


# ---------------------------------------------------------------------------
# Selector rules (X1-X7, X11-X16): data rows + a small parser helper.
# ---------------------------------------------------------------------------

# --- fixed values: per-site selectors -------------------------------------------------------
# cover: steps, each (tag, class or None, needs href, "all" | "first") searched inside the previous match;
#        "headline": selector whose text is the headline, or "self" (the link text).
# body:  "container": (tag, class, attrs, "all" | "first") or None; a missing container gives N/A;
#        "lead": (tag, class, child tag or None, suffix) text put before the paragraphs;
#        "p": (tag, class or None); each paragraph is p_prefix + text + p_suffix, or, with a
#        "joiner", the stripped texts joined by it (no paragraph -> N/A).
SITE_RULES = [
    {"newspaper": "EL MUNDO", "cover": [["div", "ue-c-cover-content__main", False, "all"],
                                        ["a", "ue-c-cover-content__link", True, "first"]],
     "headline": ["h2", "ue-c-cover-content__headline"],
     "container": ["div", "ue-c-article__body", {"data-section": "articleBody"}, "all"], "lead": None,
     "p": ["p", None], "joiner": " ", "p_prefix": "", "p_suffix": "", "strip": True},
    {"newspaper": "EL MUNDO", "cover": [["div", "ue-c-cover-content__footer", False, "all"],
                                        ["li", "ue-c-cover-content__related-link", False, "all"],
                                        ["a", None, True, "first"]],
     "headline": "self",
     "container": ["div", "ue-c-article__body", {"data-section": "articleBody"}, "all"], "lead": None,
     "p": ["p", None], "joiner": " ", "p_prefix": "", "p_suffix": "", "strip": True},
    {"newspaper": "EL DIARIO", "cover": [["div", "md__new", False, "all"], ["h2", "ni-title", False, "first"],
                                         ["a", None, False, "first"]],
     "headline": "self", "container": None, "lead": ["ul", "footer", "h2", ""],
     "p": ["p", "article-text"], "joiner": None, "p_prefix": "\n", "p_suffix": "", "strip": False},
    {"newspaper": "EL PAIS", "cover": [["article", None, False, "all"], ["h2", "c_t", False, "first"],
                                       ["a", None, False, "first"]],
     "headline": "self", "container": None, "lead": ["h2", "a_st", None, "\n"],
     "p": ["p", None], "joiner": None, "p_prefix": "", "p_suffix": "\n", "strip": False},
    {"newspaper": "EL PUBLICO", "cover": [["article", None, False, "all"], ["h2", "title", False, "first"],
                                          ["a", None, False, "first"]],
     "headline": "self", "container": None, "lead": None,
     "p": ["p", None], "joiner": None, "p_prefix": "\n", "p_suffix": "", "strip": False},
    {"newspaper": "LA RAZON", "cover": [["h2", "article__title", False, "all"], ["a", None, False, "first"]],
     "headline": "self", "container": ["div", "article-main__content", {}, "first"], "lead": None,
     "p": ["p", None], "joiner": None, "p_prefix": "\n", "p_suffix": "", "strip": False},
    {"newspaper": "EL CONFIDENCIAL", "cover": [["article", None, False, "all"], ["a", None, False, "first"]],
     "headline": "self", "container": ["div", "news-body-complete", {}, "first"], "lead": None,
     "p": ["p", None], "joiner": None, "p_prefix": "\n", "p_suffix": "", "strip": False,
     "own_domain": "https://www.elconfidencial.com"},
]
# --- end fixed values -----------------------------------------------------------------------

VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, dict(attrs), [], parent

    def classes(self):
        return (self.attrs.get("class") or "").split()

    def text(self, strip: bool) -> str:
        parts, todo = [], list(reversed(self.children))
        while todo:  # pages may nest deeper than Python recurses
            c = todo.pop()
            if isinstance(c, _Node):
                todo.extend(reversed(c.children))
            else:
                parts.append(c.strip() if strip else c)
        return "".join(parts)

    def find_all(self, tag, cls=None, attrs=None, href=False):
        out, todo = [], list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, _Node):
                if (c.tag == tag and (cls is None or cls in c.classes())
                        and all(c.attrs.get(k) == v for k, v in (attrs or {}).items())
                        and (not href or c.attrs.get("href") is not None)):
                    out.append(c)
                todo.extend(reversed(c.children))
        return out

    def find(self, tag, cls=None, attrs=None, href=False):
        r = self.find_all(tag, cls, attrs, href)
        return r[0] if r else None


class _TreeBuilder(HTMLParser):
    """Tolerant tree builder: unclosed tags stay open until an ancestor closes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("[doc]", {}, None)
        self.cur = self.root

    def handle_starttag(self, tag, attrs):
        n = _Node(tag, attrs, self.cur)
        self.cur.children.append(n)
        if tag not in VOID:
            self.cur = n

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(_Node(tag, attrs, self.cur))

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def parse_html(html: str) -> _Node:
    b = _TreeBuilder()
    b.feed(html or "")
    b.close()
    return b.root


def cover_candidates(page: str | _Node, base: str, rule: dict) -> list[tuple[str, str]]:
    """(link, headline) pairs of one cover page, HTML or parsed, under one rule."""
    root = page if isinstance(page, _Node) else parse_html(page)
    matches = [root]
    for tag, cls, href, how in rule["cover"]:
        nxt = []
        for m in matches:
            found = m.find_all(tag, cls, None, href)
            nxt.extend(found if how == "all" else found[:1])
        matches = nxt
    out = []
    for a in matches:
        link = a.attrs.get("href")
        if not link:
            continue  # Q5: heading without a link -> drop the candidate
        if link.startswith("/"):
            link = base + link
        dom = rule.get("own_domain")
        if dom and dom not in link:
            continue
        if rule["headline"] == "self":
            headline = a.text(True)
        else:
            h = a.find(rule["headline"][0], rule["headline"][1])
            if h is None:
                continue
            headline = h.text(True)
        out.append((link, headline))
    return out


def article_body(page: str | _Node, rule: dict) -> str:
    """Body of one article page, HTML or parsed, under one site rule ('N/A' when the rule cannot apply)."""
    root = page if isinstance(page, _Node) else parse_html(page)
    body = ""
    if rule.get("lead"):
        tag, cls, child, suffix = rule["lead"]
        node = root.find(tag, cls)
        if node is not None and child:
            node = node.find(child)
            if node is None:
                return NOT_FOUND  # container present, heading missing
        body = (node.text(False) if node is not None else "") + suffix
    scopes = [root]
    if rule.get("container"):
        tag, cls, attrs, how = rule["container"]
        found = root.find_all(tag, cls, attrs)
        if not found:
            return NOT_FOUND
        scopes = found if how == "all" else found[:1]
    ptag, pcls = rule["p"]
    texts = [p.text(rule["strip"]) for sc in scopes for p in sc.find_all(ptag, pcls)]
    if rule.get("joiner") is not None:
        return rule["joiner"].join(texts) if texts else NOT_FOUND
    return body + "".join(rule["p_prefix"] + t + rule["p_suffix"] for t in texts)


def extract_candidates(pages: DataFrame, rules: list[dict] | None = None, newspaper_col: str | None = None) -> DataFrame:
    """Cover pages x rule rows -> (newspaper, link, headline), via mapInPandas.

    ``pages`` needs ``url`` and ``html``; with ``newspaper_col`` only that site's
    rules apply to a page, else every rule is tried. Rules are a small constant
    list shipped with the task closure.
    """
    rules = rules if rules is not None else SITE_RULES
    payload = json.dumps(rules)
    cols = ["url", "html"] + ([newspaper_col] if newspaper_col else [])

    def run(batches):
        rs = json.loads(payload)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                url, html = row[0], row[1]
                site = row[2] if newspaper_col else None
                m = re.match(BASE_RE, url or "")
                base = m.group(1) if m else ""
                root = parse_html(html)
                for r in rs:
                    if site is not None and r["newspaper"] != site:
                        continue
                    for link, headline in cover_candidates(root, base, r):
                        out.append((r["newspaper"], link, headline))
            yield pd.DataFrame(out, columns=["newspaper", "link", "headline"])

    return pages.select(*cols).mapInPandas(run, "newspaper string, link string, headline string")


def extract_bodies(pages: DataFrame, rules: list[dict] | None = None, newspaper_col: str | None = None,
                   id_col: str = "page_id") -> DataFrame:
    """Article pages x body rules -> (id_col, newspaper, body), via mapInPandas; each page is parsed once.

    A newspaper with several cover rules has one body rule. With ``newspaper_col`` a page gets its own site's body, else one
    row for each site. Null pages count as empty; a rule that cannot apply gives 'N/A'.
    """
    by_site = {}
    for r in rules if rules is not None else SITE_RULES:
        by_site.setdefault(r["newspaper"], r)
    payload = json.dumps(list(by_site.values()))
    id_type = pages.schema[id_col].dataType.simpleString()
    cols = [F.col(id_col).alias("id"), F.col("html")] + ([F.col(newspaper_col).alias("site")] if newspaper_col else [])

    def run(batches):
        rs = json.loads(payload)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                root = parse_html(row.html)
                for r in rs:
                    if not newspaper_col or row.site == r["newspaper"]:
                        out.append((row.id, r["newspaper"], article_body(root, r)))
            yield pd.DataFrame(out, columns=["id", "newspaper", "body"])

    found = pages.select(*cols).mapInPandas(run, f"id {id_type}, newspaper string, body string")
    return found.withColumnRenamed("id", id_col)


def nav_rule(newspaper: str) -> dict:
    """Selector rule for the fixture pages' cover list: every nav link, headline = link text."""
    return {"newspaper": newspaper, "cover": [["nav", None, False, "all"], ["a", None, True, "all"]], "headline": "self"}


def extract_nav_candidates(pages: DataFrame) -> DataFrame:
    """The fixture cover rule applied to every page, newspaper = page host."""
    def run(batches):
        for pdf in batches:
            out = []
            for url, html in zip(pdf["url"], pdf["html"]):
                m = re.match(BASE_RE, url or "")
                hm = re.match(HOST_RE, url or "")
                rule = nav_rule(hm.group(1) if hm else "")
                for link, headline in cover_candidates(html, m.group(1) if m else "", rule):
                    out.append((rule["newspaper"], link, headline))
            yield pd.DataFrame(out, columns=["newspaper", "link", "headline"])

    return pages.select("url", "html").mapInPandas(run, "newspaper string, link string, headline string")
