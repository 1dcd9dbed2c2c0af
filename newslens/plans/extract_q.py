"""Queries for article extraction (X*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslens.operators import extract as X
from newslens.plans.registry import query, sql_str
from newslens.sources.tables import pages

CRAWL_DATE = "2024-01-01"


def sql_tag_text(x: str) -> str:
    t = (f"array_to_string(list_transform(regexp_split_to_array({x}, '<[^>]*>'), "
         f"lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), '')")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, {sql_str(ent)}, {sql_str(ch)})"
    return t


BASE = f"regexp_extract(url, {sql_str(X.BASE_RE)}, 1)"
HOST = f"regexp_extract(url, {sql_str(X.HOST_RE)}, 1)"
CLEAN = "regexp_replace(url, '[?#].*$', '')"

LINKS_CTE = f"""
al AS (SELECT page_id, url, regexp_extract_all(html, {sql_str(X.ANCHOR_RE)}, 1) AS l FROM pages),
an AS (SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS pos FROM al),
links AS (SELECT page_id, pos::BIGINT AS pos, url,
            CASE WHEN starts_with(href, '/') THEN {BASE} || href ELSE href END AS link FROM an)"""

BODY_CTE = f"""
art AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(html, {sql_str(X.ARTICLE_RE)}, 1),
                                                   {sql_str(X.P_OPEN_RE)}) AS pieces FROM pages),
ps AS (SELECT page_id, url, list_transform(pieces[2:], lambda p: {sql_tag_text("split_part(p, '</p>', 1)")}) AS ps FROM art),
bodies AS (SELECT page_id, url, len(ps)::BIGINT AS n_paragraphs,
             CASE WHEN len(ps) > 0 THEN array_to_string(ps, ' ') ELSE 'N/A' END AS body FROM ps),
heads AS (SELECT page_id, url, {sql_tag_text(f"regexp_extract(html, {sql_str(X.H1_RE)}, 1)")} AS headline FROM pages)"""

ARTICLES_CTE = f"""{BODY_CTE},
kept AS (SELECT * FROM bodies WHERE body <> 'N/A' AND regexp_matches(body, '\\S')),
articles AS (SELECT md5({CLEAN.replace('url', 'k.url')}) AS id, h.headline, k.body, {CLEAN.replace('url', 'k.url')} AS link,
               '01/01/24' AS fecha, 'N' AS sesgo, {HOST.replace('url', 'k.url')} AS newspaper
             FROM kept k JOIN heads h USING (page_id))"""


def _pages(spark, sf):
    return pages(spark, sf)


@query("x1_candidates", f"""
WITH nav AS (SELECT url, regexp_extract(html, {sql_str(X.NAV_RE)}, 1) AS nav FROM pages),
a AS (SELECT url, unnest(regexp_extract_all(nav, '(?s)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href,
             unnest(regexp_extract_all(nav, '(?s)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS inner_html FROM nav)
SELECT {HOST} AS newspaper, CASE WHEN starts_with(href, '/') THEN {BASE} || href ELSE href END AS link,
       {sql_tag_text('inner_html')} AS headline FROM a""")
def x1_candidates(spark, sf):
    return X.extract_nav_candidates(_pages(spark, sf))


@query("x8_domain_filter", f"WITH {LINKS_CTE} SELECT page_id, pos, link FROM links WHERE contains(link, {BASE})")
def x8_domain_filter(spark, sf):
    l = X.resolved_links(_pages(spark, sf)).withColumn("domain", X.base_url("url"))
    return X.own_domain(l).select("page_id", "pos", "link")


@query("x9_resolve_links", f"WITH {LINKS_CTE} SELECT page_id, pos, link FROM links")
def x9_resolve_links(spark, sf):
    return X.resolved_links(_pages(spark, sf)).select("page_id", "pos", "link")


@query("x10_headline", f"WITH {BODY_CTE} SELECT page_id, headline FROM heads")
def x10_headline(spark, sf):
    return X.page_headline(_pages(spark, sf))


@query("x11_body", f"WITH {BODY_CTE} SELECT page_id, n_paragraphs, body FROM bodies")
def x11_body(spark, sf):
    return X.page_body(_pages(spark, sf)).select("page_id", "n_paragraphs", "body")


@query("x12_site_bodies")
def x12_site_bodies(spark, sf):
    """Every page under every site's body rule."""
    return X.extract_bodies(_pages(spark, sf))


@query("x17_candidate_body_join", f"""
WITH {BODY_CTE},
cands AS (SELECT {CLEAN} AS link, headline FROM heads),
b AS (SELECT {CLEAN} AS u, arg_min(body, page_id) AS body FROM bodies GROUP BY 1)
SELECT c.link, c.headline, length(b.body)::BIGINT AS body_chars FROM cands c LEFT JOIN b ON c.link = b.u""")
def x17_candidate_body_join(spark, sf):
    p = _pages(spark, sf)
    cands = p.select(X.clean_url("url").alias("link"), X.headline("html").alias("headline"))
    j = X.join_bodies(cands, X.page_body(p))
    return j.select("link", "headline", F.length("body").cast("bigint").alias("body_chars"))


@query("x18_drop_empty", f"WITH {BODY_CTE} SELECT page_id FROM bodies WHERE body <> 'N/A' AND regexp_matches(body, '\\S')")
def x18_drop_empty(spark, sf):
    return X.drop_empty_bodies(X.page_body(_pages(spark, sf))).select("page_id")


def _articles(spark, sf):
    p = _pages(spark, sf)
    kept = X.drop_empty_bodies(X.page_body(p, also=(X.headline("html").alias("headline"),)))
    c = kept.select("headline", "body", X.clean_url("url").alias("link"), X.host("url").alias("newspaper"))
    return X.article_rows(c, CRAWL_DATE)


@query("x19_article_rows", f"WITH {ARTICLES_CTE} SELECT id, headline, body, link, fecha, sesgo, newspaper FROM articles")
def x19_article_rows(spark, sf):
    return _articles(spark, sf)


@query("x20_yield", f"WITH {ARTICLES_CTE} SELECT newspaper, count(*)::BIGINT AS n FROM articles GROUP BY newspaper")
def x20_yield(spark, sf):
    return X.yield_counts(_articles(spark, sf))
