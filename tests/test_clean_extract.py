import json
import os

from pyspark.sql import functions as F

from newslens.operators import clean as C
from newslens.operators import extract as X
from newslens.session import scratch_path
from newslens.sources import io as IO


def _art(i, paper="P"):
    return {"id": i, "headline": f"h{i}", "body": "b", "link": f"/l{i}", "fecha": "01/02/24", "sesgo": "N",
            "newspaper": paper}


def test_nested_reader_keep_first_and_missing_ids(spark):
    path = scratch_path(spark, "nested")
    os.makedirs(path, exist_ok=True)
    data = [[_art("a"), _art("b"), _art("")], [], [_art("a", "Q"), {**_art("x"), "id": None}, _art("c")]]
    with open(os.path.join(path, "d.json"), "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False)
    raw = IO.read_nested_dataset(spark, path)
    assert raw.count() == 6  # the empty crawl result is skipped
    counts = C.clean_counts(raw).first()
    assert (counts["n_before"], counts["n_after"]) == (6, 3)
    out = {r["id"]: r["newspaper"] for r in C.dedupe_first(raw).collect()}
    assert out == {"a": "P", "b": "P", "c": "P"}  # first "a" wins, null and empty ids dropped


def test_lookup_last_wins_and_missing(spark):
    left = spark.createDataFrame([("1",), ("2",), ("3",)], "Id string")
    right = spark.createDataFrame([("1", "A", 1), ("1", "B", 2), ("2", "C", 1)], "id string, newspaper string, ord int")
    out = {r["Id"]: r["newspaper"] for r in C.lookup_join(left, right).collect()}
    assert out == {"1": "B", "2": "C", "3": None}


def test_dates_iso_and_day_first(spark):
    d = spark.createDataFrame([("03/04/24",), ("2024-04-03",), ("bad",)], "fecha string")
    got = [r[0] for r in d.select(C.parse_dates("fecha")).collect()]
    assert str(got[0]) == "2024-04-03" and str(got[1]) == "2024-04-03" and got[2] is None


def test_exclude_keeps_nulls(spark):
    d = spark.createDataFrame([("EL MUNDO",), (None,), ("EL PAIS",)], "newspaper string")
    assert C.exclude_sources(d).count() == 2


COVER_MUNDO = """<html><body>
<div class="ue-c-cover-content__main"><a class="ue-c-cover-content__link" href="/a1">
<h2 class="ue-c-cover-content__headline"> Titular uno </h2></a></div>
<div class="ue-c-cover-content__main"><a class="ue-c-cover-content__link" href="/a2"><span>sin titular</span></a></div>
<div class="ue-c-cover-content__footer"><ul><li class="ue-c-cover-content__related-link"><a href="https://x.es/r1">Rel</a></li></ul></div>
</body></html>"""
COVER_CONF = """<html><body><article><a href="https://www.elconfidencial.com/n1">Uno</a></article>
<article><a href="https://ads.example.com/p">Anuncio</a></article><article><h2>sin enlace</h2></article></body></html>"""
ARTICLE_MUNDO = """<html><body><div class="ue-c-article__body" data-section="articleBody"><p> Hola <b>mundo</b> </p>
<p>Dos</p></div><p>fuera</p></body></html>"""


def test_selector_rules_on_inline_pages(spark):
    pages = spark.createDataFrame([("https://www.elmundo.es", COVER_MUNDO, "EL MUNDO"),
                                   ("https://www.elconfidencial.com", COVER_CONF, "EL CONFIDENCIAL")],
                                  "url string, html string, newspaper string")
    got = {(r["newspaper"], r["link"], r["headline"]) for r in X.extract_candidates(pages, newspaper_col="newspaper").collect()}
    assert got == {("EL MUNDO", "https://www.elmundo.es/a1", "Titular uno"),
                   ("EL MUNDO", "https://x.es/r1", "Rel"),
                   ("EL CONFIDENCIAL", "https://www.elconfidencial.com/n1", "Uno")}
    rule = X.SITE_RULES[0]
    assert X.article_body(ARTICLE_MUNDO, rule) == "Holamundo Dos"
    assert X.article_body("<html><p>x</p></html>", rule) == "N/A"
    pais = [r for r in X.SITE_RULES if r["newspaper"] == "EL PAIS"][0]
    assert X.article_body("<h2 class='a_st'>Sub</h2><p>A</p><p>B</p>", pais) == "Sub\nA\nB\n"


def test_native_body_and_empty_filter(spark):
    html = "<article><h1>T &amp; t</h1><p><b>Lead<br><p> Uno </p><p></p></article>"
    pages = spark.createDataFrame([(1, "https://s.example/x?y=1", html), (2, "https://s.example/z", "<p>no article</p>")],
                                  "page_id bigint, url string, html string")
    b = {r["page_id"]: (r["n_paragraphs"], r["body"]) for r in X.page_body(pages).collect()}
    assert b[1] == (3, "Lead Uno ") and b[2] == (0, "N/A")
    assert [r["page_id"] for r in X.drop_empty_bodies(X.page_body(pages)).collect()] == [1]
    h = X.page_headline(pages).filter("page_id = 1").first()["headline"]
    assert h == "T & t"
    assert pages.select(X.clean_url("url")).first()[0] == "https://s.example/x"


def test_dates_with_time_and_month_names(spark):
    texts = ["2024-01-05T10:30:00", "2024-01-05 10:30:00", "05/01/2024 10:30", "5 Jan 2024", "5 January 2024", "05/01/24", None]
    d = spark.createDataFrame([(t,) for t in texts], "fecha string")
    got = [r[0] for r in d.select(C.parse_dates("fecha")).collect()]
    assert [str(g) for g in got[:-1]] == ["2024-01-05"] * 6 and got[-1] is None


def test_site_bodies_as_rows(spark):
    page = "<div class='article-main__content'><p>one</p><p>two</p></div><p>out</p>"
    rows = [(1, page, "LA RAZON"), (2, page, "EL PUBLICO"), (3, page, "EL CONFIDENCIAL"), (4, None, "LA RAZON"), (5, page, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, newspaper string")
    own = {r["page_id"]: r["body"] for r in X.extract_bodies(pages, newspaper_col="newspaper").collect()}
    assert own == {1: "\none\ntwo", 2: "\none\ntwo\nout", 3: "N/A", 4: "N/A"}
    every = X.extract_bodies(pages)
    assert every.count() == len(rows) * 6
    by_hand = {(i, r["newspaper"]): X.article_body(h, r) for i, h, _ in rows for r in X.SITE_RULES}
    assert {(r["page_id"], r["newspaper"]): r["body"] for r in every.collect()} == by_hand


def test_repeated_page_joins_once(spark):
    cands = spark.createDataFrame([("http://a.b/x",)], "link string")
    bodies = spark.createDataFrame([(2, "http://a.b/x?q", "late"), (1, "http://a.b/x#p", "early")], "page_id bigint, url string, body string")
    assert [r["body"] for r in X.join_bodies(cands, bodies).collect()] == ["early"]
