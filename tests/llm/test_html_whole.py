"""Main text in nested containers and in wrappers whose classes name boilerplate."""

import time

import pytest

from sparkloom.llm import html_text

PARTS = ["sentence " * 32 + str(i) for i in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in PARTS)
NAV = '<nav><a href="/">menu</a></nav>'
WHOLE = "\n".join(["T", "lead", *PARTS])


def extracted(spark, *bodies):
    rows = [(i, "http://h/", f"<html><body>{NAV}{b}<footer>end</footer></body></html>") for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r.text for r in html_text.extract_pages(df).orderBy("page_id").collect()]


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", '<main class="m"><article>{}</article></main>', '<div class="wrap">{}</div>', "{}"])
def test_heading_and_lead_outside_the_body(spark, around):
    page = around.format(f'<h1>T</h1><p>lead</p><div class="body">{BODY}</div>')
    assert extracted(spark, page, page) == [WHOLE, WHOLE]


def test_parts_of_different_classes(spark):
    page = f'<article><div class="intro"><h1>T</h1><p>lead</p></div><div class="rest">{BODY}</div></article>'
    assert extracted(spark, page, page) == [WHOLE, WHOLE]


def test_linked_and_marked_text_beside_stays_out(spark):
    page = f'<div class="links"><a href="/a">one</a> <a href="/b">two</a></div><div class="body">{BODY}</div><div id="comments"><p>nice, nice</p></div>'
    assert extracted(spark, page) == ["\n".join(PARTS)]


@pytest.mark.parametrize(
    "wrapper",
    ['class="page has-sidebar"', 'class="no-sidebar"', 'class="with-comments"', 'class="header-fixed"', 'id="search-result-page"', 'class="login-page"', 'id="search"', 'role="form"'],
)
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main><div>{}</div></main>", '<div class="story">{}</div>'])
def test_marked_wrapper_keeps_the_article(spark, wrapper, inner):
    rest = '<div class="sidebar"><p>more, more</p></div><div id="comments"><article><p>nice, nice</p></article></div>'
    if "story" in inner:
        rest = '<div class="sidebar"><p>more, more</p></div>'
    page = f"<div {wrapper}>{inner.format('<h1>T</h1><p>lead</p>' + BODY)}{rest}</div>"
    assert extracted(spark, page) == [WHOLE]


def test_marks_still_drop(spark):
    kept = f"<article><h1>T</h1><p>lead</p>{BODY}</article>"
    for mark in ('class="site-footer"', 'class="related-posts"', 'id="comments-section"', 'class="cookieConsentBar"', 'role="banner"', 'class="ad-300x250"'):
        assert extracted(spark, f"{kept}<div {mark}><article><p>{'out, ' * 99}</p></article></div>") == [WHOLE], mark


def test_many_nested_wrappers(spark):
    deep = '<div class="search">' * 40 + f"<p>{PARTS[0]}</p>" + "</div>" * 40
    assert extracted(spark, deep) == [PARTS[0]]


def test_deep_pages_take_time_in_proportion():
    n = 100_000
    for page in ("<div>" * n + "x", "<div class='search'>" * n + "x", "<div>text, text" * n, "<div><b>" + "</i></p></div>" * n + "x", "<span>" * n + "<div>x</div>" * n):
        began = time.process_time()
        html_text.extract(page, ["div>div"])
        assert time.process_time() - began < 8, page[:30]


@pytest.mark.parametrize("raw", ['<svg class="i"/>', '<svg class="i" />', "<math/>", "<svg>", "<object data='x'>", "<select><option>one", "<title>", "<canvas>", "<video src=x>", "<textarea>"])
def test_raw_elements_without_an_end(spark, raw):
    page = f"<article><h1>T</h1>{raw}<p>lead</p>{BODY}</article>"
    got = extracted(spark, page)[0].split("\n")
    assert got[0] == "T" and got[-len(PARTS) - 1 :] == ["lead", *PARTS]


def test_code_without_an_end_is_no_text(spark):
    assert extracted(spark, f"<article><h1>T</h1><p>lead</p>{BODY}</article><script>var a = '<p>no</p>'") == [WHOLE]


@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", '<div class="story">{}</div>', "{}"])
def test_page_inside_a_form(spark, inner):
    page = '<form id="aspnetForm"><input type="hidden">' + inner.format(f"<h1>T</h1><p>lead</p>{BODY}") + "</form>"
    assert extracted(spark, page) == [WHOLE]


def test_form_beside_the_article_stays_out(spark):
    page = f'<article><h1>T</h1><p>lead</p>{BODY}<form action="/s"><p>Write to us, please</p><input></form></article><form><p>find</p></form>'
    assert extracted(spark, page) == [WHOLE]


@pytest.mark.parametrize("around", ["article", "main"])
def test_heading_in_a_header(spark, around):
    assert extracted(spark, f"<{around}><header><h1>T</h1><p>lead</p></header>{BODY}</{around}>") == [WHOLE]


@pytest.mark.parametrize("mark", ["comments", "user-comments", "reader_comments", "responses", "kommentare", "commentaires", "comentarios", "disqus thread"])
@pytest.mark.parametrize("place", ["inside", "beside"])
def test_long_comments_stay_out(spark, mark, place):
    said = f'<div class="{mark}">' + "".join(f"<p>I say, {i}, this and that, again and again</p>" for i in range(900)) + "</div>"
    text = f"<h1>T</h1><p>lead</p>{BODY}"
    page = f"<article>{text}{said}</article>" if place == "inside" else f'<div class="story">{text}</div>{said}'
    assert extracted(spark, page) == [WHOLE]


@pytest.mark.parametrize("mark", ["werbung", "anzeige", "publicite", "publicidad", "seitenleiste"])
def test_marks_in_other_languages(spark, mark):
    assert extracted(spark, f'<div class="story"><h1>T</h1><p>lead</p>{BODY}<div class="{mark}"><p>buy, now, here</p></div></div>') == [WHOLE]


def test_many_unclosed_raw_elements_take_time_in_proportion():
    for raw in ("<svg>", "<select>", "<title>"):
        began = time.process_time()
        html_text.extract("<body>" + raw * 200_000 + "<p>x, y</p>", [])
        assert time.process_time() - began < 8
