"""Main text of pages in many templates, against the text that each was made of."""

import itertools
import random
import re

from sparkloom.llm import html_text

WORDS = "harbour lantern meadow quarry signal timber valley winter anchor barley copper dusk ember frost granite hollow island juniper kettle ledger".split()
NAVS = [
    '<nav><ul><li><a href="/">home</a><li><a href="/b">about us</a></ul></nav>', '<div class="navbar"><a href="/">home</a> | <a href="/c">contact</a></div>', '<header><h2>The Site</h2><a href="/">start</a></header>',
    '<div id="masthead"><p>The Site, since 1901</p></div>', "",
]
SIDES = [
    '<aside><h3>more</h3><p>Another story, briefly told</p></aside>', '<div class="sidebar"><ul><li><a href="/x">one thing</a><li><a href="/y">other thing</a></ul></div>', '<div class="related-posts"><p><a href="/z">See also this</a></p></div>',
    '<div class="cookie-notice"><p>We use cookies, as all do</p></div>', "",
]
ENDS = [
    '<footer><p>&copy; the site</p></footer>', '<div class="site-footer">imprint</div>', '<section id="comments"><h3>2 comments</h3><p>Nice one, thanks</p><p>I disagree, strongly</p></section>',
    '<form action="/s"><label>mail</label><input><button>send</button></form>', '<div class="newsletter signup"><p>Get our letters</p></div>',
]
#: What is around an article, {} being it.
FRAMES = [
    "<article>{}</article>", "<main>{}</main>", '<main><article class="post">{}</article></main>', '<div id="content">{}</div>', '<div class="page has-sidebar"><article>{}</article></div>', '<div class="content no-sidebar">{}</div>',
    '<div class="layout has-comments"><div class="story">{}</div></div>', '<section class="entry-content">{}</section>', "<table><tr><td>{}</td></tr></table>", '<div class="wrap"><div class="inner"><div class="text">{}</div></div></div>',
    '<div class="col-8"><section><div class="prose">{}</div></section></div>', "<center>{}</center>",
]


def article(rng, style):
    """(markup, blocks) of an article in one of several ways to write it."""
    def sentence(n):
        return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + ", " + " ".join(rng.choice(WORDS) for _ in range(n)) + "."

    title, lead = " ".join(rng.choice(WORDS) for _ in range(5)).title(), sentence(6)
    paras = [sentence(rng.randint(14, 30)) for _ in range(rng.randint(4, 7))]
    items = [sentence(4) for _ in range(3)]
    blocks = [title, lead, *paras]
    if style == 0:
        html = f"<h1>{title}</h1><p>{lead}</p>" + "".join(f"<p>{p}</p>" for p in paras)
    elif style == 1:  # unclosed paragraphs, a list
        html = f"<h1>{title}</h1>\n<p><b>{lead}</b>\n" + "\n".join(f"<p>{p}" for p in paras) + "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
        blocks += items
    elif style == 2:  # parts in containers of their own
        half = len(paras) // 2
        html = f'<div class="head"><h1>{title}</h1><p class="lead">{lead}</p></div><div class="part">' + "".join(f"<p>{p}</p>" for p in paras[:half]) + '</div><div class="part">' + "".join(f"<p>{p}</p>" for p in paras[half:]) + "</div>"
    else:  # links, quotes and an advert inside
        linked = [p.replace("harbour", '<a href="/h">harbour</a>') for p in paras]
        html = f"<h1>{title}</h1><p><em>{lead}</em></p>" + "".join(f"<p>{p}</p>" for p in linked[:2]) + '<div class="ad">Buy now</div><script>var a = "<p>no</p>";</script>' + "".join(f"<blockquote><p>{p}</p></blockquote>" for p in linked[2:])
    return html, blocks


def pages():
    rng = random.Random(5)
    for k, (frame, style) in enumerate(itertools.product(FRAMES, range(4))):
        for copy in range(3):  # three pages of each host share a template
            html, blocks = article(rng, style)
            nav, side, end = NAVS[(k + k // 5) % len(NAVS)], SIDES[(k * 2 + 1) % len(SIDES)], ENDS[k % len(ENDS)]
            body = nav + (side + frame.format(html) if k % 2 else frame.format(html) + side) + end
            yield k * 3 + copy, f"http://host{k}.example/{copy}", f"<!doctype html><html><head><title>{k}</title></head><body>{body}</body></html>", blocks


def f1(got, want):
    a, b = got.split("\n") if got else [], list(want)
    hit = sum(x in b for x in a)
    return 2 * hit / max(1, len(a) + len(b))


def test_many_templates(spark):
    rows = list(pages())
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html_text.extract_pages(df).collect()}
    scores = {i: f1(got[i], blocks) for i, _, _, blocks in rows}
    worst = sorted((s, i) for i, s in scores.items() if s < 0.9)
    assert len(scores) == 3 * 4 * len(FRAMES) and not worst, worst
    assert sum(scores.values()) / len(scores) > 0.99


def test_blocks_are_in_page_order_and_normalised():
    rng = random.Random(6)
    html, blocks = article(rng, 1)
    spaced = re.sub(" ", lambda m: rng.choice([" ", "\n  ", "\t", "&#32;"]), html.replace("<h1>", "<h1 >"))
    assert html_text.extract(f"<body><article>{spaced}</article></body>", []) == "\n".join(blocks)
