import html
import itertools
import random
import re
import time

import pytest

from tallyloom.llm import mincut as M

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><a href=/>Site name</a><p>Our slogan is that we are the best of all sites.</p></header>
<div class="cookie-notice">We use cookies to make the site better. Please accept them all.</div>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div id="sidebar"><p>Some longer text about other things that are popular, with a full stop.</p></div>
%s
<div class="ad">Buy the new thing now, it is cheap and good for you.</div>
<section class="comments"><p>I think that this is a very good article, thank you for it.</p></section>
<form><label>Mail</label><input name=a><button>Send it now</button></form><noscript>no script</noscript>
<footer>&copy; 2024 Site name. All rights are reserved by us.</footer></body></html>"""
BODY = """<h1>The  Title</h1><p>First <b>para<i>graph</i></b> with a<br>break &amp; an &eacute;.<p>Short.</p>
<div class="advert">An advert inside of the article, which is long enough.</div><ul><li>item one<li>item two</ul>
<table><tr><td>cell a<td>cell b<tr><td>c</table><p>It ends here.<!-- <p>not this --></p>"""
WANT = "The Title First paragraph with a break & an é. Short. item one item two cell a cell b c It ends here."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", '<div class="post-content">%s</div>', "<article><header>%s</header></article>"])
def test_article(wrap):
    assert M.main_text(PAGE % (wrap % BODY)) == WANT


def test_plain_page_without_article_marks():
    body = "<div>" + "".join(f"<p>This is sentence number {i} of a page that has no article element at all.</p>" for i in range(4)) + "</div>"
    assert M.main_text(PAGE % body) == " ".join(f"This is sentence number {i} of a page that has no article element at all." for i in range(4))


@pytest.mark.parametrize("page", [None, "", " \n", "<nav>a</nav>", "<script>var a = 1;", "<p", "<!-- open", "<" * 50])
def test_nothing(page):
    assert M.main_text(page) in ("", "<" * 50, "<p")


LONG = "".join(f"<p>This is sentence number {i} of the article, and it is long enough.</p>" for i in range(3))
SAID = " ".join(f"This is sentence number {i} of the article, and it is long enough." for i in range(3))
FIRST = "Here is the first text of the article, which goes on."


@pytest.mark.parametrize("odd,want", [
    ('<p>%s <span class="share">Share</p>', FIRST), ('<p>%s <span class="share">Share<p>', FIRST), ('<div>%s <span class="share">Share</div>', FIRST),
    ('<p>%s <span class="ad">Buy <span>this <span>new</span></span> thing</span></p>', FIRST), ('<p>%s <span>It</span> <span>is</span> so.</p>', FIRST + " It is so."),
    *((f"<div><p>%s</p><{t}>inner</div>", FIRST) for t in ("svg", "video", "audio", "template", "title")),
    *((f"<div><p>%s</p><{t}>inner</{t}></div>", FIRST + " inner") for t in ("math", "object", "canvas", "noscript")),
    ("<p>%s <svg><path d=1></p>", FIRST), ("<p>%s <svg><title>t</title><foreignObject><div>inner</div></foreignObject></svg> It is so.</p>", FIRST + " It is so."),
    ("<p>%s <template><p>inner</p><div>x</div></template> It is so.</p>", FIRST + " It is so."), ("<div><svg></div><p>%s</p><div><svg></svg></div>", FIRST),
])
def test_open_elements_end_with_their_block(odd, want):
    assert M.main_text(f"<body><article>{odd % FIRST}{LONG}</article></body>") == f"{want} {SAID}"


@pytest.mark.parametrize("page,want", [
    ("<article><button>Share</button><p>%s</p><p>%s</p></article>", None), ("<article><p>%s</p><label>Vote</label><p>%s</p></article>", None),
    ("<article><p>%s</p><select><option>a<option>b</select><p>%s</p></article>", None), ("<article><p>%s <button class=x>Like</button></p><datalist><option>q</datalist>%s</article>", None),
    ('<div class="entry has-sidebar"><article><p>%s</p>%s</article></div>', None), ('<div class="post has-sidebar no-comments"><p>%s</p><p>%s</p></div><nav>Menu</nav>', None),
    ('<div class="page sidebar"><article><p>%s</p>%s</article><div class="widget">Popular things of this week.</div></div>', None),
    ('<form id=f><header>Shop</header><article><p>%s</p>%s</article><input></form>', None), ("<form><p>%s</p><p>%s</p></form>", None),
    ('<article><p>%s</p>%s</article><div class="comments"><article><p>I like this very much, thank you all.</p></article></div>', None),
    ('<article><p>%s</p>%s<section class="related-posts"><p>You may like this one too, it is long.</p></section></article>', None),
    ('<article><p>%s</p>%s<article class="comment"><p>First of all, it is good.</p></article></article>', None),
    ('<article><p>%s</p>%s</article><aside><article><p>A teaser of something else is here.</p></article></aside>', None),
    ("<article><p>%s</p>%s<p>Energy is <math><mi>E</mi>=<mi>m</mi></math> here</p><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></article>", " Energy is E=m here One Two"),
    ("<body><h1>Head line</h1><p>%s</p><p>%s</p><ul><li>milk<li>eggs<li>bread</ul><p>They are all that it takes to do it.</p><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>Mail</a></ul></body>", "Head line"),
    ("<article><p>%s<p>%s<p hidden>no</p><p style='display:none'>no</p><p aria-hidden=true>no</p></article>", None), ("<article><p>%s</p>%s<table><tr><td>a</div>b</table></article>", " ab"),
    ("<article><p>%s</p>%s a < b &lt; c <3 </ x>&nbsp;</article>", " a < b < c <3"), ('<article><p title="a > b" data-x=\'>\'>%s</p>%s<!-- > --></article>', None),
])
def test_furniture_and_marks(page, want):
    second = "And this is the second one, of which there is enough as well."
    got = M.main_text(page % (FIRST, second))
    if want == "Head line":
        assert got == f"Head line {FIRST} {second} milk eggs bread They are all that it takes to do it."
    else:
        assert got == f"{FIRST} {second}{want or ''}"


@pytest.mark.parametrize("page", [
    '<a "' * 250_000, '<a "' * 250_000 + ">", "<a x='" * 150_000 + ">", "<div>" * 100_000 + "x", "<div>x" * 60_000, "<p>" * 200_000, "<!" * 300_000, "<!--" * 200_000, "<title>" * 100_000, "<head>" * 100_000,
    "<li><ul>" * 60_000, "</div>" * 100_000, "<span class=ad>" * 60_000, "<b><p>" * 100_000, "<" * 500_000, "<a " + " " * 500_000, "&" * 300_000, "<td><table>" * 60_000, "<svg><div>" * 60_000, "<p>x</p><nav>y</nav>" * 20_000,
], ids=lambda p: p[:12])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    M.main_text(page)
    assert time.process_time() - began < 20


def made(r):
    """A random page and its main text, known from the way it is made."""
    words = lambda n: " ".join(r.choice(["alpha", "beta", "R&amp;D", "caf&eacute;", "gamma,", "delta;", "5 &lt; 6", "omega"]) for _ in range(n))
    seen: list[str] = []

    def said(n=None):
        text = words(n or r.randint(1, 30)) + r.choice([".", "", "!", "?"])
        seen.append(html.unescape(text))
        return r.choice(["{}", " {} ", "<b>{}</b>", "\n{}\t", "<span class=lead>{}</span>", "<i><em>{}</em></i>"]).format(text)

    def noise():
        text = words(r.randint(1, 12))
        return r.choice([
            f"<nav><a href=/>{text}</a></nav>", f"<aside>{text}</aside>", f'<div class="ad-slot">{text}</div>', f"<script>var a='<p>{text}';</script>", f"<style>{text}</style>", f"<!-- {text} > -->",
            f"<form><label>{text}</label><input><button>{text}</button></form>", f"<button>{text}</button>", f'<div id="sidebar">{text}</div>', f'<ul class="share"><li>{text}<li>{text}</ul>',
            f'<section class="comments"><p>{text}.</p></section>', f"<div hidden>{text}</div>", f'<div class="cookie-notice"><p>{text}.</div>', f"<select><option>{text}</select>", f"<template><p>{text}</p></template>", "",
        ])

    def body(depth=0):
        kinds = ["p", "p", "open", "h2", "ul", "table", "quote", "noise"] + ["div", "section"] * (depth < 4)
        out = []
        for _ in range(r.randint(1, 5)):
            kind = r.choice(kinds)
            out.append({
                "p": lambda: f"<p>{said()}</p>", "open": lambda: f"<p>{said()}", "h2": lambda: f"<h2>{said(3)}</h2>", "ul": lambda: "<ul>" + "".join(f"<li>{said()}" for _ in range(r.randint(1, 4))) + "</ul>",
                "table": lambda: f"<table><tr><td>{said(2)}<td>{said(2)}<tr><td>{said(2)}</table>", "quote": lambda: f"<blockquote>{said()}</blockquote>", "noise": noise,
                "div": lambda: f"<div class={r.choice(['x', 'lead', 'has-sidebar'])}>{body(depth + 1)}</div>", "section": lambda: f"<section>{body(depth + 1)}</section>",
            }[kind]())
        return "".join(out)

    wrap = r.choice(["<article>{}</article>", "<main>{}</main>", "<div class='wrap has-sidebar'><article class=post>{}</article></div>", "<main><article>{}</article></main>", "<div role=main>{}</div>"])
    page = "".join(["<!DOCTYPE html><html><head><title>t</title></head><body>", "<header>Our site</header>", noise(), noise(), wrap.format(body()), noise(), noise(), "<footer>The end</footer>"])
    return page, " ".join(" ".join(seen).split())


def test_made_pages():
    for seed in range(1500):
        page, want = made(random.Random(seed))
        assert M.main_text(page) == want, page


#: Pages of which some blocks say little of themselves: (html, its text).
VAGUE = [
    ("<body><div><p>This is one long sentence of the text that goes on for a while, until it stops.</p><div>odd</div><p>This is another one of them, of much the same kind as that before it.</p></div></body>", None),
    ("<body><div><p>A sentence of the text that goes on for a while, until it stops.</p><ul><li>milk<li>eggs</ul><p>This is another one of them, much like that before it.</p></div></body>", None),
    ("<body><div><p>A sentence of the text that goes on for a while, until it stops.</p><div>by hand</div><div>so it is</div><p>This is another one of them, much like that before it.</p></div></body>", None),
]


@pytest.mark.parametrize("page,_", VAGUE)
def test_ties_decide_vague_blocks(page, _, monkeypatch):
    whole = M.main_text(page)
    assert whole == " ".join(re.sub(r"<[^>]*>", " ", page).split())
    monkeypatch.setattr(M, "TIE", 0.0)
    assert len(M.main_text(page)) < len(whole)


def test_labels_minimise_the_cut():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(1, 8)
        gain = [r.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0]) for _ in range(n)]
        ties = [(a, b, r.choice([0.2, 1.0, 2.0])) for a in range(n) for b in range(a + 1, n) if r.random() < 0.4]

        def cost(x):
            return sum(g for g, k in zip(gain, x) if g > 0 and not k) - sum(g for g, k in zip(gain, x) if g < 0 and k) + sum(c for a, b, c in ties if x[a] != x[b])

        assert cost(M.minimum_cut(gain, ties)) == pytest.approx(min(cost(x) for x in itertools.product([False, True], repeat=n)))


def test_weak_block_goes_with_its_neighbours():
    good = "<p>This is one long sentence of the text that goes on for a while, until it stops.</p>"
    found = M.blocks(f"<body><div>{good}<div>odd</div>{good}</div></body>")
    alone = M.log_odds(found)[1]
    assert alone < 0.7 and M.label(found) == [True, True, True]


def test_long_page_is_read_whole():
    page = "<article>" + "".join(f"<p>Sentence number {i} is here.</p>" for i in range(5000)) + "</article>"
    assert M.main_text(page) == " ".join(f"Sentence number {i} is here." for i in range(5000))


def test_operator(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", PAGE % f"<article>{BODY}</article>", "clash", 3), (None, None, None, None, None), (2, "v", "", "", 0), (2, "v", "", "", 0)]
    got = sorted((tuple(r) for r in M.extract(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT)), (None, None, "", 0), (2, "v", "", 0), (2, "v", "", 0)], key=str)
    assert M.extract(spark.createDataFrame([], schema)).collect() == []
