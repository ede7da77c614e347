import itertools
import random

import pytest

from marketloom.llm import content
from marketloom.llm.html_blocks import blocks

PLAIN = content.Classifier({})
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header class=top><h1>Site</h1><nav><a href=x>Home</a></nav></header>
<div class="cookie-notice">We use cookies. Accept all of them, please do it.</div>
<div id="wrapper"><div class="post-content"><header><h2>Title &eacute; here</h2></header><!-- <p>no</p> -->
<p>First  long
paragraph&nbsp;of text, with a <a href="a>b">link</a>.<br>It goes on &amp on.<p>Second &lt;b&gt; para&#8217;s <b>bo</b>ld.
<ul><li>item one<li>item two</ul><table><tr><td>cell<td>other</table><div hidden>never</div>
<form><p>Your mail, please.</p></form></div>
<div class="sidebar"><ul><li><a>Other post</a></li></ul></div>
<section id="comments"><article class="comment"><p>I think that this is great, thank you very much.</p></article></section>
</div><footer>&copy; 2024. All rights reserved.</footer></body></html>"""


def test_page():
    assert content.main_text(PAGE, PLAIN).split("\n") == [
        "Title é here", "First long paragraph of text, with a link. It goes on & on.", "Second <b> para’s bold.",
        "item one", "item two", "cell", "other",
    ]


def test_pages_without_landmarks():
    text = "A plain page without any landmarks, but with a sentence or two. Here is more for all to read."
    page = f"<p>{text}</p><div><a href=a>x</a> | <a href=b>yy</a></div>"
    assert content.main_text(page, PLAIN) == text
    for odd in (None, "", " ", "<", "<!--", "<script>x", "<p", "<a \"" * 500, "</div></p>"):
        assert content.main_text(odd, PLAIN) in ("", "<", "x")


def cost(gains, links, side):
    return sum(max(g, 0) if not s else max(-g, 0) for g, s in zip(gains, side)) + sum(
        w for a, b, w in links if side[a] != side[b]
    )


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(1, 9)
        gains = [round(rng.uniform(-3, 3), 3) for _ in range(n)]
        links = [(a, b, round(rng.uniform(0, 2), 3)) for a in range(n) for b in range(a) if rng.random() < 0.4]
        got = cost(gains, links, content.source_side(gains, links))
        best = min(cost(gains, links, s) for s in itertools.product([True, False], repeat=n))
        assert got == pytest.approx(best)


def test_smoothing_moves_doubtful_blocks():
    assert content.source_side([5.0, -0.3, 5.0], [(0, 1, 1.0), (1, 2, 1.0)]) == [True, True, True]
    assert content.source_side([-5.0, 0.3, -5.0], [(0, 1, 1.0), (1, 2, 1.0)]) == [False, False, False]


def test_long_and_deep_pages_end():
    long_ = "<article>" + "<p>word, word.</p>" * 20_000 + "</article>"
    assert content.main_text(long_, PLAIN).count("\n") == 19_999
    assert blocks("<div>" * 20_000 + "x" + "</div>" * 20_000)[0].text == "x"


def test_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (2, None, None), (None, "v", ""), (3, "w", "<p>x</p>" * 3000)]
    pages = spark.createDataFrame([(*r, "", 0) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = content.extracted(pages).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 2] == ["", ""]
    assert "Title é here" in next(r.text for r in got if r.page_id == 1)
    assert content.extracted(pages.limit(0)).collect() == []


def test_training_learns_the_look(spark):
    pages = [(i, "u", f"<nav><a>Link {i}</a><a>More</a></nav><article><p>Some sentence {i}, with words. And more.</p></article>") for i in range(50)]
    weights = content.train(spark.createDataFrame(pages, "page_id long, url string, html string")).weights
    assert weights["links 0"] > 0 > weights["links 4"]


@pytest.mark.parametrize("outer", ["main", "article"])
@pytest.mark.parametrize("box", ["ad", "cookie-notice", "sidebar", "post-share", "related posts"])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_boxes_inside_the_article_are_boilerplate(outer, box, tag):
    text = "The story is told in a sentence or two, with commas. And there is more of it to read here."
    note = "Buy this thing now, it is cheap and good. We promise that you will not regret it, ever."
    page = f"""<div class="page with-sidebar ad"><{outer}><h1>Head</h1><p>{text}</p><{tag} class="{box}"><p>{note}</p></{tag}>
    <div class="layout with-sidebar"><p>{text}</p></div></{outer}></div>"""
    assert content.main_text(page, PLAIN).split("\n") == ["Head", text, text]


def test_formulas_are_text():
    page = (
        "<main><article><p>Let <math><semantics><mi>x</mi><annotation encoding='tex'>\\bar x</annotation>"
        "</semantics></math> be here, as it was said before.</p></article></main>"
    )
    assert content.main_text(page, PLAIN) == "Let x be here, as it was said before."
