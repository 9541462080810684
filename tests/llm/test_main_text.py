"""Main text of pages written by hand: marked and unmarked articles, broken markup, nulls."""

import html

MARKED = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<!-- <p>not this</p> --><div class="ad">An advert that is longer than the whole article of this page.</div><article><h1>Short</h1><p><b>One &amp; two<br><p>three&nbsp;four
five</p><aside>beside</aside><div class="share-buttons">Share</div><p>x</p><section id="comments"><article>A comment on it.</article></section></article><footer>&copy; site</footer>"""
FREE = """<body class="has-sidebar"><header><h1>Site</h1><a href=/>Home</a></header><div id="cookie-notice">We use cookies on this site and others, you must agree to all of them.</div>
<div class="menu"><a>One</a> <a>Two</a></div><div class="content"><h2>Title &lt;b&gt;</h2><p class=lead>First paragraph of the article which is long enough to surge over everything else.</p>
<div class="slot ad">Buy this</div><p>Short.<p>Second <b>bold</b> one<br>with a break.<ul><li>a</li><li>b <a href=x>link</a></li></ul><table><tr><td>1</td><td>2</td></tr></table><p>End.</p></div>
<div class="sidebar"><p>Side text which is somewhat long too and should go, for it is no article.</p></div><div class="commentList"><p>I like this a lot, really a lot, so I write long comments under it, longer than that.</p></div>
<form><label>Name</label><input></form><footer>foot</footer></body>"""


def test_pages():
    from weftlake.llm.main_text import main_text

    assert main_text(MARKED) == "Short\nOne & two\nthree four five\nx"
    assert main_text(FREE) == "Title <b>\nFirst paragraph of the article which is long enough to surge over everything else.\nShort.\nSecond bold one with a break.\na\nb link\n1 2\nEnd."
    assert [main_text(x) for x in (None, "", "<p>", "<nav>a</nav>", "plain", "<p>a<p>b", "<form><p>all in a form</p></form>", "<MAIN><P>A</MAIN>b")] == ["", "", "", "", "plain", "a\nb", "all in a form", "A"]
    assert main_text("<nav><p>never closed<article><p>a</article>") == "a"
    assert main_text("<article><header><h1>H</h1></header><p>t</p></article>") == "H\nt"
    assert main_text("<p title='a>b'>x</p><![CDATA[ <y> ]]>") == "x\n<y>"


def test_long_page_keeps_all():
    from weftlake.llm.main_text import main_text

    lines = [f"line {i} & {'word ' * (i % 7)}".strip() for i in range(20_000)]
    page = "<nav>menu</nav><article>" + "".join(f"<p>{html.escape(x)}" for x in lines) + "</article>"
    assert main_text(page).split("\n") == lines


def test_frame(spark):
    from weftlake.llm.main_text import extract_main_text, main_text_report

    rows = [(1, "u", MARKED, "old", 3, "x"), (1, "u", MARKED, "old", 3, "x"), (None, None, None, None, None, None), (2, "v", "", "", 0, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, Html2 string")
    got = sorted((tuple(r) for r in main_text_report(pages).collect()), key=str)
    whole = "Short\nOne & two\nthree four five\nx"
    assert got == sorted([(1, "u", whole, len(whole))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert extract_main_text(pages).columns == ["page_id", "url", "html", "Html2", "text", "n_chars"]
    assert extract_main_text(pages.limit(0)).count() == 0
    assert extract_main_text(pages.select("page_id", "text"), "text").columns == ["page_id", "text", "n_chars"]


def test_stretches_choose_the_lines_of_marked_pages(monkeypatch):
    from weftlake.llm import main_text as m

    page = "<nav>menu</nav><article><h1>T</h1><p>by A<nav>x</nav><nav>y</nav><nav>z</nav><nav>w</nav><p>" + "word " * 40 + "<p>end</article><p>out"
    assert m.main_text(page) == "T\nby A\n" + ("word " * 40).strip() + "\nend"
    assert m.stretches([1, 4, 199, 3], 80.0, True) == [(0, 4)] and m.stretches([1, 0, 0, 0, 4, 199, 0, 0, 0, 5], 80.0, True) == [(4, 6)]
    monkeypatch.setattr(m, "stretches", lambda weights, *a: [(1, 2)] if len(weights) == 4 else [])
    assert m.main_text(page) == "by A"
