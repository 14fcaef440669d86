import html
import re

import pytest

from murmur.llm import pages, queries
from tests.llm.util import SF, frame

ARTICLE = "<h1>A headline</h1><p>First paragraph, with words &amp; marks.<p>Second <b>one</b>,\n spread   out.<br>After a break."
WANT = "A headline\nFirst paragraph, with words & marks.\nSecond one, spread out. After a break."
CASES = {
    "plain article": (f"<html><body><article>{ARTICLE}</article></body></html>", WANT),
    "surroundings": (f"<!DOCTYPE html><head><title>A headline</title><style>p>a{{}}</style></head><body class='has-sidebar'><header><h1>Site</h1><p>Slogan, "
                     f"long enough to look like text.</p></header><nav><ul><li><a href='/'>Home</a></ul></nav><div class='cookie-notice'><p>We use cookies, "
                     f"as all do. Accept them.</p></div><main>{ARTICLE}<aside><p>See also this, that.</p></aside><form><label>Mail, please.</label></form></main>"
                     f"<section id=comments><h2>Comments</h2><p>I do not agree, at all.</p></section><div class=sidebar>Tags, links.</div><footer>(c) 2024, all "
                     f"rights.</footer><script>var x = '<p>no</p>';</script></body>", WANT),
    "no article element": (f"<body><div class=top><a href=a>One</a> <a href=b>Two</a></div><div id=text>{ARTICLE * 3}</div><div><a href=c>Imprint</a></div>",
                           "\n".join([WANT] * 3)),
    "comments and scripts": ("<article><!-- <p>no</p> --><script>if (a < b) { c('</p>') }</script><p>Yes, this.</p><!-- open", "Yes, this."),
    "hidden": ("<article><p>Shown text, here.</p><p hidden>No.</p><p style='display: none'>No.</p></article>", "Shown text, here."),
    "quoted >": ("<article><p title='a > b' class=\"x\">Text, one.</p></article>", "Text, one."),
    "stray": ("</div><article></b><p>Text < more, one.</article></p>", "Text < more, one."),
    "references": ("<article><p>&lt;tag&gt; &#233;&nbsp;&#x41; &copy; &unknown; a&b.</p></article>", "<tag> é A © &unknown; a&b."),
    "header in article": ("<article><header><h1>Title, one</h1></header><p>Body text, here it is.</p><footer>by X</footer></article>",
                          "Title, one\nBody text, here it is."),
    "null": (None, ""), "empty": ("", ""), "blank": (" \n", ""), "text only": ("just  text", "just text"), "only menu": ("<nav>Menu</nav>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    source, want = CASES[name]
    assert pages.main_text(source) == want


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "<p>Deep, but text.</p>" + "</div>" * 5000
    assert pages.main_text(deep) == "Deep, but text."
    long = "<article>" + "".join(f"<p>Paragraph {k}, of many.</p>" for k in range(20000)) + "</article>"
    assert len(pages.main_text(long).split("\n")) == 20000
    assert pages.main_text("<article><p " + "a='" * 3000 + ">x, y") is not None


LONG = "A long paragraph of text, with marks, and so on. " * 20
PROBES = {
    "long block among short paragraphs": ("<article><pre>" + "code line x; " * 3000 + "</pre>" + "<p>Short para, here.</p>" * 6 + "</article>", 7),
    "list after long paragraphs": (f"<body><div><p>{LONG}</p><ul>" + "<li>item one</li>" * 6 + "</ul></div>", 7),
    "page in a form": ("<form><main><h1>T</h1><p>Words, in a main.</p></main></form>", 2),
    "plain page in a form": (f"<body><form id=aspnet><div><h1>T</h1><p>{LONG}</p></div></form>", 2),
    "layout word on a wrapper": ("<div class='has-sidebar'><article><p>Text, yes.</p></article></div>", 1),
    "layout word, no article": (f"<div class='has-sidebar'><div><h1>T</h1><p>{LONG}</p></div><div class=sidebar><a href=x>link</a></div></div>", 2),
    "telling word on a heading": ("<article><h1 class='notice-title'>Notice of it</h1><p>Body, text.</p></article>", 2),
    "short block between paragraphs": (f"<div class=a><p>{LONG}</p><div class=b>Quote.</div><p>{LONG}</p></div>", 3),
    "links in running text": (f"<div><p>{LONG}</p><p><a href=x>One</a>, two.</p></div>", 2),
}


@pytest.mark.parametrize("name", PROBES)
def test_nothing_of_an_article_is_lost(name):
    source, lines = PROBES[name]
    got = pages.main_text(source).split("\n")
    assert len(got) == lines and "link" not in got


def untelling_page(k: int) -> tuple[str, str]:
    """A page without article element or telling names, and its text."""
    body = [f"Sentence {i} of page {k}, which tells a little more, and then it ends." for i in range(6 + k % 9)]
    text = [f"Headline {k}", *body, "short end."]
    links = "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(3 + k % 7))
    teasers = "".join(f"<p><a href={i}>Read more about {i}</a></p>" for i in range(4))
    main = "<h1>" + text[0] + "</h1>" + "".join(f"<p>{x}</p>" for x in body) + "<ul><li>short end.</li></ul>"
    return (f"<body><div class=alpha><ul>{links}</ul></div><div class=beta>Buy this, now.</div><div class=gamma>{main}</div>"
            f"<div class=delta>{teasers}</div><div class=omega><p>(c) {k}</p></div></body>", "\n".join(text))


def test_path_scores_decide_where_nothing_else_tells():
    for k in range(60):
        source, want = untelling_page(k)
        assert pages.main_text(source) == want
        assert pages.main_text(source, share=0) != want


def test_word_lists_break_ties_only(monkeypatch):
    monkeypatch.setattr(pages, "NOISE_WORDS", frozenset())
    monkeypatch.setattr(pages, "CONTENT_PRIOR", 1.0)
    for k in range(60):
        source, want = untelling_page(k)
        assert pages.main_text(source) == want


def test_pages_keep_their_texts_without_the_word_list(spark, monkeypatch):
    """Adverts are told from articles by their scores; only articles about as short as an advert need the list."""
    rows = [r.html for r in spark.read.parquet(f"{SF.replace('0.001', '0.1')}/pages.parquet").collect()]
    want = [pages.main_text(x) for x in rows]
    monkeypatch.setattr(pages, "NOISE_WORDS", frozenset())
    other = [w for x, w in zip(rows, want) if pages.main_text(x) != w]
    assert len(other) <= 0.02 * len(rows) and all(len(w) < 200 for w in other)


def test_rows(spark):
    rows = [(k, f"http://{k}", s) for k, (s, _) in enumerate(CASES.values())] + [(0, None, CASES["plain article"][0]), (None, "u", None)]
    got = pages.extract(frame(spark, rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as key")).collect()
    want = [w for _, w in CASES.values()] + [WANT, ""]
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in got) == sorted(
        (str(i), str(u), w, len(w)) for (i, u, _), w in zip(rows, want))
    assert pages.extract(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_query_finds_the_articles(spark):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op10_tag_path_ratios(spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<(?!br)[^>]*>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)
