from __future__ import annotations

import html
import re

import pytest

from tableprep.llm import html_wrapper as w

SHOP = """<!doctype html><html><head><title>t{i}</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<header class="site-header"><h2>My site</h2></header><div id="sidebar"><ul>{links}</ul></div>
<div class="cookie-notice">We use cookies.</div>
<div class="page"><div class="entry"><h1>Title {i}</h1><p>First &amp; <b>bo</b>ld
 text {i}.<p>Second&nbsp;text{extra}.</div><form><p>Your mail</p><input name=x></form>
<section class="comments"><p>Nice one {i}!</p></section></div><footer>&copy; us</footer></body></html>"""
PLAIN = "<html><body><div class=menu><a href=/>home</a></div><div><div>{text}</div><div><a href=x>{i} more</a></div></div></body></html>"


def shop(i):
    links = "".join(f"<li><a href='/{k}'>link {k}</a></li>" for k in range(i % 4 + 1))
    return SHOP.format(i=i, links=links, extra="<br>after" if i % 2 else "")


def plain(i):
    return PLAIN.format(i=i, text="".join(f"<p>Paragraph {k} of page {i}, long enough to matter.</p>" for k in range(i % 3 + 1)))


def test_wrappers_are_union_free_and_find_the_article():
    wrapper = w.infer([w.skeleton(shop(i)) for i in range(6)])
    text = " ".join(i.text() for i in wrapper)
    assert "(<li><a>#</></>)+" in text and "(<br></>)?" in text and "|" not in text
    assert w.main_path(wrapper) == ["html", "body", "div.page", "div.entry"]
    assert w.main_path(w.infer([w.skeleton(plain(i)) for i in range(6)]))[:3] == ["html", "body", "div"]


def test_repeated_groups_of_several_elements():
    page = "<dl>" + "<dt>k</dt><dd>v</dd>" * 3 + "</dl>"
    text = " ".join(i.text() for i in w.infer([w.skeleton(page), w.skeleton("<dl><dt>k</dt><dd>v</dd><dt>k</dt><dd>v</dd></dl>")]))
    assert re.search(r"\(\(?<dt>.*</> <dd>.*</>\)?\)\+", text)


def test_texts_of_two_templates(spark):
    rows = [(i, f"http://shop.example.com/{i}", shop(i)) for i in range(30)] + [(100 + i, f"https://Plain.example.org/{i}?q", plain(i)) for i in range(8)]
    found = {r["page_id"]: r for r in w.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        want = f"Title {i} First & bold text {i}. Second text" + (" after." if i % 2 else ".")
        assert found[i]["text"] == want and found[i]["n_chars"] == len(want)
    for i in range(8):
        assert found[100 + i]["text"].startswith(" ".join(f"Paragraph {k} of page {i}, long enough to matter." for k in range(i % 3 + 1)))


def test_pages_against_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r["page_id"]: r["text"] for r in w.extract_pages(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        inner = re.sub(r"<[^>]+>", "", re.sub(r"</?(h1|p|br)[^>]*>", " ", inner))
        assert found[r["page_id"]] == " ".join(html.unescape(inner).split())


def test_odd_pages(spark):
    rows = [
        (1, "http://a.example/x", None, "n"), (2, "http://a.example/x", "", "n"), (3, None, "just text &lt;b&gt;", "n"), (4, "no url", "<nav>menu</nav>", "n"),
        (None, "http://a.example/x", "<p>unclosed <b>tags <i>everywhere", "n"), (5, "", "<" * 300 + "a <b", "n"),
        (6, "http://deep.example/", "<div>" * 3000 + "<p>deep down</p>", "n"), (6, "http://deep.example/", "<article><p>Again</p><script>x", "n"),
        (7, "http://long.example/", "<article>" + "<p>many words</p>" * 20_000 + "</article>", "n"),
    ]
    pages = spark.createDataFrame([(*r, "h", "s") for r in rows], "page_id long, url string, html string, text string, host string, salt string")
    found = sorted(((r["page_id"], r["text"]) for r in w.extract_pages(pages).collect()), key=str)
    texts = dict(found)
    assert len(found) == len(rows) and texts[1] == texts[2] == texts[4] == ""
    assert texts[3] == "just text <b>" and texts[None] == "unclosed tags everywhere"
    assert {t for i, t in found if i == 6} == {"deep down", "Again"}
    assert texts[7] == " ".join(["many words"] * 20_000)


def test_no_rows(spark):
    assert w.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("bad", ["<!-- never closed", "<p title='>'>x", "</p></div>", "<td><td><tr>", "<a href=\"x>", "<![CDATA[x]]>"])
def test_any_text_can_be_parsed(bad):
    w.extract(bad, ["html", "body"])


def test_small_named_element_does_not_win_over_the_article():
    page = "<body><div class=a><div class=b><p>{0} first part of the article.</p></div><div class=c><p>{0} second part of it.</p></div></div><div class=text>hi</div></body>"
    pages = [page.format(i) for i in range(4)]
    path = w.main_path(w.infer([w.skeleton(x) for x in pages]))
    for i, x in enumerate(pages):
        assert f"{i} first part of the article. {i} second part of it." in w.extract(x, path)


@pytest.mark.parametrize("name", ["content with-sidebar", "content-sidebar-wrap", "no-comments", "has-banner", "nav-fixed", "page-search"])
def test_wrapper_of_the_page_is_not_furniture(name):
    page = "<body><div class='{1}'><h1>Title {0}</h1><p>The article of page {0} is here.</p><div class=sidebar>Other things</div></div><div class=footer>us</div></body>"
    pages = [page.format(i, name) for i in range(4)]
    path = w.main_path(w.infer([w.skeleton(x) for x in pages]))
    for i, x in enumerate(pages):
        assert w.extract(x, path) == f"Title {i} The article of page {i} is here."


def test_form_around_an_article_is_not_furniture_and_comments_are():
    page = "<form id=all><article><p>Short one.</p></article><div class=comments><p>A comment that is longer than the article.</p></div></form>"
    assert w.extract(page, None) == "Short one."


def test_nesting_of_any_depth_keeps_its_tags():
    inner = "<div>One.</div><div>Two.</div><nav>menu</nav><div class=ads>buy</div>"
    page = "<body><article>" + "<font>" * 70 + "<div>" * 30 + inner + "</div>" * 30 + "<p>Last words.</p></article><footer>us</footer></body>"
    assert w.extract(page, ["body", "article"]) == w.extract(page, None) == "One. Two. Last words."
    deep = "<div>" * 20_000 + "<p>deep {0}</p>" + "</div>" * 20_000 + "<p>after</p>"
    path = w.main_path(wrapper := w.infer([w.skeleton(deep.format(i)) for i in range(2)]))
    assert w.extract(deep.format(5), path).startswith("deep 5") and wrapper[0].text().count("<div>") == 20_000
