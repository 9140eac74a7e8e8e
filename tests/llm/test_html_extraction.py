from __future__ import annotations

import html
import re
from itertools import product

import pytest

from sigstrata.llm import html_extraction as he
from sigstrata.llm.common import table
from sigstrata.llm.labelled_pages import labelled_pages
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def model():
    return he.labelled_model()


def texts(source):
    return [b[0] for b in he.Page(source, he.element_features).blocks]


def test_whole_table_equals_the_article_elements(spark, model):
    rows = he.extract(table(spark, SF_SMALL, "pages"), model).collect()
    given = {r.page_id: r.html for r in table(spark, SF_SMALL, "pages").collect()}
    assert len(rows) == len(given)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", given[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"<(?:/?p|/?h1)>", article.replace("<br>", " "))]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_held_out_pages_of_other_layouts(model):
    exact, found, wrong, missed = 0, 0, 0, 0
    pages = labelled_pages(150, seed=99)
    for source, main in pages:
        got = model.text(source)
        exact += got == main
        a, b = set(got.split("\n")), set(main.split("\n"))
        found, wrong, missed = found + len(a & b), wrong + len(a - b), missed + len(b - a)
    assert exact >= 0.88 * len(pages) and found / (found + wrong) > 0.98 and found / (found + missed) > 0.98


P1 = "The river rose in the night, and by the morning the lower town was under water. Nobody had expected it."
P2 = "Three bridges were closed; the old one, built in 1874, held. Engineers will look at it again on Monday."
PAGES = [
    f"""<html><head><title>x</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
    <div id="cookie-banner"><p>We use cookies to make this site better for everyone.</p><button>Accept</button></div>
    <header class="site-header"><a href="/">Daily</a><nav><ul><li><a href=/a>News<li><a href=/b>Sport</ul></nav></header>
    <div class="container"><main><h1>Flood &amp; bridges</h1><p>{P1}<p>{P2}</main>
    <aside class="sidebar"><h3>Most read</h3><ul><li><a href=/1>A very long headline about something else</a></ul></aside></div>
    <section id="comments"><h2>2 comments</h2><div class="comment"><b>Ann</b><p>I live there, and it was worse than you write.</p></div></section>
    <footer>© 2024 Daily. All rights reserved.</footer></body></html>""",
    f"""<body><div class="topbar"><a href="/">Home</a> | <a href="/login">Login</a></div>
    <div class="post"><div class="post-content"><h1>Flood &amp; bridges</h1><p>{P1}</p><div class="ad">Buy boots now, two pairs for one!</div>
    <p>{P2}</p></div></div><form action=/s><label>Your mail</label><input name=m><button>Subscribe</button></form>
    <div class="footer"><p>Contact and imprint. The publisher is not liable for links.</p></div></body>""",
    f"""<article><header><h1>Flood &amp; bridges</h1></header><p>{P1}</p><p>{P2}</p>
    <div class="share-buttons"><a href="#">Tweet</a> <a href="#">Share</a></div></article>
    <ol class="commentlist"><li class="comment"><p>First! And thanks for the good report.</p></li></ol>""",
]


@pytest.mark.parametrize("source", PAGES)
def test_pages_written_by_hand(model, source):
    assert model.text(source) == f"Flood & bridges\n{P1}\n{P2}"


def test_blocks_of_broken_markup():
    assert texts("") == [] and texts("only text &lt;b&gt;") == ["only text <b>"]
    assert texts("<p>a<p>b<div>c</p>d</div>e") == ["a", "b", "c", "d", "e"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul>d") == ["a", "b", "c", "d"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("<p>x<b>y</b>z<br>w &nbsp;\n v</p>") == ["xyz w v"]
    assert texts("<script>a</script>b<style>p</STYLE >c<!-- d --><!doctype x><?e?>f</ g>") == ["bcf"]
    assert texts("<a title='1 > 0'>a</a><p class=x\">b") == ["a", "b"]
    assert texts("1 < 2 & 3 > 2 &amp &copy; &am") == ["1 < 2 & 3 > 2 & © &am"]
    assert texts("a<script>never closed <p>b") == ["a"] and texts("a<!-- open") == ["a"] and texts("a<p") == ["a"]
    assert texts("<head><title>t</title><p>a") == ["a"] and texts("<noscript>a<p>b</p></noscript>c") == ["c"]


def test_ancestors_and_links():
    blocks = he.Page('<nav class="mainMenu"><a href=x>Home</a></nav><p>b</p>', he.element_features).blocks
    assert {"in nav", "named main", "named menu", "nearest nav", "nearest name menu"} <= blocks[0][1] and blocks[0][4] == 4
    assert "in nav" not in blocks[1][1] and blocks[1][4] == 0


def test_viterbi_finds_the_best_of_all_labellings(model):
    reader = model.reader()
    for source, _ in labelled_pages(25, seed=5):
        page = he.Page(source, he.element_features)
        page.blocks = page.blocks[:9]
        heading, own = False, []
        for at, (text, above, tag, _, linked) in enumerate(page.blocks):
            own.append(sum(model.weights.get(f, 0) for f in [*above, *he.text_features(text, tag, linked), *he.place_features(at, len(page.blocks), heading)]))
            heading = heading or tag == "h1"

        def score(labels):
            return sum(w * y for w, y in zip(own, labels)) + sum(
                model.pairs[int(page.blocks[k][3] == page.blocks[k - 1][3])][labels[k - 1]][labels[k]] for k in range(1, len(labels)))

        best = max(product((0, 1), repeat=len(own)), key=score, default=())
        assert abs(score([int(x) for x in reader.labels(page.blocks)]) - score(best)) < 1e-9


def test_training_learns_from_any_pairs():
    pages = [(f"<div class=x><p>w{k} a</p></div><div class=y><p>w{k} b</p></div>", f"w{k} b") for k in range(20)]
    learned = he.train(pages, rounds=100)
    assert learned.text("<div class=x><p>q</p></div><div class=y><p>r</p></div>") == "r"
    assert he.train([]).text("<p>a</p>") == "" and he.train([("", "")]).text("") == ""


def test_edges(spark, model):
    rows = [(1, None, "u"), (1, "", "u"), (None, "<p>x" * 30_000, "u"), (2, "<div>" * 20_000 + "deep", "u"), (3, "plain words only.", None)]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, html string, url string, text string, n_chars int")
    got = he.extract(pages, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and dict(got.dtypes)["n_chars"] == "bigint"
    out = sorted(((r.page_id, r.text, r.n_chars) for r in got.collect()), key=str)
    assert out[:2] == [(1, "", 0), (1, "", 0)] and len(out) == 5 and (3, "plain words only.", 17) in out
    assert he.extract(pages.limit(0), model).collect() == []
