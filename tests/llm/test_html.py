import re
from html import unescape

import numpy as np
import pytest

from memlake.llm import html
from memlake.llm.tables import read

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def net(spark):
    return html.fit(html.sample(read(spark, SF, "pages"), "html"))


def plain_rule(page):
    """Main text of the given pages by their one template."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    parts = [" ".join(unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


def test_all_pages_equal_the_rule(spark, net):
    pages = read(spark, SF, "pages")
    got = {r.id: r for r in html.extract(pages, net).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == plain_rule(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


OTHER = """<html><head><title>T</title></head><body><header><h2>Site name here</h2></header><div class="top menu"><ul><li>Home</li><li>News</li></ul></div>
<div class="cookie-notice"><p>We use cookies on this site.</p></div>%s<h1>A long headline of the story</h1><p>The first paragraph of the story has a good many words in it, so it reads as text.</p>
<p>The second paragraph &amp; its <b>bold</b>&nbsp;words go on for quite some time as well, with <a href=x>a link</a>.</p><script>var x = "<p>no</p>";</script>%s
<aside><p>Read this too</p></aside><section class="comments"><p>Great story, thanks!</p></section><form><label>Your mail</label><button>Send</button></form><footer><p>Imprint</p></footer></body></html>"""


@pytest.mark.parametrize("opened,closed", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>")])
def test_other_templates(net, opened, closed):
    got = html.texts_of(net, [html.blocks(OTHER % (opened, closed))], html.Vectors())[0]
    assert got == ("A long headline of the story\nThe first paragraph of the story has a good many words in it, so it reads as text.\n"
                   "The second paragraph & its bold words go on for quite some time as well, with a link.")


def test_blocks_of_odd_markup():
    text = lambda page: [t for _, t in html.blocks(page)]
    assert text(None) == text("") == text("<p> <b></b>\n</p>") == []
    assert text("a<br>b<p>c<p>d</div>e") == ["a b", "c", "d", "e"]
    assert text("1 < 2 &lt; 3 <b>x</b>y<!-- no --><") == ["1 < 2 < 3 xy<"]
    assert text("<script>no</script><style>no<p></style>yes<script>cut off") == ["yes"]
    assert text('<p title="a > b">x</p><p class=c>y') == ["x", "y"]
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert text("<textarea><p>raw</textarea>after") == ["<p>raw", "after"]
    assert [p for p, _ in html.blocks('<body><nav class="MainMenu top-2"><p>x</nav><p>y')] == [("body", "nav", ".main", ".menu", ".top", ".2", "p"), ("body", "p")]
    assert text("<div>" * 3000 + "deep") == ["deep"]
    assert text("x" * 500_000 + "<p>" * 10_000) == ["x" * 500_000]


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in html.new_net(1).items()}
    rows = [rng.normal(size=(n, html.DIM)).astype(np.float32) for n in (5, 2, 1)]
    labels = [rng.random(len(r)) < 0.5 for r in rows]

    def loss(net):
        out = 0
        for p, y in zip(html.predict(net, rows), labels):
            out -= (np.log(np.where(y, p, 1 - p))).sum()
        return out / len(rows)

    grads = html._gradients(net, rows, labels)
    for name, g in grads.items():
        flat = np.abs(g).ravel().argmax()
        at = np.unravel_index(flat, g.shape)
        up, down = ({k: v.copy() for k, v in net.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=3e-2, abs=1e-4), name


def test_pages_do_not_touch_each_other(net):
    pages = [html.blocks(OTHER % ("<article>", "</article>")), [], html.blocks("<p>one"), html.blocks(OTHER % ("<main>", "</main>") * 20)]
    alone = [html.texts_of(net, [p], html.Vectors())[0] for p in pages]
    assert html.texts_of(net, pages, html.Vectors()) == alone


def test_odd_rows(spark, net):
    rows = [(1, None, None), (None, "u", ""), (2, "v", "<article><p>Some words of main text stand here.</article>"), (2, "v", "<article><p>Some words of main text stand here.</article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS text", "1 AS id", "2 AS n_chars")
    got = sorted(map(tuple, html.extract(df, net).collect()), key=str)
    assert len(got) == 4 and (1, None, "", 0) in got and (None, "u", "", 0) in got
    assert html.extract(df.limit(0), net).count() == 0
    assert html.texts_of(html.fit([]), [html.blocks("<p>x")], html.Vectors()) is not None
