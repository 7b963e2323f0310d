import itertools

import numpy as np
import pytest

from tessella.llm import domtree


def test_marginals_by_enumeration():
    pages = [domtree.parse("<div class=a><p>x</p><ul><li>y</li><li>z</li></ul></div>"), domtree.parse("<p>q")]
    r = np.random.default_rng(0)
    model = domtree.Model(r.normal(size=domtree.FEATURES), r.normal(size=(2, 2)))
    f = domtree.forest(pages)
    p, pairs = model.marginals(f)
    score = np.bincount(f.node, model.weights[f.feature], len(f.parents))
    total, on, joint = 0, np.zeros(len(p)), np.zeros((len(p), 2, 2))
    for z in itertools.product((0, 1), repeat=len(p)):
        w = np.exp(sum(s for s, x in zip(score, z) if x) + sum(model.turns[z[a], z[i]] for i, a in enumerate(f.parents) if a >= 0))
        total += w
        on += w * np.array(z)
        for i, a in enumerate(f.parents):
            if a >= 0:
                joint[i, z[a], z[i]] += w
    assert np.allclose(p, on / total) and np.allclose(pairs, joint / total)


@pytest.mark.parametrize(
    "html, blocks",
    [
        ("<p>a &amp; b\n  c<p><b>d<br>e</b>&nbsp;f", ["a & b c", "d e f"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<div>a<script>if (a<b) '</p>'</script>b<!-- <p>no</p> --><style>p{}</style>c</div>", ["abc"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("a < b <p title='x > y'>c</p> <svg><p>no</p></svg>d &am &amp e<br", ["a < b", "c", "d &am & e"]),
        ("", []),
        ('<p class="a>b', ["b"]),
        ("</div></p>x", ["x"]),
        ("<script>never closed", []),
    ],
)
def test_parse(html, blocks):
    assert [t for _, t, _ in domtree.parse(html).blocks] == blocks


@pytest.mark.parametrize(
    "html, blocks",
    [
        ("<script>for(i=0;i<n;i++){} // don't</script><p>It's a first paragraph.</p><p>Next.</p>", ["It's a first paragraph.", "Next."]),
        ("<style>/* <b \" */</style><div class=x><p>a</p></div><p title=\"t\">b</p>", ["a", "b"]),
        ("<textarea><a '</textarea><p>it's<p>b", ["it's", "b"]),
        ("<script><!-- </script><p>a</p> <!-- no --> b", ["a", "b"]),
    ],
)
def test_no_token_begins_in_raw_text(html, blocks):
    assert [t for _, t, _ in domtree.parse(html).blocks] == blocks


def test_held_out_layouts():
    pages = [domtree.parse(x) for x in domtree.labelled_pages(200, 77)]
    p, _ = domtree.trained().marginals(domtree.forest(pages))
    y = np.concatenate([domtree.labels_of(x) for x in pages])
    assert np.mean((p >= 0.5) == (y > 0)) > 0.97


def test_table(spark):
    page = '<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div><article><h1>Title</h1><p>One &lt;b&gt;.</p><p>Two.</p></article><div class=comments><p>I say, nice.</p></div><footer>&copy; x</footer></body></html>'
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<div>" * 3000 + "deep"), (4, "x", "\x00<<>&#xD800;&#99999999;")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string")
    got = domtree.extract(frame).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] == 1] == ["Title\nOne <b>.\nTwo."] * 2
    assert [r["text"] for r in got if r["page_id"] in (2, None)] == ["", ""]
    assert domtree.extract(frame.limit(0)).count() == 0


BLOG = """<html><head><title>My days</title></head><body><div id=top><a href=/>Home</a> <a href=/about>About</a></div>
<div id=col1>Today I walked to the harbour and looked at the boats for a long while, as the wind was low.<br><br>
Later it rained, so I went home, made tea, and read the letters that had come in spring.
<div class=comments><h4>2 comments</h4><p>Lovely, thanks for sharing this!</p><p>Same here, it rained all day.</p></div></div>
<div id=col2><h4>Archive</h4><ul><li><a href=/1>January</a></li><li><a href=/2>February</a></li><li><a href=/3>March</a></li></ul></div>
<div class=footer>&copy; 2020 me</div></body></html>"""
BLOG_TEXT = """Today I walked to the harbour and looked at the boats for a long while, as the wind was low. Later it rained, so I went home, made tea, and read the letters that had come in spring."""
WIKI = """<html><body><div class="mw-body"><div class="mw-parser-output"><div class="hatnote">For the town, see <a href=/t>Tern (town)</a>.</div>
<p>A <b>tern</b> is a seabird of the family that also holds gulls, and most of them nest in colonies near water.</p>
<div class="toc"><ul><li><a href=#a>Range</a></li><li><a href=#b>Food</a></li></ul></div>
<h2>Range</h2><p>Terns live on all coasts of the world, and some of them travel farther than any other bird each year.</p></div></div>
<div id="mw-navigation" class="nav"><ul><li><a href=/r>Random page</a></li><li><a href=/h>Help</a></li></ul></div></body></html>"""
WIKI_TEXT = """A tern is a seabird of the family that also holds gulls, and most of them nest in colonies near water.
Range
Terns live on all coasts of the world, and some of them travel farther than any other bird each year."""
DOCS = """<html><body><nav class="sidebar"><ul><li><a href=/a>Start</a></li><li><a href=/b>Guide</a></li></ul></nav>
<div class="document"><div class="body" role="main"><h1>Distances</h1><p>The distance is <math><mi>d</mi><mo>=</mo><mn>2</mn></math> for all points of the first row.</p>
<pre>d = far(a, b)</pre><p>Use it with care, as it costs a square root for each pair.</p></div></div>
<footer>Built with a tool. <a href=/s>Source</a></footer></body></html>"""
DOCS_TEXT = """Distances
The distance is d=2 for all points of the first row.
d = far(a, b)
Use it with care, as it costs a square root for each pair."""


@pytest.mark.parametrize("html, text", [(BLOG, BLOG_TEXT), (WIKI, WIKI_TEXT), (DOCS, DOCS_TEXT)])
def test_layouts_written_by_hand(html, text):
    assert domtree.texts([html], domtree.trained()) == [text]


def test_text_beside_blocks_stands_alone():
    page = domtree.parse("<div class=a>x<p>y</p>z</div>")
    assert [(page.keys[n][0], t) for n, t, _ in page.blocks] == [("#text", "x"), ("#text", "y"), ("#text", "z")]
    assert [page.parents[n] for n, _, _ in page.blocks][0] == [page.parents[n] for n, _, _ in page.blocks][2]


def test_nothing_within_an_article_is_dropped():
    page = "<article><h1>One</h1><p>Some words of it, which are enough. <canvas>drawn</canvas> <object>held</object></p><p>And <math><mi>x</mi></math>.</p></article>"
    assert domtree.texts([page], domtree.trained()) == ["One\nSome words of it, which are enough. drawn held\nAnd x."]
