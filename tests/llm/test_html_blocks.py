import duckdb
import pytest

from seqloom.llm import html_blocks, html_training

BROKEN = {"": [], "plain": ["plain"], "<p>a<p>b": ["a", "b"], "<p>a <b>b<br>c</p>d</b>": ["a b c", "d"], "<!-- x": [], "a<!-- <p>b --> c": ["a c"],
          "<script>var t='</p>'; x</script>y": ["y"], "<script>never ends": [], "</p></div>z": ["z"], "<ul><li>1<li>2</ul>3": ["1", "2", "3"],
          "a &lt;b&gt; &amp;amp; &#233;&nbsp;c": ["a <b> &amp; é c"], '<p title="a>b">c</p>': ["c"], "<p title=\"a>b": ["b"], "< p>q": ["< p>q"],
          "<table><tr><td>1<td>2<tr><td>3</table>": ["1", "2", "3"], "<head><title>t</title></head><body>u": ["u"], "a\r\n\t b": ["a b"]}

# drawings, formulas, objects and templates: closed by a slash, by a parent, by an element that only HTML has, or not at all
EMBEDDED = {'a <svg class="i"/>b<p>c': ["a b", "c"], "a<math/>b": ["ab"], "<svg/><script>x</script>y": ["y"], "<p>a<object>b</p><p>c": ["ab", "c"],
            "<div>x<svg><p>y</p></div>z": ["x", "y", "z"], "<div>x<svg><path d='q'>y</div><p>z": ["xy", "z"], "<div><svg><title>t</div><p>y": ["t", "y"],
            "<p>Let <math><msup><mi>x</mi><mn>2</mn></msup></math> be.<p>q": ["Let x2 be.", "q"], "<p>a<svg><title>Icon</title><path/></svg>b</p>": ["ab"],
            "<p>a<svg><title/><g/></svg>b</p><title>t</title>c": ["ab", "c"], "<svg><text>A</text><text>B</text></svg>": ["A", "B"],
            "<svg><foreignObject><p>in</p>side</foreignObject></svg>out": ["in", "side", "out"], "<p>a<svg><style>x{}</style></svg>b": ["ab"],
            "<p>a<object data='f'><p>fall</p><b>back</b></object></p>c": ["a", "fall", "back", "c"],
            "<ul><li>a<template><li>b</li></template><li>c</ul>": ["a", "b", "c"], "<iframe>z</iframe>w": ["w"]}


@pytest.fixture(scope="module")
def weights():
    return html_training.trained()


@pytest.mark.parametrize("html", list(BROKEN))
def test_blocks_of_broken_markup(html):
    assert [b.text for b in html_blocks.page_blocks(html)] == BROKEN[html]


@pytest.mark.parametrize("html", list(EMBEDDED))
def test_blocks_of_embedded_elements(html):
    assert [b.text for b in html_blocks.page_blocks(html)] == EMBEDDED[html]


def test_embedded_elements_are_on_the_path():
    page = "<p><math><mi>x</mi></math><p><object>b</object><template>c</template><svg><text>d</text></svg><p><math>x</math> is a number"
    marks = [{m for marks in b.path for m in marks} & {"t:math", "t:object", "t:template", "t:svg"} for b in html_blocks.page_blocks(page)]
    assert marks == [{"t:math"}, {"t:object"}, {"t:template"}, {"t:svg"}, set()]


def test_text_for_readers_without_scripts(weights):
    """What stands in `noscript` is judged like any other text."""
    paragraphs = [f"The {word} part of the report says in plain words what was seen on the coast that day, and why it matters." for word in ("first", "second", "third")]
    page = (f"<html><body><nav><a href='/'>Home</a></nav><article><h1>A report</h1><p>{paragraphs[0]}</p><noscript><p>{paragraphs[1]}</p></noscript>"
            f"<p>{paragraphs[2]}</p></article><footer>All rights reserved</footer></body></html>")
    (text,) = html_blocks.main_texts([page], html_blocks.Labeller(weights), html_blocks.Features())
    assert set(paragraphs) <= set(text.split("\n"))
    assert [b.text for b in html_blocks.page_blocks("<p>a<noscript>b</noscript><p>c")] == ["a", "b", "c"]


@pytest.mark.parametrize("more", ['<svg class="i"/>', "<p>Before <svg><path d='x'></p>", "<object data='a.pdf'><p>A sentence that stands in the text.</p></object>",
                                  "<p>The value of <math><mi>x</mi></math> is what counts in this long sentence of the text.</p>"])
def test_embedded_elements_cut_no_article(weights, more):
    pages = [h for h, in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    labeller, features = html_blocks.Labeller(weights), html_blocks.Features()
    plain, got = (html_blocks.main_texts(p, labeller, features) for p in (pages, [h.replace("</h1>", "</h1>" + more, 1) for h in pages]))
    assert sum(set(a.split("\n")) <= set(b.split("\n")) for a, b in zip(plain, got, strict=True)) >= 0.99 * len(pages)


def test_held_out_layouts(weights):
    blocks, pages = html_training.held_out_accuracy(weights)
    assert blocks > 0.99 and pages > 0.93


def test_given_pages_give_exactly_their_article(weights):
    pages = [h for h, in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    got = html_blocks.main_texts(pages, html_blocks.Labeller(weights), html_blocks.Features())
    want = ["\n".join(b.text for b in html_blocks.page_blocks(h) if any("t:article" in m for m in b.path)) for h in pages]
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.99 * len(pages)


def test_batching_cannot_change_scores(weights):
    labeller, features = html_blocks.Labeller(weights), html_blocks.Features()
    pages = [html_training._Maker(__import__("numpy").random.default_rng(s)).page() for s in range(12)] + [""]
    together = html_blocks.main_texts(pages, labeller, features)
    assert together == [html_blocks.main_texts([p], labeller, features)[0] for p in pages]


def test_training_is_repeatable():
    a, b = (html_training.train(30, 1) for _ in range(2))
    assert all((a[k] == b[k]).all() for k in a)


def test_frame(spark):
    page = "<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A title here</h1><p>Some words of the text.</p></article><footer>(c)</footer>"
    rows = [(1, page, 5, "x"), (1, page, 5, "x"), (2, None, 6, None), (3, "", 7, "y")]
    got = html_blocks.extract(spark.createDataFrame(rows, "page_id long, html string, n_chars int, text string")).collect()
    assert sorted((r.page_id, r["_h_text"], r["_h_n_chars"], r.n_chars) for r in got) == [
        (1, "A title here\nSome words of the text.", 36, 5), (1, "A title here\nSome words of the text.", 36, 5), (2, "", 0, 6), (3, "", 0, 7)]
