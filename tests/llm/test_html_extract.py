import duckdb
import numpy as np
import pytest
from tests.llm.helpers import CLASHING
from tests.test_queries import DATA

from tidelake.llm import html_extract, queries, sql
from tidelake.llm._common import table
from tidelake.llm.html_extract import Block, blocks

SCHEMA = "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in ("path", "block", *CLASHING))


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * (len(CLASHING) + 2)) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def labeller(spark):
    return html_extract.fit(table(spark, DATA, "pages"))


def test_all_pages_of_a_larger_table(spark, labeller):
    """Fitted on the small table; the pages of the large one that were not in it, against their articles by SQL."""
    folder = "/root/testdata/sf0.1"
    wanted = {r[0]: r[1:] for r in duckdb.sql(sql.HTML_EXTRACT.replace("FROM pages", f"FROM '{folder}/pages.parquet'")).fetchall()}
    found = html_extract.extract(table(spark, folder, "pages"), labeller).collect()
    assert len(found) == len(wanted) and all((r.url, r.text, r.n_chars) == wanted[r.page_id] for r in found)


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{a:b}</style></head><body class="a b" id=c><!-- <p>no</p> -->
    <nav><ul><li><a href="/x>y">Home</a><li>Two</ul></nav><script>if (a < b) document.write("<p>no</p>")</script>
    <div><p>One <b>bold<i>er</b> &amp; &lt;b&gt;&#33;<br>line<p>a < b &copy</div>tail<hr>end <unknown x='>'>of</unknown> it</p></body>"""
    assert blocks(page) == [
        Block(("html", "body.a.b#c", "nav", "ul", "li"), "Home", 1.0),
        Block(("html", "body.a.b#c", "nav", "ul", "li"), "Two", 0.0),
        Block(("html", "body.a.b#c", "div", "p"), "One bolder & <b>! line", 0.0),
        Block(("html", "body.a.b#c", "div", "p"), "a < b \N{COPYRIGHT SIGN}", 0.0),
        Block(("html", "body.a.b#c"), "tail", 0.0),
        Block(("html", "body.a.b#c"), "end of it", 0.0),
    ]
    assert blocks(None) == blocks("") == blocks("<p> &#32;\n</p><!-- open <p>x") == blocks("<script>never ends <p>x") == []
    assert [b.text for b in blocks("plain text")] == ["plain text"]
    assert [b.text for b in blocks("<p class='it>x</p><p title=a\"b>y</p>")] == ["x", "y"]


def test_edges(spark, labeller):
    long = "<article>" + "".join(f"<p>Sentence number {i} of a very long article, with words.</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", " "), (None, "u", "<article><p>No id, but text.</p></article>"), (5, "u", f"<nav>Home</nav>{long}"), (6, "u", "<nav><ul><li><a href=x>Home</a></li></ul></nav>")]
    rows += [(7, "u", "<article><p>Twice &amp; told.</p></article>")] * 2
    found = {}
    for r in html_extract.extract(frame(spark, rows), labeller).collect():
        assert r.n_chars == len(r.text)
        found.setdefault(r.page_id, []).append(r.text)
    assert found[1] == found[2] == found[3] == found[6] == [""] and found[None] == ["No id, but text."] and found[7] == ["Twice & told."] * 2
    assert found[5][0].count("\n") == 19_999
    assert html_extract.extract(frame(spark, []), labeller).count() == 0
    told = html_extract.label_blocks(frame(spark, rows), labeller).where("page_id = 7").collect()
    assert len(told) == 2 and all(r.path == "article/p" and r.score > 0.5 for r in told)


def test_without_pages_that_mark_an_article(spark):
    empty = html_extract.fit(frame(spark, []))
    rows = [(i, "u", "<p>only text</p>") for i in range(3)]
    html_extract.fit(frame(spark, rows))
    page = "<nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav><article><h1>A title</h1><p>Some words that are read.</p></article><footer>All rights</footer>"
    assert html_extract.extract(frame(spark, [(1, "u", page)]), empty).first().text == "A title\nSome words that are read."


def test_other_layouts(spark, labeller):
    """Layouts and texts that were not fitted on: menus, notices, adverts, forms and readers' comments go."""
    pages = [blocks(r.html) for r in table(spark, "/root/testdata/sf0.1", "pages").where("page_id >= 2000").select("html").collect()]
    known = [(found, html_extract.own_labels(found)) for found in pages]
    others = [b.text for found, labels in known for b, label in zip(found, labels, strict=True) if not label]
    wrong = total = 0
    for i, (found, labels) in enumerate(known):
        made, truth = html_extract.made_up(np.random.default_rng(i), [b.text for b, label in zip(found, labels, strict=True) if label], others)
        scores = labeller.scores([html_extract.block_vectors(made)])[0]
        wrong, total = wrong + int(((scores >= 0.5) != truth).sum()), total + len(truth)
    assert wrong / total < 0.03


def test_each_direction_matters(labeller):
    """The same block gets another score among other neighbours."""
    block = Block(("html", "body", "div", "p"), "Some words here.", 0.0)
    menu = [Block(("html", "body", "nav", "ul", "li"), "Home", 1.0)] * 5
    article = [Block(("html", "body", "article", "p"), "A long sentence with many words in it, as articles have.", 0.0)] * 5
    before, after = (labeller.scores([html_extract.block_vectors(p)])[0] for p in ([*menu, block, *article], [*article, block, *menu]))
    assert before[5] != after[5]
    alone = labeller.scores([html_extract.block_vectors([block])])[0][0]
    assert len({round(float(x), 6) for x in (alone, before[5], after[5])}) == 3


def test_gradients():
    rng = np.random.default_rng(3)
    size = html_extract.PATH_SIZE + html_extract.WORD_SIZE + html_extract._STATISTICS
    network = html_extract.Labeller()
    x, mask = html_extract._padded([rng.normal(size=(n, size)).astype(np.float32) for n in (5, 3)])
    y = (rng.random(mask.shape) < 0.5).astype(np.float32)

    def loss():
        (ahead, _), (back, _) = network._states(x, mask)
        p = html_extract._sigmoid(np.concatenate([ahead, back[::-1]], axis=2) @ network.weights["out"] + network.weights["bias"])
        return -np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0).sum() / mask.sum()

    for name, gradient in network._gradients(x, mask, y).items():
        weights = network.weights[name]
        at = np.unravel_index(np.abs(gradient).argmax(), weights.shape)
        kept, found = weights[at], []
        for step in (0.01, -0.01):
            weights[at] = kept + step
            found.append(loss())
        weights[at] = kept
        assert abs((found[0] - found[1]) / 0.02 - gradient[at]) < 1e-3 + 0.02 * abs(gradient[at])


def test_query(spark):
    assert queries.op11_html_extract(spark, DATA).columns == ["page_id", "url", "text", "n_chars"]
