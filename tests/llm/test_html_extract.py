"""Marginals against all labellings of small trees, and extraction on held-out pages and odd ones."""

import itertools
import math
import random

import numpy as np
import pytest

from fleet_audit.llm.dom_model import _levels, sum_product
from fleet_audit.llm.dom_tree import LABEL, landmark_labels, parse
from fleet_audit.llm.html_extract import extract, fit_extraction, main_texts
from fleet_audit.llm.labelled_pages import laid_out
from fleet_audit.llm.op13_html_extraction import op13_html_extraction

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return fit_extraction(spark.read.parquet(f"{SF}/pages.parquet"))


def blocks(html):
    return [t for t in parse([html]).text if t is not None]


def test_messages_give_the_marginals_of_all_labellings():
    rng = random.Random(1)
    for _ in range(20):
        parent = [-1] + [rng.randrange(k) for k in range(1, rng.randrange(2, 9))]
        depth = [0] * len(parent)
        for k in range(1, len(parent)):
            depth[k] = depth[parent[k]] + 1
        forest = parse([""])
        forest.parent, forest.depth = np.array(parent), np.array(depth)
        unary, edges = np.array([rng.gauss(0, 2) for _ in parent]), np.array([[[rng.gauss(0, 2) for _ in "ab"] for _ in "ab"] for _ in parent])
        one, pairs, total = np.zeros(len(parent)), np.zeros((len(parent), 2, 2)), 0.0
        for y in itertools.product((0, 1), repeat=len(parent)):
            weight = math.exp(sum(u * s for u, s in zip(unary, y)) + sum(edges[k][y[parent[k]]][y[k]] for k in range(1, len(parent))))
            total += weight
            one += weight * np.array(y)
            for k in range(1, len(parent)):
                pairs[k][y[parent[k]]][y[k]] += weight
        found, found_pairs = sum_product(unary, edges, forest.parent, _levels(forest))
        assert np.allclose(found, one / total) and np.allclose(found_pairs[1:], pairs[1:] / total)


def test_blocks_of_text():
    assert blocks("<p>a <b>b</b>\n c&amp;&#233;&nbsp;d<p>e<br>f<ul><li>g<li>h</ul>i<script>var t='</p>';</script><!-- x --><td>j") == ["a b c&é d", "e f", "g", "h", "i", "j"]
    assert blocks("</div>a</p><select><option>no</select><style>no</style>b<textarea>no</textarea>") == ["a", "b"]
    assert blocks("") == blocks("<p> <p>\n") == []
    assert blocks("<div>" * 3000 + "deep") == ["deep"]


def test_held_out_pages(spark, model):
    """Pages of another scale, none of which the model has seen, and layouts of another draw."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id >= 1000 and page_id < 1400").collect()]
    forest = parse(pages)
    label = landmark_labels(forest)
    want = ["\n\n".join(t for t, one, p in zip(forest.text, label, forest.page) if t and one and p == k) for k in range(len(pages))]
    assert sum(a == b for a, b in zip(main_texts(pages, model), want)) >= 0.98 * len(pages)
    drawn = laid_out([w for w in want if w], 150, seed=99)
    forest = parse(drawn)
    found = [set(t.split("\n\n")) for t in main_texts(drawn, model)]
    right = [(t in found[p]) == bool(one) for t, one, p in zip(forest.text, forest.label, forest.page) if t]
    assert sum(right) >= 0.95 * len(right)


def test_parts_that_are_not_the_article(model):
    story = "The council met on Monday and spoke for hours about the new bridge over the river. "
    page = f"""<html><body><div class="cookie-notice">We use cookies to make this site work.</div><header>Daily Paper</header><nav><a href=/>Home</a> <a href=/b>News</a></nav>
      <div class="post-body"><h1>A bridge</h1><p>{story * 3}</p><div class="advert">Buy now</div><p>{story * 2}</p></div>
      <aside class="sidebar"><h3>More</h3><a href=/c>Other story</a></aside><form class="subscribe"><p>Your mail</p><button>Go</button></form>
      <section class="comments"><div class="comment"><p>{story}</p></div></section><footer>&copy; Daily Paper</footer></body></html>"""
    assert main_texts([page], model) == ["\n\n".join(["A bridge", (story * 3).strip(), (story * 2).strip()])]


def test_labels_are_no_input(model):
    page = "<body><div><p>" + "Some words of a text. " * 9 + "</p></div></body>"
    assert main_texts([page], model) == main_texts([page.replace("<div>", f'<div {LABEL}="0">')], model)


def test_query_and_odd_rows(spark, model):
    found = op13_html_extraction(spark, SF).collect()
    assert len(found) == 250 and all(r.n_chars == len(r.text) for r in found)
    rows = [(1, None, "t", 1), (2, "", "t", 2), (2, "", "t", 2), (None, "<p", "t", 3), (4, "x" * 300_000, None, 4)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, label int")
    out = extract(df, model)
    assert out.columns == ["page_id", "html", "label", "text"] and out.count() == 5
    assert [r.text for r in out.filter("page_id <= 2").collect()] == ["", "", ""]
    none = fit_extraction(df.limit(0))
    assert extract(df.limit(0), none).collect() == []
