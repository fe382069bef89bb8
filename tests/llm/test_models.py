"""The trained operators: held-out accuracy on the driver tables, and awkward cases."""

from __future__ import annotations

import html.parser as html_parser
import re
import time
import zlib

import numpy as np
import pytest

from postloom.llm import html_blocks, html_labeller, licenses, quality
from postloom.llm.shared import table
from tests.llm import cases

FOLDER = "/root/testdata/sf0.01"


def test_quality_is_told_on_held_out_rows(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    rows = quality.scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    good = [r for r in held if r.quality == 1]
    assert np.mean([r.predicted for r in good]) > 0.95


def test_held_out_labels_are_never_learned(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    turned = labels.withColumn("quality", (1 - labels["quality"]).cast("int"))
    held = quality.held_out("doc_id")
    mixed = labels.where(~held).unionByName(turned.where(held))
    some = docs.where("doc_id < 300")
    want = sorted(map(tuple, quality.scores(some, labels).collect()))
    assert sorted(map(tuple, quality.scores(some, mixed).collect())) == want


def test_quality_scores_every_row(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame(
        [(200 + i, i % 2, 0) for i in range(40)] + [(201, None, 0), (None, 1, 0), (202, 1, 0), (99999, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    rows = quality.scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    none = quality.scores(docs, cases.empty(labels)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    assert quality.scores(cases.empty(docs), labels).collect() == []


def test_dual_descent_separates_what_can_be_separated():
    r = np.random.default_rng(0)
    rows = [np.unique(np.r_[r.integers(100, 5000, 40), [1 if i % 2 else 2]]).astype(np.int32) for i in range(200)]
    model = quality.fit(rows, np.arange(200) % 2)
    assert all((model.score(g) >= 0.5) == (1 in g) for g in rows)


def sparse_rows(seed: int, n: int = 60):
    r = np.random.default_rng(seed)
    labels = r.integers(0, 2, n)
    rows = [np.unique(np.r_[r.integers(0, 300, r.integers(0, 25)), 400 + y if r.random() < 0.8 else 402]).astype(np.int32) for y in labels]
    return rows, labels


def test_ratios_are_those_of_smoothed_counts():
    rows, labels = sparse_rows(1)
    found = quality.log_ratios(rows, labels)
    total = [sum(len(g) for g, y in zip(rows, labels) if y == c) + quality.SIZE * quality.SMOOTHING for c in (0, 1)]
    for k in [*range(0, 410, 7), 400, 401, 402, 5000]:
        counts = [sum(k in g for g, y in zip(rows, labels) if y == c) + quality.SMOOTHING for c in (0, 1)]
        assert found[k] == pytest.approx(np.log(counts[1] / total[1] / (counts[0] / total[0])))


def test_dual_descent_closes_the_gap_of_the_hinge_loss(monkeypatch):
    """The primal loss of the fitted weights is that of plain subgradient descent, or below."""
    monkeypatch.setattr(quality, "EPOCHS", 400)
    rows, labels = sparse_rows(2)
    ratios = quality.log_ratios(rows, labels)
    scaled, bias = quality.dual_descent(rows, labels, ratios)
    size, signs = 403, np.where(labels == 1, 1.0, -1.0)
    x = np.zeros((len(rows), size + 1))
    for row, grams in zip(x, rows):
        row[grams] = ratios[grams] / max(len(grams), 1) ** quality.LENGTH
    x[:, size] = 1.0  # the intercept is one more weight
    costs = quality.COST * 0.5 / (np.bincount(labels) / len(labels))[labels]

    def loss(w):
        return 0.5 * w @ w + costs @ np.maximum(1 - signs * (x @ w), 0)

    weights = np.divide(scaled[:size], ratios[:size], out=np.zeros(size), where=ratios[:size] != 0)
    fitted = np.r_[weights, bias]
    w = best = np.zeros(size + 1)
    for step in range(1, 20_000):
        wrong = signs * (x @ w) < 1
        w = w - (w - (costs * signs * wrong) @ x) / step
        best = w if loss(w) < loss(best) else best
    assert loss(fitted) <= loss(best) + 1e-3
    # Margins of the model are those of the plain product.
    model = quality.Model(scaled.astype(np.float64), bias, 1.0, 0.0)
    assert np.allclose([model.margin(g) for g in rows], x @ fitted, atol=1e-8)


PAGES = [
    (1, "u", "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li>"
     "<li><a href='/a'>About</a></li></ul></nav><article><h1>A &amp; B</h1><p>First  long\n paragraph of <b>text</b> here "
     "that goes on for a while.<p>Second paragraph of the article, also with several words.</p></article>"
     "<footer>&copy; site</footer><script>var x='</p><p>no</p>';</script></body></html>"),
    (2, "u", None), (3, "u", ""), (4, None, "<!-- only a comment"), (None, "u", "<script>alert(1)"),
    (5, "u", "<article><p>Cut off in the middle of a sentence that has many words &am"),
]


def test_pages(spark):
    df = spark.createDataFrame([(*p, 0, "x") for p in PAGES + PAGES[:1]], "page_id long, url string, html string, n_chars int, text string")
    rows = html_labeller.extract(df).collect()
    assert len(rows) == len(df.collect())
    got = {r.page_id: r.text for r in rows}
    assert got[1] == (
        "A & B\n\nFirst long paragraph of text here that goes on for a while.\n\n"
        "Second paragraph of the article, also with several words."
    )
    assert got[2] == got[3] == got[4] == got[None] == ""
    assert got[5].startswith("Cut off") and all(r.n_chars == len(r.text) for r in rows)
    assert html_labeller.extract(cases.empty(df)).collect() == []


@pytest.mark.parametrize("tag", ["svg", "math", "object", "noscript", "iframe", "template", "title"])
def test_an_element_without_an_end_tag_does_not_cut_the_page(tag):
    found = [b.text for b in html_blocks.blocks_of(f"<p>before</p><{tag}><p>one</p><p>two</p>")]
    assert found == ["before", "one", "two"]


def test_only_code_and_hidden_text_is_left_out():
    def texts(page):
        return [b.text for b in html_blocks.blocks_of(page)]

    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p>") == ["Let x=1 be"]
    assert texts("<noscript><p>a</p><noscript>b</noscript><p>c</p></noscript>d") == ["a", "b", "c", "d"]
    assert texts("<object data=x><object><p>a</p></object><p>b</p></object><p>c</p>") == ["a", "b", "c"]
    assert texts("<svg><path d='M0'/><text>label</text></svg><svg/><p>a</p>") == ["label", "a"]
    assert texts("<template>x<template>y</template>z</template><p>a</p><script>b<p>c") == ["a"]
    paths = [b.path for b in html_blocks.blocks_of("<noscript><p>a</p></noscript>")]
    assert paths == [(("p",),)]


def test_quotes_and_breaks():
    def texts(page):
        return [b.text for b in html_blocks.blocks_of(page)]

    assert texts("<p class='it's'>One sentence here.</p><p>Don't lose me.</p><p>Last.</p>") == ["One sentence here.", "Don't lose me.", "Last."]
    assert texts("<p title=\"abc>One</p><p>Two</p>") == ["One", "Two"]
    assert texts("<p title='a > b' data-x=\"c > 'd'\">One</p>") == ["One"]
    assert texts("<p a = 'x>y' b=\"\">One") == ["One"]
    assert texts("<p>super<wbr>cali</p><p>a<img src=x>b<br>c<hr>d</p>") == ["supercali", "ab c", "d"]
    assert texts("<script src=x />var a=1;</script><p>One</p>") == ["One"]
    assert texts("<svg><style/><text>in</text></svg><p>One</p>") == ["in", "One"]


class TextNodes(html_parser.HTMLParser):
    """An independent reading: all text but that of code, titles and templates."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.found = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in html_blocks.HIDDEN

    def handle_endtag(self, tag):
        self.hidden -= tag in html_blocks.HIDDEN

    def handle_data(self, data):
        if not self.hidden:
            self.found += data.split()


def test_all_text_nodes_survive(spark):
    quotes = "<div title=\"it's > 5\"><p class='a \"b\"'>One <b>two</b></p><p id=x'y>three</p></div><p>it's \"so\"</p>"
    pages = [r.html for r in table(spark, FOLDER, "pages").collect()] + [quotes]
    for page in pages:
        nodes = TextNodes()
        nodes.feed(page or "")
        nodes.close()
        assert "".join(nodes.found) == "".join("".join(b.text.split()) for b in html_blocks.blocks_of(page))


@pytest.mark.parametrize("unit,tail", [
    ("<a ", '"'), ("<iframe>x", ""), ("<template>x", ""), ("<b>x", "</i>" * 60_000), ("<div>x", ""), ("<b>", "<p>x</p>" * 40_000),
    ('<a x="', ""), ("<!-- ", ""), ("<svg>", "<path/>" * 40_000), ("<p a='", '"' * 9), ("<title>", ""),
])
def test_hostile_pages_take_linear_time(unit, tail):
    """A page of about a megabyte in seconds."""
    started = time.process_time()
    html_blocks.blocks_of(unit * (600_000 // len(unit)) + tail)
    assert time.process_time() - started < 10


def test_articles_within_other_elements_are_read(spark):
    long = "Paragraph of the article, also with several words that go on for a while."
    wrapped = [f"<{t}><p>{long}</p></{t}>" for t in ("noscript", "object")] + [f"<p>{long} <math><mi>x</mi></math></p>"]
    page = f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Title here</h1><p>{long}</p>%s<p>{long}</p></article></body></html>"
    rows = [(k, "u", page % w) for k, w in enumerate(wrapped)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r.text.count("Paragraph") for r in html_labeller.extract(df).orderBy("page_id").collect()] == [3, 3, 3]


def test_articles_of_the_driver_pages(spark):
    pages = table(spark, FOLDER, "pages")
    html = {r.page_id: r.html for r in pages.collect()}

    def article(page: str) -> str:
        """The blocks of the article element, found by a pattern that fits these pages."""
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        blocks = [" ".join(b.text for b in html_blocks.blocks_of(p)) for p in re.split(r"</?(?:p|h1)>", inner)]
        return "\n\n".join(b for b in blocks if b)

    rows = html_labeller.extract(pages).collect()
    assert np.mean([r.text == article(html[r.page_id]) for r in rows]) > 0.98


def test_blocks_of_layouts_not_seen_in_training():
    rows, labels = html_labeller.examples(seed=12345, pages=200)
    found = html_labeller.chances(rows, html_labeller.trained())
    right = np.concatenate([(p >= 0.5) == y for p, y in zip(found, labels)])
    assert right.mean() > 0.98


def test_batches_do_not_change_labels():
    rows, _ = html_labeller.examples(seed=5, pages=30)
    weights = html_labeller.trained()
    together = html_labeller.chances(rows, weights)
    for row, chances in zip(rows, together):
        assert np.allclose(html_labeller.chances([row], weights)[0], chances, atol=1e-4)


NOTICES = [
    (1, "Some text of a document.\nLicensed under CC BY-NC 4.0."), (2, "Released under the MIT License.\nReleased under the MIT License."),
    (3, None), (4, ""), (5, "A driving license is needed to rent a car.\nThe license was renewed."),
    (6, "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0."),
    (6, "nothing here"), (7, "word " * 30_000), (None, "All rights reserved."),
]


def test_license_notices(spark):
    docs = spark.createDataFrame([(*n, "x", 1.0) for n in NOTICES], "doc_id long, text string, h1 string, chance double")
    got = sorted((str(r.doc_id), "|".join(r.licenses), r.n_license_paragraphs) for r in licenses.scan(docs).collect())
    both = "Apache|GPL"
    assert got == [
        ("1", "CC-BY-NC", 1), ("2", "MIT", 2), ("3", "", 0), ("4", "", 0), ("5", "", 0), ("6", both, 2), ("6", both, 2),
        ("7", "", 0), ("None", "Reserved", 1),
    ]
    assert licenses.scan(cases.empty(docs)).collect() == []


def test_licenses_of_the_driver_documents(spark):
    docs = table(spark, FOLDER, "documents")
    marks = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the MIT License.": "MIT", "All rights reserved.": "Reserved",
        "Licensed under the Apache License, Version 2.0.": "Apache",
        "This work is licensed under the GNU General Public License, version 3.": "GPL",
    }
    model = licenses.train(docs)
    got = {r.doc_id: r for r in licenses.scan(docs, model).collect()}
    for r in docs.collect():
        lines = [marks[x] for x in r.text.split("\n") if x in marks]
        assert got[r.doc_id].licenses == sorted(set(lines)) and got[r.doc_id].n_license_paragraphs == len(lines)
    # The joined form and the plain one agree on every paragraph that has a weight.
    for r in licenses.scan_paragraphs(docs, model).collect():
        assert model.chances(r.paragraph).max() == pytest.approx(r.chance)


def test_license_plan_is_native(spark):
    docs = table(spark, FOLDER, "documents")
    plan = licenses.scan_paragraphs(docs, licenses.train(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
