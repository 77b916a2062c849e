"""Corpus operators beside plain re-computations, and pages that break off, nest deeply or are very long."""

import os
import time
import zlib

import numpy as np
import pytest

from factloom.llm import html_extract, quality
from factloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_quality_scores_by_plain_linear_algebra(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    labels = dict(map(tuple, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()))
    held_out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    x = {i: np.array(quality.statistics(t)) for i, t in docs}
    classes = [np.array([x[i] for i in x if labels.get(i) == c and not held_out(i)]) for c in (0, 1)]
    covs = [np.cov(c, rowvar=False, bias=True) for c in classes]
    n = [len(c) for c in classes]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    density = []
    for c, cov in zip(classes, covs, strict=True):
        mixed = 0.7 * cov + 0.3 * pooled
        mixed = 0.98 * mixed + 0.02 * np.diag(np.diag(mixed)) + 1e-5 * np.eye(len(mixed))
        density.append((c.mean(axis=0), np.linalg.inv(mixed), np.linalg.slogdet(mixed)[1]))

    def score(v):
        a, b = (-0.5 * ((v - m) @ inv @ (v - m) + log) for m, inv, log in density)
        return 1 / (1 + np.exp(-np.clip(b - a + np.log(n[1] / n[0]), -500, 500)))

    got = {r.doc_id: r for r in QUERIES["op5_quality"](spark, SF).collect()}
    assert got.keys() == x.keys()
    for i, r in got.items():
        assert r.held_out == held_out(i) and abs(r.score - score(x[i])) < 1e-6 and r.predicted == int(r.score >= 0.3)


def blocks(page):
    return [t for t in ("".join(p for p in n.parts if isinstance(p, str)) for n in html_extract.read_page(page)) if t.strip()]


def test_what_is_no_text_of_a_page():
    assert blocks("<p>a</p><script src='x'/>var leak = 1;</script><p>b</p>") == ["a", "b"]
    assert blocks("<p>a</p><iframe src='x'/><p>b</p>") == ["a", "b"] and blocks("<svg/><p>c</p>") == ["c"]
    assert blocks("<p>a<![CDATA[ x > y ]]>b</p><p>c<![CDATA[ never ends") == ["ab", "c"]
    assert blocks("<p>a <ins class='adsbygoogle'>buy <ins>now</ins> it</ins>b</p><p>c <span class=ad>x</p><p>d</p>") == ["a b", "c ", "d"]
    assert blocks("<ul><li>1<li>2</ul></section></div><table><tr><td>x<tr><td>y</table>") == ["1", "2", "x", "y"]


def test_an_article_keeps_its_own_header():
    page = "<body><header><p>Site</p></header><article><header><h1>A fine title</h1></header><p>Text.</p><footer>Tags</footer></article></body>"
    nodes = html_extract.read_page(page)
    told = {"".join(p for p in n.parts if isinstance(p, str)): label for n, label in zip(nodes, html_extract.weak_labels(nodes), strict=True)}
    assert (told["Site"], told["A fine title"], told["Text."], told["Tags"]) == (0.0, 1.0, 1.0, 0.0)
    names = {n.tag: f[:2] for n, f in zip(nodes, html_extract.node_features(nodes), strict=True) if n.tag == "header"}
    assert names["header"] == [0.0, 0.0]


def test_long_and_deep_pages_take_time_in_proportion():
    for page in ("<div>" * 40_000 + "x" + "</section>" * 40_000, "<p>word " * 150_000, "<li>" * 100_000 + "</b>" * 100_000, "<span class='x'>a</span>" * 50_000):
        began = time.perf_counter()
        nodes = html_extract.read_page(page)
        html_extract.node_features(nodes)
        assert time.perf_counter() - began < 20 and len(page) > 500_000
