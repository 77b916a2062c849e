"""HTML extraction: boosted trees score the nodes of a page, and a top-down choice makes the scores agree.

A page is read into a tree of its block elements. Each node gets features of its subtree, its attribute
words, its depth and its siblings; gradient-boosted trees turn them into log-odds of being main text.
The choice that follows is hierarchical: a node that goes takes its whole subtree along, so no
ancestor contradicts a descendant.

The trees are trained on a bounded sample of the pages themselves. Elements and attribute words that
name their role label the nodes below them. For half of the training pages these names are hidden, so
that the trees learn what main text looks like where a page names nothing; into the other half go
paragraphs of the page under names of other roles, so that the trees learn to trust names over looks. Each half has trees of its own, and a page is scored
by those of its kind.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from factloom.llm.common import cut

#: Pages of the training sample (all, if there are fewer); trees and their depth.
SAMPLE, TREES, DEPTH = 300, 10, 3

#: Elements whose content is no text of the page.
_RAW = frozenset("script style noscript template textarea title svg math iframe object select button".split())
_BLOCK = frozenset(
    "html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th "
    "caption blockquote pre figure figcaption form fieldset address details summary hr dialog menu search center".split()
)
#: A start tag of the first closes an open element of the second.
_CLOSES = {
    **dict.fromkeys(_BLOCK - {"html", "body"}, frozenset({"p"})),
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
}
#: No start tag closes anything outside of these.
_FENCE = frozenset("html body main article section header footer nav aside div ul ol dl table blockquote form".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements and attribute words that name the role of what they hold.
_GOOD_TAGS = frozenset("article main".split())
_BAD_TAGS = frozenset("nav header footer aside form dialog menu fieldset".split())
_GOOD_WORDS = frozenset("article content post entry story main body maincontent articlebody text".split())
_BAD_WORDS = frozenset(
    "ad ads advert advertisement adverts banner promo promotion sponsor sponsored nav navigation navbar menu breadcrumb breadcrumbs "
    "sidebar side footer header masthead cookie cookies consent notice popup modal newsletter subscribe signup login social share "
    "sharing related recommended comment comments reply replies disqus widget pager pagination copyright toolbar skip search form "
    "disclaimer legal".split()
)

#: Elements that a slash in the start tag closes.
_FOREIGN = frozenset("svg math".split())
#: Words of attributes by which an element within a paragraph is an advert.
_AD_WORDS = frozenset("ad ads advert advertisement adverts adsbygoogle sponsor sponsored promo".split())

#: A quote that is never closed is no quote: then the tag ends at the next >.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>|\Z)|[^>]*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("children", "depth", "link", "parts", "place", "tag", "text", "up", "words")

    def __init__(self, tag: str, up: Node | None, words: frozenset[str]) -> None:
        self.tag, self.up, self.words = tag, up, words
        self.depth = up.depth + 1 if up else 0
        self.place = len(up.children) if up else 0
        self.children: list[Node] = []
        #: Own text as pieces, and child nodes where they stand between them.
        self.parts: list[str | Node] = []
        self.text = self.link = 0
        if up:
            up.children.append(self)
            up.parts.append(self)


def _words(attributes: str) -> frozenset[str]:
    """Words in the attributes that name an element."""
    named = " ".join(m[1].strip("\"'") for m in _ATTRIBUTE.finditer(attributes)) if attributes else ""
    return frozenset(w.lower() for w in _PIECES.findall(named))


def read_page(page: str | None) -> list[Node]:
    """The block nodes of a page in page order, the root first. Unclosed, stray and cut-off tags are fine.

    An advert within a paragraph has no text; it ends with its element, or where the next block starts or ends.
    """
    root = Node("html", None, frozenset())
    nodes, at, here, raw, link, advert = [root], 0, root, "", 0, None
    #: Open elements by name, so that a stray end tag is known without a walk to the root.
    opened: dict[str, int] = {}
    page = page or ""

    def left(node: Node) -> Node:
        """Where a page goes on when node has ended."""
        at = here
        while at is not node.up:
            opened[at.tag] -= 1
            at = at.up
        return at

    while at < len(page):
        if raw:
            end = re.compile(rf"</{raw}\b", re.I).search(page, at)
            at, raw = (end.start() if end else len(page)), ""
            continue
        token = _TOKEN.search(page, at)
        text = page[at : token.start() if token else len(page)]
        if text and not advert:
            text = html.unescape(text)
            here.parts.append(text)
            size = len(text) - text.count(" ")
            here.text += size
            here.link += size if link else 0
        if not token:
            break
        at = token.end()
        close, tag = token[1], (token[2] or "").lower()
        if not tag:
            continue
        if advert and tag == advert[0]:
            advert = (tag, advert[1] + (-1 if close else 1))
            advert = advert if advert[1] else None
            continue
        if tag in _BLOCK:
            advert = None
        if tag == "br":
            here.parts.append(" ")
        elif tag == "a":
            link = 0 if close else 1
        elif close:
            if tag in _BLOCK:
                if opened.get(tag):
                    up = here
                    while up.tag != tag:
                        up = up.up
                    here = left(up)
                link = 0
        elif tag in _RAW or tag == "head":
            # A slash closes no such element in HTML; it is taken to where no end tag follows.
            slash = token[3].endswith("/")
            if tag != "head" and not (slash and (tag in _FOREIGN or not re.compile(rf"</{tag}\b", re.I).search(page, at))):
                raw = tag
        elif tag in _BLOCK and tag not in ("html", "body", "hr"):
            closes = _CLOSES.get(tag, ())
            if any(opened.get(c) for c in closes):
                up = here
                while up is not None and up.tag not in closes and (up.tag not in _FENCE or up.tag == tag and tag in closes):
                    up = up.up
                if up is not None and up.tag in closes and up.up is not None:
                    here = left(up)
            here = Node(tag, here, _words(token[3]))
            opened[tag] = opened.get(tag, 0) + 1
            nodes.append(here)
            link = 0
        elif tag not in _BLOCK and not token[3].endswith("/") and _words(token[3]) & _AD_WORDS:
            advert = (tag, 1)
    for node in reversed(nodes):
        if node.up:
            node.up.text += node.text
            node.up.link += node.link
    return nodes


N_FEATURES, NAMED = 19, 7


def _bad(n: Node, inside: bool) -> bool:
    """Does a node name itself something else than main text? The header of an article is the article's own."""
    return bool(n.words & _BAD_WORDS) or n.tag in _BAD_TAGS and not (n.tag == "header" and inside)


def _in_articles(nodes: list[Node]) -> dict[int, bool]:
    """Which nodes (by id) stand inside an article."""
    inside = {id(None): False}
    for n in nodes:
        inside[id(n)] = inside[id(n.up)] or n.up is not None and n.up.tag == "article"
    return inside


def node_features(nodes: list[Node]) -> list[list[float]]:
    """Per node: names of roles first (NAMED of them, the last: whether the page names any), then shapes."""
    named = float(any(n.tag in _GOOD_TAGS or n.tag in _BAD_TAGS or n.words & (_GOOD_WORDS | _BAD_WORDS) for n in nodes))
    below = {id(n): 0 for n in nodes}
    paragraphs = dict(below)
    for n in reversed(nodes):
        if n.up:
            below[id(n.up)] += 1 + below[id(n)]
            paragraphs[id(n.up)] += (n.tag == "p") + paragraphs[id(n)]
    whole, inside = max(1, nodes[0].text), _in_articles(nodes)
    good, bad, out = {id(None): 0.0}, {id(None): 0.0}, []
    for n in nodes:
        own_good = float(n.tag in _GOOD_TAGS or bool(n.words & _GOOD_WORDS))
        own_bad = float(_bad(n, inside[id(n)]))
        good[id(n)] = max(own_good, good[id(n.up)])
        bad[id(n)] = max(own_bad, bad[id(n.up)])
        own = [p for p in n.parts if isinstance(p, str)]
        chars = sum(map(len, own))
        stops = sum(p.count(".") + p.count(",") for p in own)
        siblings = n.up.children if n.up else [n]
        near = siblings[n.place - 1].text if n.place else 0
        after = siblings[n.place + 1].text if n.place + 1 < len(siblings) else 0
        out.append(
            [
                own_good, own_bad, good[id(n)], bad[id(n)],
                float(n.tag in _BAD_TAGS and own_bad), float(n.tag in _GOOD_TAGS), named,
                math.log1p(n.text), n.text / whole, n.link / max(1, n.text),
                math.log1p(n.text / (1 + below[id(n)])), math.log1p(chars), stops / (10.0 + chars),
                float(n.depth), math.log1p(len(siblings)), n.place / len(siblings),
                math.log1p(near), math.log1p(after),
                2.0 * (n.tag == "p") + 1.0 * (n.tag in _HEADINGS) + math.log1p(paragraphs[id(n)]),
            ]
        )
    return out


def weak_labels(nodes: list[Node]) -> list[float | None]:
    """1 below a node that names itself main text, 0 below one that names itself something else; the inner name wins
    where both hold, and a bad name inside a good one makes 0. None where nothing is named."""
    out: dict[int, float | None] = {id(None): None}
    inside = _in_articles(nodes)
    for n in nodes:
        label = out[id(n.up)]
        if _bad(n, inside[id(n)]):
            label = 0.0
        elif label is None and (n.tag in _GOOD_TAGS or n.words & _GOOD_WORDS):
            label = 1.0
        out[id(n)] = label
    return [out[id(n)] for n in nodes]


#: Pages of the plainest kind, which stand in every training sample, so that it always has text of either label.
EXAMPLES = [
    f"<html><body><nav><ul><li><a href='/{i}'>Home</a></li><li><a href='/about'>About us</a></li></ul></nav>{around}"
    f"<h1>A page about one thing</h1>{'<p>It says this, and then it says that; more of it follows in whole sentences.</p>' * i}{end}"
    "<aside><p><a href='/x'>Read more</a></p></aside><footer><p>All rights reserved</p></footer></body></html>"
    for i, (around, end) in enumerate([("<article>", "</article>"), ("<main><div>", "</div></main>")] * 4, 2)
]


def with_decoys(page: str, turn: int) -> str:
    """The page with copies of its first paragraphs inside an element of another role, in and after its main part."""
    copies = "".join(re.findall(r"<p>[^<]*</p>", page)[turn % 3 : turn % 3 + 2]) or "<p>One, two, three.</p>"
    names, tags = sorted(_BAD_WORDS), sorted(_BAD_TAGS)
    decoy = f'<div class="{names[turn % len(names)]}">{copies}</div>'
    tag = tags[turn % len(tags)]
    inside = decoy if turn % 2 else f"<{tag}>{copies}</{tag}>"
    return page.replace("</article>", f"{inside}</article>").replace("</main>", f"{inside}</main>").replace("</body>", "") + decoy


class Trees:
    """Boosted regression trees as arrays, for scoring many rows at once."""

    def __init__(self, roots: list[dict], weights: list[float]) -> None:
        self.roots, self.weights = roots, weights

    @classmethod
    def of(cls, model) -> Trees:
        def read(node) -> dict:
            if node.getClass().getSimpleName() == "LeafNode":
                return {"value": node.prediction()}
            split = node.split()
            return {
                "feature": split.featureIndex(), "threshold": split.threshold(),
                "left": read(node.leftChild()), "right": read(node.rightChild()),
            }

        return cls([read(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for root, weight in zip(self.roots, self.weights, strict=True):
            waiting = [(root, np.arange(len(x)))]
            while waiting:
                node, rows = waiting.pop()
                if "value" in node:
                    total[rows] += weight * node["value"]
                else:
                    left = x[rows, node["feature"]] <= node["threshold"]
                    waiting += [(node["left"], rows[left]), (node["right"], rows[~left])]
        return 2 * total


def choose(nodes: list[Node], odds: list[float]) -> set[int]:
    """ids of nodes that stay. For each subtree the better of two: it goes whole, or its top stays and its parts choose.

    A node's log-odds weigh as its own text does; containers without text of their own follow their parts.
    """
    stay, go = {}, {}
    for n, o in zip(reversed(nodes), reversed(odds), strict=True):
        own = sum(len(p) for p in n.parts if isinstance(p, str) and p.strip())
        mine = o * math.log1p(own) if own else 0.05 * o
        go[id(n)] = -mine + sum(go[id(c)] for c in n.children)
        stay[id(n)] = mine + sum(max(stay[id(c)], go[id(c)]) for c in n.children)
    kept: set[int] = set()
    waiting = nodes[:1]
    while waiting:
        n = waiting.pop()
        if stay[id(n)] > go[id(n)]:
            kept.add(id(n))
            waiting += n.children
    return kept


def text_of(nodes: list[Node], kept: set[int]) -> str:
    """The blocks of kept nodes in page order, one a line."""
    blocks: list[str] = []
    now: list[str] = []

    def end() -> None:
        block = " ".join("".join(now).split())
        now.clear()
        if block:
            blocks.append(block)

    waiting: list = [nodes[0]] if id(nodes[0]) in kept else []
    while waiting:
        part = waiting.pop()
        if isinstance(part, str):
            now.append(part)
            continue
        end()
        if isinstance(part, Node) and id(part) in kept:
            waiting.append(None)
            waiting += reversed(part.parts)
    end()
    return "\n".join(blocks)


_ROWS = StructType([StructField("hidden", LongType()), StructField("label", DoubleType()), StructField("x", ArrayType(DoubleType()))])


def train(pages: DataFrame, sample: int = SAMPLE) -> dict[bool, Trees]:
    """Trees by whether a page names roles, from about `sample` pages taken by a hash of their id, and EXAMPLES."""
    share = max(1, pages.count() // sample)
    some = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(share)) == 0).select(F.col("page_id").cast("long"), "html")
    some = some.unionByName(pages.sparkSession.createDataFrame(list(enumerate(EXAMPLES)), "page_id long, html string"))
    arrow = to_arrow_schema(_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple[int, float, list[float]]] = []
            for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                turn, hidden = divmod(page_id or 0, 2)
                page = page.as_py() or ""
                nodes = read_page(page if hidden else with_decoys(page, turn))
                for x, label in zip(node_features(nodes), weak_labels(nodes), strict=True):
                    if label is not None:
                        made.append((hidden, label, [0.0] * NAMED + x[NAMED:] if hidden else x))
            columns = list(zip(*made, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    rows = cut(some.mapInArrow(run, _ROWS)).select("hidden", "label", array_to_vector("x").alias("x")).coalesce(4)
    boosting = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, featuresCol="x")
    return {not hidden: Trees.of(boosting.fit(rows.where(F.col("hidden") == hidden))) for hidden in (0, 1)}


def score_nodes(trees: dict[bool, Trees], x: np.ndarray) -> np.ndarray:
    """Log-odds of each node, by the trees of its page's kind."""
    odds = np.zeros(len(x))
    for named, own in trees.items():
        rows = (x[:, NAMED - 1] == 1) == named
        odds[rows] = own.log_odds(x[rows])
    return odds


TEXTS = StructType(
    [
        StructField("page_id", LongType()),
        StructField("url", StringType()),
        StructField("text", StringType()),
        StructField("n_chars", LongType()),
    ]
)


def extract_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of pages.

    A null or empty html, and a page without main text, give an empty text. Ids and urls may be null or
    repeat; each row is read on its own. An empty table gives an empty one. Other columns are not read.
    """
    trees = train(pages, sample)
    arrow = to_arrow_schema(TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for at in range(0, batch.num_rows, 64):
                read = [read_page(batch.column(2)[i].as_py()) for i in range(at, min(at + 64, batch.num_rows))]
                odds = score_nodes(trees, np.array([x for nodes in read for x in node_features(nodes)]).reshape(-1, N_FEATURES))
                start = 0
                for nodes in read:
                    mine = odds[start : start + len(nodes)].tolist()
                    start += len(nodes)
                    texts.append(text_of(nodes, choose(nodes, mine)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=arrow
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, TEXTS)
