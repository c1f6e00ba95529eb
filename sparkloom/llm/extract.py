"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page is read into a tree of blocks where it lies, the trees give every node the
odds that it holds main text, and the likeliest consistent choice of nodes
decides which runs of text stay.  No shuffle.  The model is fitted by Spark ML on
pages that :func:`page` makes up, with labels; its trees are small arrays.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .dom import FEATURES, TEXT, Blocks, decode, features, labels

#: Labelled pages that the model is fitted on.
TRAINING_PAGES = 1500
TREES, DEPTH, STEP = 20, 5, 0.3

# What the made-up pages' words are made of.
SYLLABLES = "ka lo mi ter an on es ti ra ne su po ver den al it or ing é ü ñ ção der que ment 学 数 ста ко".split()


class Page:
    """A made-up page: main blocks carry ``data-main``, everything else is around them."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.obscure = self.r.random() < 0.25  # class names that tell nothing
        self.semantic = self.r.random() < 0.6

    def some(self, *choices):
        return self.r.choice(choices)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 1, high: int = 18) -> str:
        text = self.words(low, high)
        if self.chance(0.1):
            text = text.replace(" ", self.some("&amp; ", ", ", "*** ", "%% ", " &quot;"), 3)
        return text[:1].upper() + text[1:] + self.some(".", ".", ".", "!", "?", "", "&hellip;")

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def attributes(self, *tokens: str) -> str:
        if self.obscure or not tokens or self.chance(0.1):
            return self.some("", f' class="c{self.r.randrange(999)}"', f' id="x-{self.r.randrange(99)}"')
        name = self.r.choice(tokens) + self.some("", "", f"-{self.some('box', 'wrap', 'inner', 'item', 'list')}", f"_{self.r.randrange(9)}")
        return self.some(f' class="{name}"', f" class='{name} c{self.r.randrange(99)}'", f' id="{name}"', f" class={name}")

    def links(self, low: int, high: int, tag: str = "li") -> str:
        own = (f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(low, high)))
        return "".join(f"<{tag}>{a}</{tag}>" if tag else f"{a} " for a in own)

    def paragraph(self, main: bool) -> str:
        mark = " data-main" if main else ""
        text = self.prose(1, self.some(1, 2, 5, 20))
        if self.chance(0.15):
            return f"<p{mark}><b>{text}<br>"  # neither is closed
        if self.chance(0.2):
            text = text.replace(" ", self.some(' <a href="#">x</a> ', " <em>y</em> ", "<br>", " <span>z</span> "), 1)
        return f"<p{mark}>{text}" + ("" if self.chance(0.1) else "</p>")

    def article(self) -> str:
        out = []
        if self.chance(0.8):
            out.append(f"<{(h := self.some('h1', 'h1', 'h2'))} data-main>{self.words(1, 14)}{self.some('', '.')}</{h}>")
        kind = self.r.random()
        for _ in range(self.some(1, 1, 2, 3, 5, 8, 15)):
            out.append(self.paragraph(True))
            if self.chance(0.08):
                out.append(f"<ul data-main>{''.join(f'<li>{self.sentence()}</li>' for _ in range(self.r.randint(2, 6)))}</ul>")
            if self.chance(0.08):
                out.append(f"<h3 data-main>{self.words(1, 6)}</h3>")
            if self.chance(0.05):
                out.append(f"<blockquote data-main>{self.paragraph(True)}</blockquote>")
            if self.chance(0.04):
                rows = "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.r.randrange(9999)}</td></tr>" for _ in range(self.r.randint(2, 6)))
                out.append(f"<table data-main>{rows}</table>")
            if self.chance(0.04):
                out.append(f'<figure data-main><img src="a.png"><figcaption>{self.sentence()}</figcaption></figure>')
            if self.chance(0.06):
                out.append(self.around())
        if kind < 0.1:  # text without paragraphs
            return f"<div data-main>{self.prose(2, 20)}<br><br>{self.prose(1, 9)}</div>"
        if self.chance(0.3):
            out = [out[0], f"<div{self.attributes('body', 'text', 'prose', 'content')}>", *out[1:], "</div>"]
        if self.chance(0.15):
            out.append(self.comments())
        return "".join(out)

    def around(self) -> str:
        """Something within or beside the article that isn't part of it."""
        kind = self.r.randrange(5)
        if kind == 0:
            text = self.some(self.sentence(), self.prose(1, 3), f'<a href="#">{self.words(1, 6)}</a>')
            return f"<{(t := self.some('div', 'div', 'aside', 'section'))}{self.attributes('ad', 'ads', 'advert', 'sponsored', 'banner', 'promo')}>{text}</{t}>"
        if kind == 1:
            return f"<div{self.attributes('share', 'social', 'follow')}>{self.links(2, 5, self.some('', 'li', 'span'))}</div>"
        if kind == 2:
            return f"<div{self.attributes('newsletter', 'subscribe', 'notice')}><p>{self.prose(1, 2)}</p><form{self.attributes('form')}><input type=text><button>{self.word()}</button></form></div>"
        if kind == 3:
            tag = "aside" if self.semantic else "div"
            return f"<{tag}{self.attributes('related', 'recommended', 'more', 'trending')}><h4>{self.words(1, 3)}</h4><ul>{self.links(2, 8)}</ul></{tag}>"
        return f"<div{self.attributes('cookie', 'consent', 'notice', 'alert', 'gdpr')}>{self.prose(1, 3)} <button>{self.word()}</button></div>"

    def comments(self) -> str:
        own = []
        for _ in range(self.r.randint(1, 6)):
            by = f'<a href="#">{self.word()}</a> {self.r.randrange(60)} {self.word()}'
            own.append(f"<{(t := self.some('div', 'li', 'article'))}{self.attributes('comment', 'reply')}>{self.some(f'<span>{by}</span>', f'<h5>{by}</h5>')}<p>{self.prose(1, 4)}</p></{t}>")
        tag = self.some("section", "div", "ol")
        return f"<{tag}{self.attributes('comments', 'discussion', 'commentlist', 'respond')}><h3>{self.words(1, 2)}</h3>{''.join(own)}</{tag}>"

    def menu(self) -> str:
        tag = "nav" if self.semantic else "div"
        own = self.links(2, 12, self.some("li", "li", "", "div"))
        return f"<{tag}{self.attributes('nav', 'menu', 'navbar', 'breadcrumb', 'toolbar')}>{f'<ul>{own}</ul>' if own.startswith('<li') else own}</{tag}>"

    def footer(self) -> str:
        tag = "footer" if self.semantic else "div"
        text = self.some("&copy; ", "", f"{self.r.randrange(1990, 2030)} ") + self.some(self.prose(1, 3), f"{self.word()}.example.com &middot; {self.sentence()}", self.words(2, 9))
        return f"<{tag}{self.attributes('footer', 'foot', 'copyright', 'legal', 'bottom')}>{self.some(text, f'<p>{text}</p>', text + self.links(2, 6, ''))}</{tag}>"

    def html(self) -> str:
        if self.chance(0.03):
            return self.some("", self.menu() + self.footer(), f"<p data-main>{self.prose(1, 6)}</p>", f"<body data-main><div data-main>{self.prose(1, 3)}</div>")
        head, tail = [], []
        if self.chance(0.4):
            tag = "header" if self.semantic else "div"
            head.append(f"<{tag}{self.attributes('header', 'masthead', 'logo', 'top')}>{self.some('<h1>', '<p>', '<div>')}{self.words(1, 5)}{self.some('', self.menu())}</{tag}>")
        if self.chance(0.8):
            head.append(self.menu())
        for place in (head, tail):
            while self.chance(0.45):
                place.append(self.around())
        if self.chance(0.3):
            tag = "aside" if self.semantic else "div"
            box = f"<{tag}{self.attributes('sidebar', 'side', 'widget', 'secondary')}><h3>{self.words(1, 3)}</h3>{self.some(f'<ul>{self.links(2, 9)}</ul>', f'<p>{self.prose(1, 4)}</p>')}</{tag}>"
            self.some(head, tail).append(box)
        if self.chance(0.2):
            tail.append(self.comments())
        if self.chance(0.85):
            tail.append(self.footer())
        tag = self.some("article", "article", "main") if self.semantic else self.some("div", "div", "section")
        body = f"<{tag}{self.attributes('article', 'post', 'content', 'entry', 'story', 'main')}>{self.article()}</{tag}>"
        if self.chance(0.1):
            body = self.article()
        if self.chance(0.1):
            cells = [f"<td>{''.join(head)}</td>", f"<td>{body}</td>", f"<td>{''.join(tail)}</td>"]
            body, head, tail = f"<table><tr>{''.join(cells)}</tr></table>", [], []
        elif self.chance(0.3):
            body = f"<div{self.attributes('wrap', 'page', 'content', 'main')}>{body}</div>"
        title = f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>"
        return title + "".join(head) + body + "".join(tail) + self.some("</body></html>", "")


def labelled_nodes(spark: SparkSession, pages: int = TRAINING_PAGES, seed: int = 0) -> DataFrame:
    """(features, label) of the nodes with text of made-up pages; ``pages`` bounds them."""
    common.prepare(spark)

    def run(batches):
        for batch in batches:
            blocks = Blocks()
            for i in batch.column(0).to_pylist():
                blocks.read(Page(i + seed).html())
            a = blocks.arrays()
            y, some = labels(a)
            x = features(a)[some].astype(np.float64)
            yield common.record_batch(
                x=pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel())),
                label=pa.array(y[some].astype(np.float64)),
            )

    rows = common.map_arrow(spark.range(0, pages, 1, 8), run, "x array<double>, label double")
    return rows.select(array_to_vector("x").alias("features"), "label")


def train(rows: DataFrame, *, trees: int = TREES, depth: int = DEPTH, step: float = STEP, seed: int = 7) -> GBTClassificationModel:
    """Fit boosted trees on (features, label)."""
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, maxBins=64, seed=seed).fit(rows)


class Trees:
    """Boosted trees as arrays: feature (-1: a leaf), threshold, the two children, and the leaf's value times its tree's weight."""

    def __init__(self, model: GBTClassificationModel):
        rows: list[list] = []
        self.roots: list[int] = []

        def add(node, weight: float) -> int:
            at = len(rows)
            rows.append([-1, 0.0, at, at, weight * node.prediction()])
            if node.subtreeDepth():
                split = node.split()
                rows[at][:2] = split.featureIndex(), split.threshold()
                rows[at][2] = add(node.leftChild(), weight)
                rows[at][3] = add(node.rightChild(), weight)
            return at

        for tree, weight in zip(model.trees, model.treeWeights):
            self.roots.append(add(tree._call_java("rootNode"), weight))
        self.depth = max(t.depth for t in model.trees)
        feature, threshold, left, right, value = zip(*rows)
        self.feature, self.left, self.right = (np.array(x, np.int64) for x in (feature, left, right))
        self.threshold, self.value = np.array(threshold), np.array(value)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                feature = self.feature[at]
                left = x[row, feature] <= self.threshold[at]
                at = np.where(feature < 0, at, np.where(left, self.left[at], self.right[at]))
            total += self.value[at]
        return 2 * total


def main_texts(trees: Trees, htmls: list[str | None]) -> list[str]:
    """The main text of each page."""
    blocks = Blocks()
    for html in htmls:
        blocks.read(html or "")
    a = blocks.arrays()
    keep = decode(a, trees.log_odds(features(a))) & (a["group"] == TEXT) & (a["chars"] > 0)
    kept: list[list[str]] = [[] for _ in htmls]
    for i in np.flatnonzero(keep):
        kept[a["page"][i]].append(blocks.texts[i])
    return ["\n\n".join(own) for own in kept]


def extract(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", model: GBTClassificationModel | None = None
) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    The text is the article's blocks in the page's order with an empty line
    between them, white space within a block being one space; it is empty where no
    block is taken for main text, for null and empty pages too.  Unclosed, crossed
    and cut off markup is read as browsers do, roughly.  Pages are read whole,
    however long; repeated rows and pages without an id or url give their rows
    like any other; other columns are left out.  No pages give no rows.
    ``model`` is from :func:`train`; by default it is fitted on ``TRAINING_PAGES``
    made-up pages.
    """
    spark = common.prepare(pages.sparkSession)
    trees = Trees(model or train(labelled_nodes(spark)))
    own = common.only(pages, page_id=page_id, url=url, html=html)

    def run(batches):
        for batch in batches:
            texts = main_texts(trees, batch.column(2).to_pylist())
            yield common.record_batch(
                page_id=batch.column(0), url=batch.column(1), text=pa.array(texts, pa.string()), n_chars=pa.array(map(len, texts), pa.int64())
            )

    return common.map_arrow(own, run, f"page_id {common.id_type(own, 'page_id')}, url string, text string, n_chars long")
