"""Main text of web pages by a tree-structured graphical model.

Nodes are the page's block elements and its text blocks. A node is content if main text lies in
it. Node potentials score tag, names and shape of a block; edge potentials say how often a child
of a content or of another node is content. Both are trained on labelled pages: the node
potentials as a logistic model, the edge potentials as counts. Sum-product message passing, from
the leaves up and from the root down, gives each text block's exact marginal; blocks of 0.5 or
more, in page order, are the main text.

Null and empty pages, and pages without main text, give an empty text. Truncated pages are read
as far as they go. Repeated rows are extracted each for itself. An empty table gives an empty
result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import htmltree, labelledpages, linear, tables

#: Labelled pages to train on.
TRAINING_PAGES = 1000
WIDTH = 1 << 14
#: Names of elements, which pages choose, whose buckets a worker keeps at most.
NAMES_KEPT = 1 << 14


def _bucket(feature: str) -> int:
    import zlib

    return zlib.crc32(feature.encode()) & (WIDTH - 1)


@lru_cache(NAMES_KEPT)
def _static(tag: str, names: tuple, hidden: bool) -> tuple[int, ...]:
    """Buckets of an element's own features."""
    out = [f"t:{tag}"] + [f"n:{w}" for w in names] + (["hidden"] if hidden else [])
    if not names:
        out.append(f"bare:{tag}")
    elif tag in ("div", "section", "p", "ul", "ol", "li", "article", "aside"):
        out.append(f"named:{tag}")
    return tuple(_bucket(f) for f in out)


@lru_cache(NAMES_KEPT)
def _inherited(tag: str, names: tuple) -> tuple[int, ...]:
    """Buckets that an element gives to everything in it."""
    if not names and (tag in _FLOW or tag in _OUTER):
        return ()
    return tuple(_bucket(f) for f in [f"a:{tag}" if names else f"a:bare:{tag}"] + [f"an:{w}" for w in names])


_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre table tbody thead tr td th figure figcaption dl dt dd code".split())
_OUTER = frozenset(["#root", "html", "body", "head"])
_BINS = [[_bucket(f"{kind}:{i}") for i in range(16)] for kind in ("len", "link", "stop", "comma", "many", "p-len", "p-link", "share")]


_PLACE = [[_bucket(f"{kind}:{i}") for i in range(5)] for kind in ("outside", "inside")]


def features(nodes: list[htmltree.Node]) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]]]:
    """Buckets of each node: own tag and names; for text, length, links, punctuation and the holding
    element; for elements, how much text and links lie in them; and whether it lies in the innermost
    element that holds more than half of the text. And those that a node gives to all
    that lies in it, which features of a node are too: see above()."""
    n = len(nodes)
    chars, links, blocks = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        x = nodes[i]
        if x.text is not None:
            chars[i], links[i], blocks[i] = len(x.text), x.link_chars, 1
        p = x.parent
        chars[p] += chars[i]
        links[p] += links[i]
        blocks[p] += blocks[i]
    total = max(1, chars[0])
    # The innermost holder of more than half of the text.
    heavy = max(i for i, x in enumerate(nodes) if i == 0 or (2 * chars[i] > total and x.text is None and x.tag not in _FLOW))
    inside = [False] * n
    out, given = [], []
    for i, x in enumerate(nodes):
        inside[i] = i == heavy or (i > 0 and inside[x.parent])
        size = chars[i]
        link = min(3, 4 * links[i] // size) if size else 4
        given.append(() if x.text is not None else _inherited(x.tag, x.names))
        if x.text is not None:
            t = x.text
            holder = nodes[x.parent]
            out.append((_BINS[0][min(15, size.bit_length())], _BINS[1][link], _BINS[2][min(4, t.count(". ") + (t[-1:] in ".!?"))], _BINS[3][min(3, t.count(","))], _bucket_of_holder(holder.tag), _PLACE[inside[i]][min(2, chars[heavy] * 8 // total - 4)]))
        elif x.tag in _FLOW and not x.names:
            out.append((*_static(x.tag, x.names, x.hidden), _PLACE[inside[i]][3]))
        else:
            out.append((*_static(x.tag, x.names, x.hidden), _BINS[4][min(15, blocks[i].bit_length())], _BINS[5][min(15, size.bit_length())], _BINS[6][link], _BINS[7][min(7, 8 * size // total)], _PLACE[inside[i]][4]))
    return out, given


def above(nodes: list[htmltree.Node], given: list, nothing):
    """What the elements around each node give it, added up from the root."""
    out = [nothing] * len(nodes)
    for i in range(1, len(nodes)):
        p = nodes[i].parent
        out[i] = out[p] + given[p] if given[p] else out[p]
    return out


@lru_cache(NAMES_KEPT)
def _bucket_of_holder(tag: str) -> int:
    return _bucket(f"in:{tag}")


def truth(nodes: list[htmltree.Node], blocks: list[str]) -> list[int]:
    """Labels of nodes: a text block is content if it is the next of the main text's blocks; an
    element if content lies in it."""
    label, at = [0] * len(nodes), 0
    for i, x in enumerate(nodes):
        if x.text is not None and at < len(blocks) and x.text == blocks[at]:
            label[i], at = 1, at + 1
    for i in range(len(nodes) - 1, 0, -1):
        if label[i]:
            label[nodes[i].parent] = 1
    return label


def edge_kinds(nodes: list[htmltree.Node]) -> list[int]:
    """Kind of the edge above each node: text blocks, plain flow elements and all other elements,
    each under the page itself or deeper."""
    return [(0 if x.text is not None else 1 if x.tag in _FLOW and not x.names else 2) * 2 + (x.parent >= 0 and nodes[x.parent].tag not in _OUTER) for x in nodes]


class Model:
    """weights: log odds by bucket; edge[kind][parent][child]: log potential by edge_kinds()."""

    def __init__(self, weights: np.ndarray, bias: tuple[float, float], edge: list):
        self.weights, self.bias, self.edge = weights.tolist(), bias, edge

    def marginals(self, nodes: list[htmltree.Node]) -> list[float]:
        """Probability of content, by sum-product on log odds. A message to a parent is the log
        ratio of the child's evidence under a content parent to that under another; a message to a
        child is the parent's log odds without what the child itself told it."""
        from math import exp, log1p

        w, (bias_text, bias_node), edge = self.weights, self.bias, self.edge
        (feats, given), kinds = features(nodes), edge_kinds(nodes)
        n = len(nodes)
        around = above(nodes, [sum([w[b] for b in g]) for g in given], 0.0)
        up = [0.0] * n  # evidence of the subtree, log odds
        for i in range(n):
            up[i] = sum([w[b] for b in feats[i]]) + around[i] + (bias_text if nodes[i].text is not None else bias_node)
        message = [0.0] * n

        def soft(a: float, b: float) -> float:
            return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))

        for i in range(n - 1, 0, -1):
            e = edge[kinds[i]]
            message[i] = soft(e[1][0], e[1][1] + up[i]) - soft(e[0][0], e[0][1] + up[i])
            up[nodes[i].parent] += message[i]
        belief = up[:]
        for i in range(1, n):
            e = edge[kinds[i]]
            without = belief[nodes[i].parent] - message[i]
            belief[i] = up[i] + soft(e[0][1], e[1][1] + without) - soft(e[0][0], e[1][0] + without)
        return [1 / (1 + exp(-max(-40.0, min(40.0, b)))) for b in belief]

    def main_text(self, html: str | None) -> str:
        if not html:
            return ""
        nodes = htmltree.parse(html)
        return "\n".join([x.text for x, p in zip(nodes, self.marginals(nodes), strict=True) if x.text is not None and p >= 0.5])


def train(pages: list[tuple[str, list[str]]]) -> Model:
    """Potentials from pages and their main text's blocks."""
    rows, cols, target, text_row = [], [], [], []
    counts = np.full((6, 2, 2), 0.5)
    for html, blocks in pages:
        nodes = htmltree.parse(html)
        label = truth(nodes, blocks)
        kinds = edge_kinds(nodes)
        own, given = features(nodes)
        for i, f in enumerate(x + y for x, y in zip(own, above(nodes, given, ()), strict=True)):
            r = len(target)
            rows += [r] * len(f)
            cols += f
            target.append(label[i])
            text_row.append(nodes[i].text is not None)
            if i:
                counts[kinds[i], label[nodes[i].parent], label[i]] += 1
    y, is_text = np.array(target, float), np.array(text_row)
    extra = np.where(is_text, WIDTH, WIDTH + 1)
    w, b = linear.fit_logistic(np.concatenate((rows, np.arange(len(y)))), np.concatenate((cols, extra)), np.ones(len(rows) + len(y)), y, WIDTH + 2, l2=1e-5, steps=250)
    edge = []
    for kind in counts:
        child = kind / kind.sum(axis=1, keepdims=True)
        edge.append(np.log(child / (kind.sum(axis=0) / kind.sum())).tolist())  # the node potentials have the prior already
    return Model(w[:WIDTH], (float(w[WIDTH] + b), float(w[WIDTH + 1] + b)), edge)


@cache
def default_model() -> Model:
    return train(labelledpages.labelled_pages(TRAINING_PAGES, seed=7))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns of pages, `html` replaced by `text` (as is a text column, if there is one)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    kept = [c for c in pages.columns if c not in ("html", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        for batch in batches:
            texts = [own.main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    schema = pages.select(*kept).withColumn("text", F.lit("")).schema
    return pages.select(*kept, "html").mapInArrow(run, schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
