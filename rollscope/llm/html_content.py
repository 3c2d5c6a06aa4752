"""Main text of web pages by a tree-structured graphical model over the page's elements.

Every block element and every run of text between block borders is a node with two states, article or not. A node's potential
comes from its tag, the hints in its class, id and role, its length, link share, sentences and place; a pair potential ties each
node to its parent, by the kind of the child. Sum-product messages go up and down the tree once, for all pages of a slice together
and level by level, and give exact marginals. The weights maximise the likelihood of labelled pages: the gradient is the difference of
observed and expected counts, and the expected ones come from the same messages. A run whose marginal reaches a half is article text.

Labelled pages are HTML with the attribute `data-main`; the default ones are composed from a seed (`html_labelled.py`), `PAGES` of
them, since the tables have no labels. The fit is small, deterministic and done once per driver; weights go to the tasks with the code.

Defined results: null and empty pages, and pages without article text, give an empty text. White space of any kind (also no-break spaces
and line breaks by `br`) is one space inside a block; a table cell, list item or heading is a block of its own. Scripts, styles, titles,
buttons, fields and embedded media have no text. Pages of any length and depth are parsed whole. Rows are judged one by one, so repeated
rows give repeated results. Columns named `text` or `n_chars` in the input are replaced, others stay; missing end tags are implied.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rollscope.llm.common import add_columns
from rollscope.llm.html_labelled import MARK, labelled_pages
from rollscope.llm.html_tree import BLOCKS, CUES, TAGS, Tree, parse

PAGES, SEED, STEPS, RATE, RIDGE = 700, 12, 120, 0.1, 2e-4
HALF = 0.5
RUN = len(BLOCKS)
LEAVES = frozenset(TAGS[t] for t in "p pre li dt dd td th tr h1 h2 h3 h4 h5 h6 blockquote figcaption caption".split())
PARTS = frozenset(TAGS[t] for t in "html body main article section div header footer nav aside form fieldset dialog details td th".split())
SENTENCE_ENDS = ".!?。！？"


class Forest:
    """Nodes of many pages with their features, in one numbering; the root of page i is `roots[i]`."""

    def __init__(self, trees: list[Tree]) -> None:
        sizes = np.array([len(t.parent) for t in trees], np.int64)
        first = np.cumsum(sizes) - sizes
        self.roots = first
        self.page = np.repeat(np.arange(len(trees)), sizes)
        self.parent = np.concatenate([np.asarray(t.parent, np.int64) for t in trees]) + np.repeat(first, sizes)
        self.parent[first] = first
        tag = np.concatenate([np.asarray(t.tag, np.int64) for t in trees])
        self.cue = np.concatenate([np.asarray(t.cue, np.int64) for t in trees])
        depth = np.concatenate([np.asarray(t.depth, np.int64) for t in trees])
        self.run = tag < 0
        texts = [x for t in trees for x in t.text]
        chars = np.fromiter(map(len, texts), np.int64, len(texts)).astype(np.float64)
        linked = np.concatenate([np.asarray(t.linked, np.float64) for t in trees])
        marked = np.concatenate([np.asarray(t.marked, np.float64) for t in trees])
        ends = np.fromiter((sum(map(x.count, SENTENCE_ENDS)) if x else 0 for x in texts), np.float64, len(texts))
        self.texts = texts
        order = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 2))
        self.levels = [order[a:b] for a, b in zip(cut[:-1], cut[1:])]
        self.depth = depth

        def below(x: np.ndarray) -> np.ndarray:
            """Sums over the runs of each subtree."""
            out = x.copy()
            for level in reversed(self.levels):
                np.add.at(out, self.parent[level], out[level])
            return out
        all_chars, all_linked, all_ends, all_runs = below(chars), below(linked), below(ends), below(self.run.astype(np.float64))
        total = np.maximum(all_chars[first], 1)[self.page]
        before = np.cumsum(chars) - chars
        before = (before - before[first][self.page]) / total
        kind = np.where(self.run, RUN, tag)
        above = kind[self.parent]
        # The nearest part of the page a node stands in, itself included, and the hints of all parts around it.
        part, around = np.arange(len(tag)), self.cue.copy()
        is_part = np.isin(tag, list(PARTS))
        for level in self.levels:
            up = self.parent[level]
            part[level] = np.where(is_part[level], level, part[up])
            around[level] |= around[up]
        size = np.clip(np.log2(all_chars + 1).astype(np.int64), 0, 13)
        mean = np.clip(np.log2(all_chars / np.maximum(all_runs, 1) + 1).astype(np.int64), 0, 10)
        link = np.searchsorted([0.01, 0.2, 0.5, 0.9], all_linked / np.maximum(all_chars, 1), side="right")
        share = np.searchsorted([0.01, 0.05, 0.15, 0.35, 0.6, 0.85], all_chars / total)
        density = np.searchsorted([0.0, 0.5, 1.5, 3, 6], 100 * all_ends / np.maximum(all_chars, 1))
        place = np.searchsorted([0.02, 0.1, 0.3, 0.6, 0.85, 0.95], before)
        run = self.run.astype(np.int64)
        columns = [(kind * 7 + share, 7 * RUN + 7), (kind[part] * 14 + share[part] * 2 + run, 14 * RUN + 14),
                   (kind[part] * 20 + link[part] * 4 + np.minimum(link, 3), 20 * RUN + 20), (above + (RUN + 1) * run, 2 * RUN + 2), (size * 2 + run, 28), (mean * 2 + run, 22), (link * 2 + run, 10),
                   (share * 2 + run, 14), (density * 2 + run, 12), (place * 2 + run, 14), (link * 14 + size, 70), (np.minimum(depth, 9), 10)]
        at = 0
        index = []
        for x, n in columns:
            index.append(x + at)
            at += n
        self.index = np.stack(index, 1)
        self.bits = ((np.stack([self.cue, around], 1)[:, :, None] >> np.arange(len(CUES))) & 1).reshape(len(tag), -1).astype(np.float64)
        self.n_index, self.n_weights = at, at + self.bits.shape[1]
        leaf = np.isin(tag, list(LEAVES))
        self.edge = np.where(self.run, 0, np.where(leaf, 1, 2)) + 3 * (self.cue > 0)
        mass = below(np.where(self.run, chars * marked, 0.0))
        self.state = np.where(self.run, marked, (mass * 2 > all_chars).astype(np.float64))


EDGES = 6


class Model:
    def __init__(self, weights: np.ndarray, edges: np.ndarray) -> None:
        self.weights, self.edges = weights, edges

    def unary(self, forest: Forest) -> np.ndarray:
        return self.weights[forest.index].sum(1) + forest.bits @ self.weights[forest.n_index:]

    def messages(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Log beliefs (node, state) and joint marginals (node, parent's state, own state)."""
        up = np.zeros((len(forest.parent), 2))
        up[:, 1] = self.unary(forest)
        sent = np.zeros_like(up)
        pair = self.edges[forest.edge]
        for level in reversed(forest.levels):
            sent[level] = np.logaddexp(pair[level, :, 0] + up[level, 0:1], pair[level, :, 1] + up[level, 1:2])
            np.add.at(up, forest.parent[level], sent[level])
        belief = up.copy()
        joint = np.zeros((len(up), 2, 2))
        for level in forest.levels:
            rest = belief[forest.parent[level]] - sent[level]
            both = pair[level] + rest[:, :, None] + up[level][:, None, :]
            belief[level] = up[level] + np.logaddexp(pair[level, 0] + rest[:, 0:1], pair[level, 1] + rest[:, 1:2])
            both -= both.max((1, 2), keepdims=True)
            both = np.exp(both)
            joint[level] = both / both.sum((1, 2), keepdims=True)
        return belief, joint

    def marginals(self, forest: Forest) -> np.ndarray:
        """Probability of each node to be article text."""
        belief, _ = self.messages(forest)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))

    def gradient(self, forest: Forest) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of the labelled states and its gradient."""
        belief, joint = self.messages(forest)
        y = forest.state.astype(np.int64)
        chance = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        child = forest.depth > 0
        scores = self.unary(forest)
        seen = np.zeros((EDGES, 2, 2))
        np.add.at(seen, (forest.edge[child], y[forest.parent[child]], y[child]), 1)
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.edge[child], joint[child])
        roots = belief[forest.roots]
        value = float((scores * y).sum() + (seen * self.edges).sum() - np.logaddexp(roots[:, 0], roots[:, 1]).sum())
        off = y - chance
        grad = np.zeros(forest.n_weights)
        grad[:forest.n_index] = np.bincount(forest.index.ravel(), np.repeat(off, forest.index.shape[1]), forest.n_index)
        grad[forest.n_index:] = forest.bits.T @ off
        return value, grad, seen - expected


def fit(pages: list[str], steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> Model:
    """Weights by gradient ascent with per-weight step sizes (Adam) on labelled pages."""
    forest = Forest([parse(p, MARK) for p in pages])
    n = forest.n_weights
    x, m, v = np.zeros(n + 4 * EDGES), np.zeros(n + 4 * EDGES), np.zeros(n + 4 * EDGES)
    for step in range(1, steps + 1):
        _, a, b = Model(x[:n], x[n:].reshape(EDGES, 2, 2)).gradient(forest)
        g = np.concatenate([a, b.ravel()]) / len(forest.parent) - ridge * x
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(x[:n], x[n:].reshape(EDGES, 2, 2))


@lru_cache(maxsize=2)
def default_model(pages: int = PAGES, seed: int = SEED) -> Model:
    return fit(labelled_pages(pages, seed))


def main_text(model: Model, pages: list[str]) -> list[str]:
    """Article text of each page."""
    forest = Forest([parse(p) for p in pages])
    own = np.nonzero(forest.run & (model.marginals(forest) >= HALF))[0]
    out: list[list[str]] = [[] for _ in pages]
    for i, page in zip(own.tolist(), forest.page[own].tolist()):
        out[page].append(forest.texts[i])
    return ["\n".join(x) for x in out]


def extract(pages: DataFrame, model: Model | None = None, html: str = "html") -> DataFrame:
    """Rows without the html, plus text and n_chars (code points)."""
    model = model or default_model()
    fields = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make():
        def run(texts: list[bytes]) -> list[list]:
            found = main_text(model, [x.decode("utf-8", "replace") for x in texts])
            return [found, list(map(len, found))]
        return run

    return add_columns(pages, make, fields, text=html, slice_bytes=1 << 20)
