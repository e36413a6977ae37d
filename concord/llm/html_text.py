"""Main text of web pages: boosted trees over nodes of the page, decoded from the root down.

Every element and every text is a node with features of its own (tag, names in its
attributes, depth), of its subtree (characters, words, share in links, tags), of its
ancestors, and of its siblings. Boosted trees give each node the log-odds that it
holds text of the article. Decoding keeps the set of nodes of the largest sum of log-odds
in which no node is kept below one that is not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm import gbt
from concord.llm.dom import Node, name_tokens, parse
from concord.llm.html_pages import MARK, marked_page
from concord.llm.shared import with_mapped

#: Made pages that the model is learned from.
PAGES = 1200
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SIGNS = re.compile(r"[.,;:!?]")
_FLAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "a", "li", "table")


@dataclass
class Model:
    """Log-odds by tag and by name token, and the trees."""

    tags: dict[str, float]
    names: dict[str, float]
    trees: gbt.Trees | None = None

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.names), default=0)

    def name_score(self, tokens: list[str]) -> tuple[float, float]:
        """Least and largest log-odds of the tokens; of an unknown one, those of the longest known one that it begins with."""
        low = high = 0.0
        for t in tokens:
            v = self.names.get(t)
            if v is None:
                v = next((self.names[t[:k]] for k in range(min(len(t) - 1, self.longest), 3, -1) if t[:k] in self.names), 0.0)
            low, high = min(low, v), max(high, v)
        return low, high


def _own(nodes: list[Node], model: Model) -> np.ndarray:
    """Per node: numbers of its own, and what its ancestors hand down."""
    rows = []
    for i, n in enumerate(nodes):
        up = rows[n.parent] if i else None
        text = n.text
        chars = len(text.strip()) if text and n.seen else 0
        if n.tag == "#":
            low = high = tag = 0.0
        else:
            low, high = model.name_score(name_tokens(n.attributes)) if n.attributes else (0.0, 0.0)
            tag = model.tags.get(n.tag, 0.0)
        least, most = (min(low, up[5]), max(high, up[6])) if up else (low, high)
        inside = up[8] if up else 0
        if n.tag in _FLAGS:
            inside |= 1 << _FLAGS.index(n.tag)
        rows.append((chars, len(text.split()) if chars else 0, len(_SIGNS.findall(text)) if chars else 0, low, high, least, most, tag, inside, min(tag, up[9]) if up else tag, n.depth))
    return np.array(rows, np.float64)


def node_features(pages: list[list[Node]], model: Model) -> np.ndarray:
    """A row of features for each node of the pages, in order."""
    own = np.concatenate([_own(p, model) for p in pages])
    sizes = [len(p) for p in pages]
    base = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    local = np.array([n.parent for p in pages for n in p])
    root = local < 0
    total = len(own)
    parent = np.where(root, np.arange(total), local + base)
    page = np.repeat(np.arange(len(pages)), sizes)
    depth = own[:, 10].astype(np.int64)
    # nodes are in document order, so a subtree ends where the next node is not deeper
    end = np.full(total, 0)
    stack: list[int] = []
    for i, d in enumerate(depth.tolist()):
        while stack and (d == 0 or depth[stack[-1]] >= d):
            end[stack.pop()] = i
        stack.append(i)
    for i in stack:
        end[i] = total
    inside = own[:, 8].astype(np.int64)
    chars, words, signs = own[:, 0], own[:, 1], own[:, 2]
    linked = np.where(inside >> _FLAGS.index("a") & 1, chars, 0)
    element = np.array([n.tag != "#" for p in pages for n in p], np.float64)
    paragraph = np.array([n.tag == "p" for p in pages for n in p], np.float64)
    field = np.array([n.tag in ("input", "button", "label", "select", "textarea") for p in pages for n in p], np.float64)

    def below(x: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(x)])
        return s[end] - s[np.arange(total)]

    text, word, link = below(chars), below(words), below(linked)
    tags, paragraphs, fields, sign = below(element), below(paragraph), below(field), below(signs)
    density = link / np.maximum(text, 1)
    first = np.concatenate([[0], np.cumsum(chars)])[:-1]
    start = first - first[np.arange(total) - (np.arange(total) - base)]
    whole = np.maximum(text[base], 1)
    # neighbours: the sibling before, and the one that begins where this node ends
    after = np.minimum(end, total - 1)
    after = np.where((end < total) & (parent[after] == parent) & ~root[after], after, -1)
    before = np.full(total, -1)
    before[after[after >= 0]] = np.flatnonzero(after >= 0)
    side = lambda x, k: np.where(k >= 0, x[np.maximum(k, 0)], -1.0)
    place = np.zeros(total)
    for i in np.flatnonzero(before >= 0).tolist():
        place[i] = place[before[i]] + 1
    heading = np.array([n.tag in _HEADINGS for p in pages for n in p], np.float64)
    columns = [
        np.log1p(text), np.log1p(word), density, text / np.maximum(tags, 1), sign / np.maximum(word, 1), paragraphs, fields, np.log1p(tags),
        own[:, 3], own[:, 4], own[:, 5], own[:, 6], own[:, 7], own[:, 9], depth, text / np.maximum(text[parent], 1), np.log1p(text[parent]),
        density[parent], text / whole, start / whole, place, side(np.log1p(text), before), side(np.log1p(text), after), side(density, before),
        side(density, after), side(own[:, 7], before), side(own[:, 7], after), element, heading, own[parent, 7], own[parent, 3],
        *(inside >> k & 1 for k in range(len(_FLAGS))), np.log1p(sizes)[page],
    ]
    return np.stack(columns, axis=1)


def _odds(good: Counter, bad: Counter, weight: float = 2.0) -> dict[str, float]:
    g, b = sum(good.values()), sum(bad.values())
    return {k: float(np.log((good[k] + weight * g / (g + b)) / (bad[k] + weight * b / (g + b)) * b / g)) for k in {*good, *bad}}


def train(seeds: range) -> Model:
    """A model of made pages; half of them give the log-odds of tags and names, and all the trees."""
    pages, labels = [], []
    for seed in seeds:
        nodes = parse(marked_page(seed))
        keep = np.zeros(len(nodes), np.int64)
        for i in range(len(nodes) - 1, -1, -1):
            n = nodes[i]
            if n.tag == "#" and MARK in n.text:
                n.text = n.text.replace(MARK, "")
                keep[i] = 1
            if keep[i] and i:
                keep[n.parent] = 1
        pages.append(nodes)
        labels.append(keep)
    good: tuple[Counter, Counter] = Counter(), Counter()
    bad: tuple[Counter, Counter] = Counter(), Counter()
    for nodes, keep in zip(pages[::2], labels[::2], strict=True):
        for n, k in zip(nodes, keep.tolist(), strict=True):
            if n.tag != "#":
                (good if k else bad)[0][n.tag] += 1
                (good if k else bad)[1].update(set(name_tokens(n.attributes)))
    model = Model(_odds(good[0], bad[0]), _odds(good[1], bad[1]))
    model.trees = gbt.fit(node_features(pages, model), np.concatenate(labels), trees=50, depth=5, rate=0.25)
    return model


@lru_cache
def default_model() -> Model:
    return train(range(PAGES))


def _decode(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """Which nodes are kept: the set of largest sum in which every node's parent is kept."""
    best = margin.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].tag == "#" and not nodes[i].text.strip():
            best[i] = 0.0
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    keep = [True] * len(nodes)
    for i in range(1, len(nodes)):
        n = nodes[i]
        blank = n.tag == "#" and not n.text.strip()
        keep[i] = keep[n.parent] and n.seen and (best[i] > 0 or blank)
    return keep


def _render(nodes: list[Node], keep: list[bool]) -> str:
    """Kept texts in order; a block begins and ends white space, and each run of white space is one blank."""
    out, open_blocks = [], []
    for i, n in enumerate(nodes):
        while open_blocks and open_blocks[-1] >= n.depth:
            open_blocks.pop()
            out.append(" ")
        if n.tag == "#":
            if keep[i]:
                out.append(n.text)
        elif n.block:
            out.append(" ")
            open_blocks.append(n.depth)
    return " ".join("".join(out).split())


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    """The main text of each page; "" for a page without any, an empty one and null."""
    parsed = [parse(p or "") for p in pages]
    if not parsed:
        return []
    margin = model.trees.margin(node_features(parsed, model))
    out, at = [], 0
    for nodes in parsed:
        out.append(_render(nodes, _decode(nodes, margin[at : at + len(nodes)])))
        at += len(nodes)
    return out


#: Nodes' features are made for so many characters of pages at a time.
_RUN = 1 << 20


def _extract(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column(batch.num_columns - 1).to_pylist()
        texts, low, size = [], 0, 0
        for i, p in enumerate(pages):
            size += len(p or "")
            if size >= _RUN or i == len(pages) - 1:
                texts += main_texts(pages[low : i + 1], model)
                low, size = i + 1, 0
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "main_text"])


def with_main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``pages`` with main_text string, the main text of the whole of html; all columns stay, a main_text is replaced.

    Null and empty html, and pages without an article, have "". Equal html gives equal
    text; rows may repeat. An empty table stays empty. Nothing is shuffled.
    """
    model = model or default_model()
    sent = pages.sparkSession.sparkContext.broadcast(model)
    return with_mapped(pages, F.col("html").cast("string"), lambda it: _extract(sent.value, it), T.StructField("main_text", T.StringType()))
