"""Main text of web pages by a tree-structured graphical model.

Every block element is a node that is main text or not. Its look gives a potential, and
each parent and child share one. Messages passed up the tree and down again (sum-product,
exact on a tree) give the marginal of every node; the text of nodes that are main text
with a probability of one half or more is the page's. The weights are those of greatest
likelihood on labelled pages, found by following the difference of the labelled features
and their expectation under the same messages.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseflow.llm.common import require
from caseflow.llm.dom import Node, block_tree, own_blocks
from caseflow.llm.labelled_pages import labelled_pages

_TAGS = (
    "html p h1 h2 li ul div section article main nav aside header footer form table td tr blockquote pre "
    "figure figcaption dl other"
).split()
_ALIKE = {"ol": "ul", "menu": "ul", "dt": "li", "dd": "li", "th": "td", "tbody": "table", "thead": "table", "tfoot": "table",
          "caption": "figcaption", "fieldset": "form"} | {f"h{i}": "h2" for i in range(3, 7)}
#: Parts of class, id and role that tell what a block is for.
_HINTS = {
    "text": r"article|content|post|entry|story|\bmain\b|\bbody\b|text",
    "menu": r"menu|nav|breadcrumb|pagination|crumb|toc",
    "ad": r"(?:^|[\s_-])ads?(?:$|[\s_-])|advert|sponsor|promo|banner",
    "side": r"side|widget|related|recommend|trending",
    "foot": r"foot|copyright|legal|colophon",
    "head": r"header|masthead|logo|topbar|toolbar",
    "notice": r"cookie|consent|notice|alert|popup|modal|newsletter|subscribe|gdpr|warning|disclaimer",
    "comment": r"comment|repl(?:y|ies)|discuss|disqus|respond",
    "share": r"share|social|follow",
    "form": r"search|login|signup|\bform\b",
}
_HINT_PATTERNS = [re.compile(p) for p in _HINTS.values()]
_SIZES = (0, 20, 80, 300)
_RATES = (0.0, 0.3, 0.7)
_ENDS = re.compile(r"[.!?。！？…][\"'”’)]*\s*$")
N_TAGS, N_HINTS = len(_TAGS), len(_HINTS)
_TAG_AT = {t: i for i, t in enumerate(_TAGS)}
N_FEATURES = 1 + N_TAGS + N_HINTS + (len(_SIZES) + 1) + 2 * (len(_RATES) + 1) + 3
#: A parent and a child share a weight for each pair of their labels and kind of child.
N_WEIGHTS = N_FEATURES + 4 * N_TAGS
ROUNDS, RATE, PENALTY = 150, 0.5, 1e-3


def _tag(node: Node) -> int:
    return _TAG_AT.get(_ALIKE.get(node.tag, node.tag), N_TAGS - 1)


def _level(value: float, bounds: Sequence[float]) -> int:
    return sum(value > b for b in bounds)


def features(nodes: list[Node]) -> list[list[int]]:
    """For each node the numbers of its features (each is present or not)."""
    chars = [n.chars for n in nodes]
    links = [n.link_chars for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        chars[nodes[i].parent] += chars[i]
        links[nodes[i].parent] += links[i]
    out = []
    for i, node in enumerate(nodes):
        at = 1
        found = [0, at + _tag(node)]
        at += N_TAGS
        if node.hints:
            found += [at + k for k, p in enumerate(_HINT_PATTERNS) if p.search(node.hints)]
        at += N_HINTS
        found.append(at + _level(node.chars, _SIZES))
        at += len(_SIZES) + 1
        for part, whole in ((node.link_chars, node.chars), (links[i], chars[i])):
            found.append(at + _level(part / whole if whole else 0.0, _RATES))
            at += len(_RATES) + 1
        own = [p for p in node.pieces if isinstance(p, str) and p.strip()] if node.chars else []
        found += [at + k for k, yes in enumerate((
            bool(own) and bool(_ENDS.search(own[-1])), any("©" in p for p in own), not chars[i],
        )) if yes]
        out.append(found)
    return out


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(nodes: list[Node], found: list[list[int]], weights: Sequence[float]) -> tuple[list[float], list[tuple]]:
    """Probability of each node to be main text, and, for each node but the first, of its
    pair of labels with its parent: (neither, child alone, parent alone, both)."""
    n = len(nodes)
    up0, up1 = [0.0] * n, [sum([weights[k] for k in f]) for f in found]
    edges = [N_FEATURES + 4 * _tag(node) for node in nodes]
    sent: list[tuple[float, float]] = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):
        e, p = edges[i], nodes[i].parent
        to0 = _log_sum(weights[e] + up0[i], weights[e + 1] + up1[i])
        to1 = _log_sum(weights[e + 2] + up0[i], weights[e + 3] + up1[i])
        sent[i] = (to0, to1)
        up0[p] += to0
        up1[p] += to1
    down: list[tuple[float, float]] = [(0.0, 0.0)] * n
    single = [0.0] * n
    pairs: list[tuple] = [()] * n
    for i in range(n):
        b0, b1 = up0[i] + down[i][0], up1[i] + down[i][1]
        single[i] = 1 / (1 + math.exp(min(max(b0 - b1, -700), 700)))
        for c in nodes[i].children:
            e = edges[c]
            r0, r1 = b0 - sent[c][0], b1 - sent[c][1]  # all the parent knows but from this child
            down0 = _log_sum(r0 + weights[e], r1 + weights[e + 2])
            down1 = _log_sum(r0 + weights[e + 1], r1 + weights[e + 3])
            top = max(down0, down1)
            down[c] = (down0 - top, down1 - top)
            joint = (r0 + weights[e] + up0[c], r0 + weights[e + 1] + up1[c], r1 + weights[e + 2] + up0[c], r1 + weights[e + 3] + up1[c])
            top = max(joint)
            parts = [math.exp(j - top) for j in joint]
            total = sum(parts)
            pairs[c] = tuple(x / total for x in parts)
    return single, pairs


def train(pages: Sequence[str], rounds: int = ROUNDS) -> np.ndarray:
    """Weights of greatest penalised likelihood on pages whose main text is marked."""
    trees = []
    for page in pages:
        nodes, marked = block_tree(page)
        # The page itself, and whatever holds main text, counts as marked.
        trees.append((nodes, features(nodes), [int(i in marked or i == 0) for i in range(len(nodes))]))
    size = sum(len(t[0]) for t in trees)
    weights, grown = np.zeros(N_WEIGHTS), np.full(N_WEIGHTS, 1e-8)
    for _ in range(rounds):
        slope = -PENALTY * weights * size
        plain = weights.tolist()
        for nodes, found, labels in trees:
            single, pairs = marginals(nodes, found, plain)
            for i, node in enumerate(nodes):
                slope[found[i]] += labels[i] - single[i]
                if i:
                    e = N_FEATURES + 4 * _tag(node)
                    slope[e + 2 * labels[node.parent] + labels[i]] += 1
                    slope[e : e + 4] -= pairs[i]
        slope /= size
        grown += slope**2
        weights += RATE * slope / np.sqrt(grown)
    return weights


@lru_cache(maxsize=1)
def default_weights() -> tuple[float, ...]:
    return tuple(train(labelled_pages()).tolist())


def main_text(html: str | None, weights: Sequence[float]) -> str:
    """The main text of one page."""
    if not html:
        return ""
    nodes, _ = block_tree(html)
    single, _ = marginals(nodes, features(nodes), weights)
    out: list[str] = []
    todo: list = [0]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
            continue
        own = own_blocks(nodes[part])
        if single[part] < 0.5:
            own = [p for p in own if not isinstance(p, str)]
        todo += reversed(own)
    return " ".join(out)


def extract_main_text(pages: DataFrame, weights: Sequence[float] | None = None) -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars (code points).

    Character references are decoded, white space in a block becomes one blank, blocks are
    joined by one in the order of the page. NULL and empty pages, and pages without main
    text, have the text "". Broken markup is read as far as it goes. Without `weights` the
    model is trained on `labelled_pages()`.
    """
    held = tuple(weights) if weights is not None else default_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), held) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = require(pages, "page_id", "url", "html").selectExpr("cast(page_id as bigint) page_id", "url", "html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
