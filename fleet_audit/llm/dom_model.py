"""A tree-structured graphical model over the nodes of web pages: is a node part of the main text or not?

Each node has a potential from what it is (element, words of its class, amount and place of its text, share of links). Each edge
has a 2 x 2 potential that depends on the kinds of both ends. Sum-product messages pass up from the leaves and down from the roots, level
by level over all pages at once, and give the exact marginals. The weights are those of the largest
likelihood of labelled pages; its gradient is the difference between labels and marginals.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np

from fleet_audit.llm.dom_tree import Forest

HASHED = 1 << 12
BINS = 16
_KINDS = {
    "": 0, "p": 1, **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 2), **dict.fromkeys(("ul", "ol", "dl", "menu"), 3), **dict.fromkeys(("li", "dt", "dd"), 4),
    **dict.fromkeys(("div", "section", "body"), 5), **dict.fromkeys(("table", "tbody", "thead", "tr", "td", "th"), 6), **dict.fromkeys(("article", "main"), 7),
}
_OTHER_KIND, _KIND_COUNT = 8, 9
KINDS = _KIND_COUNT**2
_MEASURES = 9
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _hashed_names(name: tuple[str, str]) -> list[int]:
    tag, names = name
    words = sorted({w.lower() for w in _WORD.findall(names)}) if tag else [names]
    return [zlib.crc32(f"{'tag' if k == 0 else 'word' if tag else 'in'}={w}".encode()) % HASHED for k, w in enumerate([tag, *words])]


def _levels(forest: Forest) -> list[np.ndarray]:
    order = np.argsort(forest.depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(forest.depth))[:-1]) if len(order) else []


@dataclass
class Inputs:
    """What the potentials of a forest are made of."""

    forest: Forest
    levels: list[np.ndarray]
    names: list[tuple[str, str]]
    name: np.ndarray
    measures: np.ndarray
    kind: np.ndarray
    hashed: list[list[int]] = field(default_factory=list)


def _log_bin(values: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(values + 1).astype(np.int64), BINS - 1)


def _share_bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(part <= 0, 0, 1 + np.minimum(7, 8 * part // np.maximum(whole, 1)))


def inputs_of(forest: Forest) -> Inputs:
    levels, leaf = _levels(forest), forest.leaf
    chars, links, blocks = forest.chars.copy(), forest.links.copy(), leaf.astype(np.int64)
    for level in levels[:0:-1]:
        for sums in (chars, links, blocks):
            np.add.at(sums, forest.parent[level], sums[level])
    roots = levels[0] if levels else np.zeros(0, np.int64)
    total = np.maximum(chars[roots], 1)[forest.page] if len(roots) else chars
    before = np.cumsum(forest.chars) - forest.chars
    before = before - before[roots][forest.page] if len(roots) else before
    texts = [t or "" for t in forest.text]
    mark = np.array([3 if "©" in t else 2 if t[-1:] in ".!?。؟" else 1 if t else 0 for t in texts], np.int64)
    first = np.ones(len(leaf), np.int64)
    first[forest.parent[1:][forest.parent[1:] >= 0]] = 0
    has_parent = np.maximum(forest.parent, 0)
    measures = np.stack([
        _log_bin(chars), _share_bin(links, chars), np.minimum(9, 10 * before // total), np.minimum(9, 10 * (before + chars) // total), _share_bin(chars, total),
        np.minimum(forest.depth, BINS - 1), _log_bin(blocks), _log_bin(chars // np.maximum(blocks, 1)), mark + 4 * (blocks[has_parent] > 1) * leaf,
    ]).astype(np.int64)
    offsets = (np.arange(_MEASURES)[:, None] * 2 + leaf[None]) * BINS
    index: dict[tuple[str, str], int] = {}
    name = np.array([index.setdefault(n, len(index)) for n in forest.name], np.int64)
    kind = np.array([_KINDS.get(t, _OTHER_KIND) for t, _ in forest.name], np.int64)
    kind = kind + _KIND_COUNT * kind[has_parent]
    return Inputs(forest, levels, list(index), name, offsets + measures, kind, [_hashed_names(n) for n in index])


@dataclass
class DomModel:
    hashed: np.ndarray
    measured: np.ndarray
    edges: np.ndarray

    def unary(self, x: Inputs) -> np.ndarray:
        of_names = np.array([self.hashed[h].sum() for h in x.hashed])
        return (of_names[x.name] if len(of_names) else np.zeros(0)) + self.measured[x.measures].sum(axis=0)

    def marginals(self, x: Inputs) -> np.ndarray:
        """The probability of each node to be part of the main text."""
        return sum_product(self.unary(x), self.edges[x.kind], x.forest.parent, x.levels)[0]


def sum_product(unary: np.ndarray, edges: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 per node, and of both states of (parent, node) per node as ``[node, parent state, state]``.

    ``unary`` is the log potential of state 1 (that of 0 is none), ``edges`` the log potentials ``[node, parent state, state]``
    of the edge above each node.
    """
    inside = np.stack([np.zeros_like(unary), unary], axis=1)
    up = np.zeros_like(inside)
    for level in levels[:0:-1]:
        to_parent = edges[level] + inside[level][:, None, :]
        up[level] = np.logaddexp(to_parent[:, :, 0], to_parent[:, :, 1])
        np.add.at(inside, parent[level], up[level])
    outside = np.zeros_like(inside)
    pairs = np.zeros((len(unary), 2, 2))
    for level in levels[1:]:
        above = (inside + outside)[parent[level]] - up[level] if len(level) * 4 > len(unary) else inside[parent[level]] + outside[parent[level]] - up[level]
        both = edges[level] + above[:, :, None]
        outside[level] = np.logaddexp(both[:, 0], both[:, 1])
        joint = both + inside[level][:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        pairs[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
    belief = inside + outside
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pairs


def fit(x: Inputs, label: np.ndarray, rounds: int = 100, rate: float = 0.1, penalty: float = 1e-4) -> DomModel:
    """Weights of the greatest likelihood of ``label``, with a small penalty on their squares, by Adam on the exact gradient."""
    model = DomModel(np.zeros(HASHED), np.zeros(_MEASURES * 2 * BINS), np.zeros((KINDS, 2, 2)))
    nodes = max(1, len(label))
    child = np.flatnonzero(x.forest.parent >= 0)
    seen = np.zeros_like(model.edges)
    np.add.at(seen, (x.kind[child], label[x.forest.parent[child]], label[child]), 1.0)
    owner = np.repeat(np.arange(len(x.hashed)), [len(h) for h in x.hashed])
    flat = np.array([f for h in x.hashed for f in h], np.int64)
    weights = [model.hashed, model.measured, model.edges]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for turn in range(1, rounds + 1):
        expected, pairs = sum_product(model.unary(x), model.edges[x.kind], x.forest.parent, x.levels)
        off = label - expected
        of_names = np.bincount(x.name, weights=off, minlength=len(x.hashed))
        expected_pairs = np.zeros_like(model.edges)
        np.add.at(expected_pairs, x.kind[child], pairs[child])
        steps = [
            np.bincount(flat, weights=of_names[owner], minlength=HASHED),
            np.bincount(x.measures.ravel(), weights=np.tile(off, _MEASURES), minlength=_MEASURES * 2 * BINS),
            seen - expected_pairs,
        ]
        for w, g, m, v in zip(weights, steps, first, second):
            g = g / nodes - penalty * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return model


def node_labels(forest: Forest, leaf_label: np.ndarray) -> np.ndarray:
    """Labels of all nodes from those of the text blocks: an element is main text when half of its characters or more are."""
    inside, whole = np.where(forest.leaf, leaf_label, 0) * forest.chars, forest.chars.copy()
    for level in _levels(forest)[:0:-1]:
        np.add.at(inside, forest.parent[level], inside[level])
        np.add.at(whole, forest.parent[level], whole[level])
    return ((whole > 0) & (2 * inside >= whole)).astype(np.int64)
