"""Web pages as trees of block elements and blocks of text, in arrays that hold many pages at once.

A block is the text between two tags of block elements; inline elements belong to their block. White space in a
block becomes one space, character references are decoded, and scripts, styles, form controls and embedded objects have no text.
Missing end tags of paragraphs, list items and table cells are supplied; end tags of what is not open are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np

# Elements of HTML by the way they behave.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base col embed frame hr input link meta param source track".split())
TEXTLESS = frozenset("audio button canvas datalist head iframe map math noframes noscript object option script select style svg template textarea title video".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
CONTENT_LANDMARKS = frozenset(("article", "main"))
OTHER_LANDMARKS = frozenset(("nav", "aside", "footer", "form"))

#: Attribute of labelled pages: 1 where the main text begins, 0 where it is interrupted. Never an input of a score.
LABEL = "data-content"
_NAMING = ("class", "id", "role")


@dataclass
class Forest:
    """Nodes of pages, parents before children; ``text`` is null for elements."""

    page: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    name: list[tuple[str, str]]
    chars: np.ndarray
    links: np.ndarray
    label: np.ndarray
    text: list[str | None]

    @property
    def leaf(self) -> np.ndarray:
        return np.array([t is not None for t in self.text], bool)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pages = 0
        self.rows: list[tuple] = []

    def page(self, html: str | None) -> None:
        self.reset()
        self.stack: list[tuple[int, str, int, int, bool]] = []  # node, tag, links, label, whether it has no text
        self.links, self.linked, self.buffer = 0, 0, []
        self._push("page", "", 0, False)
        self.feed(html or "")
        self.close()
        self._end_block()
        self.pages += 1

    def _push(self, tag: str, names: str, label: int, textless: bool) -> None:
        parent = self.stack[-1][0] if self.stack else -1
        self.stack.append((len(self.rows), tag, self.links, label, textless))
        self.rows.append((self.pages, parent, len(self.stack) - 1, (tag, names), 0, 0, label, None))

    def _end_block(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                node, tag, _, label, _ = self.stack[-1]
                self.rows.append((self.pages, node, len(self.stack), ("", tag), len(text), min(self.linked, len(text)), label, text))
        self.buffer, self.linked = [], 0

    def _pop(self) -> None:
        self.links = self.stack.pop()[2]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in INLINE:
            if tag == "a":
                self.links += 1
            elif tag == "br":
                self.buffer.append(" ")
            return
        self._end_block()
        if self.stack[-1][1] == "p":
            self._pop()
        if tag in VOID:
            return
        if tag in _CLOSES:
            closed, barriers = _CLOSES[tag]
            depth = len(self.stack) - 1
            while depth and self.stack[depth][1] not in barriers and self.stack[depth][1] not in closed:
                depth -= 1
            if depth and self.stack[depth][1] in closed:
                while len(self.stack) > depth:
                    self._pop()
        label = self.stack[-1][3]
        names = []
        for name, value in attrs:
            if name in _NAMING and value:
                names.append(value)
            elif name == LABEL:
                label = int(value == "1")
        self._push(tag, " ".join(names), label, self.stack[-1][4] or tag in TEXTLESS)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.links = max(0, self.links - 1)
            return
        self._end_block()
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][1] == tag:
                while len(self.stack) > depth:
                    self._pop()
                return

    def handle_data(self, data: str) -> None:
        if self.stack[-1][4]:
            return
        self.buffer.append(data)
        if self.links:
            self.linked += len(data.strip())


def parse(pages: list[str | None]) -> Forest:
    """The trees of ``pages``; each has a root named ``page``, also an empty one."""
    builder = _Builder()
    for html in pages:
        builder.page(html)
    page, parent, depth, name, chars, links, label, text = map(list, zip(*builder.rows)) if builder.rows else ([] for _ in range(8))
    whole = [np.array(c, np.int64) for c in (page, parent, depth, chars, links, label)]
    return Forest(*whole[:3], name, *whole[3:], text)


def landmark_labels(forest: Forest) -> np.ndarray:
    """Labels by the landmarks of HTML: what stands in an article or the main part, and not in a menu, aside, footer or form there."""
    label = np.zeros(len(forest.parent), np.int64)
    for k, (parent, (tag, _)) in enumerate(zip(forest.parent.tolist(), forest.name)):
        label[k] = 1 if tag in CONTENT_LANDMARKS else 0 if tag in OTHER_LANDMARKS or parent < 0 else label[parent]
    return label
