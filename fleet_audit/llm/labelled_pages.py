"""Labelled pages to train on: texts of real pages laid out anew, with known parts.

Real pages that mark their main text with landmark elements are labelled as they are. As other sites look different, their texts are
also put into layouts drawn at random: the main text in one of several containers, and around and inside it menus, headers,
footers, sidebars, notices, adverts, forms and reader comments under the names that are common for them, or under none.
"""

from __future__ import annotations

import html
import random

from fleet_audit.llm.dom_tree import LABEL, Forest, landmark_labels

# Names of parts of pages, as element and class.
MAIN = ["article", "main", "div content", "div post-body", "div entry-content", "section story", "div article-text", "div main-text", "div page-main", "div", "td", "div text body", "section"]
PARTS = {
    "menu": ["nav", "div menu", "ul nav navbar", "div navigation", "div top-links", "div breadcrumbs", "ol breadcrumb", "div"],
    "header": ["header", "div header", "div masthead", "div site-title", "div top"],
    "footer": ["footer", "div footer", "div copyright", "div site-info", "div bottom", "div"],
    "sidebar": ["aside", "div sidebar", "div related", "div widget", "section recommended", "div popular posts", "div teaser", "div side column"],
    "notice": ["div cookie-notice", "div consent gdpr", "div alert notice", "div newsletter", "div popup modal", "div paywall", "p disclaimer", "div notice", "section banner"],
    "advert": ["div ad", "div ads", "div advert", "div advertisement", "div sponsored", "aside ad-slot", "div promo", "section promotion"],
    "form": ["form", "form search", "form login", "form subscribe", "form contact"],
    "comments": ["section comments", "div comments", "ol commentlist", "div comment-list", "div discussion replies", "div reader-comments", "section responses", "div reviews"],
    "share": ["div share", "ul social", "div tags", "div meta-links", "ul share-buttons"],
}
_LINKED = {"menu", "share", "sidebar"}


class _Writer:
    def __init__(self, texts: list[str], rng: random.Random) -> None:
        self.texts, self.rng = texts, rng

    def words(self, least: int, most: int) -> str:
        found = self.rng.choice(self.texts).split() or ["text"]
        start = self.rng.randrange(len(found))
        return html.escape(" ".join(found[start : start + self.rng.randint(least, most)]))

    def prose(self) -> str:
        return html.escape(self.rng.choice(self.texts))

    def element(self, name: str, inner: str, label: int | None = None, plain: bool = False) -> str:
        tag, *classes = name.split(" ")
        attrs = f' {self.rng.choice(("class", "class", "id"))}="{" ".join(classes)}"' if classes and not plain else ""
        attrs += f' {LABEL}="{label}"' if label is not None else ""
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def links(self) -> str:
        item = [f'<a href="/{k}">{self.words(1, 5)}</a>' for k in range(self.rng.randint(2, 9))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in item) + "</ul>" if self.rng.random() < 0.7 else " | ".join(item)

    def part(self, kind: str, plain: bool) -> str:
        name = self.rng.choice(PARTS[kind])
        if kind == "form":
            inner = f"<p>{self.words(1, 8)}</p><label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>"
        elif kind == "comments":
            item = "li comment" if name.startswith("ol") else self.rng.choice(["div comment", "article comment", "div reply", "div"])
            one = [f"<h4>{self.words(1, 3)}</h4><p>{self.prose()}</p>" if self.rng.random() < 0.6 else f"<b>{self.words(1, 2)}</b> {self.prose()}" for _ in range(self.rng.randint(1, 5))]
            inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(self.element(item, i) for i in one)
        elif kind == "footer":
            inner = f"&copy; {self.words(1, 4)} &middot; {self.words(3, 14)}" + (self.links() if self.rng.random() < 0.4 else "")
        elif kind in _LINKED:
            inner = (f"<h3>{self.words(1, 4)}</h3>" if self.rng.random() < 0.5 else "") + self.links() + (f"<p>{self.words(5, 25)}</p>" if kind == "sidebar" and self.rng.random() < 0.5 else "")
        else:
            inner = self.words(3, 30) if self.rng.random() < 0.6 else f"<p>{self.words(5, 30)}</p>"
        # A long text without a name cannot be told from the main text.
        return self.element(name, inner, 0, plain and kind not in ("comments", "sidebar", "notice", "advert"))

    def paragraph(self) -> str:
        draw, text = self.rng.random(), self.prose()
        if draw < 0.7:
            return f"<p>{text}</p>" if draw < 0.6 else f"<p>{text}"
        if draw < 0.78:
            return f"<div>{text}</div>"
        if draw < 0.84:
            return f"<h2>{self.words(2, 8)}</h2><p>{text}</p>"
        if draw < 0.89:
            return f"<blockquote>{text}</blockquote>"
        if draw < 0.94:
            return "<ul>" + "".join(f"<li>{self.words(4, 20)}</li>" for _ in range(self.rng.randint(2, 5))) + "</ul>"
        if draw < 0.97:
            return f"<table><tr><td>{self.words(1, 6)}</td><td>{self.words(1, 6)}</td></tr></table>"
        return f"<figure><figcaption>{self.words(4, 16)}</figcaption></figure>"

    def page(self) -> str:
        rng = self.rng
        plain = rng.random() < 0.25
        inside = [f"<h1>{self.words(3, 12)}</h1>", *(self.paragraph() for _ in range(rng.choice((1, 2, 4, 8, 14))))]
        for kind in ("advert", "share", "sidebar", "notice"):
            if rng.random() < 0.2:
                inside.insert(rng.randint(1, len(inside)), self.part(kind, plain))
        if rng.random() < 0.25:
            inside.append(self.part("comments", plain))
        front = [self.part(k, plain) for k in ("notice", "header", "menu", "form", "advert") if rng.random() < 0.5]
        back = [self.part(k, plain) for k in ("sidebar", "share", "comments", "advert", "form") if rng.random() < 0.35] + [self.part("footer", plain)] * (rng.random() < 0.8)
        main = self.element(rng.choice(MAIN), "".join(inside), 1, plain)
        body = "".join([*front, main, *back])
        for _ in range(rng.randint(0, 3)):
            body = f"<div>{body}</div>"
        return f"<html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body>{body}<script>var a='<p>';</script></body></html>"


def laid_out(texts: list[str], pages: int, seed: int = 13) -> list[str]:
    """``pages`` labelled pages made of ``texts``."""
    rng = random.Random(seed)
    writer = _Writer(texts or [" ".join("".join(rng.choices("aeinrst", k=rng.randint(2, 8))) for _ in range(rng.randint(3, 60))) + "." for _ in range(200)], rng)
    return [writer.page() for _ in range(pages)]


def landmark_pages(forest: Forest) -> tuple[list[int], list[str]]:
    """The pages of ``forest`` whose landmarks say what their main text is, and the texts in them."""
    label = landmark_labels(forest)
    known = sorted({int(p) for p, one, t in zip(forest.page, label, forest.text) if one and t})
    return known, [t for t, one in zip(forest.text, label) if t and one]
