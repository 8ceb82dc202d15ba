"""Labelled pages for training: layouts that sites use, filled with random words.

Every element that holds text says in ``data-gold`` whether it belongs to the article. The number of pages is a parameter;
page n is the same in every run.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba che do er fi gla hu in jo ka lem mi no or pra qui ro sta tu un ve wi xa yo ze an the es on ti re la de".split()


class _Writer:
    def __init__(self, number: int):
        self.random = random.Random(number)

    def word(self) -> str:
        return "".join(self.random.choice(_SYLLABLES) for _ in range(self.random.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(self.random.randint(low, high))]
        text = ""
        for i, w in enumerate(words):
            text += w + (", " if self.random.random() < 0.1 and i < len(words) - 1 else " ")
        return text.strip().capitalize() + self.random.choice("....!?")

    def prose(self, most: int) -> str:
        return " ".join(self.sentence(1, 25) for _ in range(self.random.randint(1, most)))

    def short(self) -> str:
        return " ".join(self.word() for _ in range(self.random.randint(1, 5))).capitalize()

    def links(self, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{self.word()}">{self.short()}</a></{tag}>' for _ in range(self.random.randint(2, 9)))

    def pick(self, *options: str) -> str:
        return self.random.choice(options)

    def maybe(self, chance: float, text: str) -> str:
        return text if self.random.random() < chance else ""


def _attribute(w: _Writer, *names: str) -> str:
    name = w.pick(*names)
    return w.pick(f' class="{name}"', f' id="{name}"', f' class="{w.word()} {name}"', f' class="{name}-{w.word()}"')


def _paragraph(w: _Writer) -> str:
    kind = w.random.random()
    if kind < 0.75:
        return f"<p>{w.maybe(0.15, '<b>')}{w.prose(6)}{w.maybe(0.1, '<br>' + w.prose(2))}{w.maybe(0.8, '</p>')}"
    if kind < 0.82:
        return f"<p>{w.short()}.</p>"
    if kind < 0.88:
        return f"<h2>{w.short()}</h2>"
    if kind < 0.92:
        return "<ul>" + "".join(f"<li>{w.sentence(2, 15)}</li>" for _ in range(3)) + "</ul>"
    if kind < 0.95:
        return f"<blockquote>{w.prose(2)}</blockquote>"
    if kind < 0.97:
        return f"<p>{w.sentence(3, 12)} <a href='/{w.word()}'>{w.short()}</a> {w.sentence(3, 12)}</p>"
    return f"<table><tr><td>{w.short()}</td><td>{w.short()}</td></tr></table>"


def _aside(w: _Writer) -> str:
    """What stands in or beside an article without being part of it."""
    body = w.pick(f"<p>{w.prose(3)}</p>", w.prose(2), f"<h3>{w.short()}</h3><p>{w.sentence(3, 20)}</p>", f"<ul>{w.links()}</ul>")
    kind = w.random.randrange(8)
    if kind == 0:
        return f'<div{_attribute(w, "ad", "ads", "advert", "advertisement", "sponsored", "promo")} data-gold="0">{body}</div>'
    if kind == 1:
        return f'<aside{w.maybe(0.5, _attribute(w, "sidebar", "related", "widget"))} data-gold="0">{body}</aside>'
    if kind == 2:
        return f'<div{_attribute(w, "sidebar", "related", "widget", "trending", "popular", "recommended")} data-gold="0">{body}</div>'
    if kind == 3:
        notice = w.pick("We use cookies. ", "This site stores data. ", "")
        tag = w.pick("div", "section", "p")
        return f'<{tag}{_attribute(w, "notice", "cookie", "consent", "alert", "modal", "popup", "warning", "newsletter")} data-gold="0">{notice}{w.prose(2)}</{tag}>'
    if kind == 4:
        return f'<form data-gold="0"><label>{w.short()}</label><input name="q"><p>{w.sentence(2, 12)}</p><button>{w.short()}</button></form>'
    if kind == 5:
        return f'<div{_attribute(w, "share", "social", "tags", "meta", "byline", "author")} data-gold="0">{w.short()} {w.maybe(0.5, w.links("span"))}</div>'
    if kind == 6:
        return f'<nav data-gold="0">{w.pick(f"<ul>{w.links()}</ul>", w.links("span"))}</nav>'
    return f'<div{_attribute(w, "breadcrumb", "menu", "toc", "pagination")} data-gold="0">{w.pick(f"<ul>{w.links()}</ul>", w.links("span"))}</div>'


def _comments(w: _Writer) -> str:
    one = lambda: w.pick(f"<p>{w.prose(4)}</p>", f"<b>{w.short()}</b><p>{w.prose(3)}</p>", w.prose(3))
    inner = w.pick("div", "li", "article")
    own = "".join(f'<{inner}{w.maybe(0.7, _attribute(w, "comment", "reply"))}>{one()}</{inner}>' for _ in range(w.random.randint(1, 5)))
    outer = w.pick("section", "div", "ol", "aside")
    return f'<{outer}{_attribute(w, "comments", "comment", "respond", "discussion", "commentlist")} data-gold="0">{w.maybe(0.5, f"<h3>{w.short()}</h3>")}{own}</{outer}>'


def page(number: int) -> str:
    w = _Writer(number)
    head = f"<!DOCTYPE html><html><head><title>{w.short()}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>"
    top = w.pick(
        f'<header data-gold="0"><a href="/">{w.short()}</a><p>{w.sentence(2, 9)}</p></header>',
        f'<div{_attribute(w, "header", "masthead", "topbar", "banner")} data-gold="0"><h1>{w.short()}</h1>{w.sentence(2, 9)}</div>', "", "")
    around = w.pick("div", "ul")
    menu = w.pick(
        f'<nav data-gold="0"><ul>{w.links()}</ul></nav>',
        f'<{around}{_attribute(w, "menu", "nav", "navbar", "navigation")} data-gold="0">{w.links()}</{around}>', "")
    between = "".join(w.maybe(0.4, _aside(w)) for _ in range(2))
    title = w.pick(f"<h1>{w.sentence(2, 10)}</h1>", f"<h1>{w.short()}</h1>", f"<header><h1>{w.short()}</h1></header>", "")
    body = title + "".join(_paragraph(w) + w.maybe(0.1, _aside(w)) for _ in range(w.random.choice((1, 2, 3, 5, 8, 13))))
    inside = w.maybe(0.15, f'<footer data-gold="0"><p>{w.sentence(2, 12)}</p></footer>') + w.maybe(0.15, _comments(w))
    layout = w.random.randrange(5)
    if layout < 2:
        main = f'<article data-gold="1">{body}{inside}</article>'
    elif layout == 2:
        main = f'<main data-gold="1">{body}{inside}</main>'
    elif layout == 3:
        main = f'<div{_attribute(w, "content", "post", "entry", "story", "main")} data-gold="1">{body}{inside}</div>'
    else:
        main = f'<div data-gold="1">{body}{inside}</div>'
    after = w.maybe(0.3, _comments(w)) + "".join(w.maybe(0.3, _aside(w)) for _ in range(2))
    foot = w.pick(
        f'<footer data-gold="0">&copy; {w.word()}.example &middot; {w.sentence(1, 9)}</footer>',
        f'<div{_attribute(w, "footer", "copyright", "legal")} data-gold="0"><p>{w.prose(2)}</p>{w.links("span")}</div>', "")
    return head + top + menu + between + main + after + foot + w.maybe(0.9, "</body></html>")


def pages(count: int, first: int = 0) -> list[str]:
    return [page(n) for n in range(first, first + count)]
