"""HTML to leaf blocks: runs of text between block-level tags, with what their ancestors and their text tell.

Scripts, styles, titles and the like never give text. Missing end tags are implied as browsers imply the common ones.
Time is linear in the page, memory that of its blocks.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

# Kinds of HTML elements.
SKIPPED = frozenset("script style title template noscript textarea iframe svg math object canvas audio video head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot "
    "th thead tr ul".split())
#: A start tag on the left ends the nearest open one of these, unless one of the containers stands between.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
           "option": ("option",), "tbody": ("tr", "tbody", "thead"), "tfoot": ("tr", "tbody", "thead")}
CONTAINERS = frozenset("ul ol dl table select article aside body div fieldset footer form header html main menu nav section blockquote figure".split())

#: Elements that say what their text is for; of these and of the hints below the nearest counts by itself too.
SECTIONS = frozenset("article main nav aside header footer form section".split())

#: Name parts in class, id and role attributes, by what they hint at.
HINTS = {word: kind for kind, words in {
    "content": "content article post entry story main body text prose page",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager tabs toc skip",
    "side": "sidebar side aside widget widgets rail related recommended recommendations trending popular complementary more teaser teasers",
    "foot": "foot footer copyright legal colophon contentinfo imprint bottom",
    "head": "header masthead banner logo branding hero head top tagline",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted",
    "comment": "comment comments commentlist reply replies respond disqus discussion reactions feedback",
    "notice": "cookie cookies notice notices consent gdpr popup modal overlay alert warning subscribe subscription newsletter signup paywall login "
              "message dialog announcement disclaimer",
    "share": "share sharing social follow tag tags meta byline author date print search form",
}.items() for word in words.split()}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+")
#: Skipped elements that nest, and that a slash closes unless it is the end of an unquoted value.
_FOREIGN, _VALUE = frozenset(["svg", "math"]), re.compile(r"""=\s*[^\s"']+\Z""")
_CLOSING = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in SKIPPED}
_ENDS = {".", "!", "?", ":", "…", "\"", "”", "»"}
_CUES = re.compile(r"©|\bcopyright\b|all rights reserved|\bcookies?\b|\bsubscribe\b|\bnewsletter\b|\bsign (?:in|up)\b|\blog ?in\b|\bshare\b|\bcomments?\b|\breply\b|\badvert|\bsponsor|\bprivacy\b", re.I)


@dataclass
class Block:
    text: str
    features: list[str]
    gold: str | None = None


@dataclass
class _Open:
    name: str
    features: frozenset
    linked: bool
    gold: str | None
    near: tuple = ()


@lru_cache(maxsize=50_000)
def _hinted(name: str, attributes: str) -> tuple[frozenset, str | None]:
    """What a tag tells about all text inside it, and its label if it is a labelled page."""
    found, gold = {f"in:{name}"} if name in BLOCK else set(), None
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role", "aria-label"):
            parts = [p.lower() for p in _NAME_PARTS.findall(value.replace("-", " ").replace("_", " "))]
            found.update(f"hint:{HINTS[p]}" for p in parts if p in HINTS)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            found.add("hidden")
        elif key == "data-gold":
            gold = value
    return frozenset(found), gold


def _text_features(text: str, linked: int) -> list[str]:
    words, share = text.count(" ") + 1, linked / len(text)
    size = "1" if words == 1 else "2-3" if words < 4 else "4-8" if words < 9 else "9-20" if words < 21 else "21-50" if words < 51 else "51+"
    out = ["bias", f"words:{size}", "links:" + ("0" if not linked else "few" if share < 0.3 else "many" if share < 0.8 else "all")]
    if text[-1] in _ENDS:
        out.append("ends")
    if "," in text:
        out.append("comma")
    if len(text) < 400 and _CUES.search(text):
        out.append("cue")
    return out


def _closed(attributes: str) -> bool:
    return attributes.endswith("/") and not _VALUE.search(attributes)


def _foreign_end(page: str, at: int, name: str) -> int:
    """Where the element whose start tag ends at ``at`` ends, elements of its name inside it counted."""
    depth = 1
    for m in _TOKEN.finditer(page, at):
        if m[2] and m[2].lower() == name:
            depth += -1 if m[1] else not _closed(m[3])
            if not depth:
                return m.end()
    return len(page)


def blocks(page: str | None) -> list[Block]:
    out: list[Block] = []
    if not page:
        return out
    stack = [_Open("", frozenset(), False, None)]
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                top = stack[-1]
                near = next((x.name for x in reversed(stack) if x.name in BLOCK), "none")
                out.append(Block(text, [*_text_features(text, min(linked, len(text))), f"own:{near}", *top.near, *top.features], top.gold))
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        pieces.append(raw)
        if stack[-1].linked:
            linked += len(raw)

    def close(names: tuple[str, ...], barrier: frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return
            if stack[i].name in barrier:
                return

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                flush()
            if any(x.name == name for x in stack):
                close((name,), frozenset())
            continue
        if name in SKIPPED:
            if name == "head":  # its parts are skipped one by one, as pages forget to close it
                continue
            if name in _FOREIGN:
                at = at if _closed(m[3]) else _foreign_end(page, at, name)
                continue
            end = _CLOSING[name].search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                pieces.append(" ")
            continue
        if name in BLOCK:
            flush()
            close(("p",), CONTAINERS)
            if name in IMPLIED:
                close(IMPLIED[name], CONTAINERS)
        if not m[3].rstrip().endswith("/") or name in BLOCK:
            own, gold = _hinted(name, m[3])
            top = stack[-1]
            nearest = tuple(f"near:{x}" for x in own if x.startswith("hint:") or x[3:] in SECTIONS) or top.near
            stack.append(_Open(name, top.features | own if own else top.features, top.linked or name == "a", gold or top.gold, nearest))
    flush()
    return out
