"""HTML as a sequence of leaf blocks: text, path of open elements, share of link text.

A small tolerant reader: comments, declarations and elements whose content is no text are skipped, an opening block
closes an open paragraph, an end tag closes up to its element and is ignored without one.  Inline elements and ``br``
do not end a block.  A skipped element without its end tag ends with its parent; only script, style, title and
textarea then go to the end of the page.  A self-closed svg is empty, in XHTML any self-closed element.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>""", re.S)
_NAME = re.compile(r"""(?:^|\s)(class|id|role|data-keep)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_UNQUOTED_END = re.compile(r"""=\s*[^\s"']+/\Z""")

#: Elements whose content is no text of the page.
RAW = frozenset(["script", "style", "title", "textarea", "template", "noscript", "iframe", "svg", "object",
                 "audio", "video", "canvas", "select", "datalist"])
#: Those of them in which tags are plain characters.
PLAIN = frozenset(["script", "style", "title", "textarea"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
                  "track", "wbr"])
BLOCK = frozenset(["address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details",
                   "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1",
                   "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "label", "legend", "li",
                   "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody",
                   "td", "tfoot", "th", "thead", "tr", "ul"])
#: An element that opens ends an open one of these, inside the same list or table.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",)}
_FENCES = frozenset(["ul", "ol", "menu", "dl", "table"])


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[str, ...]
    links: float
    keep: bool


def _element(name: str, attributes: str) -> tuple[str, str, bool]:
    """(element name, name with the words of class, id and role, marked as training target)."""
    if not attributes:
        return name, name, False
    words, keep = [], False
    for m in _NAME.finditer(attributes):
        if m[1].lower() == "data-keep":
            keep = True
        else:
            words += _WORD.findall((m[2] or m[3] or m[4] or "").lower())
    return name, " ".join([name, *words]), keep


def _end_tag(name: str) -> re.Pattern:
    return re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I)


def _self_closed(attributes: str) -> bool:
    return attributes.endswith("/") and not _UNQUOTED_END.search(attributes)


def _skip(page: str, at: int, name: str, stack: list[tuple[str, str, bool]], xml: bool, last: dict[str, int]) -> int:
    """Where the element ``name`` that opens before ``at`` ends: behind its end tag, or with its parent."""
    if name in PLAIN:
        end = _end_tag(name).search(page, at)
        return end.end() if end else len(page)
    if name not in last:
        last[name] = max((m.start() for m in _end_tag(name).finditer(page)), default=-1)
    for implied in (False, True):
        if not implied and last[name] < at:
            continue
        place, inner = at, [(name, name, False)]
        outer = {e[0] for e in stack}
        while (m := _TOKEN.search(page, place)) is not None:
            place = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                k = next((k for k in range(len(inner) - 1, -1, -1) if inner[k][0] == tag), -1)
                if k == 0:
                    return place
                if k > 0:
                    del inner[k:]
                elif tag in outer:  # the parent ends
                    if implied:
                        return m.start()
                    break
                continue
            if implied and tag in BLOCK:
                open_ = [*stack, *inner]
                _make_room(open_, tag)
                if len(open_) <= len(stack):
                    return m.start()
                inner = open_[len(stack):]
            if tag in PLAIN and not (xml and _self_closed(m[3])):
                end = _end_tag(tag).search(page, place)
                place = end.end() if end else len(page)
            elif tag not in VOID and not m[3].endswith("/"):
                inner.append((tag, tag, False))
    return len(page)


def blocks(page: str, xml: bool = False) -> list[Block]:
    """Leaf blocks of a page in order; white space is one blank, empty blocks are left out."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool]] = []
    pieces: list[str] = []
    linked = 0
    last: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, tuple(e[1] for e in stack if e[0] in BLOCK or e[0] == "a"),
                                 min(1.0, linked / len(text)), any(e[2] for e in stack)))
            pieces.clear()
            linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if any(e[0] == "a" for e in stack):
                linked += len(text.strip())

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at: m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in RAW:
            if name not in ("title",):
                pieces.append(" ")
            if not ((xml or name == "svg") and _self_closed(m[3])):
                at = _skip(page, at, name, stack, xml, last)
            continue
        if name == "br" or name == "img":
            pieces.append(" ")
        if name in BLOCK:
            flush()
            _make_room(stack, name)
        if name not in VOID and not m[3].endswith("/"):
            stack.append(_element(name, m[3]))
    flush()
    return out


def _make_room(stack: list[tuple[str, str, bool]], name: str) -> None:
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == "p":
            del stack[k:]
            break
        if stack[k][0] in BLOCK:
            break
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] in CLOSES.get(name, ()):
            del stack[k:]
            return
        if stack[k][0] in _FENCES:
            return
