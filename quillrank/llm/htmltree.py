"""A small, forgiving HTML reader: a scan over tags that yields text blocks with the path of elements they stand in."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "noembed", "noframes", "xmp"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video audio button".split())
#: What an opening tag closes when it is still open.
CLOSES = {t: {"p"} for t in BLOCK - {"body", "html", "head", "option", "optgroup", "button", "video", "audio", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}}
CLOSES |= {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "body": {"head"}}
#: Elements that end the search for what an opening tag closes.
SCOPE = set("table ul ol dl article section div aside main nav header footer form blockquote body html td th".split())


class Node:
    __slots__ = ("attrs", "name", "parent")

    def __init__(self, name: str, attrs: str, parent: Node | None) -> None:
        self.name, self.attrs, self.parent = name, attrs, parent

    def get(self, key: str) -> str:
        for m in ATTR.finditer(self.attrs):
            if m[1].lower() == key:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return ""


def scan(page: str) -> Iterator[tuple[str, Node | None, str]]:
    """("open", node, ""), ("close", node, ""), ("void", node, "") and ("text", node it stands in, decoded text), in page order."""
    stack: list[Node] = []
    at, n = 0, len(page)
    low = None
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            break
        if m.start() > at:
            yield "text", stack[-1] if stack else None, html.unescape(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield "text", stack[-1] if stack else None, m[0][9:-3]
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    for node in reversed(stack[k:]):
                        yield "close", node, ""
                    del stack[k:]
                    break
                if stack[k].name in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "article", "main", "div", "section"):
                    break
            else:
                if name in ("p", "br"):
                    yield "void", Node(name, "", stack[-1] if stack else None), ""
            continue
        closes = CLOSES.get(name)
        if closes:
            for k in range(len(stack) - 1, -1, -1):
                inner = stack[k].name
                if inner in closes:
                    for node in reversed(stack[k:]):
                        yield "close", node, ""
                    del stack[k:]
                    break
                if inner in SCOPE:
                    break
        node = Node(name, m[3], stack[-1] if stack else None)
        if name in VOID:
            yield "void", node, ""
        elif name in RAW and not m[3].endswith("/"):
            low = low or page.lower()
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])").search(low, at)
            body = page[at : end.start() if end else n]
            yield "open", node, ""
            if name in ("title", "textarea"):
                yield "text", node, html.unescape(body)
            yield "close", node, ""
            at = n if end is None else (page.find(">", end.start()) + 1 or n)
        elif m[3].endswith("/") and name not in BLOCK and name not in ("a", "b", "i", "span", "em", "strong"):
            yield "void", node, ""
        else:
            stack.append(node)
            yield "open", node, ""
    if at < n:
        yield "text", stack[-1] if stack else None, html.unescape(page[at:])
    for node in reversed(stack):
        yield "close", node, ""
