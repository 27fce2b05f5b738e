"""HTML as a stream of tokens, in one pass whatever the text holds.

Tags, attributes, comments and raw text elements follow the HTML standard's tokenizer, without its script escapes. A tag
that does not end takes the rest of the page with it, as there; so nothing is looked at twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

ATTRIBUTE = r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)|(?=>))|(?!\s*+=))"""
# Possessive throughout: a tag matches at once or not at all.
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:" + re.sub(r"\((?!\?)", "(?:", ATTRIBUTE) + r")*+)[\s/]*+>")
ATTRIBUTES = re.compile(ATTRIBUTE)
#: Elements that hold text alone; character references count in the last two.
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
DECODED = frozenset(("title", "textarea"))
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def attributes(text: str) -> dict[str, str]:
    """Names in lower case; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTES.findall(text):
        value = a or b or c
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('open', name, attributes' text), ('close', name, '') and ('text', text, '') in order."""
    at, text = 0, 0  # where to look on, and where text that is not out yet begins
    while True:
        tag = page.find("<", at)
        if tag < 0:
            break
        after = page[tag + 1 : tag + 2]
        if after == "!" or after == "?" or (after == "/" and not page[tag + 2 : tag + 3].isalpha()):
            if tag > text:
                yield "text", unescape(page[text:tag]), ""
            if not page.startswith("<!--", tag):
                end = page.find(">", tag)
            elif page.startswith((">", "->"), tag + 4):
                end = page.find(">", tag + 4)
            else:
                end = page.find("-->", tag + 4)
                end = end + 2 if end >= 0 else -1
            if end < 0:
                return
            at = text = end + 1
            continue
        if not (after.isascii() and after.isalpha()) and after != "/":
            at = tag + 1
            continue
        m = TAG.match(page, tag)
        if tag > text:
            yield "text", unescape(page[text:tag]), ""
        if not m:
            return
        at = text = m.end()
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in RAW:
            end = _ENDS[name].search(page, at)
            inner = page[at : end.start() if end else len(page)]
            if inner:
                yield "text", unescape(inner) if name in DECODED else inner, ""
            if not end:
                return
            at = text = end.start()
    if text < len(page):
        yield "text", unescape(page[text:]), ""
