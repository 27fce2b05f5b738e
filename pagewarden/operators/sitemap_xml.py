"""A pull parser for sitemap documents: one pass over the text, no tree.

What it yields follows fixed rules: locations are the text of `loc` elements that stand directly in a `url` of a `urlset`,
or in a `sitemap` of a `sitemapindex`, by their written names (a prefixed name is another name). Entities stay as written.
Text is trimmed, the content of CDATA sections is not; comments, processing instructions and attributes are skipped. A
location that has child elements, is one of several in its entry, is empty, or reads as a number or truth value counts
for nothing. A document that is not well formed (an open or mismatched tag, an open comment or section, elements nested
beyond MAX_DEPTH) has no locations at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of a document, and levels of nested elements.
MAX_BYTES = 50 * 1024 * 1024
MAX_DEPTH = 20
ROOTS = {"sitemapindex": "sitemap", "urlset": "url"}

# Possessive, so a tag that does not end is given up after one pass.
TAG = re.compile(r"""<(/?)([^\s<>/!?"'=]++)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""")
NUMBER = re.compile(r"[+-]?(?:0[xX][0-9A-Fa-f]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")
SPACE = " \t\n\r\x0b\x0c" + chr(0xA0) + chr(0xFEFF)


class Malformed(ValueError):
    pass


def events(text: str) -> Iterator[tuple[str, str]]:
    """('open', name), ('close', name), ('text', ...) and ('cdata', ...) in document order.

    The text around a comment or instruction is one text.
    """
    at, held = 0, []
    while True:
        tag = text.find("<", at)
        held.append(text[at : tag if tag >= 0 else len(text)])
        if tag < 0:
            break
        for mark, end in (("<!--", "-->"), ("<?", "?>"), ("<![CDATA[", "]]>")):
            if text.startswith(mark, tag):
                at = text.find(end, tag + len(mark))
                if at < 0:
                    raise Malformed(f"{mark} is not closed")
                if mark == "<![CDATA[":
                    yield "text", "".join(held)
                    held = []
                    yield "cdata", text[tag + len(mark) : at]
                at += len(end)
                break
        else:
            if text.startswith("<!", tag):
                at = _declaration(text, tag)
                continue
            m = TAG.match(text, tag)
            if not m:
                raise Malformed("a tag is not closed")
            yield "text", "".join(held)
            held, at = [], m.end()
            if m[1]:
                yield "close", m[2]
            else:
                yield "open", m[2]
                if m[3].endswith("/"):
                    yield "close", m[2]
    yield "text", "".join(held)


def _declaration(text: str, at: int) -> int:
    """The place behind <!DOCTYPE ...>, with its bracketed part if it has one."""
    end, bracket = text.find(">", at), text.find("[", at)
    if 0 <= bracket < end:
        inner = text.find("]", bracket)
        end = text.find(">", inner) if inner >= 0 else -1
    if end < 0:
        raise Malformed("a declaration is not closed")
    return end + 1


def _plain(pieces: list[tuple[str, str]]) -> str | None:
    """The location that the pieces of an element's text make, or None."""
    out = "".join(p if kind == "cdata" else p.strip(SPACE) for kind, p in pieces)
    read = out.strip(SPACE)
    return None if not read or read in ("true", "false") or NUMBER.fullmatch(read) else out


def locations(text: str) -> tuple[str | None, list[str]]:
    """('index' or 'urlset' or None, locations in order). An index anywhere at the top goes before a urlset."""
    found: dict[str, list[str]] = {}
    path: list[str] = []
    pieces: list[tuple[str, str]] = []
    locs: list[str | None] = []
    try:
        for kind, value in events(text):
            if kind == "open":
                path.append(value)
                if len(path) > MAX_DEPTH:
                    raise Malformed("nested too deep")
                if len(path) == 1 and value in ROOTS:
                    found.setdefault(value, [])
                elif len(path) == 2:
                    locs = []
                elif len(path) == 3 and value == "loc":
                    pieces = []
                elif len(path) == 4 and path[2] == "loc":
                    pieces.append(("cdata", "0"))  # with child elements it is no text, and this reads as none
                    locs.append(None)
            elif kind == "close":
                if not path or path.pop() != value:
                    raise Malformed("tags do not match")
                if len(path) == 2 and value == "loc":
                    locs.append(_plain(pieces))
                elif len(path) == 1 and ROOTS.get(path[0]) == value and len(locs) == 1 and locs[0] is not None:
                    found[path[0]].append(locs[0])
            elif len(path) == 3 and path[2] == "loc":
                pieces.append((kind, value))
        if path:
            raise Malformed("the document is not closed")
    except Malformed:
        return None, []
    if found.get("sitemapindex"):
        return "index", found["sitemapindex"]
    return ("urlset", found["urlset"]) if found.get("urlset") else (None, [])
