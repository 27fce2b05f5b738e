"""Main text of pages, by wrapper induction over the pages of a host.

1. Every page is parsed into a tree and reduced to a skeleton: block elements with their classes, runs of equal
   siblings as one node. Each host's references are its most frequent skeletons, at most REFERENCES of them.
2. Every page of the host is aligned, by simple tree matching, with the reference whose labels are most like its own.
   Aligned nodes are slots, and so is the path of labels of every node, matched or not; what a slot holds is summed
   over all pages of the host: pages, smallest and largest hash of the text, characters, characters in links. A slot of
   one text on three pages or more is template; slots whose characters are mostly links are menus. Siblings in a run
   are slots of their own besides, by their place from either end: those of one text on three pages, and on half of the
   pages that have the run, are template on pages without an article (or main) element.
3. Extraction walks the page with its host's slots: template, menus and what the markup itself names (nav, footer,
   aside, form, classes such as ad or comments) go; varying slots are content. Inside the main part a name counts if it
   is a whole class or role of a container: ids are anchors there, and a header holds the title. Where a page has an article (or main)
   element, content is what stays inside it; else the varying slots of the body.

Only sums travel between tasks. The wrappers (one row for each host) are broadcast while they hold at most
`broadcast_chars`; beyond that pages and wrappers are joined by a shuffle. Nothing recurses, and no step grows with the
square of a page's depth or blocks but the table of best matches, whose memory is bounded.

Defined cases: null or empty html gives an empty text; a null url has a host of its own, without a name; a host of one
or two pages has no constant slots, so markup alone decides; if all content of a page is constant on its host (copies
of one article), it stays; repeated rows repeat their result; unclosed tags end with their parents.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import staged, table

#: Characters of references and slots of all hosts that are broadcast; beyond it they are joined by a shuffle.
BROADCAST_CHARS = 16_000_000
REFERENCES = 4
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: What can start behind the last ">" of a page.
TAIL = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
# Elements without article text, elements that start a block, and names that pages give to other parts.
DROP = frozenset("head script style noscript template iframe object svg annotation annotation-xml nav header footer aside form button select textarea input label fieldset dialog menu audio video canvas title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
OTHER = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets related recommended "
    "share sharing social comment comments reply replies respond disqus discussion notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "search footer header masthead toolbar pagination pager skip navigation contentinfo complementary dialog form copyright legal disclaimer".split()
)
CONTAINERS = frozenset("div section ul ol dl table".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}


class Node:
    __slots__ = ("tag", "attrs", "kids", "slot", "nth", "left", "start", "end")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.slot, self.nth, self.left = tag, attrs, [], -1, 0, 0


class Stack:
    """Open elements. Counts by tag and the places of block elements keep a search from walking over all that is open."""

    def __init__(self, root: Node):
        self.nodes, self.open, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        tag = node.tag
        if tag in BLOCK or tag in CLOSED_BY:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1

    def cut(self, k: int) -> None:
        for n in self.nodes[k:]:
            self.open[n.tag] -= 1
        del self.nodes[k:]
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def close(self, tag: str) -> None:
        if self.open.get(tag):
            k = len(self.nodes) - 1
            while self.nodes[k].tag != tag:
                k -= 1
            self.cut(k)

    def make_room(self, tag: str) -> None:
        """What an opening tag ends: a block ends an open paragraph, an item or cell the one before it."""
        if tag in BLOCK and tag != "html" and self.blocks and self.nodes[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])
        ended = CLOSED_BY.get(tag)
        if ended and any(self.open.get(t) for t in ended):
            for k in reversed(self.blocks):
                if self.nodes[k].tag in ended:
                    return self.cut(k)
                if self.nodes[k].tag in FENCE[tag]:
                    return None
        return None


def token(page: str, at: int, stop: int) -> re.Match | None:
    """The next token. Tags are looked for before stop, the end of the last ">", alone: behind it none can match."""
    m = TOKEN.search(page, at, stop) if at < stop else None
    if m is None:
        return TAIL.search(page, at)
    return TAIL.match(page, m.start()) if m.end() == stop and page.startswith(("<!", "<?"), m.start()) else m


def parse(page: str) -> Node:
    """A tree of whatever is there, in one pass; text kids are still encoded."""
    root = Node("#")
    stack, at, low = Stack(root), 0, None
    open_ = stack.nodes
    stop = page.rfind(">") + 1
    while m := token(page, at, stop):
        start, end = m.span()
        if start > at:
            open_[-1].kids.append(page[at:start])
        at = end
        tag = m[2] or m[5] if m.re is TOKEN else None
        if tag is None:
            if m[0].startswith("<![CDATA["):
                open_[-1].kids.append(entities.unescape("&lt;").join(m[0][9:-3].split("<")).replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            stack.close(tag)
            continue
        if tag in BLOCK or tag in CLOSED_BY:
            stack.make_room(tag)
        node = Node(tag, m[3] or m[6] or "")
        open_[-1].kids.append(node)
        if tag in RAW:
            if low is None:
                low = page.lower()
            end = low.find(f"</{tag}", at)
            end = len(page) if end < 0 else end
            node.kids.append(page[at:end])
            at = end
            stack.push(node)
        elif tag not in VOID and not node.attrs.endswith("/"):
            stack.push(node)
    if at < len(page):
        open_[-1].kids.append(page[at:])
    return root


def named_other(n: Node, in_main: bool = False) -> bool:
    """Does the markup itself say that this is not article text?"""
    if n.tag in DROP and not (in_main and n.tag == "header"):
        return True
    if not n.attrs or n.tag in ("html", "body", "article", "main"):
        return False
    if in_main:
        names = (w.lower() for m in NAMES.finditer(n.attrs) if not m[0].lower().startswith("id") for w in (m[1] or m[2] or m[3] or "").split())
        return (n.tag in CONTAINERS and any(w in OTHER and w != "header" for w in names)) or bool(HIDDEN.search(n.attrs))
    for m in NAMES.finditer(n.attrs):
        if any(w.lower() in OTHER for w in PARTS.findall(m[1] or m[2] or m[3] or "")):
            return True
    return bool(HIDDEN.search(n.attrs))


def label(n: Node) -> str:
    m = CLASS.search(n.attrs) if n.attrs else None
    name = re.sub(r"[^a-z]+", "-", (m[1] or m[2] or m[3] or "").lower()).strip("-") if m else ""
    return f"{n.tag}.{name}" if name else n.tag


def skeleton(root: Node) -> tuple[str, list[list[Node]]]:
    """Labels of block elements with their kids in brackets, and the tree's nodes at each skeleton node, in preorder."""
    at: list[list[Node]] = []
    out: list[str] = []
    todo: list[list[Node] | None] = [[root]]
    while todo:
        nodes = todo.pop()
        if nodes is None:
            out.append(")")
            continue
        for i, n in enumerate(nodes):
            n.slot, n.nth, n.left = len(at), i + 1, i - len(nodes)
        at.append(nodes)
        runs: list[tuple[str, list[Node]]] = []
        if nodes[0].tag not in LEAF and nodes[0].tag not in RAW:
            for n in nodes:
                inner = [k for k in reversed(n.kids) if isinstance(k, Node)]
                while inner:
                    k = inner.pop()
                    if k.tag in BLOCK or k.tag in DROP:
                        x = label(k)
                        if runs and runs[-1][0] == x:
                            runs[-1][1].append(k)
                        else:
                            runs.append((x, [k]))
                    else:
                        inner += [y for y in reversed(k.kids) if isinstance(y, Node)]
        out += [" ", label(nodes[0])]
        if runs:
            out.append("(")
            todo.append(None)
            todo += [r for _, r in reversed(runs)]
    return "".join(out).replace("( ", "(").strip(), at


class Shape:
    """A written skeleton in preorder: labels, kids, and for every subtree a number that equal subtrees share."""

    def __init__(self, text: str, numbers: dict):
        self.labels: list[str] = []
        self.kids: list[list[int]] = []
        above: list[int] = []
        for m in re.finditer(r"[^\s()]+|[()]", text):
            if m[0] == "(":
                above.append(len(self.labels) - 1)
            elif m[0] == ")":
                above.pop()
            else:
                if above:
                    self.kids[above[-1]].append(len(self.labels))
                self.labels.append(m[0])
                self.kids.append([])
        self.size = [1] * len(self.labels)
        self.tree = [0] * len(self.labels)
        for i in range(len(self.labels) - 1, -1, -1):
            self.size[i] += sum(self.size[k] for k in self.kids[i])
            key = (self.labels[i], tuple(self.tree[k] for k in self.kids[i]))
            self.tree[i] = numbers.setdefault(key, len(numbers))


#: Cells of a table of best matches that is held at once.
CELLS = 1 << 21


class Matching:
    """Simple tree matching of two skeletons: the largest number of matched pairs that keeps labels, order and ancestry.

    Equal subtrees match whole. Of two nodes' kids, equal ones at either end are matched first, which costs no match;
    what is between is one table of best matches by rows, of which no more than CELLS are held: larger ones are halved
    and solved twice over. Nothing recurses by depth. Pairs of different subtrees are taken one after another, however
    many there are.
    """

    def __init__(self, a: Shape, b: Shape):
        self.a, self.b = a, b
        self.known: dict[int, dict[int, int]] = {}  # matched pairs of two different subtrees, by their numbers

    def ends(self, x: int, y: int) -> tuple[list[int], list[int], int]:
        """Kids of x and y without the equal ones at either end, and how many there are at the start."""
        p, q = self.a.kids[x], self.b.kids[y]
        s, m = 0, min(len(p), len(q))
        while s < m and self.a.tree[p[s]] == self.b.tree[q[s]]:
            s += 1
        e = 0
        while e < m - s and self.a.tree[p[-1 - e]] == self.b.tree[q[-1 - e]]:
            e += 1
        return p[s : len(p) - e], q[s : len(q) - e], s

    def unlike(self, p: list[int], q: list[int]) -> Iterator[tuple[int, int]]:
        """A pair of nodes for each pair of different subtrees of one label that is unknown when its turn comes."""
        one, other = {self.a.tree[i]: i for i in p}, {self.b.tree[j]: j for j in q}
        by: dict[str, list[int]] = {}
        for j in other.values():
            by.setdefault(self.b.labels[j], []).append(j)
        return ((i, j) for i in one.values() for j in by.get(self.a.labels[i], ()) if self.a.tree[i] != self.b.tree[j] and self.b.tree[j] not in self.known.get(self.a.tree[i], ()))

    def weight(self, i: int, j: int) -> int:
        t, u = self.a.tree[i], self.b.tree[j]
        return self.a.size[i] if t == u else self.known.get(t, {}).get(u, 1) if self.a.labels[i] == self.b.labels[j] else 0

    def rows(self, p: list[int], q: list[int]) -> Iterator[np.ndarray]:
        """For each of p, how many pairs it matches with each of q."""
        trees, first, at = np.unique([self.b.tree[j] for j in q], return_index=True, return_inverse=True)
        by: dict[str, list[int]] = {}
        for k, f in enumerate(first.tolist()):
            by.setdefault(self.b.labels[q[f]], []).append(k)
        made: dict[int, np.ndarray] = {}
        for i in p:
            t = self.a.tree[i]
            if t not in made:
                if len(made) * len(q) > CELLS:
                    made.clear()
                w = np.zeros(len(trees), np.int64)
                some = by.get(self.a.labels[i], [])
                w[some] = 1
                known = self.known.get(t)
                if known:
                    w[some] = [known.get(u, 1) for u in trees[some].tolist()]
                w[trees == t] = self.a.size[i]
                made[t] = w[at]
            yield made[t]

    def last_row(self, p: list[int], q: list[int]) -> np.ndarray:
        best = np.zeros(len(q) + 1, np.int64)
        for w in self.rows(p, q):
            best[1:] = np.maximum(best[1:], best[:-1] + w)
            np.maximum.accumulate(best, out=best)
        return best

    def weigh(self, x: int, y: int) -> None:
        """Fills `known` for the trees of x and y and all that this needs."""

        def opened(i: int, j: int) -> tuple[int, int, list[int], list[int], Iterator[tuple[int, int]]]:
            p, q, _ = self.ends(i, j)
            return i, j, p, q, self.unlike(p, q)

        todo = [opened(x, y)]
        while todo:
            i, j, p, q, more = todo[-1]
            if pair := next(more, None):
                todo.append(opened(*pair))
                continue
            todo.pop()
            inner = 0 if not p or not q else self.weight(p[0], q[0]) if len(p) == len(q) == 1 else int(self.last_row(p, q)[-1])
            self.known.setdefault(self.a.tree[i], {})[self.b.tree[j]] = self.a.size[i] - sum(self.a.size[k] for k in p) + inner

    def aligned(self, p: list[int], q: list[int]) -> Iterator[tuple[int, int]]:
        """Matched pairs of two lists of siblings."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if not p or not q:
                continue
            if len(p) > 1 and len(p) * len(q) > CELLS:
                half = len(p) // 2
                up, down = self.last_row(p[:half], q), self.last_row(p[half:][::-1], q[::-1])[::-1]
                cut = int((up + down).argmax())
                todo += [(p[half:], q[cut:]), (p[:half], q[:cut])]
                continue
            best = [np.zeros(len(q) + 1, np.int64)]
            for w in self.rows(p, q):
                row = best[-1].copy()
                row[1:] = np.maximum(row[1:], best[-1][:-1] + w)
                best.append(np.maximum.accumulate(row))
            i, j = len(p), len(q)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    yield p[i], q[j]

    def pairs(self) -> Iterator[tuple[int, int]]:
        """All matched pairs of nodes, by their places in preorder."""
        if not self.a.labels or not self.b.labels or self.a.labels[0] != self.b.labels[0]:
            return
        if self.a.tree[0] != self.b.tree[0]:
            self.weigh(0, 0)
        todo = [(0, 0)]
        while todo:
            i, j = todo.pop()
            if self.a.tree[i] == self.b.tree[j]:
                yield from ((i + k, j + k) for k in range(self.a.size[i]))
                continue
            yield i, j
            p, q, s = self.ends(i, j)
            todo += zip(self.a.kids[i][:s], self.b.kids[j][:s], strict=True)
            e = len(self.a.kids[i]) - s - len(p)
            todo += zip(self.a.kids[i][len(self.a.kids[i]) - e :], self.b.kids[j][len(self.b.kids[j]) - e :], strict=True)
            todo += self.aligned(p, q)


@lru_cache(1024)
def aligned(page: str, reference: str) -> tuple[int, ...]:
    """For each skeleton node of the page in preorder, the reference node that it matches, or -1."""
    numbers: dict = {}
    a, b = Shape(page, numbers), Shape(reference, numbers)
    out = [-1] * len(a.labels)
    for i, j in Matching(a, b).pairs():
        out[i] = j
    return tuple(out)


class Measured:
    """The text of a page below its root, measured once: of any node the characters, those in links, and a hash."""

    def __init__(self, root: Node):
        pieces: list[str] = []
        chars = linked = size = 0
        todo: list[tuple] = [(root, False, False)]
        while todo:
            n, link, ends = todo.pop()
            if isinstance(n, str):
                raw = n.encode("utf-8", "replace")
                pieces.append(raw)
                chars, linked, size = chars + len(n), linked + len(n) * link, size + len(raw)
            elif ends:
                n.end = (size, chars, linked)
            else:
                n.start = n.end = (size, chars, linked)
                if n.tag not in ("script", "style"):
                    todo.append((n, link, True))
                    todo += [(k, link or n.tag == "a", False) for k in reversed(n.kids)]
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        self.p = tv.prefix(tv.byte_table(0)[raw], 0)

    def hashes(self, nodes: list[Node]) -> list[int]:
        start, end = np.array([n.start[0] for n in nodes], np.int64), np.array([n.end[0] for n in nodes], np.int64)
        return (tv.mix(tv.window_hash(self.p, start, end, 0) + (end - start).astype(np.uint64)) >> np.uint64(1)).tolist()


@lru_cache(1024)
def labels(skeleton: str) -> Counter:
    return Counter(re.findall(r"[^\s()]+", skeleton))


@lru_cache(1024)
def paths(page: str) -> tuple[int, ...]:
    """Of each skeleton node in preorder, a negative number for its path of labels and places."""
    shape = Shape(page, {})
    key = [b""] * len(shape.labels)
    for i, word in enumerate(shape.labels):
        if i == 0:
            key[i] = blake2b(word.encode("utf-8", "replace"), digest_size=16).digest()
        seen: Counter = Counter()
        for k in shape.kids[i]:
            word = shape.labels[k]
            key[k] = blake2b(key[i] + f" {word} {seen[word]}".encode("utf-8", "replace"), digest_size=16).digest()
            seen[word] += 1
    return tuple(-1 - (int.from_bytes(x[:8], "big") >> 1) for x in key)


@lru_cache(1024)
def places(page: str, references: str) -> tuple[tuple[int, ...], ...]:
    """The slots of each skeleton node of the page in preorder: the node's path and, if it is matched, the node of the nearest reference."""
    every, own = references.split("\n"), labels(page)

    def near(k: int) -> tuple:
        other = labels(every[k])
        return every[k] == page, sum((own & other).values()) / ((own.total() + other.total()) or 1), -k

    k = max(range(len(every)), key=near)
    return tuple((path, ref + (k << 32)) if ref >= 0 else (path,) for ref, path in zip(aligned(page, every[k]), paths(page), strict=True))


def slots(page: str, references: str) -> list[tuple[int, int, int, int, int]]:
    """(slot, 0 for the run or a sibling's place from the start or, below 0, the end, hash of the text, characters, characters in links)."""
    root = parse(page)
    s, at = skeleton(root)
    m = Measured(root)
    out, k, hashes = [], 0, m.hashes([n for nodes in at for n in nodes])
    for nodes, here in zip(at, places(s, references), strict=True):
        own, k = hashes[k : k + len(nodes)], k + len(nodes)
        if nodes[0].tag not in ("#", "html", "body"):
            each = [(h, n.end[1] - n.start[1], n.end[2] - n.start[2]) for h, n in zip(own, nodes, strict=True)]
            whole = zlib.crc32(" ".join(str(h) for h, _, _ in each).encode()) if len(each) > 1 else each[0][0]
            held = [(0, whole, sum(c for _, c, _ in each), sum(k for _, _, k in each))]
            for n, x in zip(nodes, each, strict=True):
                held += [(n.nth, *x), (n.left, *x)]
            out += [(slot, *x) for slot in here for x in held]
    return out


def extract(page: str | None, references: str, marks: dict[tuple[int, int], str]) -> str:
    """marks: T (template) or M (mostly links) of slots and their siblings; all others vary."""
    if not page:
        return ""
    root = parse(page)
    s, at = skeleton(root)
    place = places(s, references)
    mains = {id(n) for nodes in at for n in nodes if n.tag in ("article", "main") or "main" in re.findall(r"role\s*=\s*[\"']?(\w+)", n.attrs)}

    def kind(n: Node) -> str:
        """template (constant), menu (links) or slot (varying) by what the host's pages have in this place."""
        if n.slot < 0:
            return "slot"
        runs = [marks.get((slot, 0)) for slot in place[n.slot]]
        if "T" in runs or (not mains and any(marks.get((slot, x)) == "T" for slot in place[n.slot] for x in (n.nth, n.left))):
            return "template"
        return "menu" if "M" in runs and n.tag in ("ul", "ol", "div", "section", "dl", "table") else "slot"

    def blocks(use_template: bool, only_main: bool) -> list[str]:
        out, line = [], []

        def flush() -> None:
            t = SPACE.sub(" ", entities.unescape("".join(line))).strip()
            if t:
                out.append(t)
            line.clear()

        # (node, 0 outside of what is read, 1 inside, 2 inside the main part; closes a block)
        todo: list[tuple] = [(root, int(not only_main), False)]
        while todo:
            n, inside, ends = todo.pop()
            if ends:
                flush()
                continue
            if isinstance(n, str):
                if inside:
                    line.append(n)
                continue
            if n.tag == "br":
                line.append(" ")
                continue
            if named_other(n, inside == 2) or (use_template and n.tag not in ("#", "html", "body", "article", "main") and kind(n) != "slot"):
                if n.tag in BLOCK:
                    flush()
                else:
                    line.append(" " if n.tag in ("script", "style", "iframe", "svg") else "")
                continue
            inside = 2 if id(n) in mains else inside
            if n.tag in BLOCK:
                flush()
                todo.append((n, inside, True))
            todo += [(k, inside, False) for k in reversed(n.kids)]
        flush()
        return out

    for only_main in (True, False) if mains else (False,):
        for use_template in (True, False):
            if got := blocks(use_template, only_main):
                return "\n".join(got)
    return ""


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.set_column(2, "skeleton", pa.array([skeleton(parse(x.as_py()))[0] if x.is_valid and len(x.as_buffer()) else None for x in b.column(2)], pa.string()))


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        host, rows = [], []

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5))], ["host", "slot", "sib", "hash", "chars", "linked"])

        for h, page, reference in zip(*b.columns, strict=True):
            got = slots(page.as_py() or "", reference.as_py() or "#")
            host += [h.as_py()] * len(got)
            rows += got
            if len(rows) > 50_000:
                yield sent()
                host, rows = [], []
        yield sent()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    @lru_cache(1024)
    def read(packed: str) -> dict:
        return {(int(a), int(i)): m for a, i, m in (x.split(":") for x in packed.split(" ") if x)}

    for b in batches:
        text = [extract(page.as_py(), reference.as_py() or "#", read(packed.as_py() or "")) for page, reference, packed in zip(*(b.column(i) for i in (2, 3, 4)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def main_text(pages: DataFrame, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(page_id, url, html) to page_id, url, text, n_chars."""
    p = with_host(pages)
    made = p.select("page_id", "host", "html").mapInArrow(_skeletons, "page_id long, host string, skeleton string")
    counts = made.filter("skeleton is not null").groupBy("host", "skeleton").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.col("n").desc(), F.col("first").asc_nulls_last(), "skeleton"))
    most = counts.withColumn("place", place).filter(F.col("place") <= REFERENCES)
    refs = most.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "skeleton"))), lambda x: x["skeleton"]), "\n").alias("reference"))
    refs = staged(refs, "references")
    sent = lambda df, *c: F.broadcast(df) if (df.agg(F.sum(sum(F.length(F.coalesce(x, F.lit(""))) for x in ("host", *c)) + 50)).first()[0] or 0) <= broadcast_chars else df
    rows = p.select("host", "html").join(sent(refs, "reference"), "host").select("host", "html", "reference").mapInArrow(_slot_rows, "host string, slot long, sib long, hash long, chars long, linked long")
    sums = rows.groupBy("host", "slot", "sib").agg(F.count(F.lit(1)).alias("n"), (F.min("hash") == F.max("hash")).alias("same"), F.sum("chars").alias("c"), F.sum("linked").alias("k"))
    mark = F.when(F.col("same"), "T").when((F.col("sib") == 0) & (F.col("k") > 0.6 * F.col("c")), "M")
    marked = F.collect_list(F.when((F.col("n") >= 3) & (F.col("c") > 0) & mark.isNotNull(), F.struct("sib", "n", mark.alias("mark"))))
    # The run itself is on most pages of a slot.
    kept = sums.groupBy("host", "slot").agg(F.max("n").alias("most"), marked.alias("m")).select("host", "slot", "most", F.explode("m").alias("x")).filter("x.sib = 0 or 2 * x.n >= most")
    packed = kept.groupBy("host").agg(F.array_join(F.collect_list(F.concat_ws(":", "slot", "x.sib", "x.mark")), " ").alias("slots"))
    wrappers = staged(refs.join(packed, "host", "left"), "wrappers")
    return p.join(sent(wrappers, "reference", "slots"), "host", "left").select("page_id", "url", "html", "reference", "slots").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
