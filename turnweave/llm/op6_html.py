"""Main text of HTML pages by wrapper induction.

1. Every page of a host is parsed into an outline: its block nodes, in which neighbouring paragraphs, list items and the like of
   one signature (tag and class names) are one repeated node. Outlines of pages whose main parts differ are aligned one after
   another with the host's template by simple tree matching; a large host is dealt to salts, whose templates are merged the same
   way. Aligned nodes whose text is the same on all pages that have them are template, the others are slots.
2. Every page is aligned with its host's template. What varies decides where the article is: the walk starts at the top and goes
   to the child that holds most of the varying text, until a node has varying text, headings or several such children of its
   own. <article> and <main> count where they hold at least half of what varies; sibling <article>s stay together.
3. Inside that region all text stays, constant or not, but for hidden nodes, elements that are menus, footers, asides or
   forms by their tag or role, nodes of which a whole class is a name of a menu, sidebar, notice, advert or comment part (PARTS), and
   nodes that speak against themselves twice: a whole class or id that names such or another part (sharing, widgets, promotion) on
   a node that is constant, mostly links or without paragraphs and headings; or two of these: constant, mostly links, and, where
   there are no paragraphs, such a name as a piece of a class. Names never empty a page. Where a page has no container around its
   article, constant nodes at both ends of the body go, and pieces of class names count too.

A host has a template once DISTINCT pages with different main parts were aligned; copies of one page do not make its text
constant. This least support is a parameter of what counts as constant and the same at every size; on hosts with fewer different
pages all text varies, and tags and names alone decide. Templates of a host are merged in a tree, GROUP pages and then FAN templates a
task, whose depth follows the largest host. They are broadcast up to BROADCAST_BYTES, which is checked, and else meet the pages in a
join salted within hosts.

Matching is exact at any size: equal subtrees at both ends of child lists are paired at once, sizes of matches are kept by shape,
rows of the table are vectors, and long lists are halved (Hirschberg), so memory is linear in a list's length. There are no caps
on children, depth or template size; in the final template what lies below a slot without constant nodes is left out. Time
grows with the product of two nodes' different children (4 pages with 2,000 different children each take some seconds).

Text: character references decoded, white space inside a block made one space, blocks joined by one space in page order.
Defined results: a null or empty html, or one without an article's text, gives an empty string; a null url is a host of its own;
repeated rows each give a row, and count once for the template; of equally heavy children the first is taken; an empty table
gives none; very long and deep pages are read whole; extra columns, also of clashing names, are ignored. Unclosed, crossed and
cut-off tags are mended as browsers do, roughly. Hidden is what has the hidden attribute or display:none, and a dialog that is not
open; aria-hidden text is seen by readers and stays. Text in <math> and <svg> stays, but for its annotations, titles and styles.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import materialize, quoted, slices

DISTINCT = 4
BROADCAST_BYTES = 16 << 20
SALTS = 32
#: Pages, and later templates, that are merged in one task.
GROUP, FAN = 128, 16
#: Cells of a matching table that are kept at once; longer lists are halved.
CELLS = 1 << 20
#: Share of the varying text from which a second child belongs to the region, and that an <article> must hold.
SIDE_SHARE, ARTICLE_SHARE = 0.1, 0.5

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp select annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "option", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
REPEATED = frozenset("p li dt dd tr td th option br hr h2 h3 h4 h5 h6 blockquote figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
FLOW = REPEATED | HEADINGS | frozenset("pre table ul ol dl address details figcaption caption tbody thead center".split())
SCOPES = frozenset("ul ol dl table article main section div body nav aside footer header form blockquote".split())
# What is not the article.
DULL_TAGS = frozenset("head nav header footer aside form button menu object embed canvas audio video map".split()) | RAW
DULL_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer "
    "sidebar sidenav aside rail widget widgets cookie cookies consent gdpr notice notices alert toast popup modal overlay comment comments commentlist disqus reply replies respond "
    "share sharing social newsletter subscribe subscription signup login search related recommended teaser pagination pager tags toolbar skip copyright legal disclaimer".split()
)
# Of these, menus, headers and footers of the site, sidebars, notices, adverts and reader comments.
PARTS = frozenset("ad ads advert adverts advertisement adsense adslot sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs masthead sidebar sidenav cookie cookies notice comments commentlist disqus".split())
# Whole classes or ids of these and of other parts, which need a second sign.
SUSPECTS = PARTS | frozenset("advertising banner sponsor promo promotion widget widgets consent gdpr toast popup modal overlay replies respond share sharing social newsletter subscribe subscription teaser pagination pager toolbar skip".split())
# A whole class that does not hold the article, whatever it weighs.
ASIDE = PARTS | {"teaser"}
OWN_NAMES = frozenset("article post entry story content".split())
DULL_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>?|</[^>]*>?|<[a-zA-Z][^>]*\Z", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAME = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]+|\d+")
ENDS = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}


class Node:
    __slots__ = ("classes", "hidden", "kids", "names", "role", "tag", "tokens")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.kids = tag, []
        self.names, self.tokens, self.classes, self.role, self.hidden = (), (), (), "", tag == "dialog"
        if attributes and (tag == "dialog" or "=" in attributes or "hidden" in attributes):
            got = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTR.findall(attributes)}
            if "class" in got or "id" in got:
                named = f"{got.get('class', '')} {got.get('id', '')}"
                self.tokens, self.classes = tuple(named.lower().split()), tuple(got.get("class", "").lower().split())
                self.names = tuple(dict.fromkeys(x.lower() for x in NAME.findall(named) if not x.isdigit()))
            self.role = got.get("role", "").lower()
            self.hidden = "hidden" in got or "display:none" in got.get("style", "").replace(" ", "").lower() or (tag == "dialog" and "open" not in got)

    @property
    def apart(self) -> bool:
        """An element that is no article text by its tag or role."""
        return self.tag in DULL_TAGS or self.role in DULL_ROLES

    @property
    def plain(self) -> bool:
        """Its names do not count."""
        return self.tag in ("body", "html") or self.tag in HEADINGS

    @property
    def named(self) -> bool:
        """A whole class says that this holds no article."""
        return not self.plain and not ASIDE.isdisjoint(self.classes)

    @property
    def part(self) -> bool:
        """A whole class says that this is a menu, sidebar, notice, advert or comment part."""
        return not self.plain and not PARTS.isdisjoint(self.classes)

    @property
    def suspect(self) -> bool:
        """A whole class or id names a part of the page, be it one of the article."""
        return not self.plain and not SUSPECTS.isdisjoint(self.tokens)

    @property
    def hinted(self) -> bool:
        """A part of a class or id says so."""
        found = DULL_NAMES.intersection(self.names)
        if found <= {"header"} and not OWN_NAMES.isdisjoint(self.names):  # an article's own heading
            return False
        return bool(found) and not self.plain


def parse(html: str) -> Node:
    """The tree of a page: nodes, and strings for text; raw elements are left out with all they hold."""
    root = Node("html")
    stack = [root]
    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            stack[-1].kids.append(html[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            _close(stack, tag)
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            close = ENDS[tag].search(html, at)
            at = close.end() if close else end
            continue
        if tag == "html" or (tag == "body" and any(n.tag == "body" for n in stack)):
            continue
        if tag == "body" or (tag != "head" and stack[-1].tag == "head" and tag in BLOCK):
            while stack[-1].tag == "head":
                stack.pop()
        if tag in CLOSES_P:
            _end_of(stack, ("p",), SCOPES)
        if tag in SIBLINGS:
            _end_of(stack, SIBLINGS[tag], SCOPES)
        if tag in ("article", "main"):  # a menu or form that was never closed does not hold the article
            for i, n in enumerate(stack):
                if n.tag in ("nav", "form", "header", "ul", "li", "a", "p"):
                    del stack[i:]
                    break
        node = Node(tag, attributes)
        stack[-1].kids.append(node)
        if tag not in VOID:
            stack.append(node)
    return root


def _close(stack: list[Node], tag: str) -> None:
    if tag in ("body", "html"):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if tag not in BLOCK and stack[i].tag in SCOPES:
            return  # an inline end tag does not close blocks


def _end_of(stack: list[Node], tags: tuple[str, ...], scopes: frozenset[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in scopes:
            return


def blocks(node: Node, skip: set[int]) -> list[str]:
    """Texts of the blocks below node, without hidden nodes and those whose id() is in skip."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    stack: list = [iter(node.kids)]
    open_blocks = [False]
    while stack:
        kid = next(stack[-1], None)
        if kid is None:
            stack.pop()
            if open_blocks.pop():
                flush()
        elif isinstance(kid, str):
            run.append(kid)
        else:
            block = kid.tag in BLOCK
            if block:
                flush()
            if kid.hidden or id(kid) in skip:
                continue
            stack.append(iter(kid.kids))
            open_blocks.append(block)
    flush()
    return out


# Outlines and templates


class Outline:
    """Page nodes of one place, or a template's node.

    digest: of the text below, 0 for none or, in a template, for a slot. count: different pages that have the node. own, linked:
    characters of its text outside of further blocks, and those of them in links.
    """

    __slots__ = ("sign", "digest", "kids", "nodes", "own", "linked", "count", "shape", "fixed", "items")

    def __init__(self, sign: str, nodes: list[Node] | None = None, digest: int = 0, count: int = 1):
        self.sign, self.nodes, self.digest, self.count = sign, nodes, digest, count
        self.kids, self.own, self.linked, self.shape, self.fixed, self.items = [], 0, 0, 0, False, None


def _digest(parts: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") or 1


def _expand(o: Outline) -> None:
    """Find the blocks right below the nodes of o, and the text that is in none of them."""
    items: list = []
    run: list[str] = []
    last: tuple | None = None
    stack = [(k, False) for n in reversed(o.nodes) for k in reversed(n.kids)]

    def flush() -> None:
        if run:
            if text := " ".join("".join(run).split()):
                items.append(text)
            run.clear()

    while stack:
        k, link = stack.pop()
        if isinstance(k, str):
            run.append(k)
            n = len(k) if not k.isspace() else 0
            o.own += n
            o.linked += n * link
        elif k.hidden:
            continue
        elif k.tag not in BLOCK:  # inline nodes stand for what they hold
            link = link or k.tag == "a"
            stack += [(x, link) for x in reversed(k.kids)]
        else:
            flush()
            sign = (k.tag, k.names, k.role)
            if sign == last and k.tag in REPEATED:
                o.kids[-1].nodes.append(k)
            else:
                kid = Outline(" ".join((k.tag, *k.names)), [k])
                o.kids.append(kid)
                items.append(kid)
                last = sign
    flush()
    o.items = items


def outline(root: Node) -> list[Outline]:
    """All outline nodes of a page, parents before their children."""
    found, todo = [], [Outline("html", [root])]
    while todo:
        o = todo.pop()
        found.append(o)
        _expand(o)
        todo += reversed(o.kids)
    for o in reversed(found):
        parts = [x if isinstance(x, str) else f"\x01{x.digest}" for x in o.items if isinstance(x, str) or x.digest]
        o.digest = _digest(parts) if parts else 0
        o.items = None
    return found


class Shapes:
    """Numbers for subtrees of equal signatures, and sizes of the largest matches between two of them."""

    def __init__(self) -> None:
        self.of: dict[tuple, int] = {}
        self.sign: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def name(self, nodes: list[Outline]) -> None:
        """Set the shape of all nodes (parents first)."""
        for o in reversed(nodes):
            key = (o.sign, tuple(k.shape for k in o.kids))
            at = self.of.get(key)
            if at is None:
                at = self.of[key] = len(self.sign)
                self.sign.append(o.sign)
                self.kids.append(key[1])
                self.size.append(1 + sum(self.size[k] for k in key[1]))
            o.shape = at

    def match(self, a: int, b: int) -> int:
        """Size of the largest order-preserving match of two subtrees; 0 where their roots differ."""
        if a == b:
            return self.size[a]
        if self.sign[a] != self.sign[b]:
            return 0
        todo = [(a, b)]
        while todo:  # children's sizes first, without recursion, as pages can be deep
            pair = todo[-1]
            if pair in self.known:
                todo.pop()
                continue
            x, y = self.kids[pair[0]], self.kids[pair[1]]
            i, j = _ends(x, y)
            both = sum(self.size[k] for k in x[:i]) + sum(self.size[k] for k in x[len(x) - j :])
            x, y = x[i : len(x) - j], y[i : len(y) - j]
            below = {(p, q) for p in set(x) for q in set(y) if p != q and self.sign[p] == self.sign[q]} - self.known.keys()
            if below:
                todo += below
                continue
            self.known[pair] = 1 + both + (int(_last_row(range(len(x)), self.rows(x, y))[-1]) if x and y else 0)
            todo.pop()
        return self.known[a, b]

    def rows(self, x: tuple[int, ...], y: tuple[int, ...]):
        """Weights of a child of x against all of y, by its place."""
        held: dict[int, np.ndarray] = {}

        def row(i: int) -> np.ndarray:
            if x[i] not in held:
                held[x[i]] = np.array([self.match(x[i], t) for t in y], np.int64)
            return held[x[i]]

        return row


def _ends(x: tuple[int, ...], y: tuple[int, ...]) -> tuple[int, int]:
    """How many equal subtrees stand at the front and, beyond them, at the end; pairing those is never worse."""
    most = min(len(x), len(y))
    i = 0
    while i < most and x[i] == y[i]:
        i += 1
    j = 0
    while j < most - i and x[-1 - j] == y[-1 - j]:
        j += 1
    return i, j


def _next_row(before: np.ndarray, weight: np.ndarray) -> np.ndarray:
    now = before.copy()
    np.maximum(before[1:], np.where(weight > 0, before[:-1] + weight, 0), out=now[1:])
    return np.maximum.accumulate(now)


def _last_row(x, row) -> np.ndarray:
    best = None
    for i in range(len(x)):
        w = row(i)
        best = _next_row(np.zeros(len(w) + 1, np.int64) if best is None else best, w)
    return best


def _align(n: int, m: int, row) -> list[tuple[int, int]]:
    """Pairs of a heaviest order-preserving matching of n and m children; row(i) has the weights of i against all."""
    if not n or not m:
        return []
    if n == 1:
        w = row(0)
        j = int(m - 1 - np.argmax(w[::-1]))
        return [(0, j)] if w[j] > 0 else []
    if n * m > CELLS:  # halve the list: where the best matching crosses its middle
        half = n // 2
        front = _last_row(range(half), row)
        back = _last_row(range(n - half), lambda i: row(n - 1 - i)[::-1])[::-1]
        cut = int(np.argmax(front + back))
        left = _align(half, cut, lambda i: row(i)[:cut])
        return left + [(i + half, j + cut) for i, j in _align(n - half, m - cut, lambda i: row(i + half)[cut:])]
    table = [np.zeros(m + 1, np.int64)]
    for i in range(n):
        table.append(_next_row(table[-1], row(i)))
    pairs, i, j = [], n, m
    while i and j:
        w = row(i - 1)[j - 1]
        if w > 0 and table[i][j] == table[i - 1][j - 1] + w:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def paired(a: Outline, b: Outline, shapes: Shapes) -> list[tuple[int, int]]:
    """Places of the children that simple tree matching pairs; of equal matchings one that pairs equal texts."""
    if a.shape == b.shape:
        return [(i, i) for i in range(len(a.kids))]
    x, y = tuple(k.shape for k in a.kids), tuple(k.shape for k in b.kids)
    i, j = _ends(x, y)
    x, y = x[i : len(x) - j], y[i : len(y) - j]
    sizes, texts = shapes.rows(x, y), np.array([k.digest for k in b.kids[i : len(b.kids) - j]], np.uint64)
    more = 2 * (len(x) + len(y)) + 2  # equal texts break ties and never outweigh a node

    def row(k: int) -> np.ndarray:
        w, own = sizes(k), a.kids[i + k].digest
        return np.where(w > 0, w * more + (texts == np.uint64(own)) * (own > 0), 0)

    middle = _align(len(x), len(y), row) if x and y else []
    return [(k, k) for k in range(i)] + [(p + i, q + i) for p, q in middle] + [(len(a.kids) - k, len(b.kids) - k) for k in range(j, 0, -1)]


def _all(top: Outline) -> list[Outline]:
    found, todo = [], [top]
    while todo:
        found.append(o := todo.pop())
        todo += reversed(o.kids)
    return found


def _merge(template: Outline, page: Outline, shapes: Shapes) -> None:
    """Bring a page, or another template, into a template; nodes that it adds stay where they stood among paired ones."""
    shapes.name(_all(template))
    shapes.name(_all(page))
    todo = [(template, page)]
    while todo:
        t, o = todo.pop()
        t.count += o.count
        if t.digest != o.digest:
            t.digest = 0
        pairs = paired(t, o, shapes)
        if len(pairs) < len(o.kids):
            at = {j: i for i, j in pairs}
            kids, done = [], 0
            for j, k in enumerate(o.kids):
                if j in at:
                    kids += t.kids[done : at[j] + 1]
                    done = at[j] + 1
                else:
                    kids.append(k)
            todo += [(t.kids[i], o.kids[j]) for i, j in pairs]
            t.kids = kids + t.kids[done:]
        else:
            todo += [(t.kids[i], o.kids[j]) for i, j in pairs]


def written(top: Outline) -> str:
    """A template as JSON: columns of its nodes, parents first, with their numbers of children."""
    nodes = _all(top)
    return json.dumps([[o.sign for o in nodes], [o.digest for o in nodes], [o.count for o in nodes], [len(o.kids) for o in nodes]], separators=(",", ":"))


def read(text: str) -> Outline:
    columns = json.loads(text)
    nodes = [Outline(s, None, d, n) for s, d, n, _ in zip(*columns, strict=True)]
    todo: list[list] = []
    for o, kids in zip(nodes, columns[3], strict=True):
        if todo:
            todo[-1][0].kids.append(o)
            todo[-1][1] -= 1
        todo.append([o, kids])
        while todo and not todo[-1][1]:
            todo.pop()
    return nodes[0]


def _main_part(nodes: list[Outline]) -> int:
    """Digest of the nodes with at least SIDE_SHARE of the most running text (not in links) in a node and the paragraphs and headings right below it.

    A long box that all pages have does not hide that their articles differ, and a line that varies on copies does not count.
    """
    weight = [o.own - o.linked + sum(k.own - k.linked for k in o.kids if k.sign.split(" ", 1)[0] in FLOW) for o in nodes]
    most = max(weight)
    return _digest([str(o.digest) for o, w in zip(nodes, weight, strict=True) if w >= SIDE_SHARE * most])


def of_page(html: str) -> tuple[int, Outline]:
    """(digest of a page's main parts, the page as a template of one)."""
    nodes = outline(parse(html))
    return _main_part(nodes), nodes[0]


def merged(parts: Iterable[Outline]) -> Outline:
    """One template of several, of different pages each."""
    template, shapes = None, Shapes()
    for part in parts:
        if template is None:
            template = part
            continue
        if len(shapes.sign) > 100_000:
            shapes = Shapes()
        _merge(template, part, shapes)
    return template


def final(template: Outline) -> Outline:
    """Without what lies below slots that hold no constant node."""
    nodes = _all(template)
    holds: set[int] = set()
    for o in reversed(nodes):
        if (o.digest and o.count >= DISTINCT) or any(id(k) in holds for k in o.kids):
            holds.add(id(o))
        else:
            o.kids = []
    return template


def induce(pages: Iterable[str]) -> Outline | None:
    """The template of pages of one host, or None if their main parts are too few or too alike."""
    own: dict[int, Outline] = {}
    for html in pages:  # a node counts the different pages that have it, not their copies
        own.setdefault(*of_page(html))
    return final(merged(own.values())) if len(own) >= DISTINCT else None


# Extraction


class Weights:
    """Characters of varying text below every outline node, by id: without what its tag rules out (vary), and by names too (kept)."""

    def __init__(self, nodes: list[Outline]):
        self.vary: dict[int, int] = {}
        self.kept: dict[int, int] = {}
        self.links: dict[int, int] = {}
        self.mostly_links: set[int] = set()
        whole: dict[int, tuple[int, int]] = {}
        for o in reversed(nodes):
            below = [whole[id(k)] for k in o.kids]
            length, linked = whole[id(o)] = o.own + sum(a for a, _ in below), o.linked + sum(b for _, b in below)
            if 2 * linked > length:
                self.mostly_links.add(id(o))
            none = o.fixed or o.nodes[0].apart
            self.vary[id(o)] = 0 if none else o.own + sum(self.vary[id(k)] for k in o.kids)
            self.links[id(o)] = 0 if none else o.linked + sum(self.links[id(k)] for k in o.kids)
        total = self.vary[id(nodes[0])]
        self.excluded: set[int] = set()
        for o in reversed(nodes):
            n, own = o.nodes[0], self.vary[id(o)]
            if own and (n.named or (n.hinted and 2 * own <= total)):
                self.excluded.add(id(o))
                own = 0
            else:
                own = 0 if not own else o.own + sum(self.kept[id(k)] for k in o.kids)
            self.kept[id(o)] = own
        if not self.kept[id(nodes[0])]:  # names never empty a page
            self.kept, self.excluded = self.vary, set()

    def flows(self, o: Outline, total: int) -> bool:
        """Belongs to an article that a sibling holds more of: running text with a heading, or of some size."""
        if 2 * self.links[id(o)] > self.vary[id(o)]:
            return False
        return self.kept[id(o)] >= SIDE_SHARE * total or any(self.kept[id(k)] and k.nodes[0].tag in HEADINGS for k in _all(o))


def region(nodes: list[Outline], w: Weights, induced: bool) -> list[Outline]:
    """The outline nodes that hold the article."""
    top, total = nodes[0], w.kept[id(nodes[0])]
    for kind in ("article", "main"):
        parents: dict[int, list[Outline]] = {}
        todo = [(top, top)]
        while todo:
            o, parent = todo.pop()
            n = o.nodes[0]
            if not w.kept[id(o)]:
                continue
            if n.tag == kind or (kind == "main" and n.role == "main"):
                parents.setdefault(id(parent), []).append(o)
            else:
                todo += [(k, o) for k in reversed(o.kids)]
        weight = lambda own: sum(w.kept[id(o)] for o in own)
        best = max(parents.values(), key=weight, default=None)
        if best and (not induced or weight(best) >= ARTICLE_SHARE * total):
            return best
    o = top
    while True:
        kids = [k for k in o.kids if w.kept[id(k)]]
        if o.own or not kids:
            return [o]
        best = max(kids, key=lambda k: w.kept[id(k)])
        if best.nodes[0].tag in FLOW or any(w.flows(k, total) for k in kids if k is not best):
            return [o]
        o = best


def _skipped(top: Outline, w: Weights) -> set[int]:
    """Page nodes of a region that are not its text."""
    flat = top.nodes[0].tag in ("html", "body")
    skip: set[int] = set()
    if flat:  # no container around the article: constant nodes before and after all that varies go
        for kids in (top.kids, top.kids[::-1]):
            for k in kids:
                if w.kept[id(k)]:
                    break
                if k.fixed:
                    skip.update(map(id, k.nodes))
    todo = list(top.kids)
    while todo:
        o = todo.pop()
        n = o.nodes[0]
        gone = n.part or (n.apart and (flat or n.tag != "header" or n.role in DULL_ROLES))  # an article's header has its title
        if not gone:
            links, bare = id(o) in w.mostly_links and n.tag not in HEADINGS, not _running(o)
            gone = n.suspect and (o.fixed or links or bare) or n.hinted and links or o.fixed and (links or n.hinted and bare)
            gone = gone or (flat and id(o) in w.excluded and (links or bare or n.named or not PARTS.isdisjoint(n.names)))
        if gone:
            skip.update(map(id, o.nodes))
        else:
            todo += o.kids
    return skip


def _running(o: Outline) -> bool:
    return any(k.nodes[0].tag == "p" or k.nodes[0].tag in HEADINGS for k in _all(o))


class Wrapper:
    """A host's template with the shapes that were met."""

    def __init__(self, template: Outline):
        self.template = template
        self.clear()

    def clear(self) -> None:
        self.shapes = Shapes()
        self.shapes.name(_all(self.template))

    def mark(self, page: list[Outline]) -> None:
        """Set fixed on the nodes of a page that hold the template's constant text."""
        if len(self.shapes.sign) > 100_000:
            self.clear()
        self.shapes.name(page)
        todo = [(self.template, page[0])]
        while todo:
            t, o = todo.pop()
            for i, j in paired(t, o, self.shapes):
                a, b = t.kids[i], o.kids[j]
                if a.digest and a.count >= DISTINCT and a.digest == b.digest:
                    b.fixed = True
                else:
                    todo.append((a, b))


def extract(html: str | None, wrapper: Wrapper | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    nodes = outline(parse(html))
    induced = wrapper is not None
    if induced:
        wrapper.mark(nodes)
    w = Weights(nodes)
    if induced and not w.kept[id(nodes[0])]:  # the page is all template: nothing was learned of it
        induced = False
        for o in nodes:
            o.fixed = False
        w = Weights(nodes)
    return " ".join(t for o in region(nodes, w, induced) for n in o.nodes for t in blocks(n, _skipped(o, w)))


# Spark


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): JSON templates, one a host that has one; from one page of every different main part."""

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 4 << 20):
            got = [of_page(h) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d for d, _ in got], pa.uint64()).view(pa.int64()), pa.array([written(o) for _, o in got], pa.string())], names=["host", "article", "outline"])

    def merge(last: bool) -> Callable[[pa.Table], pa.Table]:
        def run(t: pa.Table) -> pa.Table:
            rows = sorted(zip(t.column("part").to_pylist(), t.column("outline").to_pylist(), strict=True))
            top = merged(read(o) for _, o in rows)
            return pa.table({"host": t.column("host")[:1], "part": t.column("salt")[:1], "outline": pa.array([written(final(top) if last else top)], pa.string()), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64())})

        return run

    each = pages.where("html IS NOT NULL").select("host", "html").mapInArrow(outlines, "host string, article long, outline string")
    own = materialize(each.groupBy("host", "article").agg(F.min("outline").alias("outline")), "outlines")
    most = own.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    salts = 1
    while salts * GROUP < most:
        salts *= FAN
    rows = own.select("host", F.col("article").alias("part"), "outline", F.lit(1).cast("long").alias("n"), F.pmod(F.xxhash64("article"), F.lit(salts)).alias("salt"))
    while True:
        rows = rows.groupBy("host", "salt").applyInArrow(merge(salts == 1), "host string, part long, outline string, n long")
        if salts == 1:
            return rows.where(F.col("n") >= DISTINCT).select("host", F.col("outline").alias("template"))
        salts //= FAN
        rows = rows.withColumn("salt", F.pmod("part", F.lit(salts)))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: (id_col, url_col, text, n_chars)."""
    host = F.coalesce(F.lower(F.regexp_extract(quoted(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    own = pages.select(quoted(id_col).cast("long").alias("page"), quoted(url_col).cast("string").alias("url"), quoted(html_col).cast("string").alias("html"), host.alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        for b in slices(batches, "html", 4 << 20):
            texts = []
            for html, template in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if template is not None and template not in held:
                    if len(held) >= 256:
                        held.clear()
                    held[template] = Wrapper(read(template))
                texts.append(extract(html, held.get(template)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page", "url", "text", "n_chars"])

    known = materialize(templates(own), "templates")
    if (known.agg(F.sum(F.octet_length("template"))).first()[0] or 0) <= BROADCAST_BYTES:
        joined = own.join(F.broadcast(known), "host", "left")
    else:  # many hosts: a large one is spread over salts
        salted = known.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        joined = own.withColumn("salt", F.pmod(F.xxhash64("page", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.select("page", "url", "html", "template")
    return joined.mapInArrow(run, "page long, url string, text string, n_chars long").select(F.col("page").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
