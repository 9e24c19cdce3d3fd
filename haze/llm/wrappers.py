"""Main text of web pages by wrappers inferred from pages of the same host and layout.

Every page becomes a stream of block tags and texts. Repetitions inside a stream are folded into
repeated groups, which gives the page's skeleton. A page's layout is the path of the element that
holds most of its own text; pages of one host and layout that have the same skeleton are counted
as one, and the distinct skeletons of a host's layout are aligned in a tree of merges, at most
about ``MERGE`` skeletons a merge. In an alignment every mismatch is resolved: differing texts
become a text slot, a stretch that only one side has becomes an optional group, or joins the
neighbouring repeated group if it repeats it. The result is a union-free regular expression over
tags, the wrapper of that layout. Its containers are then weighed by the slot text they hold
outside navigation, notices and comments, and the best one - an article or main element where
there is one - is where the layout's main text lives. Constants are counted apart, so that they
are found inside repeated groups too: a text that stands at the same path on more than half of a
layout's different pages, three at least, is boilerplate. Three things are not, however many pages
share them: table cells, terms, captions and preformatted text; a heading under which text is kept;
and what makes up more than half of a page's text, since such pages are copies of one another.

All pages take part, and no host, however large, is gathered anywhere. Every page is then read
again: blocks under its layout's container are its main text, without boilerplate and furniture.
Where that leaves nothing, the page's own container decides, then boilerplate counts as text, and
at last furniture does.

Defined cases: a null or empty page gives an empty text, and so does one whose only texts are
links; unclosed elements end where the next block of their kind begins or their parent ends; a
page cut off in a tag loses that tag only; html, body, article and main are never furniture, nor is
what holds most of a page's text and its title or article; scripts and other raw text end at their own end tag, or
with the page; a head ends at the first tag or text that cannot stand in it; a null url counts as a host of its own; repeated pages
are each reported, and count once for boilerplate.
"""

from __future__ import annotations

import hashlib
import html
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.llm.common import chunks, materialize

MERGE, HELD_NODES = 64, 200_000
MAX_GROUP = 8
SHARED = 3

#: Elements that never hold text, that hold no main text, and that are blocks.
RAW = frozenset("script style noscript textarea title iframe noembed noframes xmp".split())
SKIPPED = RAW | frozenset("template svg math object canvas audio video select datalist button".split())
HEAD = RAW | frozenset("base basefont bgsound link meta template".split())
ASIDE = frozenset("nav footer aside form dialog menu fieldset option optgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input".split())
#: Words in class, id or role that name page furniture.
FURNITURE = frozenset("""nav navbar navigation menu topbar header masthead footer sidebar aside ad ads advert adverts advertisement
 banner promo promotion sponsor sponsored cookie cookies consent notice notification alert newsletter subscribe signup login search popup
 modal overlay share sharing social related recommended comment comments replies disqus breadcrumb breadcrumbs pagination pager widget
 toolbar contentinfo complementary dialog form copyright""".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(>|\Z)|([^<]+|<)", re.S)
#: Words that only say what kind of box a name is for, and words for the top of a page or an article.
NEUTRAL = frozenset("section area block box list items posts articles links container wrapper content inner bar buttons form".split())
TOP = frozenset("header masthead banner".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose texts name or list something; pages that share them share no notice.
LABELS = frozenset("th td dt dd caption figcaption legend summary pre".split())

_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_BLANK = re.compile(r"\s+")
_PART = re.compile(r"[A-Za-z]+")


def _signature(tag: str, attributes: str) -> tuple[str, bool]:
    """(tag with its names, does it name page furniture)."""
    if not attributes or "=" not in attributes:
        return tag, tag in ASIDE
    names, words = set(), set()
    for m in _NAMED.finditer(attributes):
        given = (m[2] or m[3] or m[4] or "").lower().split()
        names.update(given)
        for parts in map(_PART.findall, given):
            # ids of headings and sections are slugs of their titles: only a name made of nothing else counts
            slug = m[1].lower() == "id" and (tag in HEADINGS or tag == "section")
            if not slug or tag == "section" and FURNITURE.issuperset(p for p in parts if p not in NEUTRAL):
                words.update(FURNITURE.intersection(parts))
    stable = [n for n in sorted(names) if not any(c.isdigit() for c in n)]
    named = bool(words) or tag in ASIDE
    return tag + "".join("." + n for n in stable), named and tag not in ("html", "body", "article", "main")


class _Walk:
    """One pass over a page: calls ``open``, ``close`` and ``text`` with the stack kept right."""

    def __init__(self, page: str):
        self.events: list[tuple] = []  # ("+", signature, furniture) ("-",) ("t", text, linked) ("|",)
        stack: list[str] = []
        linked, at, head = 0, 0, False
        unclosed: set[str] = set()
        while m := _TOKEN.match(page, at):
            at = m.end()
            closing, tag, attributes, end, text = m.groups()
            if text is not None:
                head = head and text.isspace()
                if not head:
                    self.events.append(("t", html.unescape(text), linked > 0))
                continue
            if tag is None or not end:
                continue
            tag = tag.lower()
            if tag == "head":
                head = not closing
                continue
            head = head and (tag in HEAD or bool(closing))
            if tag in SKIPPED:
                if not closing and not attributes.endswith("/"):
                    at = self._behind(page, at, tag, unclosed)
                continue
            if tag == "a":
                linked = 0 if closing else 1
            if tag == "br":
                self.events.append(("t", " ", linked > 0))
            if tag in INLINE:
                continue
            if tag in VOID:
                self.events.append(("|",))
                continue
            if closing:
                if tag in stack:
                    while stack:
                        self.events.append(("-",))
                        if stack.pop() == tag:
                            break
                else:
                    self.events.append(("|",))
                linked = 0
                continue
            if tag not in ("html", "body"):
                while stack and (stack[-1] == "p" or stack[-1] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    self.events.append(("-",))
                    stack.pop()
            stack.append(tag)
            self.events.append(("+", *_signature(tag, attributes)))
            if attributes.endswith("/"):
                stack.pop()
                self.events.append(("-",))
        self.events += [("-",)] * len(stack)

    @staticmethod
    def _behind(page: str, at: int, tag: str, unclosed: set[str]) -> int:
        """Where the page goes on after the element ``tag`` whose content begins at ``at``."""
        if tag in RAW:
            # its content is no markup: only its own end tag ends it
            m = _END[tag].search(page, at)
            return m.end() if m else len(page)
        depth, start = 1, at
        while tag not in unclosed and (m := _TOKEN.match(page, at)):
            at = m.end()
            closing, inner, attributes, end, _ = m.groups()
            if inner is None or not end:
                continue
            inner = inner.lower()
            if inner == tag and not attributes.endswith("/"):
                depth += -1 if closing else 1
                if not depth:
                    return at
            elif inner in RAW and not closing and not attributes.endswith("/"):
                m = _END[inner].search(page, at)
                at = m.end() if m else len(page)
        # nothing closes it: what follows is the page's
        unclosed.add(tag)
        return start


# ---------------------------------------------------------------- wrapper inference

# A node is ["<sig", furniture] / [">sig"] for tags, ["T", constant or None, letters, linked letters] for texts,
# ["+", nodes] for a repeated and ["?", nodes] for an optional group.

def stream(events: list, elements: list | None = None) -> list:
    """Tags and texts of a page, given as the events of its walk, as wrapper nodes; ``elements`` say what is furniture."""
    out: list = []
    path: list[str] = []
    opened = iter(elements or ())
    for e in events:
        if e[0] == "+":
            path.append(e[1])
            out.append(["<" + e[1], next(opened)[2] if elements else e[2]])
        elif e[0] == "-":
            out.append([">" + path.pop()])
        elif e[0] == "t" and (text := _BLANK.sub(" ", e[1]).strip()):
            n, linked = len(text), len(text) if e[2] else 0
            if out and out[-1][0] == "T":
                out[-1] = ["T", f"{out[-1][1]} {text}", out[-1][2] + n, out[-1][3] + linked]
            else:
                out.append(["T", text, n, linked])
    return out


def _key(node: list) -> str:
    return node[0] + "(" + " ".join(map(_key, node[1])) + ")" if node[0] in "+?" else node[0]


def _merge(a: list, b: list) -> list:
    """One node for two that have the same key."""
    if a[0] == "T":
        return ["T", a[1] if a[1] == b[1] else None, a[2] + b[2], a[3] + b[3]]
    if a[0] in "+?":
        return [a[0], [_merge(x, y) for x, y in zip(a[1], b[1], strict=True)]]
    return [a[0], a[1] and b[1]] if a[0][0] == "<" else a


def _sound(keys: list[str]) -> bool:
    """Does every element of a stretch begin and end in it?"""
    depth = 0
    for k in keys:
        depth += (k[0] == "<") - (k[0] == ">")
        if depth < 0:
            return False
    return depth == 0


def _units(nodes: list) -> list[list]:
    """What the repeated groups of a stream repeat, inner groups first."""
    out = []
    for n in nodes:
        if n[0] in "+?":
            out += _units(n[1])
            if n[0] == "+":
                out.append(n[1])
    return out


def _adopt(nodes: list, units: list[list]) -> list:
    """Single occurrences of what the other stream repeats become repeated groups too."""
    for unit in units:
        keys = [_key(n) for n in unit]
        out, i = [], 0
        while i < len(nodes):
            if [_key(n) for n in nodes[i:i + len(keys)]] == keys:
                out.append(["+", nodes[i:i + len(keys)]])
                i += len(keys)
            else:
                n = nodes[i]
                inner = n[0] in "+?" and [_key(m) for m in n[1]] != keys
                out.append([n[0], _adopt(n[1], [unit])] if inner else n)
                i += 1
        nodes = out
    return nodes


def fold(nodes: list) -> list:
    """Adjacent repetitions as repeated groups, shortest patterns first, until none is left."""
    size = 1
    while size <= min(MAX_GROUP, len(nodes) // 2):
        keys, out, i, changed = [_key(x) for x in nodes], [], 0, False
        while i < len(nodes):
            j = i + size
            unit = keys[i:j]
            if keys[j:j + size] == unit and not (size == 1 and unit[0][0] in "+?T") and _sound(unit):
                group = nodes[i:j]
                while keys[j:j + size] == unit:
                    group = [_merge(x, y) for x, y in zip(group, nodes[j:j + size], strict=True)]
                    j += size
                group = group[0][1] if size == 1 and group[0][0] == "+" else group
                out.append(["+", group])
                i, changed = j, True
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
        size = 1 if changed else size + 1
    return nodes


def _common(p: list[str], q: list[str]):
    """Length of the longest common subsequence of p[i:] and q[j:], for any i and j; one bit a cell."""
    full = (1 << len(q)) - 1
    places: dict[str, int] = {}
    for j, k in enumerate(reversed(q)):
        places[k] = places.get(k, 0) | 1 << j
    row = full
    rows = [row]
    for k in reversed(p):
        u = row & places.get(k, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    rows.reverse()
    return lambda i, j: (~rows[i] & ((1 << (len(q) - j)) - 1)).bit_count()


def align(a: list, b: list) -> list:
    """The wrapper of two streams: common nodes merged, the rest optional or taken into a repetition."""
    a, b = _adopt(a, _units(b)), _adopt(b, _units(a))
    x, y = [_key(n) for n in a], [_key(n) for n in b]
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    p, q = x[head:len(x) - tail], y[head:len(y) - tail]
    common = _common(p, q)
    out = [_merge(a[i], b[i]) for i in range(head)]
    i = j = 0
    alone: list = []

    def settle():
        if alone:
            inner = alone[:]
            alone.clear()
            near = out[-1] if out and out[-1][0] == "+" else None
            if near and [_key(n) for n in near[1]] == [_key(n) for n in inner]:
                near[1] = [_merge(m, n) for m, n in zip(near[1], inner, strict=True)]
            elif len(inner) == 1 and inner[0][0] in "+?":
                out.append(["?", inner[0][1] if inner[0][0] == "?" else inner])
            else:
                out.append(["?", inner])

    while i < len(p) or j < len(q):
        if i < len(p) and j < len(q) and p[i] == q[j]:
            settle()
            out.append(_merge(a[head + i], b[head + j]))
            i, j = i + 1, j + 1
        elif j == len(q) or i < len(p) and common(i + 1, j) >= common(i, j + 1):
            alone.append(a[head + i])
            i += 1
        else:
            alone.append(b[head + j])
            j += 1
    settle()
    return out + [_merge(a[len(a) - tail + k], b[len(b) - tail + k]) for k in range(tail)]


def infer(pages: list[str]) -> list:
    """The wrapper of pages of one host."""
    wrapper: list | None = None
    for page in pages:
        folded = fold(stream(_Walk(page).events))
        wrapper = folded if wrapper is None else align(wrapper, folded)
    return wrapper or []


def expression(nodes: list) -> str:
    """A wrapper as a readable regular expression."""
    out = []
    for n in nodes:
        if n[0] in "+?":
            out.append(f"({expression(n[1])}){n[0]}")
        elif n[0] == "T":
            out.append("#text" if n[1] is None else json.dumps(n[1][:40], ensure_ascii=False))
        else:
            out.append(n[0] + ">" if n[0][0] == "<" else f"</{n[0][1:]}>")
    return " ".join(out)


def _best(weights: dict[tuple, float]) -> list[str] | None:
    """The path that holds the main text, given the text under each; None if there is none."""
    most = max(weights.values(), default=0)
    if most <= 0:
        return None
    last = {k: k[-1].split(".")[0] if k else "" for k in weights}
    named = {k: w for k, w in weights.items() if last[k] in ("article", "main") and w >= 0.3 * most}
    if named:
        articles = {k: w for k, w in named.items() if last[k] == "article"}
        pool = articles or named
        return list(max(pool, key=lambda k: (pool[k], -len(k))))
    whole = [k for k, w in weights.items() if w >= 0.8 * most and last[k] not in ("p", "li", "h1", "h2", "h3", "td", "pre", "blockquote")]
    return list(max(whole, key=len))


def container(nodes: list) -> list[str] | None:
    """Path of the element that holds the main text; constant texts weigh nothing next to slots."""
    weights: dict[tuple, float] = {}
    path: list[tuple[str, bool]] = []

    def walk(items):
        for n in items:
            if n[0] in "+?":
                walk(n[1])
            elif n[0][0] == "<":
                path.append((n[0][1:], n[1]))
            elif n[0][0] == ">":
                if path:
                    path.pop()
            elif not any(f for _, f in path):
                # links and texts that never change are seldom main text
                good = (n[2] - n[3]) * (1.0 if n[1] is None else 0.1)
                for depth in range(len(path) + 1):
                    key = tuple(s for s, _ in path[:depth])
                    weights[key] = weights.get(key, 0.0) + good

    walk(nodes)
    return _best(weights)


# ---------------------------------------------------------------- pages

class Page:
    """Elements of a page as (parent, signature, furniture) and its blocks as (element, text, linked letters)."""

    def __init__(self, elements: list, blocks: list):
        self.elements, self.blocks = elements, blocks
        self.paths: list[tuple] = []
        for parent, signature, _ in elements:
            self.paths.append((*self.paths[parent], signature) if parent >= 0 else (signature,))

    @classmethod
    def of(cls, events: list) -> Page:
        elements, blocks, at, text, linked = [], [], -1, [], 0
        for e in events:
            if e[0] == "t":
                text.append(e[1])
                linked += len(_BLANK.sub(" ", e[1]).strip()) if e[2] else 0
                continue
            if text and (block := _BLANK.sub(" ", "".join(text)).strip()):
                blocks.append((at, block, min(linked, len(block))))
            text, linked = [], 0
            if e[0] == "+":
                elements.append((at, e[1], e[2]))
                at = len(elements) - 1
            elif e[0] == "-":
                at = elements[at][0]
        if text and (block := _BLANK.sub(" ", "".join(text)).strip()):
            blocks.append((at, block, min(linked, len(block))))
        return cls(_cleared(elements, blocks), blocks)

    def layout(self) -> list[str] | None:
        """Path of the element that holds the page's own main text; None if all its texts are links."""
        for furniture in (True, False):
            veiled: list[bool] = []
            for parent, _, named in self.elements:
                veiled.append(furniture and (named or parent >= 0 and veiled[parent]))
            own: dict[tuple, float] = {}
            for at, text, linked in self.blocks:
                if at < 0 or not veiled[at]:
                    path = self.paths[at] if at >= 0 else ()
                    own[path] = own.get(path, 0.0) + len(text) - linked
            weights: dict[tuple, float] = {}
            for path, good in own.items():
                for depth in range(len(path) + 1):
                    weights[path[:depth]] = weights.get(path[:depth], 0.0) + good
            if (found := _best(weights)) is not None:
                return found
        return None

    def marks(self) -> list[int]:
        """A hash of each block: its path and its text."""
        prefix: dict[int, bytes] = {}
        out = []
        for at, text, _ in self.blocks:
            if at not in prefix:
                prefix[at] = " ".join(self.paths[at]).encode() + b"\0" if at >= 0 else b"\0"
            out.append(_hash(prefix[at] + text.encode(errors="replace")))
        return out

    def select(self, where: list[str], shared: frozenset = frozenset(), furniture: bool = True) -> str:
        """Blocks under the container ``where`` joined by line breaks, without those in ``shared``."""
        where = tuple(where)
        kept: list[bool | None] = []  # None: outside of the container
        for k, (parent, _, named) in enumerate(self.elements):
            above = kept[parent] if parent >= 0 else None if where else True
            if above is None:
                kept.append(True if self.paths[k] == where else None)
            else:
                kept.append(above and not (furniture and named))
        root = None if where else True
        inside = [i for i, (at, _, _) in enumerate(self.blocks) if (kept[at] if at >= 0 else root)]
        gone = self._boilerplate(inside, shared) if shared else frozenset()
        return "\n".join(self.blocks[i][1] for i in inside if i not in gone)

    def _boilerplate(self, inside: list[int], shared: frozenset) -> set[int]:
        """Which of the blocks ``inside`` are boilerplate, given the hashes that a layout's pages share."""
        marks = self.marks()
        gone: set[int] = set()
        below = [False] * 7  # is text kept before the next heading of this level, or of one above it?
        for i in reversed(inside):
            at = self.blocks[i][0]
            tag = self.elements[at][1].split(".")[0] if at >= 0 else ""
            level = int(tag[1]) if tag in HEADINGS else 0
            if marks[i] in shared and tag not in LABELS and not below[level]:
                gone.add(i)
            if level:
                below[level:] = [False] * (7 - level)
            elif i not in gone:
                below[1:] = [True] * 6
        letters = [len(self.blocks[i][1]) for i in inside]
        return gone if 2 * sum(len(self.blocks[i][1]) for i in gone) <= sum(letters) else set()

    def main_text(self, where: list[str] | None, own: list[str] | None, shared: frozenset) -> str:
        """Main text by the layout's container and boilerplate, or what comes closest to it."""
        places = [w for w in (where, own) if w is not None]
        for known, furniture in ((shared, True), (frozenset(), True), (frozenset(), False)):
            for place in places:
                if found := self.select(place, known, furniture):
                    return found
        return ""


def _cleared(elements: list, blocks: list) -> list:
    """Elements whose names say furniture but that hold the page, or an article's title, as no furniture."""
    if not any(furniture for _, _, furniture in elements):
        return elements
    tags = [signature.split(".")[0] for _, signature, _ in elements]
    letters, titled = [0] * len(elements), [tag in ("h1", "article", "main") for tag in tags]
    for at, text, linked in blocks:
        if at >= 0:
            letters[at] += len(text) - linked
    whole = sum(len(text) - linked for _, text, linked in blocks)
    for k in range(len(elements) - 1, -1, -1):
        parent = elements[k][0]
        if parent >= 0:
            letters[parent] += letters[k]
            titled[parent] = titled[parent] or titled[k]
    titles = any(tag in ("h1", "article", "main") for tag in tags)
    out = []
    for k, (parent, signature, furniture) in enumerate(elements):
        if furniture:
            most = 2 * letters[k] > whole and titled[k] or 10 * letters[k] >= 9 * whole and not titles
            top = titled[k] and tags[k] not in ASIDE and all(p in TOP or p not in FURNITURE for p in _PART.findall(signature))
            furniture = not (most or top)
        out.append((parent, signature, furniture))
    return out


def _hash(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


# ---------------------------------------------------------------- Spark

_LEARN = "host string, layout string, page long, texts array<long>, skeleton long, nodes string"
_KEYED = "host string, layout string, skeleton long, nodes string"


def _short(nodes: list) -> list:
    """Nodes whose long constants are cut to a beginning and a hash."""
    out = []
    for n in nodes:
        if n[0] in "+?":
            out.append([n[0], _short(n[1])])
        elif n[0] == "T" and n[1] is not None and len(n[1]) > 60:
            out.append(["T", f"{n[1][:40]}\0{_hash(n[1].encode(errors='replace'))}", n[2], n[3]])
        else:
            out.append(n)
    return out


def _skeleton(nodes: list) -> int:
    return _hash(" ".join(map(_key, nodes)).encode(errors="replace"))


def _learned(pages: DataFrame) -> DataFrame:
    """One row of each page (host, layout, hash, block hashes) and of each skeleton that a task has met."""
    def run(batches):
        held: dict = {}
        size = 0

        def flush():
            rows = [(h, w, k, json.dumps(n)) for (h, w, k), n in held.items()]
            held.clear()
            host, layout, skeleton, nodes = zip(*rows, strict=True) if rows else ((),) * 4
            none = pa.nulls(len(rows))
            return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(layout, pa.string()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64())),
                                               pa.array(skeleton, pa.int64()), pa.array(nodes, pa.string())], names=["host", "layout", "page", "texts", "skeleton", "nodes"])

        for batch in batches:
            for part in chunks(batch, "html"):
                layouts, hashes, texts = [], [], []
                for host, raw in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    events = _Walk(raw).events
                    page = Page.of(events)
                    marks, layout = page.marks(), json.dumps(page.layout())
                    layouts.append(layout)
                    hashes.append(_hash(repr(marks).encode()))
                    texts.append(sorted(set(marks)))
                    nodes = _short(fold(stream(events, page.elements)))
                    key = host, layout, _skeleton(nodes)
                    if key in held:
                        held[key] = [_merge(x, y) for x, y in zip(held[key], nodes, strict=True)]
                    else:
                        held[key] = nodes
                        size += len(nodes)
                    if size > HELD_NODES:
                        yield flush()
                        size = 0
                none = pa.nulls(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(layouts, pa.string()), pa.array(hashes, pa.int64()), pa.array(texts, pa.list_(pa.int64())),
                                                  none.cast(pa.int64()), none.cast(pa.string())], names=["host", "layout", "page", "texts", "skeleton", "nodes"])
        yield flush()

    return pages.where("html is not null").select(_host("url").alias("host"), "html").mapInArrow(run, _LEARN)


def _aligned(table):
    """One wrapper for a table of skeletons or wrappers of one host and layout."""
    met: dict = {}
    for key, raw in sorted(zip(table.column("skeleton").to_pylist(), table.column("nodes").to_pylist(), strict=True)):
        nodes = json.loads(raw)
        met[key] = [_merge(x, y) for x, y in zip(met[key], nodes, strict=True)] if key in met else nodes
    wrapper: list | None = None
    for nodes in met.values():
        wrapper = nodes if wrapper is None else align(wrapper, nodes)
    return pa.table({"host": table.column("host")[:1], "layout": table.column("layout")[:1], "skeleton": pa.array([_skeleton(wrapper)], pa.int64()), "nodes": pa.array([json.dumps(wrapper)])})


def _wrappers(learned: DataFrame) -> DataFrame:
    """host, layout, wrapper (readable) and container (JSON path) of every layout."""
    rows = learned.where("nodes is not null").select("host", "layout", "skeleton", "nodes")
    while True:
        sizes = materialize(rows.groupBy(F.col("host").alias("h"), F.col("layout").alias("l")).agg(F.count("*").alias("n")))
        most = sizes.agg(F.max("n")).first()[0] or 0
        buckets = F.ceil(F.col("n") / MERGE)
        placed = rows.join(sizes, (F.col("host") == F.col("h")) & (F.col("layout") == F.col("l"))).withColumn("bucket", F.pmod(F.xxhash64("skeleton"), buckets))
        rows = materialize(placed.select("host", "layout", "skeleton", "nodes", "bucket").groupBy("host", "layout", "bucket").applyInArrow(_aligned, _KEYED))
        if most <= MERGE:
            break

    def read(batches):
        for batch in batches:
            nodes = [json.loads(x) for x in batch.column("nodes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("layout"), pa.array([expression(n) for n in nodes], pa.string()),
                                              pa.array([json.dumps(container(n)) for n in nodes], pa.string())], names=["host", "layout", "wrapper", "container"])

    return rows.mapInArrow(read, "host string, layout string, wrapper string, container string")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, layout, wrapper, container and shared (hashes of boilerplate blocks) of every layout of ``pages`` (page_id, url, html)."""
    learned = materialize(_learned(pages))
    # a page that the table repeats adds nothing
    known = materialize(learned.where("page is not null").groupBy("host", "layout", "page").agg(F.first("texts").alias("texts")))
    total = known.groupBy("host", "layout").agg(F.count("*").alias("pages"))
    counts = known.select("host", "layout", F.explode("texts").alias("text")).groupBy("host", "layout", "text").agg(F.count("*").alias("c")).where(F.col("c") >= SHARED)
    shared = counts.join(total, ["host", "layout"]).where(2 * F.col("c") > F.col("pages")).groupBy("host", "layout").agg(F.collect_list("text").alias("shared"))
    return _wrappers(learned).join(shared, ["host", "layout"], "left")


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    learned = materialize(wrappers(pages).select("host", "layout", "container", "shared"))

    def read(batches):
        for batch in batches:
            for part in chunks(batch, "html"):
                layouts, read = [], []
                for raw in part.column("html").to_pylist():
                    page = Page.of(_Walk(raw or "").events)
                    layouts.append(json.dumps(page.layout()))
                    read.append(json.dumps([page.elements, page.blocks], ensure_ascii=False).encode(errors="replace").decode() if raw else None)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), pa.array(layouts, pa.string()), pa.array(read, pa.string())],
                                                 names=["page_id", "url", "host", "layout", "page"])

    def run(batches):
        known: dict = {}
        for batch in batches:
            for part in chunks(batch, "page"):
                texts = []
                for raw, host, layout, where, shared in zip(*(part.column(c).to_pylist() for c in ("page", "host", "layout", "container", "shared")), strict=True):
                    if (host, layout) not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[host, layout] = json.loads(where) if where else None, json.loads(layout), frozenset(shared or ())
                    texts.append(Page(*json.loads(raw)).main_text(*known[host, layout]) if raw else "")
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html", _host("url").alias("host")).mapInArrow(read, "page_id long, url string, host string, layout string, page string")
    return rows.join(learned, ["host", "layout"], "left").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
