"""Main text of web pages by wrapper induction.

Pages of one host share a template. A few unlike pages of each host are parsed to whole trees, menus and adverts included,
and aligned by simple tree matching (a dynamic programme over ordered children with equal labels). A node that is matched
on most of the aligned pages belongs to the host's wrapper, whether or not its text varies. From the root down, the
wrapper's nodes are told apart by what they hold over all aligned pages: one whose text is the same everywhere or stands
in links is chrome; if one container holds most of the varying text, the way to the article leads through it, and its
siblings are chrome, but for a heading before it; if none does, the node is the content. ``article`` and ``main``
elements are never chrome. The wrapper is matched to every page of its host; what falls on chrome goes, what falls on
content or on nothing stays. Blocks inside the content that are the same on all aligned pages but one go too.

Inside the content, and for pages that no wrapper fits (hosts with too few unlike pages, pages of another layout), rules
take out what never is an article: scripts, styles, forms, navigation, headers, footers, asides, hidden elements, and
elements whose class, id or role is a name for an advert, notice, menu, sidebar or reader comments, unless such an element
holds most of the page's text. Without a wrapper, all of the outermost ``article`` and ``main`` elements with text are the
content, or else the page.

The wrapper is fitted on ``REFERENCES`` pages a host at most: the first unlike ones of at most ``REFERENCE_DEPTH`` levels in
the order of their hashes, copies aside. A look at the ``CANDIDATES`` smallest hashes finds them for most hosts, and passes
over all pages of the others find the rest. Wrappers are joined by host: broadcast below the checked limit, salted beyond it.

Defined results: null or empty html gives an empty text; a null url is a host of its own; unclosed elements end with their
parent; repeated rows are kept; further columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.llm.tables import small_batches
from lumenframe.plans.storage import BROADCAST_BYTES, fits_broadcast, materialize

#: Different pages of a host that are looked at before all of its pages are.
CANDIDATES = 12
#: Aligned pages of a host, and how many are needed for a wrapper and must share a node.
REFERENCES, LEAST = 5, 3
#: Deeper pages are extracted like all others, but no wrapper is fitted on them.
REFERENCE_DEPTH = 200
#: Two pages that share more of their text than this are copies.
COPY = 0.9
#: A container with more than this share of the varying text leads to the article; text with more than this share in links is a menu.
MOST = 0.5
#: Lists whose lengths multiply to more than the square of this are cut at equal subtrees before they are aligned.
ALIGNED_CHILDREN = 400
SALT = 32

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
_DROP = frozenset("script style textarea title noscript template iframe head nav footer aside form button select option svg canvas object audio video menu dialog".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody thead tfoot tr ul caption".split())
#: Blocks of text, which never hold an article as a whole.
_LEAVES = frozenset("#inline p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote ul ol dl table tbody tr figure figcaption".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "comment comments disqus replies sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related "
    "recommended newsletter subscribe subscription popup modal overlay toolbar pagination pager login signup complementary contentinfo search form dialog".split()
)
#: What may stand beside such a word in one name without changing its sense.
_BESIDE = frozenset("site page main top bottom left right global primary secondary post wrapper container wrap box bar list area section block inner widget unit slot links".split())
_SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}

RULE, NAME = 1, 2


class Node:
    """An element. ``drop``: by a rule for elements, or by its name; ``place``: a hash of the labels down to it; ``deep``: holds blocks."""

    __slots__ = ("tag", "drop", "label", "place", "deep", "children")

    def __init__(self, tag: str, drop: int, label: str, place: int = 0):
        self.tag, self.drop, self.label, self.place, self.deep, self.children = tag, drop, label, place, False, []


def _names_chrome(value: str) -> bool:
    """Whether one of the names is made of chrome words, and of words that may stand beside them, alone."""
    for name in value.split():
        parts = _PART.findall(name)
        if parts and not _WORDS.isdisjoint(parts) and all(p in _WORDS or p in _BESIDE for p in parts):
            return True
    return False


def _node(tag: str, attrs: str, parent: Node) -> Node:
    drop, names = RULE if tag in _DROP or tag == "header" else 0, []
    if attrs and len(attrs) > 3:
        for m in _ATTR.finditer(attrs):
            name = m[1].lower()
            if name in ("class", "id", "role"):
                value = (m[2] or m[3] or m[4] or "").lower()
                names += [x for x in value.split() if not any(c.isdigit() for c in x)]
                if not drop and tag not in ("html", "body", "article", "main") and _names_chrome(value):
                    drop = NAME
            elif name == "hidden" and (m[2] or m[3] or m[4] or "").lower() != "until-found":
                drop = RULE
    label = ".".join([tag, *sorted(names)]) if names else tag
    return Node(tag, drop, label, crc32(label.encode("utf-8", "surrogatepass"), parent.place) if tag in _BLOCK else parent.place)


def parse(html: str) -> Node:
    """A tree of ``Node`` and text chunks (character references decoded); linear in the page."""
    root = Node("#root", 0, "#root")
    stack, at, n, last = [root], 0, len(html), html.rfind(">")
    named = False

    def text(chunk: str) -> None:
        if chunk:
            stack[-1].children.append(html_lib.unescape(chunk))

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        text(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if lt > last:  # no tag ends any more
            text(html[lt:])
            break
        m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if not m:
            text("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[1].lower()
        if html[lt + 1] == "/":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in _BLOCK or tag in _SELF_CLOSING:
            _close_implied(stack, tag)
        node = _node(tag, m[2], stack[-1])
        named |= node.drop == NAME
        stack[-1].children.append(node)
        if tag in _BLOCK:
            for above in reversed(stack):
                if above.deep:
                    break
                above.deep = True
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else n
        elif tag not in _VOID and not m[2].endswith("/"):
            stack.append(node)
    if named:
        _spare_most(root)
    return root


def _spare_most(root: Node) -> None:
    """A name doesn't take out an element that holds most of the page's text outside scripts, menus and the like."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node) and c.drop != RULE)
    size: dict[int, int] = {}
    for node in reversed(order):
        size[id(node)] = sum(len(c.strip()) if isinstance(c, str) else size.get(id(c), 0) for c in node.children)
    for node in order:
        if node.drop == NAME and size[id(node)] > MOST * size[id(root)]:
            node.drop = 0


def _close_implied(stack: list[Node], tag: str) -> None:
    """A block ends an open paragraph; an item ends the item before it in the same list."""
    stop = _SELF_CLOSING.get(tag)
    for i in range(len(stack) - 1, 0, -1):
        open_ = stack[i].tag
        if open_ == "p" and tag in _BLOCK or stop and (open_ == tag or {open_, tag} <= {"dt", "dd"} or {open_, tag} <= {"td", "th"}):
            del stack[i:]
            return
        if stop and open_ in stop or open_ in _BLOCK and open_ not in ("p", "li", "dt", "dd"):
            return


def _squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _kept_header(node: Node) -> bool:
    """A header inside an article is kept if it holds the heading."""
    return node.tag == "header" and any(isinstance(c, Node) and c.tag == "h1" for c in node.children)


def blocks(root: Node, inside: bool = False) -> list[tuple[int, str]]:
    """(place, text) of the text blocks under ``root`` in page order, without dropped elements."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    places = [root.place]

    def close() -> None:
        if parts:
            if line := _squeeze(parts):
                out.append((places[-1], line))
            parts.clear()

    todo: list = [(root, False)]
    while todo:
        node, leave = todo.pop()
        if isinstance(node, str):
            parts.append(node)
            continue
        block = node.tag in _BLOCK
        if leave:
            if block:
                close()
                places.pop()
            elif node.tag in ("td", "th"):
                parts.append(" ")
            continue
        if node.drop and not (inside and _kept_header(node)):
            parts.append(" ")
            continue
        if node.tag == "br":
            parts.append(" ")
            continue
        if block:
            close()
            places.append(node.place)
        todo.append((node, True))
        todo.extend((c, False) for c in reversed(node.children))
    close()
    return out


def content_root(root: Node) -> tuple[Node, bool]:
    """The outermost main and article elements outside dropped ones, in page order; without text in them the page."""
    found, todo = Node("#root", 0, "#root"), [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main"):
            found.children.append(node)
        else:
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.drop)
    return (found, True) if blocks(found, True) else (root, False)


def parts(node: Node) -> list[Node]:
    """The blocks that a node consists of; text and inline elements between them as ``#inline`` nodes."""
    out: list[Node] = []
    run: list = []

    def close() -> None:
        if any(not c.isspace() if isinstance(c, str) else c.children for c in run):
            inline = Node("#inline", 0, "#inline", node.place)
            inline.children = run.copy()
            out.append(inline)
        run.clear()

    for c in node.children:
        if isinstance(c, Node) and (c.deep or c.tag in _BLOCK):
            close()
            out.append(c)
        else:
            run.append(c)
    close()
    return out


def _inline(node: Node) -> tuple[str, int]:
    """Text of a node without blocks, and how much of it stands in links."""
    texts: list[str] = []
    links, todo = 0, [(c, False) for c in reversed(node.children)]
    while todo:
        c, link = todo.pop()
        if isinstance(c, str):
            texts.append(c)
            links += len(c.strip()) if link else 0
        elif c.drop or c.tag in ("br", "td", "th"):
            texts.append(" ")
        if not isinstance(c, str) and not c.drop:
            todo.extend((x, link or c.tag == "a") for x in reversed(c.children))
    return _squeeze(texts), links


class Shape:
    """A tree for alignment: labels, own text, blocks as children; ``free`` is the text outside links and dropped elements."""

    __slots__ = ("label", "tag", "place", "text", "children", "size", "same", "chars", "free", "heading", "main")

    def __init__(self, label: str, text: str, children: list, tag: str = "", place: int = 0, links: int = 0, drop: bool = False):
        self.label, self.text, self.children, self.tag, self.place = label, text, children, tag, place
        self.same = _digest("\0".join([label, text, *(c.same for c in children)]))
        self.size = 1 + sum(c.size for c in children)
        self.chars = len(text) + sum(c.chars for c in children)
        self.free = 0 if drop else max(0, len(text) - links) + sum(c.free for c in children)
        self.heading = self.chars if tag in ("h1", "h2") else sum(c.heading for c in children)
        self.main = self.chars > 0 and (tag in ("article", "main") or any(c.main for c in children)) and not drop

    @property
    def key(self) -> str:
        return f"{self.place:08x}{_digest(self.text)}"


def shape(root: Node) -> Shape:
    """The whole tree of a page, dropped elements included (scripts and styles hold nothing)."""
    order, kids, todo = [], {}, [root]
    while todo:
        node = todo.pop()
        order.append(node)
        if node.deep:
            kids[id(node)] = parts(node)
            todo.extend(kids[id(node)])
    made: dict[int, Shape] = {}
    for node in reversed(order):
        if node.deep:
            made[id(node)] = Shape(node.label, "", [made.pop(id(k)) for k in kids[id(node)]], node.tag, node.place, 0, bool(node.drop))
        else:
            text, links = _inline(node)
            made[id(node)] = Shape(node.label, text, [], node.tag, node.place, links, bool(node.drop))
    return made[id(root)]


def _depth(root: Node) -> int:
    depth, level = 0, [root]
    while level:
        level = [c for node in level for c in node.children if isinstance(c, Node) and c.deep]
        depth += 1
    return depth


def tree_match(a: Shape, b: Shape) -> tuple[float, list[tuple[Shape, Shape]]]:
    """Simple tree matching: the largest order-preserving set of node pairs with equal labels and matched parents.

    Equal texts weigh a little more, so that of two alignments the one that explains more text wins.
    """
    if a.label != b.label:
        return 0.0, []
    score, pairs = 1.0 + (0.5 if a.text and a.text == b.text else 0.0), [(a, b)]
    todo = [(a.children, b.children)]
    while todo:
        xs, ys = todo.pop()
        head, most = 0, min(len(xs), len(ys))
        while head < most and xs[head].same == ys[head].same:
            head += 1
        tail = 0
        while tail < most - head and xs[-1 - tail].same == ys[-1 - tail].same:
            tail += 1
        twins = [*zip(xs[:head], ys[:head]), *zip(xs[len(xs) - tail :], ys[len(ys) - tail :])]
        xs, ys = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
        if len(xs) * len(ys) <= ALIGNED_CHILDREN**2:
            more, found = _align(xs, ys)
            score += more
            pairs += found
        else:
            at = _anchors([x.same for x in xs], [y.same for y in ys])
            if at:
                twins += [(xs[i], ys[j]) for i, j in at]
                ends = [(-1, -1), *at, (len(xs), len(ys))]
                todo += [(xs[i + 1 : k], ys[j + 1 : n]) for (i, j), (k, n) in zip(ends, ends[1:]) if k - i > 1 and n - j > 1]
            else:  # nothing equal in here, but nodes with equal labels may hold equal parts
                for i, j in _anchors([x.label for x in xs], [y.label for y in ys]):
                    more, found = tree_match(xs[i], ys[j])
                    score += more
                    pairs += found
        while twins:
            x, y = twins.pop()
            score += 1.5 if x.text else 1.0
            pairs.append((x, y))
            twins += zip(x.children, y.children)
    return score, pairs


def _anchors(xs: list[str], ys: list[str]) -> list[tuple[int, int]]:
    """The longest rising run of pairs of equal keys, the n-th use of a key with its n-th use; linear in memory."""

    def numbered(keys: list[str]) -> list[tuple[str, int]]:
        uses: dict[str, int] = {}
        out = []
        for k in keys:
            uses[k] = uses.get(k, 0) + 1
            out.append((k, uses[k]))
        return out

    place = {k: j for j, k in enumerate(numbered(ys))}
    met = [(i, place[k]) for i, k in enumerate(numbered(xs)) if k in place]
    last: list[int] = []  # by length of the run: its smallest end
    ends: list[int] = []
    before = []
    for n, (_, j) in enumerate(met):
        at = bisect_left(last, j)
        before.append(ends[at - 1] if at else -1)
        last[at : at + 1], ends[at : at + 1] = [j], [n]
    run, n = [], ends[-1] if ends else -1
    while n >= 0:
        run.append(met[n])
        n = before[n]
    return run[::-1]


def _align(xs: list[Shape], ys: list[Shape]) -> tuple[float, list[tuple[Shape, Shape]]]:
    if not xs or not ys:
        return 0.0, []
    score = [[0.0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    step: dict = {}
    for i, x in enumerate(xs, 1):
        for j, y in enumerate(ys, 1):
            best, how = score[i - 1][j], None
            if score[i][j - 1] > best:
                best, how = score[i][j - 1], "left"
            if x.label == y.label:
                w, pairs = tree_match(x, y)
                if score[i - 1][j - 1] + w > best:
                    best, how = score[i - 1][j - 1] + w, pairs
            score[i][j] = best
            if how is not None:
                step[i, j] = how
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        how = step.get((i, j))
        if how is None:
            i -= 1
        elif how == "left":
            j -= 1
        else:
            pairs += how
            i, j = i - 1, j - 1
    return score[-1][-1], pairs


def _texts(found: list[tuple[int, str]]) -> dict[str, int]:
    return {t: len(t) for _, t in found}


def _found(page: str) -> list[tuple[int, str]]:
    root, inside = content_root(parse(page))
    return blocks(root, inside) if _depth(root) <= REFERENCE_DEPTH else []


def unlike(mine: dict[str, int], others: list[dict[str, int]]) -> bool:
    """Whether the page has text and is no copy, or near copy, of the others; copies say nothing about the template."""
    size = sum(mine.values())
    return size > 0 and all(sum(n for t, n in mine.items() if t in other) <= COPY * min(size, sum(other.values())) for other in others)


def references(pages: list[str], most: int = REFERENCES) -> list[int]:
    """The places of the first ``most`` pages that are unlike those before."""
    out, seen = [], []
    for i, page in enumerate(pages):
        mine = _texts(_found(page))
        if unlike(mine, seen):
            seen.append(mine)
            out.append(i)
        if len(out) == most:
            break
    return out


PATH, CONTENT, CHROME = "path", "content", "chrome"


class Slots:
    """The wrapper's nodes on one aligned page, with what stands in their places on the others."""

    def __init__(self, pivot: Shape, partners: list[dict[int, Shape]], need: int):
        self.pivot, self.partners, self.need = pivot, partners, need

    def forms(self, node: Shape) -> list[Shape]:
        return [node, *(p[id(node)] for p in self.partners if id(node) in p)]

    def constant(self, node: Shape) -> bool:
        return sum(f.same == node.same for f in self.forms(node)) >= self.need

    def varying(self, node: Shape) -> int:
        """Text outside links over all pages; none if it is the same on most of them."""
        return 0 if self.constant(node) else sum(f.free for f in self.forms(node))

    def tree(self, node: Shape) -> list:
        """``[label, role, labels below, children]`` of a node on the way to the article, and of its children."""
        kept = [k for k in node.children if len(self.forms(k)) >= self.need]
        total = sum(f.free for f in self.forms(node)) - sum(f.free for k in kept if self.constant(k) for f in self.forms(k))
        lead = max(kept, key=self.varying, default=None)
        leads = lead is not None and self.varying(lead) > MOST * total and lead.tag not in _LEAVES
        if not leads and not any(k.main and k.tag not in _LEAVES for k in kept):
            return [node.label, CONTENT, _below(node), []]
        children, before = [], True
        for k in kept:
            before &= k is not lead
            chars = sum(f.chars for f in self.forms(k))
            heads = before and leads and not self.constant(k) and sum(f.heading for f in self.forms(k)) > MOST * chars
            if k is lead and leads or k.main:
                children.append(self.tree(k) if k.tag not in ("article", "main") else [k.label, CONTENT, _below(k), []])
            elif heads or not leads and not self.constant(k) and sum(f.free for f in self.forms(k)) > MOST * chars:
                children.append([k.label, CONTENT, _below(k), []])
            else:
                children.append([k.label, CHROME, _below(k), []])
        return [node.label, PATH, _below(node), children]


def _below(node: Shape) -> list[str]:
    """The labels inside a node, which tell nodes with equal labels apart."""
    found, todo = set(), [*node.children]
    while todo:
        k = todo.pop()
        found.add(k.label)
        todo += k.children
    return sorted(found)


def induce(pages: list[str], most: int = REFERENCES) -> tuple[list | None, list[str]]:
    """The wrapper of a host's pages, and the keys (place and text) of its constant blocks; nothing with too few unlike pages.

    A node is the wrapper's if most of the pages, and ``LEAST`` at least, have it; a block is constant if all of them but
    one, and ``LEAST`` at least, have it; so one odd page hides nothing, and a line that some articles share stays. The wrapper is written on the page that fits the others best.
    """
    trees = [shape(parse(pages[i])) for i in references(pages, most)]
    if len(trees) < LEAST:
        return None, []
    votes: dict[int, set[int]] = {}
    places: dict[int, Shape] = {}
    partners: list[list[dict[int, Shape]]] = [[] for _ in trees]
    fits = [0.0] * len(trees)
    for i, one in enumerate(trees):
        for j in range(i + 1, len(trees)):
            score, pairs = tree_match(one, trees[j])
            for x, y in pairs:
                if x.text and x.text == y.text:
                    for node, other in ((x, j), (y, i)):
                        votes.setdefault(id(node), set()).add(other)
                        places[id(node)] = node
            for k, match in ((i, {id(x): y for x, y in pairs}), (j, {id(y): x for x, y in pairs})):
                partners[k].append(match)
                fits[k] += score / max(1.0, one.size + trees[j].size)
    need = max(LEAST, len(trees) // 2 + 1)
    constant = sorted({x.key for i, x in places.items() if len(votes[i]) + 1 >= max(LEAST, len(trees) - 1)})
    best = max(range(len(trees)), key=lambda i: (fits[i], -i))
    wrapper = Slots(trees[best], partners[best], need).tree(trees[best])
    return (wrapper if wrapper[1] == PATH else None), constant


def _labels(node: Node) -> set[str]:
    found, todo = set(), [node]
    while todo:
        inside = todo.pop()
        for k in parts(inside) if inside.deep else ():
            found.add(k.label)
            todo.append(k)
    return found


def _alike(mine: set[str], other: list[str]) -> float:
    both = mine.union(other)
    return len(mine.intersection(other)) / len(both) if both else 1.0


def _like_chrome(label: str, below: set[str], slots: list) -> bool:
    """Whether an unmatched node is one more of a chrome slot's kind: of the slots with its label, such a one holds the likest labels."""
    same = [s for s in slots if s[0] == label]
    return bool(same) and max(same, key=lambda s: (_alike(below, s[2]), s[1] != CHROME))[1] == CHROME


def fit(wrapper: list, node: Node) -> tuple[float, list[Node], bool]:
    """Matches a wrapper's node on the way to the article to a page's node with the same label.

    A node that is left over stays too, unless it looks like one more of a chrome slot. Gives the score of the best
    alignment, the page's nodes that stay, and whether a content slot is among them.
    """
    slots, kids = wrapper[3], parts(node)
    labels = [k.label for k in kids]
    twice = {x for x in {s[0] for s in slots} if labels.count(x) > 1 or sum(s[0] == x for s in slots) > 1}
    below = [_labels(k) if k.label in twice else set() for k in kids]
    inner: dict = {}
    best = [[0.0] * (len(kids) + 1) for _ in range(len(slots) + 1)]
    for i, slot in enumerate(slots, 1):
        row, above = best[i], best[i - 1]
        for j, k in enumerate(kids, 1):
            row[j] = max(above[j], row[j - 1])
            if slot[0] != k.label:
                continue
            weight = 1.0
            if k.label in twice:
                weight += 2 * _alike(below[j - 1], slot[2])
            if slot[1] == PATH:
                deeper = fit(slot, k)
                weight += deeper[0]
            row[j] = max(row[j], above[j - 1] + weight)
            inner[i, j] = (weight, deeper if slot[1] == PATH else None)
    stays: dict[int, list[Node]] = {}
    hit, i, j = False, len(slots), len(kids)
    taken = set()
    while i and j:
        found = inner.get((i, j))
        if found is not None and best[i][j] == best[i - 1][j - 1] + found[0]:
            slot = slots[i - 1]
            taken.add(j - 1)
            if slot[1] == CONTENT:
                stays[j - 1], hit = [kids[j - 1]], True
            elif slot[1] == PATH:
                stays[j - 1], hit = found[1][1], hit or found[1][2]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    for j, k in enumerate(kids):
        if j not in taken and not (k.tag not in ("article", "main") and _like_chrome(k.label, below[j], slots)):
            stays[j] = [k]
    return best[-1][-1], [k for j in sorted(stays) for k in stays[j]], hit


def extract(html: str | None, wrapper: list | None = None, constant: frozenset | set = frozenset()) -> tuple[str, bool]:
    """The text of a page, and whether the wrapper found it."""
    if not html:
        return "", False
    page = parse(html)
    if wrapper and wrapper[1] == PATH:
        _, stays, hit = fit(wrapper, page)
        if hit:
            found = Node("#root", 0, "#root")
            found.children = stays
            if text := _lines(blocks(found, True), constant):
                return text, True
    root, inside = content_root(page)
    return _lines(blocks(root, inside), constant), False


def _lines(found: list[tuple[int, str]], constant: frozenset | set) -> str:
    return "\n".join(t for p, t in found if not constant or f"{p:08x}{_digest(t)}" not in constant)


def main_text(html: str | None, wrapper: list | None = None, constant: frozenset | set = frozenset()) -> str:
    return extract(html, wrapper, constant)[0]


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))


def _beside(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``rows(host, html, ...)`` with the columns of ``found(host, ...)``."""
    if fits_broadcast(found, BROADCAST_BYTES):
        return rows.join(F.broadcast(found), "host", how)
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], how)


def _next_unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each host the page with the smallest hashes that is unlike its references, among the task's rows."""
    known: dict = {}
    best: dict = {}
    for batch in batches:
        for host, h1, h2, html, refs in zip(*(batch.column(i) for i in range(5))):
            host, at = host.as_py(), (h1.as_py(), h2.as_py())
            if host in best and best[host][0] <= at:
                continue
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = [_texts(_found(r)) for r in refs.as_py()]
            page = html.as_py()
            if unlike(_texts(_found(page)), known[host]):
                best[host] = (at, page)
        if len(best) > 1000:
            yield _best(best)
            best.clear()
    yield _best(best)


def _best(best: dict) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    rows = [(host, *at, page) for host, (at, page) in best.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["host", "h1", "h2", "html"])


def templates(pages: DataFrame) -> DataFrame:
    """``(host, wrapper, constant)`` of hosts that have one; ``pages(url, html)``.

    The references are those of a scan over all pages of the host by hash. Each pass after the first finds the next one
    of every host that still lacks some, so there are at most ``REFERENCES`` passes, and a pass keeps one page a host.
    """
    full = pages.where(F.length("html") > 0).select(_host().alias("host"), F.xxhash64("html").alias("h1"), F.xxhash64(F.lit("page"), F.col("html")).alias("h2"), "html")
    keys = full.select("host", "h1", "h2").distinct()
    order = W.partitionBy("host").orderBy("h1", "h2")
    few = materialize(keys.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CANDIDATES + 1), "page-candidates")
    first = few.where(F.col("rank") <= CANDIDATES)
    first = F.broadcast(first) if fits_broadcast(few, BROADCAST_BYTES) else first
    picked = full.join(first.select("host", "h1", "h2"), ["host", "h1", "h2"], "left_semi").groupBy("host", "h1", "h2").agg(F.min("html").alias("html"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        htmls = list(pdf.sort_values(["h1", "h2"]).html)
        return pd.DataFrame({"host": [pdf.host.iloc[0]], "refs": [[htmls[i] for i in references(htmls)]]}, dtype=object)

    refs = picked.groupBy("host").applyInPandas(choose, "host string, refs array<string>")
    larger = few.where(F.col("rank") > CANDIDATES).select("host", F.lit(True).alias("larger"))
    state = refs.join(larger, "host", "left")
    state = materialize(state.select("host", "refs", (F.col("larger").isNotNull() & (F.size("refs") < REFERENCES)).alias("open")), "page-references")
    for _ in range(REFERENCES):
        lacking = state.where("open").select("host", "refs")
        if lacking.isEmpty():
            break
        lacking = materialize(lacking, "page-lacking")
        rows = _beside(full, lacking, "inner").select("host", "h1", "h2", "html", "refs")
        new = rows.mapInArrow(small_batches(_next_unlike), "host string, h1 long, h2 long, html string").groupBy("host").agg(F.min(F.struct("h1", "h2", "html")).alias("new"))
        grown = state.join(new.select("host", F.col("new.html").alias("html")), "host", "left")
        more = F.when(F.col("html").isNull(), F.col("refs")).otherwise(F.concat("refs", F.array("html")))
        state = materialize(grown.select("host", more.alias("refs"), (F.col("open") & F.col("html").isNotNull() & (F.size(more) < REFERENCES)).alias("open")), "page-references")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(host, *induce(r.as_py())) for host, r in zip(batch.column(0).to_pylist(), batch.column(1))]
            found = [(host, json.dumps(w) if w else None, keys) for host, w, keys in found if w or keys]
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["host", "wrapper", "constant"])

    return state.select("host", "refs").repartition(SALT, "host").mapInArrow(small_batches(run), "host string, wrapper string, constant array<string>")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        texts = []
        for host, html, wrapper, keys in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), batch.column(5)):
            if host not in known:
                if len(known) > 10_000:
                    known.clear()
                wrapper = wrapper.as_py()
                known[host] = (json.loads(wrapper) if wrapper else None, frozenset(keys.as_py() or ()))
            texts.append(extract(html.as_py(), *known[host]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([t for t, _ in texts], pa.string()), pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([w for _, w in texts], pa.bool_())],
            ["page_id", "url", "text", "n_chars", "by_wrapper"],
        )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, by_wrapper`` for every row; the last tells whether the host's wrapper found the text."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = materialize(templates(rows.select("url", "html")), "page-templates")
    rows = rows.withColumn("host", _host())
    rows = _beside(rows, found, "left")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "host", "html", "wrapper", "constant").mapInArrow(small_batches(_extract), f"page_id {kind}, url string, text string, n_chars long, by_wrapper boolean")
