"""Main text of web pages by wrapper induction."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter, OrderedDict
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import keep, text_slices, tidy

LEAST_PAGES = 4  # different pages of a host that must agree on a text before it counts as template
LINKED = 0.6  # share of link text from which a slot outside an article is a menu
MAIN = 0.8  # share of a host's varying text from which one place is where the main text is
CELLS = 1 << 18  # pairs of unlike neighbours up to which the best match is sought; beyond, neighbours of equal label match in order
FAN = 16
BROADCAST_BYTES = 16 << 20  # wrappers up to which they are broadcast; beyond, they are joined by host
_SLICE = 8 << 20

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math object canvas audio video".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_LEFT_OUT = frozenset("head script style title noscript iframe template svg math object canvas audio video nav header footer aside form button select option input textarea dialog menu fieldset map area embed link meta base".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_NAME = (
    r"(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|paywall|"
    r"sidebar|side|aside|widget|menu|menubar|nav|navbar|navigation|topbar|breadcrumbs?|pagination|pager|masthead|header|footer|foot|copyright|legal|disclaimer|"
    r"share|sharing|social|follow|related|recommend\w*|comments?|commentlist|disqus|replies|reply|respond|form|search|toolbar|skip|hidden)"
)
_UNSURE = re.compile(r"(?:side|foot|legal|disclaimer|share|follow|related|recommend\w*|reply|respond|form|search|skip)", re.I)  # of these, what text may be called too
_WHOLE, _PART = re.compile(_NAME, re.I), re.compile(rf"(?:^|[-_]){_NAME}(?:$|[-_])", re.I)
_NAMED = frozenset("div section ul ol dl table center".split())  # what a class or id can tell to be chrome; headings, paragraphs and inline elements never
_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_HOLDERS = frozenset("html body div section main article center table tbody tr td form".split())  # what may hold a whole main text
_TEXTUAL = frozenset("#text p h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl figure".split())  # what is text of the element that it stands in
_SCOPE = frozenset("ul ol dl table tbody thead tfoot tr select div article section main body html nav aside header footer form blockquote".split())


class Node:
    """An element that makes blocks, or a stretch of text (label ``#text``)."""

    __slots__ = ("label", "tag", "left_out", "named", "holds", "kids", "text", "links", "parent")

    def __init__(self, label: str, tag: str, left_out: bool = False, named: int = 0, parent: Node | None = None) -> None:
        self.label, self.tag, self.left_out, self.named, self.holds, self.kids, self.text, self.links, self.parent = label, tag, left_out, named, 0, [], "", 0, parent


def _chrome(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element is no part of the main text by its kind, role or state."""
    if tag in _LEFT_OUT or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in _ROLES:
        return True
    return "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _named(tag: str, attrs: dict[str, str]) -> int:
    """How surely a container's name tells chrome: 3 a whole class that names a header, 2 another whole class, 1 a class that text may have too, a part of a class or a whole id, 0 not at all.

    The id of a section is the slug of its heading and tells nothing.
    """
    if tag not in _NAMED:
        return 0
    classes = attrs.get("class", "").split()
    if whole := [x for x in classes if _WHOLE.fullmatch(x) and not _UNSURE.fullmatch(x)]:
        return 3 if all(x.lower() in ("header", "masthead") for x in whole) else 2
    if any(_PART.search(x) for x in classes):  # whole ones among them
        return 1
    return int(tag != "section" and "section" not in classes and bool(_WHOLE.fullmatch(attrs.get("id", "").strip())))


def _label(tag: str, attrs: dict[str, str]) -> str:
    names = sorted(re.sub(r"\d+", "0", x) for x in attrs.get("class", "").split())
    return tag + "".join("." + x for x in names)


def parse(html: str) -> Node:
    """The block tree of a page; lenient: unclosed, crossed and cut-off tags all give a tree."""
    root = Node("#root", "#root")
    stack, said, linked, links, mute = [root], [], 0, 0, []
    opened: Counter[str] = Counter()  # how often each tag is on the stack
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if said:
            text = " ".join(unescape("".join(said)).split())
            if text:
                leaf = Node("#text", "#text")
                leaf.text, leaf.links = text, min(linked, len(text))
                stack[-1].kids.append(leaf)
            said.clear()
        linked = 0

    def close(tags: set[str], until: frozenset[str]) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                opened.subtract(x.tag for x in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in until:
                return

    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            if not mute:
                said.append(html[at:])
            break
        if m.start() > at and not mute:
            said.append(html[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if html[at - 1] != ">" and at < n:  # an odd quote: the tag goes to the next >
            end = html.find(">", at)
            at = n if end < 0 else end + 1
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if mute:
                if mute[-1] == tag:
                    mute.pop()
                continue
            if tag in _INLINE:
                said.append(" " if tag == "br" else "")
            elif opened[tag]:
                flush()
                while stack[-1].tag != tag:
                    opened[stack.pop().tag] -= 1
                stack.pop()
                opened[tag] -= 1
            else:
                flush()  # a stray end tag still ends a block
            continue
        attrs = {k.lower(): next((v for v in (a, b, c) if v), "") for k, a, b, c in _ATTR.findall(m[3])} if m[3] else {}
        if tag in _RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = n if not end else (html.find(">", end.end()) + 1 or n)
            continue
        if tag in _INLINE:
            if mute:
                if tag == mute[-1]:
                    mute.append(tag)
                continue
            if tag == "br":
                said.append(" ")
            elif _chrome(tag, attrs) and tag not in _VOID:
                mute.append(tag)  # a left-out inline element: its text is no part of the block
            elif tag == "a":
                links += 1
            continue
        if mute:
            mute.clear()  # a block ends what an unclosed inline element hid
        if tag in _VOID:
            if tag in ("hr",):
                flush()
            continue
        flush()
        links = 0
        if stack[-1].tag == "p" or any(s.tag == "p" for s in stack[-3:]):
            close({"p"}, frozenset())
        if tag in _CLOSED_BY:
            close(_CLOSED_BY[tag], _SCOPE - _CLOSED_BY[tag])
        if tag == "body":
            close({"head"}, frozenset())
        node = Node(_label(tag, attrs), tag, _chrome(tag, attrs), _named(tag, attrs), stack[-1])
        if tag in ("h1", "main"):
            grade, x = 1 if tag == "h1" else 2, stack[-1]
            while x is not None and x.holds < grade:
                x.holds, x = grade, x.parent
        stack[-1].kids.append(node)
        stack.append(node)
        opened[tag] += 1
    flush()
    return root


def _least(a: list[int], b: list[int]) -> list[int]:
    """The smallest digests of two sorted lists, LEAST_PAGES of them at most."""
    if a == b or not b or len(a) == LEAST_PAGES and b[0] > a[-1]:
        return a
    return sorted({*a, *b})[:LEAST_PAGES]


class Tree:
    """A node of a wrapper: one place of the template, with what the pages have there.

    ``seen`` has the digests of different pages, LEAST_PAGES of them at most;
    ``mass`` counts the characters that are no links and in no element that
    says it is chrome. All work on trees goes by loops: pages nest as deep as
    they like.
    """

    __slots__ = ("label", "kids", "digest", "pages", "seen", "chars", "links", "mass", "leaves")

    def __init__(self, label: str) -> None:
        self.label, self.kids, self.digest, self.pages, self.seen, self.chars, self.links, self.mass, self.leaves = label, [], None, 1, [], 0, 0, 0, []

    @property
    def tag(self) -> str:
        return self.label.partition(".")[0]

    def walk(self):
        """The nodes, each before its kids."""
        stack = [self]
        while stack:
            t = stack.pop()
            yield t
            stack += t.kids[::-1]

    def shape(self) -> str:
        return "".join(f"{t.label}\0{len(t.kids)}\0" for t in self.walk())

    def dump(self) -> list:
        return [[t.label, t.digest, t.pages, t.seen, t.chars, t.links, t.mass, len(t.kids)] for t in self.walk()]

    @classmethod
    def load(cls, rows: list) -> Tree:
        above: list[tuple[Tree, int]] = []
        for row in rows:
            t = cls(row[0])
            t.digest, t.pages, t.seen, t.chars, t.links, t.mass = row[1:7]
            if above:
                above[-1][0].kids.append(t)
            else:
                root = t
            above.append((t, row[7]))
            while above and len(above[-1][0].kids) == above[-1][1]:
                above.pop()
        return root


def _weight(x: Tree, y: Tree, known: dict):
    """Nodes in the best match of two trees of equal label; yields the pairs of trees that it needs first."""
    p, q = x.kids, y.kids
    last = [0] * (len(q) + 1)
    if len(p) * len(q) > CELLS:
        return 1 + len(_in_order(p, q))
    for u in p:
        row = [0]
        for j, v in enumerate(q):
            best = max(last[j + 1], row[j])
            if u.label == v.label:
                if (id(u), id(v)) not in known:
                    known[id(u), id(v)] = yield u, v
                best = max(best, last[j] + known[id(u), id(v)])
            row.append(best)
        last = row
    return 1 + last[-1]


def weight(x: Tree, y: Tree, known: dict) -> int:
    """``_weight`` by an explicit stack."""
    stack, value = [_weight(x, y, known)], None
    while stack:
        try:
            stack.append(_weight(*stack[-1].send(value), known))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def _in_order(a: list[Tree], b: list[Tree]) -> list[tuple[int, int]]:
    """Each node with the next one of its label."""
    places: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y.label, []).append(j)
    pairs, after = [], 0
    for i, x in enumerate(a):
        where = places.get(x.label, [])
        k = bisect_left(where, after)
        if k < len(where):
            pairs.append((i, where[k]))
            after = where[k] + 1
    return pairs


def align(a: list[Tree], b: list[Tree], known: dict) -> list[tuple[int, int]]:
    """Simple tree matching of two forests: the pairs of an order-keeping match of most nodes.

    Neighbours that agree from either end on are matched at once; what is
    between them is a grid of the weights of its pairs (``known`` has those
    worked out).
    """
    low, high = 0, 0
    least = min(len(a), len(b))
    while low < least and a[low].label == b[low].label:
        low += 1
    while high < least - low and a[-1 - high].label == b[-1 - high].label:
        high += 1
    head = [(i, i) for i in range(low)]
    tail = [(len(a) - k, len(b) - k) for k in range(high, 0, -1)]
    p, q = a[low : len(a) - high], b[low : len(b) - high]
    if not p or not q:
        return head + tail
    if len(p) * len(q) > CELLS:
        return head + [(i + low, j + low) for i, j in _in_order(p, q)] + tail
    w = [[0] * (len(q) + 1)]
    for x in p:
        row = [0]
        for j, y in enumerate(q):
            best = max(w[-1][j + 1], row[j])
            if x.label == y.label:
                if (id(x), id(y)) not in known:
                    known[id(x), id(y)] = weight(x, y, known)
                best = max(best, w[-1][j] + known[id(x), id(y)])
            row.append(best)
        w.append(row)
    middle, i, j = [], len(p), len(q)
    while i and j:
        if w[i][j] == w[i - 1][j]:
            i -= 1
        elif w[i][j] == w[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            middle.append((i + low, j + low))
    return head + middle[::-1] + tail


def merge(a: Tree, b: Tree, same_page: bool = False) -> None:
    """Add ``b`` to ``a``: matched nodes become one, others are put in at their place."""
    known: dict = {}
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if same_page:
            a.digest = xxhash.xxh64_intdigest(f"{a.digest}/{b.digest}") >> 1
            a.leaves += b.leaves
        else:
            a.pages, a.seen = a.pages + b.pages, _least(a.seen, b.seen)
            if a.digest != b.digest:
                a.digest = -1
        a.chars, a.links, a.mass = a.chars + b.chars, a.links + b.links, a.mass + b.mass
        if not b.kids:
            continue
        kids, i = [], 0
        of = {j: i for i, j in align(a.kids, b.kids, known)}
        for j, y in enumerate(b.kids):
            if j in of:
                kids += a.kids[i : of[j] + 1]
                todo.append((a.kids[of[j]], y))
                i = of[j] + 1
            else:
                kids.append(y)
        a.kids = kids + a.kids[i:]


class Block:
    """A block of text: whether an element around it says that it is no main text, and whether it is in an article or main element."""

    __slots__ = ("text", "out", "inside")

    def __init__(self, text: str, out: bool, inside: bool) -> None:
        self.text, self.out, self.inside = text, out, inside


class _Around:
    """What the elements around a place say.

    An element is chrome by kind, role, state or the whole of a class that
    names adverts, notices, menus, sidebars, footers or comments. The
    heading of an article stays in a header. Where only a part of a name, an
    id, or a class that text may have too (legal, form, related ...) tells chrome, an element in an article or main stays for the
    wrapper to decide on, and so does one that holds the page's h1 or main.
    """

    __slots__ = ("out", "header", "heading", "article", "main")

    def __init__(self, above: _Around | None, e: Node) -> None:
        if above is None:
            self.out = self.header = self.heading = self.article = self.main = False
        else:
            self.out, self.header, self.heading, self.article, self.main = above.out, above.header, above.heading, above.article, above.main
        if e.left_out or e.named > 1 and e.holds < 2:
            if self.article and (e.tag == "header" or e.named == 3 and not e.left_out):
                self.header, self.heading = True, False
            else:
                self.out = True
        elif e.named == 1 and not e.holds and not (self.article or self.main):
            self.out = True
        self.heading = self.heading or e.tag in ("h1", "h2")
        self.article, self.main = self.article or e.tag == "article", self.main or e.tag == "main"

    def block(self, text: str) -> Block:
        return Block(text, self.out or self.header and not self.heading, self.article or self.main)


def page_tree(root: Node) -> tuple[Tree, list[Block]]:
    """(tree with repeated neighbours folded into one, the page's blocks)."""
    blocks: list[Block] = []
    tree = Tree(root.label)
    stack = [(root, tree, iter(root.kids), _Around(None, root))]
    while stack:
        node, t, kids, around = stack[-1]
        kid = next(kids, None)
        if kid is None:
            stack.pop()
            t.digest = xxhash.xxh64_intdigest("/".join([str(k.digest) for k in t.kids])) >> 1
            t.chars, t.links, t.mass = sum([k.chars for k in t.kids]), sum([k.links for k in t.kids]), sum([k.mass for k in t.kids])
            got, to = t, stack[-1][1] if stack else None
        elif kid.tag != "#text":
            stack.append((kid, Tree(kid.label), iter(kid.kids), _Around(around, kid)))
            continue
        else:
            block = around.block(kid.text)
            got, to = Tree(kid.label), t
            got.digest, got.chars, got.links, got.leaves = xxhash.xxh64_intdigest(kid.text) >> 1, len(kid.text), kid.links, [len(blocks)]
            got.mass = 0 if block.out else got.chars - got.links
            blocks.append(block)
        if to is not None:
            if to.kids and to.kids[-1].label == got.label:
                merge(to.kids[-1], got, True)
            else:
                to.kids.append(got)
    for t in tree.walk():
        t.seen = [tree.digest]
    return tree, blocks


def _constant(t: Tree) -> bool:
    """Whether a place has the same text on all pages, LEAST_PAGES different ones at least."""
    return t.digest != -1 and len(t.seen) >= LEAST_PAGES


def content_places(tree: Tree) -> set[int]:
    """The places (ids of nodes) that hold the main text of a wrapper.

    From the root on, the place with at least ``MAIN`` of all varying text is
    gone into, as long as it is one that may hold a whole text, takes the h1
    along, and has no varying text right beside it. Where no place has that
    much, article elements below decide (else main elements), if there are
    any.
    """
    nodes = list(tree.walk())
    mass: dict[int, int] = {}
    h1: dict[int, bool] = {}
    for t in reversed(nodes):
        mass[id(t)] = sum(mass[id(k)] for k in t.kids) if t.label != "#text" else 0 if _constant(t) else t.mass
        h1[id(t)] = t.tag == "h1" or any(h1[id(k)] for k in t.kids)
    at = tree
    while at.kids and at.tag != "article":
        best = max(at.kids, key=lambda k: mass[id(k)])
        if best.tag not in _HOLDERS or mass[id(best)] < MAIN * mass[id(tree)] or h1[id(at)] and not h1[id(best)] or any(mass[id(k)] for k in at.kids if k.tag in _TEXTUAL):
            break
        at = best
    if at.tag == "article":
        return {id(at)}
    for tag in ("article", "main"):
        found, stack = set(), [at]
        while stack:
            t = stack.pop()
            if t.tag == tag and mass[id(t)]:
                found.add(id(t))
            else:
                stack += t.kids
        if found:
            return found
    return {id(at)}


def _below(tree: Tree, places: set[int]) -> set[int]:
    """Numbers (in walking order) of the nodes that are or are in ``places``."""
    found, stack, i = set(), [(tree, False)], 0
    while stack:
        t, inside = stack.pop()
        inside = inside or id(t) in places
        if inside:
            found.add(i)
        i += 1
        stack += [(k, inside) for k in t.kids[::-1]]
    return found


def _added(a: Tree, b: Tree) -> None:
    """``merge`` of trees of equal shape."""
    for x, y in zip(a.walk(), b.walk(), strict=True):
        x.pages, x.seen, x.chars, x.links, x.mass = x.pages + y.pages, _least(x.seen, y.seen), x.chars + y.chars, x.links + y.links, x.mass + y.mass
        if x.digest != y.digest:
            x.digest = -1


class Wrapper:
    """What the pages of a host have in common; pages of equal shape are added first, shapes are aligned when it is closed."""

    def __init__(self) -> None:
        self.shapes: dict[str, Tree] = {}

    def add(self, tree: Tree) -> None:
        if (shape := tree.shape()) in self.shapes:
            _added(self.shapes[shape], tree)
        else:
            self.shapes[shape] = tree
            if len(self.shapes) > 64:
                self.shapes = {(t := self.one()).shape(): t}

    def one(self) -> Tree:
        trees = sorted(self.shapes.values(), key=lambda t: (-t.pages, t.shape()))
        for t in trees[1:]:
            merge(trees[0], t)
        return trees[0]

    def dump(self) -> str:
        return json.dumps(self.one().dump(), separators=(",", ":"))


class Extractor:
    """Main text of pages, given their host's wrapper."""

    def __init__(self) -> None:
        self.wrappers: OrderedDict[str, tuple[Tree | None, set[int], dict]] = OrderedDict()

    def marks(self, wrapper: str | None, tree: Tree) -> tuple[set[int], set[int], set[int]]:
        """Nodes (in walking order) of a page's tree that are constant over the host, those that are mostly links, and those where the host's pages have their main text."""
        if not wrapper:
            return set(), set(), set()
        if wrapper not in self.wrappers:
            common = Tree.load(json.loads(wrapper))
            common = common if len(common.seen) >= LEAST_PAGES and common.digest == -1 else None
            self.wrappers[wrapper] = common, content_places(common) if common else set(), {}
            if len(self.wrappers) > 1000:
                self.wrappers.popitem(last=False)
        common, places, known = self.wrappers[wrapper]
        if common is None:
            return set(), set(), set()
        shape = tree.shape()
        if shape not in known:
            if len(known) > 1000:
                known.clear()
            number = {id(t): i for i, t in enumerate(tree.walk())}
            constant: set[int] = set()
            linked: set[int] = set()
            main: set[int] = set()
            weights: dict = {}
            todo = [(tree, common)]
            while todo:
                x, y = todo.pop()
                if id(y) in places:
                    main.add(id(x))
                if x.label == "#text":
                    if _constant(y):
                        constant.add(number[id(x)])
                    if y.chars and y.links >= LINKED * y.chars:
                        linked.add(number[id(x)])
                todo += [(x.kids[i], y.kids[j]) for i, j in align(x.kids, y.kids, weights)]
            known[shape] = constant, linked, _below(tree, main)
        return known[shape]

    def text(self, html: str, wrapper: str | None) -> str:
        tree, blocks = page_tree(parse(html))
        constant, linked, main = self.marks(wrapper, tree)

        def chosen(places: set[int]) -> list[int]:
            inside, marked = [], set()
            for i, t in enumerate(tree.walk()):
                if t.leaves and i in places:
                    inside += [b for b in t.leaves if not blocks[b].out]
                    marked |= {b for b in t.leaves if i in constant or i in linked and not blocks[b].inside}
            inside.sort()
            stays = [b for b in inside if b not in marked]
            size = lambda some: sum(len(blocks[b].text) for b in some)
            article = bool(inside) and all(blocks[b].inside for b in inside)
            return inside if article and 2 * size(stays) < size(inside) else stays or inside

        stays = chosen(main) or chosen(_below(tree, content_places(tree)))
        return "\n".join(blocks[b].text for b in stays)


def _induced(batches):
    """Per task and host one wrapper."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()
    hosts: OrderedDict[str, Wrapper] = OrderedDict()

    def rows(some):
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in some], pa.string()), pa.array([number] * len(some), pa.int64()), pa.array([w.dump() for _, w in some], pa.string())], names=["host", "part", "wrapper"])

    for batch in batches:
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tree, _ = page_tree(parse(html.as_py() or ""))
            hosts.setdefault(host, Wrapper()).add(tree)
            if len(hosts) > 2000:
                yield rows([hosts.popitem(last=False) for _ in range(500)])
    if hosts:
        yield rows(list(hosts.items()))


def _unified(batches):
    """Rows sorted by host and part: one wrapper for each."""
    at, held = None, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "wrapper")), strict=True):
            if row[:2] != at:
                if held is not None:
                    yield pa.RecordBatch.from_pydict({"host": [at[0]], "part": [at[1]], "wrapper": [held.dump()]}, schema=_WRAPPERS)
                at, held = row[:2], Wrapper()
            held.add(Tree.load(json.loads(row[2])))
    if held is not None:
        yield pa.RecordBatch.from_pydict({"host": [at[0]], "part": [at[1]], "wrapper": [held.dump()]}, schema=_WRAPPERS)


_WRAPPERS = pa.schema([("host", pa.string()), ("part", pa.int64()), ("wrapper", pa.string())])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from (host, html): a wrapper per task and host, merged in two rounds, so a hot host's pages meet as a few small trees."""
    parts = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    level = pages.select("host", "html").mapInArrow(tidy(_induced), "host string, part long, wrapper string")
    for part in (F.col("part") % FAN, F.lit(0).cast("long")):
        level = level.withColumn("part", part).repartition(parts, "host", "part").sortWithinPartitions("host", "part", "wrapper").mapInArrow(tidy(_unified), "host string, part long, wrapper string")
    return level.select("host", "wrapper")


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every row of ``pages`` with text and n_chars (code points).

    Pages of one host are parsed to block trees, in which repeated neighbours
    are folded, and aligned by simple tree matching to the host's wrapper. A
    slot whose text is the same on all its pages (four different ones at
    least) is template. The main text of the host is where its pages' varying
    text is: the wrapper is gone into as long as one place has four fifths of
    all that varies and no such text right beside it; article (else main) elements decide where none has.
    What varies in that place is a page's main text, and what lies elsewhere
    is not. A page that has nothing there, or whose host has fewer than four
    different pages, is its own wrapper, on which all text counts as varying.

    In that place, elements that say by kind, role, state or the whole of a
    class that they are no article text (forms, comments, asides, adverts) go
    too, and their text has no weight in finding it; a part of a class or an
    id counts outside articles only. Outside articles, slots that are mostly
    links go. Where more than half of an article would go as template, it
    stays whole.

    Inside a block white space is one blank; blocks are joined by a line feed
    in page order. A null html counts as empty and gives an empty text; a null
    or odd url belongs to no host's wrapper but that of all such pages;
    repeated rows are pages of their own but one page for the wrapper (only
    the share of links is taken over rows). An empty table gives no rows; columns of the new names are replaced.
    """
    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    rows = pages.select(*rest, F.coalesce(F.lower(F.try_parse_url(F.col(url_col).cast("string"), F.lit("HOST"))), F.lit("")).alias("_host"), F.col(html_col).cast("string").alias("_html"))
    found = keep(wrappers(rows.select(F.col("_host").alias("host"), F.col("_html").alias("html"))), "wrappers").withColumnsRenamed({"host": "_of", "wrapper": "_wrapper"})
    small = (found.agg(F.sum(F.octet_length("_wrapper"))).first()[0] or 0) <= BROADCAST_BYTES
    joined = rows.join(F.broadcast(found) if small else found, F.col("_host") == F.col("_of"), "left").select(*rest, "_wrapper", "_html")
    schema = joined.select(*rest, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def extract(batches):
        extractor = Extractor()
        for batch in batches:
            html = batch.column(batch.num_columns - 1)
            for a, b in text_slices(html, _SLICE):
                own = batch.slice(a, b - a)
                texts = [extractor.text(h or "", w) for h, w in zip(own.column(own.num_columns - 1).to_pylist(), own.column(own.num_columns - 2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*own.columns[:-2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    return joined.mapInArrow(tidy(extract), schema)
