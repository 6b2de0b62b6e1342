"""Main text of web pages by wrapper induction.

The DOM trees of a host's pages are aligned by simple tree matching into one template, the wrapper: runs of equal
siblings fold into one node, and every text slot knows whether its text was the same on all pages (template) or
varied (slot). The wrapper says which region holds the article and which of its slots are boilerplate; a page's
text is read off by aligning it with its host's wrapper. Pages of a host with and without an element that marks the
article have wrappers of their own. Wrappers merge in any order, so they are built by
partition, then by host and salt, then by host.

Trees are walked with stacks, so a page may be nested as deep as it likes. Repeated groups of siblings fold, and long
lists of unlike ones align by what they share in order, so a page takes time in proportion to its size. A wrapper is
bounded: slots of low support go first, then the deepest levels; what has no slot follows the element around it.
"""

from __future__ import annotations

import html as _html
import json
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.kit import Tables, arrow, groups

#: Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags before which an open element of the set ends.
_P_ENDERS = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
ENDS = {t: {"p"} for t in _P_ENDERS} | {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}, "body": {"head"}}
#: An element that implied ends don't reach beyond.
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}}

#: Elements that are never article text, and words of classes, ids and roles that say so.
DROP_TAGS = set("head script style noscript template nav footer aside form button select option textarea input iframe object svg canvas dialog menu title xmp noembed noframes datalist audio video map".split())
DROP_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus respond replies share sharing social "
    "related recommended newsletter subscribe signup login search toolbar widget pagination pager copyright disclaimer skip masthead topbar complementary contentinfo dialog".split()
)
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that may wrap a whole article; any other is a block of one.
WRAPS = {"#root", "html", "body", "div", "section", "center"}


class Node:
    """An element; kids are Nodes and, for text, Leafs."""

    __slots__ = ("kids", "sig", "tag")

    def __init__(self, tag: str, sig: str):
        self.tag, self.sig, self.kids = tag, sig, []


class Leaf:
    """A text block: its text, and how much of it is in links."""

    __slots__ = ("links", "text")
    sig = tag = "#text"

    def __init__(self, text: str, links: int):
        self.text, self.links = text, links


_ATTR = re.compile(r"""(?<![^\s=/"'>])([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: From such a word on, a class says how an element is laid out, not what it is: has-sidebar, noComments.
_FLAG = re.compile(r"(?:(?<![A-Za-z])(?:has|no|with|without)(?=[-_A-Z])|(?<=[a-z])(?:Has|No|With|Without)(?=[-_A-Z]))\S*")


def _signature(tag: str, attrs: str) -> str:
    if "=" not in attrs:
        return tag
    said = []
    for name, *values in _ATTR.findall(attrs):
        name = name.lower()
        if name in ("class", "id", "role"):
            value = next((v for v in values if v), "")
            said += [f.lower() for f in _FLAG.findall(value)] + [w.lower() for w in _WORD.findall(_FLAG.sub("", value))]
    return f"{tag} {' '.join(sorted(set(said)))}" if said else tag


def parse(source: str) -> Node:
    """A lenient tree: unknown ends are ignored, open elements end with the page, inline tags leave no node."""
    root = Node("#root", "#root")
    stack, n, at = [root], len(source), 0
    opened: Counter[str] = Counter()  # tags of the stack
    text: list[str] = []
    links = in_link = 0
    no_more = {'"': False, "'": False}

    def end_from(i: int):
        for node in stack[i:]:
            opened[node.tag] -= 1
        del stack[i:]

    def flush():
        nonlocal links
        if text:
            said = " ".join(_html.unescape("".join(text)).split())
            if said:
                stack[-1].kids.append(Leaf(said, min(links, len(said))))
            text.clear()
        links = 0

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text.append(source[at:lt])
            if in_link:
                links += lt - at
        if lt >= n:
            break
        after = source[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = after == "/"
        first = source[lt + 2 : lt + 3] if closing else after
        if not (first.isascii() and first.isalpha()):
            text.append("<")
            at = lt + 1
            continue
        end = source.find(">", lt)
        if end < 0:
            break  # a tag cut off by the page's end
        inside = source[lt + 1 + closing : end]
        for quote in "\"'":  # a ">" within a quoted value doesn't end the tag
            while inside.count(quote) % 2 and not no_more[quote]:
                q = source.find(quote, end)
                if q < 0:
                    no_more[quote] = True
                    break
                more = source.find(">", q)
                if more < 0:
                    break
                end = more
                inside = source[lt + 1 + closing : end]
        at = end + 1
        m = re.match(r"[^\s/>]+", inside)
        tag = m[0].lower()
        if tag == "br" or tag == "wbr":
            text.append(" " if tag == "br" else "")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            continue
        flush()
        if closing:
            in_link = 0
            if opened[tag]:
                end_from(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        ends = ENDS.get(tag)
        if ends:
            fences = FENCES.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                if not any(opened[e] for e in ends):
                    break
                if stack[i].tag in ends:
                    end_from(i)
                elif stack[i].tag in fences or tag not in FENCES:
                    break
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*[/>]?", re.I).search(source, at)
            at = n if close is None else max(source.find(">", close.start()) + 1, close.end())
            continue
        if inside.endswith("/") and tag in ("path", "rect", "circle", "use", "g", "svg"):
            continue
        node = Node(tag, _signature(tag, inside[m.end() :]))
        stack[-1].kids.append(node)
        stack.append(node)
        opened[tag] += 1
    flush()
    return root


# A template node is a list: [sig, pages, occurrences, text hash or None (varying), characters, characters in links, kids,
# the node that it was merged into or None].
SIG, PAGES, TIMES, SAME, CHARS, LINKS, KIDS, INTO = range(8)
#: Siblings of a group that folds when it comes again, and siblings beyond which all of a kind fold.
GROUP, WIDE = 8, 64
#: Products of sizes up to which trees are matched exactly, and lists by all pairs.
EXACT, PAIRS = 40_000, 10_000


def preorder(top, kids) -> list:
    """All nodes of a tree, each before its kids."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(kids(node)))
    return out


def _page_kids(node) -> list:
    return () if isinstance(node, Leaf) else node.kids


def _template_kids(t: list) -> list:
    return t[KIDS]


def templates(page) -> dict[int, list]:
    """id() of each node of a page -> its node of the page's template, or one that was merged into it."""
    out: dict[int, list] = {}
    for node in reversed(preorder(page, _page_kids)):
        if isinstance(node, Leaf):
            out[id(node)] = [node.sig, 1, 1, xxhash.xxh3_64_hexdigest(node.text), len(node.text), node.links, [], None]
        else:
            out[id(node)] = [node.sig, 1, 1, "", 0, 0, _folded([out[id(k)] for k in node.kids]), None]
    return out


def template(page) -> list:
    """The template of one page's node."""
    return templates(page)[id(page)]


def _folded(kids: list[list]) -> list[list]:
    """Siblings with runs of equal ones, and groups that come again at once, folded."""
    out: list[list] = []
    for t in kids:
        out.append(t)
        for size in range(1, min(GROUP, len(out) // 2) + 1):
            if all(out[-i][SIG] == out[-i - size][SIG] for i in range(1, size + 1)):
                for x, y in zip(out[-2 * size : -size], out[-size:]):
                    merge(x, y, 0)
                del out[-size:]
                break
    if len(out) > WIDE:
        out, more = _of_a_kind(out)
        for x, y in more:
            merge(x, y, 0)
    return out


def _of_a_kind(kids: list[list]) -> tuple[list[list], list[tuple[list, list]]]:
    """(the first sibling of each signature, the others with it)"""
    first: dict[str, list] = {}
    more = []
    for t in kids:
        if first.setdefault(t[SIG], t) is not t:
            more.append((first[t[SIG]], t))
    return list(first.values()), more


def matched(a: list, b: list) -> int:
    """Simple tree matching: nodes of the largest order-keeping matching of two trees whose roots match."""
    return _matched(a, b, {})


def _matched(a: list, b: list, known: dict) -> int:
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        key = id(x), id(y)
        if key not in known and x[SIG] != y[SIG]:
            known[key] = 0
        if key in known:
            stack.pop()
            continue
        need = [(p, q) for p in x[KIDS] for q in y[KIDS] if p[SIG] == q[SIG] and (id(p), id(q)) not in known]
        if need:
            stack += need
            continue
        known[key] = 1 + _best(x[KIDS], y[KIDS], lambda p, q: known[id(p), id(q)])[0]
    return known[id(a), id(b)]


def _best(a: list, b: list, weight) -> tuple[int, list[tuple[int, int]]]:
    """The order-keeping pairing of two lists with the greatest sum of weights of nodes of a signature."""
    own = [[weight(x, y) if x[SIG] == y[SIG] else 0 for y in b] for x in a]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + own[i][j] if own[i][j] else 0)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if own[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + own[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1], pairs[::-1]


def _nodes(kids: list[list], most: int) -> int:
    """Nodes of some trees; counting ends beyond most."""
    n, stack = 0, list(kids)
    while stack and n <= most:
        n += 1
        stack += stack.pop()[KIDS]
    return n


def _shallow(x: list, y: list) -> int:
    """A stand-in for the matching of two large trees: kinds of kids that both have."""
    return 1 + len({k[SIG] for k in x[KIDS]} & {k[SIG] for k in y[KIDS]})


def _in_order(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """The longest order-keeping pairing of the first nodes of each signature (a longest increasing subsequence)."""
    place: dict[str, int] = {}
    for j, y in enumerate(b):
        place.setdefault(y[SIG], j)
    tails: list[int] = []  # the least last place of a chain of each length
    ends: list[tuple[int, int]] = []
    links: list[int] = []
    at_tail: list[int] = []
    for i, x in enumerate(a):
        j = place.pop(x[SIG], None)
        if j is None:
            continue
        k = bisect_left(tails, j)
        tails[k : k + 1] = [j]
        links.append(at_tail[k - 1] if k else -1)
        at_tail[k : k + 1] = [len(ends)]
        ends.append((i, j))
    out, e = [], at_tail[-1] if at_tail else -1
    while e >= 0:
        out.append(ends[e])
        e = links[e]
    return out[::-1]


def _align(a: list, b: list) -> list[tuple[int, int]]:
    """An order-keeping pairing of two lists of kids: the best one unless they are very large."""
    if [x[SIG] for x in a] == [x[SIG] for x in b]:
        return [(i, i) for i in range(len(a))]
    if _nodes(a, EXACT) * _nodes(b, EXACT) <= EXACT:
        known: dict = {}
        return _best(a, b, lambda x, y: _matched(x, y, known))[1]
    low, end_a, end_b = 0, len(a), len(b)
    while low < end_a and low < end_b and a[low][SIG] == b[low][SIG]:
        low += 1
    while end_a > low and end_b > low and a[end_a - 1][SIG] == b[end_b - 1][SIG]:
        end_a, end_b = end_a - 1, end_b - 1
    left, right = a[low:end_a], b[low:end_b]
    inner = _best(left, right, _shallow)[1] if len(left) * len(right) <= PAIRS else _in_order(left, right)
    return [(i, i) for i in range(low)] + [(low + i, low + j) for i, j in inner] + [(end_a + i, end_b + i) for i in range(len(a) - end_a)]


def merge(into: list, other: list, pages: int = 1) -> None:
    """Adds a template to another, which takes its nodes over; pages: 0 if both are of one page."""
    stack = [(into, other, pages)]
    while stack:
        x, y, n = stack.pop()
        x[PAGES] += y[PAGES] * n
        x[TIMES] += y[TIMES]
        x[CHARS] += y[CHARS]
        x[LINKS] += y[LINKS]
        if x[SAME] != y[SAME]:
            x[SAME] = None
        y[INTO] = x
        a, b, out, i, j = x[KIDS], y[KIDS], [], 0, 0
        if not b:
            continue
        for p, q in _align(a, b) if a else ():
            out += a[i:p] + b[j:q]
            out.append(a[p])
            stack.append((a[p], b[q], n))
            i, j = p + 1, q + 1
        out += a[i:] + b[j:]
        if len(out) > WIDE:
            out, more = _of_a_kind(out)
            stack = [(p, q, 0) for p, q in more] + stack  # after the pairs above, whose nodes they may hold
        x[KIDS] = out


def settled(t: list) -> list:
    """The node that t was merged into in the end."""
    while t[INTO] is not None:
        if t[INTO][INTO] is not None:
            t[INTO] = t[INTO][INTO]
        t = t[INTO]
    return t


def bounded(top: list, most: int, support: int) -> int:
    """Cuts a template down to most nodes, and counts them: slots of few pages go first, then the deepest levels."""
    n, low = _nodes([top], most), 2
    while n > most and 2 * low <= max(2 * support, top[PAGES]):
        for t in preorder(top, _template_kids):
            t[KIDS] = [k for k in t[KIDS] if k[PAGES] >= low]
        n, low = _nodes([top], most), 2 * low
    if n <= most:
        return n
    level, n = [top], 1
    while level:
        below = [k for t in level for k in t[KIDS]]
        if n + len(below) > most:
            for t in level:
                t[KIDS] = []
            break
        level, n = below, n + len(below)
    return n


@dataclass(frozen=True)
class Wrapper:
    #: Pages on which a slot must have had one text before it is template.
    support: int = 8
    #: Blocks whose text is in links to this share are lists of links.
    link_share: float = 0.5
    salts: int = 32
    #: Nodes of a host's wrapper of one layout.
    most_nodes: int = 1_000


def _dropped(sig: str, inside: bool, holds: bool) -> bool:
    tag, *words = sig.split(" ")
    if tag in DROP_TAGS:
        return True
    if tag == "header" and not inside:
        return not holds
    if tag in ("#root", "html", "body", "main") or holds:
        return False
    if tag == "article":
        return "comment" in words or "comments" in words
    if "header" in words and not inside:
        return True
    return not DROP_WORDS.isdisjoint(words)


def _marks(sig: str, wanted: str) -> bool:
    return (sig.split(" ")[0] == wanted or wanted == "main" and sig.endswith(" main")) and not _dropped(sig, False, False)


def layout(page: Node) -> str:
    """What marks a page's article: "article", "main" or, where nothing does, ""."""
    found, stack = "", [page]
    while stack:
        node = stack.pop()
        if isinstance(node, Leaf) or node.sig.split(" ")[0] in DROP_TAGS:
            continue
        if _marks(node.sig, "article"):
            return "article"
        if _marks(node.sig, "main"):
            found = "main"
        stack += node.kids
    return found


def roles(top: list, conf: Wrapper) -> dict[int, bool]:
    """Template node (by id()) -> whether its text is article text; nodes that aren't in it have their parent's role.

    The template is of pages of one layout. What alignment says comes first: a constant slot is template, a varying one
    may be content, and the region is the smallest element that holds the varying text. Marks and names only tell
    varying slots apart.
    """
    nodes = preorder(top, _template_kids)
    tag = {id(t): t[SIG].split(" ")[0] for t in nodes}

    def fixed(t: list) -> bool:
        return t[SAME] is not None and t[PAGES] >= conf.support and t[TIMES] == t[PAGES]

    def loose(t: list) -> int:
        return t[CHARS] if t[SIG] == "#text" and not fixed(t) and t[LINKS] <= conf.link_share * t[CHARS] else 0

    def weigh(tops: list[list], own, gone) -> dict[int, int]:
        """Sum of own over the slots of each node under tops; an element that is gone has none."""
        size: dict[int, int] = {}
        for one in tops:
            for t in reversed(preorder(one, _template_kids)):
                size[id(t)] = 0 if gone(t) else own(t) + sum(size[id(k)] for k in t[KIDS])
        return size

    def topmost(wanted: str) -> list[list]:
        out, stack = [], [top]
        while stack:
            t = stack.pop()
            if tag[id(t)] in DROP_TAGS:
                continue
            if _marks(t[SIG], wanted):
                out.append(t)
            else:
                stack += t[KIDS]
        return out

    out: dict[int, bool] = {}

    def settle(top: list, varies: bool) -> None:
        stack = [(top, True, varies, True)]
        while stack:  # within: whether t lies in an article, not right in the page, whose header is the site's
            t, inside, varies, within = stack.pop()
            keep = inside and not _dropped(t[SIG], within, id(t) in holding)
            if keep and t[SIG] == "#text":
                keep = not (fixed(t) and varies)
            out[id(t)] = keep
            below = keep, varies and tag[id(t)] not in HEADS, tag[id(t)] not in ("#root", "html", "body")
            stack += [(k, *below) for k in t[KIDS]]

    marked = topmost("article") or topmost("main")
    by_tag = lambda t: tag[id(t)] in DROP_TAGS
    size = weigh(marked or [top], loose, by_tag)
    most = sum(size[id(t)] for t in marked or [top])
    if not most and marked:
        size = weigh(marked, lambda t: t[CHARS], by_tag)
        most = sum(size[id(t)] for t in marked)
    #: Elements that hold most of the varying text; no class word drops them.
    holding = {i for i, n in size.items() if 2 * n > most}
    if marked:
        for t in marked:
            settle(t, any(not fixed(x) for x in preorder(t, _template_kids) if x[SIG] == "#text"))
        return out
    varying = weigh([top], loose, lambda t: _dropped(t[SIG], False, id(t) in holding))
    total, region = varying[id(top)], top
    while total:  # down to the smallest wrapping element that holds all of it
        inner = next((k for k in region[KIDS] if varying[id(k)] == total), None)
        if inner is None or tag[id(inner)] not in WRAPS or inner[TIMES] > inner[PAGES]:
            break
        region = inner
    settle(region, True)
    for t in preorder(region, _template_kids):
        if t[SIG] == "#text" and t[LINKS] > conf.link_share * t[CHARS]:
            out[id(t)] = False
    return out


def read_off(page: Node, wrapper: list | None, said: dict[int, bool]) -> list[str]:
    """The texts of a page's slots that are article text, by aligning the page's template with its host's wrapper."""
    mates: dict[int, list] = {}
    own: dict[int, list] = {}
    if wrapper is not None:
        own = templates(page)
        stack = [(own[id(page)], wrapper)]
        while stack:
            t, w = stack.pop()
            mates[id(t)] = w
            if t[KIDS] and w[KIDS]:
                stack += [(t[KIDS][i], w[KIDS][j]) for i, j in _align(t[KIDS], w[KIDS])]
    out: list[str] = []
    todo = [(page, False)]
    while todo:
        node, inside = todo.pop()
        w = mates.get(id(settled(own[id(node)]))) if own else None
        if w is not None:
            inside = said.get(id(w), inside)
        elif inside and _dropped(node.sig, True, False):
            inside = False
        if isinstance(node, Leaf):
            if inside:
                out.append(node.text)
        else:
            todo += [(k, inside) for k in reversed(node.kids)]
    return out


def main_text(source: str | None, known: dict[str, tuple[list, dict[int, bool]]]) -> str:
    """known: layout -> the host's wrapper of such pages, and its roles."""
    if not source:
        return ""
    page = parse(source)
    return " ".join(read_off(page, *known.get(layout(page), (None, {}))))


def packed(t: list) -> list[list]:
    """A template as a flat list: [depth, sig, pages, ..., characters in links] of its nodes, each before its kids."""
    out, stack = [], [(0, t)]
    while stack:
        depth, t = stack.pop()
        out.append([depth, *t[:KIDS]])
        stack += [(depth + 1, k) for k in reversed(t[KIDS])]
    return out


def unpacked(rows: list[list]) -> list:
    path: list[list] = []
    for depth, *values in rows:
        t = [*values, [], None]
        del path[depth:]
        if path:
            path[-1][KIDS].append(t)
        path.append(t)
    return path[0]


PARTS = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.string())])


class _Found:
    """Wrappers by host and layout while they grow, bounded."""

    #: Nodes beyond which a task gives its wrappers out.
    MOST = 200_000

    def __init__(self, conf: Wrapper):
        self.conf, self.hosts, self.nodes = conf, {}, 0
        self.sizes: Counter[tuple] = Counter()

    def add(self, host, kind: str, t: list) -> None:
        kinds = self.hosts.setdefault(host, {})
        n = _nodes([t], 1 << 40)
        if kind in kinds:
            merge(kinds[kind], t)
        else:
            kinds[kind] = t
        self.sizes[host, kind] += n
        self.nodes += n
        if self.sizes[host, kind] > 4 * self.conf.most_nodes:
            left = bounded(kinds[kind], self.conf.most_nodes, self.conf.support)
            self.nodes += left - self.sizes[host, kind]
            self.sizes[host, kind] = left

    def given(self, salt: int) -> pa.RecordBatch:
        said = []
        for kinds in self.hosts.values():
            for t in kinds.values():
                bounded(t, self.conf.most_nodes, self.conf.support)
            said.append(json.dumps({kind: packed(t) for kind, t in kinds.items()}, separators=(",", ":")))
        out = arrow({"host": list(self.hosts), "salt": [salt] * len(said), "wrapper": said}, PARTS)
        self.__init__(self.conf)
        return out


def _induced(conf: Wrapper):
    def run(batches):
        from pyspark import TaskContext

        salt, found = TaskContext.get().partitionId(), _Found(conf)
        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if source:
                    page = parse(source)
                    found.add(host, layout(page), template(page))
                    if found.nodes > found.MOST:
                        yield found.given(salt)
        yield found.given(salt)

    return run


def _merged(keys: tuple[str, ...], conf: Wrapper):
    def run(batches):
        for key, slices in groups(batches, keys):
            found = _Found(conf)
            for part in slices:
                for text in part.column(part.schema.get_field_index("wrapper")).to_pylist():
                    for kind, rows in json.loads(text).items():
                        found.add(key[0], kind, unpacked(rows))
            yield found.given(0)

    return run


def wrappers(pages: DataFrame, host: Column, conf: Wrapper, tables: Tables) -> DataFrame:
    """(host, wrapper) for every host of pages; a wrapper is a JSON object of flat templates by layout."""
    kinds = "host string, salt int, wrapper string"
    parts = pages.select(host.alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_induced(conf), kinds)
    parts = parts.withColumn("salt", F.pmod("salt", F.lit(conf.salts)).cast("int"))
    for keys in (("host", "salt"), ("host",)):
        parts = parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merged(keys, conf), kinds)
    return tables.keep(parts.select("host", "wrapper"), "wrappers")


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _read(conf: Wrapper):
    def run(batches):
        known: dict[str, dict] = {}
        for batch in batches:
            at = batch.schema.get_field_index
            page, url, source, wrapper = (batch.column(at(c)).to_pylist() for c in ("page_id", "url", "html", "wrapper"))
            said = []
            for s, w in zip(source, wrapper):
                if w is not None and w not in known:
                    if len(known) > 500:
                        known.clear()
                    known[w] = {kind: (t := unpacked(rows), roles(t, conf)) for kind, rows in json.loads(w).items()}
                said.append(main_text(s, known.get(w, {})))
            yield arrow({"page_id": page, "url": url, "text": said, "n_chars": [len(x) for x in said]}, TEXTS)

    return run


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def extract(pages: DataFrame, conf: Wrapper = Wrapper(), tables: Tables | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    A null or empty html, and a page without article text, give an empty text. Pages without a url form a host of
    their own. Repeated rows are read each by itself, and support a slot each. Other columns of pages, whatever their
    names, are left out; an empty table gives no rows. Long and deeply nested pages are read whole, in time in
    proportion to them. Of several regions that hold equally much text the first wins. Large wrapper tables are joined by a shuffle on the host,
    whose hot keys Spark splits; small ones are broadcast below Spark's size threshold.
    """
    tables = tables or Tables(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    known = wrappers(pages, host_of(F.col("url")), conf, tables)
    joined = pages.withColumn("host", host_of(F.col("url"))).join(known, "host", "left")
    return joined.mapInArrow(_read(conf), "page_id long, url string, text string, n_chars long")
