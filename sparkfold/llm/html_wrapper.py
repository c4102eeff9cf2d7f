"""Main text of web pages by union-free regular expressions inferred for each host.

A page becomes a token stream of element starts, ends and text slots (inline elements belong to the text around them).
The wrapper of a host is a union-free regular expression over such streams, kept as the nesting it describes: sequences
whose members may be optional or repeated, and text slots. It is inferred by aligning one page after another: what
matches is merged, an element or group that repeats becomes a repeated group, what one side lacks becomes optional, and
texts that differ become variable slots. Alignment is associative enough to run in a tree: pages of a partition are
folded into one wrapper a host, those of all partitions are merged ``MERGED`` at a time, so a host with a third of all pages
costs no single task more than others.

Extraction walks a page along its host's wrapper. Text goes if it lies in an element whose tag or role says navigation,
header, footer, sidebar, advert or form, in a slot that has the same text on most pages of the host while other texts
differ, or in a list that is links for the most part. Class names and ids that say so are weaker evidence: an element so
named stays if it holds the article or main element, or, on a page without them, half of the page's own text; words for
states (has-sidebar, comments-open) name nothing. Only comments go by name alone. If a page marks its text by ``article``
or ``main`` elements, only what lies in them counts; of it constant slots go too, and such lists of links as most of the
host's pages have, so that an article keeps a list of its own. Parts that the wrapper lacks are judged by the page alone.

A slot keeps its ``TOPS`` most frequent texts and how often each came at least (a mergeable summary): a text on three
quarters of the pages is always found constant, one on less than half never; between them it depends on the merges.

Defined results: null or empty html gives the empty text; markup that breaks off is read as far as it goes; very long
pages are read whole, and elements nested deeper than ``MOST_DEPTH`` become siblings in their order and keep what their
parents say of them; rows that repeat are extracted alike; a null url is a host of its own; other columns, whatever their
names, are not read; an empty table gives an empty table. A wrapper stops taking in new elements at ``MOST_NODES``. Such a
host is decided by exact counts instead, made in Spark over all its pages: each slot and list has as its place the
elements that lead to it, and a place is constant, or links, by the same rules.
"""

from __future__ import annotations

import bisect
import hashlib
import html as html_lib
import json
import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.llm.common import discard, map_rows, mark, stored, stored_at, table

MOST_NODES = 3000
MOST_DEPTH = 150
#: Pages a host must have, and the part of them with the same text in a slot, before the slot counts as constant.
CONST_PAGES = 8
CONST_SHARE = 0.5
LINK_SHARE = 0.7
#: Texts a slot remembers with their numbers.
TOPS = 3
#: Wrappers of a host that one task merges, and bytes of all wrappers up to which they are sent to every task.
MERGED = 32
SENT_BYTES = 32 << 20
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![=\w\"'])(hidden)\b")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: Elements that go with all they hold, nested too; without an end tag they hold nothing.
EMBEDDED = frozenset("noscript iframe svg math template xmp select object canvas audio video".split())
DROP_TAGS = frozenset("nav header footer aside form head menu dialog button fieldset".split()) | RAW | EMBEDDED
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAME_END = r"(?:$|[-_\s\d])"
DROP_WORDS = re.compile(
    r"(?:^|[-_\s])(?:ads?|adv|adverts?|advertisements?|advertising|adsense|banner|sponsor(?:ed|s)?|promo(?:tion|s)?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|"
    r"sidebars?|widgets?|menus?|nav|navbar|navigation|breadcrumbs?|pagination|pager|shar(?:e|ing)|social|related|recommend(?:ed|ations?)?|respond|footer|foot|"
    r"masthead|topbar|toolbar|login|signup|search|copyright|skip|hidden|sr-only|toc|site-?header|page-?header)" + _NAME_END,
    re.I,
)
COMMENT_WORDS = re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|disqus|repl(?:y|ies))" + _NAME_END, re.I)
#: Class words that say a state, not what an element is.
_STATE = re.compile(r"(?:has|no|not|with|without|show|hide|is|enable|disable)[-_].*|.*[-_](?:open|closed|enabled|disabled|on|off|count|status)", re.I)
DROP_NAMES = frozenset("header top topbar top-bar".split())
MAIN_TAGS = frozenset(("article", "main"))
CLOSES = {t: frozenset(ends.split()) for t, ends in (("li", "li"), ("dt", "dt dd"), ("dd", "dt dd"), ("tr", "tr td th"), ("td", "td th"), ("th", "td th"), ("option", "option"))}
HOLDS = frozenset("ul ol dl table".split())


class Element:
    """``named``: what class and id say; 1 that it is no main text, 2 that it is comments."""

    __slots__ = ("key", "tag", "drop", "main", "named", "kids")

    def __init__(self, tag: str, key: str, drop: bool, main: bool, named: int = 0):
        self.tag, self.key, self.drop, self.main, self.named, self.kids = tag, key, drop, main, named, []


class Text:
    __slots__ = ("parts", "links")

    def __init__(self):
        self.parts, self.links = [], 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw and raw.strip(" /") else {}


def _element(tag: str, raw: str) -> Element:
    at = _attributes(raw)
    names = " ".join(sorted(at.get("class", "").split()))
    role, ident = at.get("role", "").lower(), at.get("id", "")
    main = tag in MAIN_TAGS or role in ("main", "article") or at.get("itemprop", "").lower() == "articlebody"
    drop = tag in DROP_TAGS or role in DROP_ROLES or "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "").lower()
    named = 0
    if tag not in ("html", "body"):
        words = [w for w in (*names.split(), ident) if not _STATE.fullmatch(w)]
        if any(map(COMMENT_WORDS.search, words)):
            named = 2
        elif any(map(DROP_WORDS.search, words)) or not DROP_NAMES.isdisjoint(w.lower() for w in words):
            named = 1
    return Element(tag, re.sub(r"\d+", "0", f"{tag}.{names}#{ident}"[:120]), drop, main, named)


def decide(root: Element) -> Element:
    """Settles which named elements go."""
    own: dict[int, int] = {}
    mains: dict[int, bool] = {}

    def measure(e: Element) -> None:
        n, main = 0, e.main
        for k in e.kids:
            if isinstance(k, Text):
                n += max(0, len(k.text) - k.links)
            else:
                measure(k)
                if not k.drop:
                    n += own[id(k)]
                    main |= mains[id(k)]
        own[id(e)], mains[id(e)] = n, main

    def settle(e: Element) -> None:
        for k in e.kids:
            if isinstance(k, Element):
                if k.named == 2:
                    k.drop = True
                elif k.named:
                    holds = any(isinstance(x, Element) and not x.drop and mains[id(x)] for x in k.kids)
                    most = 2 * own[id(k)] >= own[id(root)] > 0
                    k.drop |= not (holds or most and (k.main or not mains[id(root)]))
                settle(k)

    measure(root)
    settle(root)
    return root


def parse(html: str | None) -> Element:
    """The page's nesting; end tags may lack, and elements too deep join one that is not."""
    root = Element("root", "root", False, False)
    stack, at, src = [root], 0, html or ""
    opened: Counter = Counter()
    link, muted = False, ""
    # Open embedded elements, which are in no parent's list, with their place and the state before them.
    held: list[tuple[Element, int, bool, str]] = []

    def push(e: Element) -> None:
        stack.append(e)
        opened[e.tag] += 1

    def pop() -> Element:
        e = stack.pop()
        opened[e.tag] -= 1
        return e

    def floor() -> Element:
        """Where what opens now is listed."""
        return stack[min(len(stack) - 1, max(MOST_DEPTH, held[-1][1] if held else 0))]

    def close(i: int) -> None:
        """Closes the elements from place i; an embedded one without end tag gives what it took to its parent."""
        parts: list[list] = []
        while len(stack) > i:
            e = pop()
            if held and held[-1][0] is e:
                held.pop()
                parts.append(e.kids)
            if parts and (len(stack) == i or len(stack) <= MOST_DEPTH + 1 and not (held and held[-1][0] is stack[-1])):
                under = floor()
                while parts:
                    under.kids.extend(parts.pop())

    def add(text: str) -> None:
        if not text or muted:
            return
        top, under = stack[-1], floor()
        if under is not top and (not under.kids or under.kids[-1] is not top):
            # A deep element goes on after another that is listed beside it.
            if text.isspace():
                return
            stack[-1] = top = Element(top.tag, top.key, top.drop, top.main, top.named)
            under.kids.append(top)
        kids = top.kids
        if not kids or not isinstance(kids[-1], Text):
            if text.isspace():
                return
            kids.append(Text())
        text = html_lib.unescape(text) if "&" in text else text
        kids[-1].parts.append(text)
        if link:
            kids[-1].links += len(text)

    n = len(src)
    while at < n:
        m = _TOKEN.search(src, at)
        if m is None:
            cut = src.find("<", at)
            # An unfinished tag at the very end is no text.
            stop = cut if cut >= 0 and re.match(r"</?[a-zA-Z]", src[cut : cut + 3]) else n
            add(src[at:stop])
            break
        add(src[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        if m["end"] or m["end2"]:
            if tag == "a":
                link = False
            if tag in INLINE:
                if tag == muted:
                    muted = ""
                continue
            if tag in EMBEDDED:
                place = next((i for i in range(len(held) - 1, -1, -1) if held[i][0].tag == tag), None) if opened[tag] else None
                if place is not None:
                    e, _, link, muted = held[place]
                    del held[place:]
                    while pop() is not e:
                        pass
                continue
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    muted, link = "", False
                    break
            continue
        if tag in INLINE:
            link = link or tag == "a"
            if attrs.strip(" /") and not muted and tag != "wbr":
                e = _element(tag, attrs)
                muted = tag if e.drop or e.named else ""
            continue
        if tag == "br":
            add("\n")
            continue
        if tag in VOID:
            if tag == "hr" and stack[-1].kids:
                floor().kids.append(Element("hr", "hr", False, False))
            continue
        if attrs.endswith("/") and (tag in EMBEDDED or any(e.tag in ("svg", "math") for e, *_ in held)):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(src, at)
            at = end.end() if end else n
            continue
        if attrs.endswith("/") and tag not in ("p", "div", "li"):
            continue
        if tag in EMBEDDED:
            e = Element(tag, tag, True, False)
            held.append((e, len(stack), link, muted))
            push(e)
            continue
        muted, link = "", False
        while len(stack) > 1 and stack[-1].tag == "p":
            pop()
        for i in range(len(stack) - 1, 0, -1) if tag in CLOSES else ():
            if stack[i].tag in HOLDS or stack[i].tag in EMBEDDED:
                break
            if stack[i].tag in CLOSES[tag]:
                close(i)
                break
        new, under = _element(tag, attrs), floor()
        if under is not stack[-1]:
            new.drop, new.main, new.named = new.drop or stack[-1].drop, new.main or stack[-1].main, max(new.named, stack[-1].named)
        under.kids.append(new)
        push(new)
    close(1)
    return decide(root)


class Node:
    """A member of a wrapper's sequence: element, group (key "()") or text slot (key "#").

    ``tops``: a slot's most frequent texts by checksum, with numbers that are never too great.
    """

    __slots__ = ("key", "many", "opt", "n", "kids", "tops", "chars", "links", "flag", "full")

    def __init__(self, key, many=False, opt=False, n=1, kids=(), tops=None, chars=0, links=0):
        self.key, self.many, self.opt, self.n, self.kids = key, many, opt, n, list(kids)
        self.tops, self.chars, self.links, self.flag = tops or {}, chars, links, False
        #: Elements were left out of it.
        self.full = False

    def dump(self):
        return [self.key, int(self.many), int(self.opt), self.n, sorted(self.tops.items()), self.chars, self.links, [k.dump() for k in self.kids], int(self.full)]

    @staticmethod
    def load(x) -> Node:
        out = Node(x[0], bool(x[1]), bool(x[2]), x[3], [Node.load(k) for k in x[7]], {k: n for k, n in x[4]}, x[5], x[6])
        out.full = bool(x[8])
        return out

    def size(self) -> int:
        return 1 + sum(k.size() for k in self.kids)


def _shape(node: Node):
    return (node.key, tuple(k.key for k in node.kids) if node.key == "()" else ())


def _tops(a: dict[int, int], b: dict[int, int]) -> dict[int, int]:
    """Sum of two summaries, cut to ``TOPS`` texts by taking the next one's number off all."""
    out = dict(a)
    for k, n in b.items():
        out[k] = out.get(k, 0) + n
    if len(out) > TOPS:
        less = sorted(out.values(), reverse=True)[TOPS]
        out = {k: n - less for k, n in out.items() if n > less}
    return out


def absorb(a: Node, b: Node, room: list[int], inside: bool = False) -> None:
    """Merges b into a; ``inside``: both are of one page, so a repetition and not another page."""
    a.many |= b.many
    a.full |= b.full
    a.opt |= b.opt
    if not inside:
        a.n += b.n
    if a.key == "#":
        a.tops = _tops(a.tops, b.tops)
    a.chars += b.chars
    a.links += b.links
    a.kids = align(a.kids, b.kids, room, inside)


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence, by matching places: the longest ascending chain of places in b, taken in a's order."""
    places: dict = {}
    for j, k in enumerate(b):
        places.setdefault(k, []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i, k in enumerate(a):
        for j in reversed(places.get(k, ())):
            at = bisect.bisect_left(ends, j)
            chain = (i, j, chains[at - 1] if at else None)
            if at == len(ends):
                ends.append(j)
                chains.append(chain)
            else:
                ends[at], chains[at] = j, chain
    out, chain = [], chains[-1] if chains else None
    while chain is not None:
        i, j, chain = chain
        out.append((i, j))
    return out[::-1]


def align(a: list[Node], b: list[Node], room: list[int], inside: bool = False) -> list[Node]:
    """One sequence that both match: a longest common subsequence is merged, the rest becomes optional."""
    ka, kb = [_shape(x) for x in a], [_shape(x) for x in b]
    pairs = [(i, i) for i in range(len(a))] if ka == kb else _common(ka, kb)
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        for node in a[i:x]:
            node.opt = True
            out.append(node)
        for node in b[j:y]:
            if room[0] > 0:
                room[0] -= node.size()
                node.opt = True
                out.append(node)
            else:
                room[1] = 1
        if x < len(a):
            absorb(a[x], b[y], room, inside)
            out.append(a[x])
        i, j = x + 1, y + 1
    return fold(out, room)


def fold(nodes: list[Node], room: list[int]) -> list[Node]:
    """Repeated members and groups of up to three members become one that repeats."""
    for width in (1, 2, 3):
        out: list[Node] = []
        for node in nodes:
            out.append(node)
            if width == 1:
                if len(out) >= 2 and node.key not in ("#", "()") and _shape(out[-2]) == _shape(node):
                    last = out.pop()
                    absorb(out[-1], last, room, inside=True)
                    out[-1].many = True
                continue
            if len(out) > width and out[-width - 1].key == "()" and [_shape(k) for k in out[-width - 1].kids] == [_shape(k) for k in out[-width:]]:
                for k, x in zip(out[-width - 1].kids, out[-width:], strict=True):
                    absorb(k, x, room, inside=True)
                del out[-width:]
            elif len(out) >= 2 * width and [_shape(k) for k in out[-2 * width : -width]] == [_shape(k) for k in out[-width:]] and any(k.key not in ("#", "()") for k in out[-width:]):
                group = Node("()", many=True, n=out[-width].n, kids=out[-2 * width : -width])
                for k, x in zip(group.kids, out[-width:], strict=True):
                    absorb(k, x, room, inside=True)
                del out[-2 * width :]
                out.append(group)
        nodes = out
    return nodes


def skeleton(e: Element) -> Node:
    """The page's own expression."""
    room = [MOST_NODES, 0]
    kids, chars, links = [], 0, 0
    for k in e.kids:
        if isinstance(k, Text):
            t = k.text
            if t:
                kids.append(Node("#", tops={zlib.crc32(t.encode("utf-8", "surrogatepass")): 1}, chars=len(t), links=min(k.links, len(t))))
        else:
            kids.append(skeleton(k))
    kids = fold(kids, room)
    for k in kids:
        chars, links = chars + k.chars, links + k.links
    out = Node(e.key, kids=kids, chars=chars, links=links)
    out.full = bool(room[1]) or any(_full(k) for k in kids)
    return out


def _full(node: Node) -> bool:
    return node.full or (node.key == "()" and any(_full(k) for k in node.kids))


def combine(a: Node | None, b: Node) -> Node:
    if a is None:
        return b
    room = [MOST_NODES - a.size(), 0]
    absorb(a, b, room)
    a.full |= bool(room[1])
    return a


def _constant(node: Node) -> bool:
    return max(node.tops.values(), default=0) >= CONST_SHARE * node.n


def _varies(node: Node) -> bool:
    return (node.key == "#" and not _constant(node) and not node.many) or any(_varies(k) for k in node.kids)


def judge(root: Node) -> Node:
    """Flags constant slots and lists of links."""
    pages, varied = root.n, _varies(root)

    def walk(node: Node, repeated: bool) -> None:
        repeated |= node.many
        if node.key == "#":
            node.flag = varied and not repeated and _constant(node) and node.n >= CONST_PAGES and node.n >= CONST_SHARE * pages
        elif node.key.split(".", 1)[0] in ("ul", "ol", "table", "dl") and node.chars and node.links >= LINK_SHARE * node.chars:
            node.flag = True
        for k in node.kids:
            walk(k, repeated)

    walk(root, False)
    return root


def _members(node: Node) -> list[Node]:
    out = []
    for k in node.kids:
        out += _members(k) if k.key == "()" else [k]
    return out


def _has_main(e: Element) -> bool:
    return any(isinstance(k, Element) and not k.drop and (k.main or _has_main(k)) for k in e.kids)


def _place(above: int, key: str, nth: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(f"{above}/{nth}/{key}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def places(page: Element) -> list[tuple[int, bool, bool, int, int, int]]:
    """(place, slot, repeated, checksum, chars, links) of the page's text slots and lists, each place once."""
    found: dict[int, list] = {}

    def walk(e: Element, here: int, repeated: bool) -> tuple[int, int]:
        times = Counter(k.key for k in e.kids if isinstance(k, Element))
        nth = chars = links = 0
        for k in e.kids:
            if isinstance(k, Text):
                t, nth = k.text, nth + 1
                at, row = _place(here, "#", nth), [True, repeated, zlib.crc32(t.encode("utf-8", "surrogatepass")), len(t), min(k.links, len(t))]
            else:
                at = _place(here, k.key)
                row = [False, repeated or times[k.key] > 1, 0, 0, 0]
                row[3:] = walk(k, at, row[1])
            chars, links = chars + row[3], links + row[4]
            if isinstance(k, Text) or k.tag in HOLDS:
                if at in found:
                    found[at][3] += row[3]
                    found[at][4] += row[4]
                else:
                    found[at] = row
        return chars, links

    walk(page, 0, False)
    return [(at, *row) for at, row in found.items()]


def constant_places(pages: DataFrame) -> DataFrame:
    """(host, html_key, places): what goes from each of the pages (host, html, html_key), by counts over all of them."""

    def per_batch(batch):
        rows = []
        for host, key, source in zip(*(batch[c].to_pylist() for c in ("host", "html_key", "html")), strict=True):
            # The row without a place counts the page.
            rows += [(host, key, *x) for x in [(None, False, False, 0, 0, 0), *places(parse(source))]]
        names = ("host", "html_key", "place", "slot", "repeated", "same", "chars", "links")
        return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else None

    schema = "host string, html_key string, place long, slot boolean, repeated boolean, same long, chars long, links long"
    all_ = stored(map_rows(pages.select("host", "html_key", "html"), per_batch, schema), "places")
    by_text = all_.groupBy("host", "place", "same").agg(F.count("*").alias("n"), F.max("slot").alias("slot"), F.max("repeated").alias("repeated"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    counts = by_text.groupBy("host", "place").agg(
        F.sum("n").alias("n"), F.max("slot").alias("slot"), F.max("repeated").alias("repeated"), (F.max("n") >= CONST_SHARE * F.sum("n")).alias("alike"), F.sum("chars").alias("chars"), F.sum("links").alias("links")
    )
    counts = stored(counts, "places")
    hosts = counts.groupBy("host").agg(
        F.max(F.when(F.col("place").isNull(), F.col("n"))).alias("pages"), F.max(F.col("slot") & ~F.col("repeated") & ~F.col("alike")).alias("varied")
    )
    often = (F.col("n") >= CONST_PAGES) & (F.col("n") >= CONST_SHARE * F.col("pages"))
    slot = F.col("slot") & F.col("varied") & ~F.col("repeated") & F.col("alike") & often
    links = ~F.col("slot") & (F.col("chars") > 0) & (F.col("links") >= LINK_SHARE * F.col("chars"))
    gone = counts.where("place is not null").join(hosts, "host").where(slot | links).select("host", "place", often.alias("often"))
    chosen = all_.select("host", "html_key", "place").distinct().join(gone, ["host", "place"])
    return chosen.groupBy("host", "html_key").agg(F.collect_list(F.struct("place", "often")).alias("places"))


def extract(page: Element, wrapper: Node | None, gone: dict[int, bool] | None = None) -> str:
    """The page's main text; ``gone``: instead of the wrapper's, the places that go, and whether most pages have them."""
    blocks: list[str] = []
    marked = _has_main(page)
    least = max(CONST_PAGES, CONST_SHARE * wrapper.n) if marked and wrapper is not None else 0

    def cut(node: Node | None, place: int) -> bool:
        if gone is not None:
            return place in gone and (gone[place] or not marked)
        return node is not None and node.flag and node.n >= least

    def walk(e: Element, w: Node | None, inside: bool, here: int) -> None:
        inside |= e.main
        nth = 0
        members = _members(w) if w is not None else []
        at = 0
        for k in e.kids:
            key = "#" if isinstance(k, Text) else k.key
            match = next((i for i in range(at, len(members)) if members[i].key == key), None)
            if match is None:
                match = next((i for i in range(min(at, len(members))) if members[i].key == key), None)
            node = members[match] if match is not None else None
            at = match if match is not None else at
            if node is not None and key == "#" and not node.many:
                at += 1
            nth += key == "#"
            place = _place(here, key, nth if key == "#" else 0) if gone is not None else 0
            if isinstance(k, Text):
                if inside and not cut(node, place):
                    blocks.append(k.text)
            elif k.drop:
                if k.tag == "header" and inside:
                    for h in k.kids:
                        if isinstance(h, Element) and re.fullmatch("h[1-6]", h.tag):
                            walk(h, None, True, _place(place, h.key) if gone is not None else 0)
            elif not cut(node, place):
                walk(k, node, inside, place)

    walk(page, wrapper, not marked, 0)
    return " ".join(b for b in blocks if b)


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, full): one expression a host, from all its pages; full: it has elements left out."""

    def per_partition(batches):
        import pyarrow as pa

        held: dict[str, Node] = {}

        def flush():
            out = pa.RecordBatch.from_pydict({"host": list(held), "wrapper": [json.dumps(w.dump()) for w in held.values()]}, schema=pa.schema([("host", pa.string()), ("wrapper", pa.string())]))
            held.clear()
            return out

        for batch in batches:
            for host, source in zip(batch["host"], batch["html"], strict=True):
                host = host.as_py()
                held[host] = combine(held.get(host), skeleton(parse(source.as_py())))
                if len(held) > 2000:
                    yield flush()
        if held:
            yield flush()

    def merged(table_):
        import pyarrow as pa

        total = None
        for w in sorted(table_["wrapper"].to_pylist()):
            total = combine(total, Node.load(json.loads(w)))
        return pa.Table.from_pydict({"host": [table_["host"][0].as_py()], "wrapper": [json.dumps(total.dump())]})

    level = stored(pages.mapInArrow(per_partition, "host string, wrapper string"), "wrappers")
    most = level.groupBy("host").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    while True:
        parts = max(1, -(-most // MERGED))
        level = level.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(parts))).groupBy("host", "part").applyInArrow(merged, "host string, wrapper string")
        if parts == 1:
            # The root's own mark ends the text.
            return level.withColumn("full", F.col("wrapper").endswith(", 1]"))
        level, most = stored(level, "wrappers"), parts


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page (page_id, url, html)."""
    spark, start = pages.sparkSession, mark()
    hosted = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    known, path = stored_at(wrappers(hosted.select("host", "html")), "wrappers")
    size = known.agg(F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0))).first()[0]
    kept = [path]
    if known.where("full").isEmpty():
        rows = hosted.withColumns({"full": F.lit(False), "places": F.lit(None).cast("array<struct<place: long, often: boolean>>")})
    else:
        keyed = hosted.join(known.select("host", "full"), "host").withColumn("html_key", F.when(F.col("full"), F.sha2(F.coalesce("html", F.lit("")), 256)))
        places_, at = stored_at(constant_places(keyed.where("full")), "gone")
        rows, kept = keyed.join(places_, ["host", "html_key"], "left"), [path, at]
    discard(spark, start, kept)
    # Wrappers go to every task if they are small, and with the pages of their host if not.
    sent = spark.sparkContext.broadcast({r.host: r.wrapper for r in known.select("host", "wrapper").collect()}) if size <= SENT_BYTES else None
    rows = rows.withColumn("wrapper", F.lit(None).cast("string")) if sent is not None else rows.join(known.select("host", "wrapper"), "host", "left")
    cache: dict[str, Node] = {}

    def per_batch(batch):
        texts = []
        for source, host, w, full, known_places in zip(*(batch[c].to_pylist() for c in ("html", "host", "wrapper", "full", "places")), strict=True):
            node = cache.get(host)
            if node is None:
                if len(cache) > 500:
                    cache.clear()
                node = cache[host] = judge(Node.load(json.loads(sent.value[host] if sent is not None else w)))
            texts.append(extract(parse(source), node, {x["place"]: x["often"] for x in known_places or ()} if full else None))
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(rows.select("page_id", "url", "html", "host", "wrapper", "full", "places"), per_batch, "page_id long, url string, text string, n_chars long")


def op4_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
