"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text (a block ends where a block-level element begins or ends).  A linear classifier of a
block's own text (length, punctuation, share of link text, kind of block) gives its terminal capacity.  Elements that
say what stands in them, by what they are or by role or names in class and id, are nodes of the graph too: what they
say is the capacity of the edge to each block in them, and their own terminal capacity is without bound, but for
names that need not mean what they seem to (a widget, a promotion, ...): blocks of enough main text together outweigh
these.  Further edges join neighbours in page order, neighbours under the same element, and an element's node and
that of the element around it.  A maximum flow separates main text from the rest.  The classifier's weights are
stated, not learnt: pages come without labels.

Character references are decoded, white space in a block becomes one space, blocks are joined by one newline.
Scripts, styles, comments, titles and the elements in MUTED give no text.  Null html counts as empty and gives an
empty text, like a page without main text.  Damaged markup is read as browsers do in outline: unknown end tags
are passed over, an end tag closes what stands open in it, an unfinished tag at the end is dropped.  Elements in
RAW run on to their end tag, as in browsers, or else to the end; those in MUTED end with what they stand in at the
latest and, where no end tag of their name follows, before the next element in FLOW; a head ends before the first element
that cannot stand in it.  Page size only bounds the time.  Further columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from harrow.llm.maxflow import min_cut
from harrow.llm.shared import ship, slim

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^<]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")
#: Elements whose content is no text of the page (fixed names): without and with elements in them.
RAW = frozenset("script style textarea title".split())
MUTED = frozenset("noscript template iframe object svg math select option canvas audio video".split())
FLOW = frozenset("address article aside blockquote body center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img bdo ruby rt rp".split())
#: What standing in an element says, for (+) or against (-) main text.
ELEMENT = {"article": 4.5, "main": 4.0, "nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "header": -5.0, "menu": -8.0, "dialog": -8.0, "button": -8.0, "fieldset": -8.0, "address": -1.5, "figcaption": -0.5, "td": -0.3}
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement adsense adslot sponsor sponsored promo promotion menu menubar nav navbar navigation topnav subnav sidebar aside rail footer header masthead "
    "topbar banner notice notices notification cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login register form search searchbox share "
    "sharing social related recommended recommendations more comment comments reply replies respond disqus discussion breadcrumb breadcrumbs pagination pager toolbar widget widgets "
    "copyright legal disclaimer tagcloud hidden print skip".split()
)
#: Of these, names that no amount of text in the element outweighs: readers' own long texts, and parts of a site.
FIRM = frozenset("comment comments reply replies respond disqus discussion nav navbar navigation topnav subnav menu menubar cookie cookies consent gdpr breadcrumb breadcrumbs pagination pager".split())
FOR = frozenset("article content main post entry story body text".split())
ROLES = {"navigation": -8.0, "banner": -8.0, "contentinfo": -8.0, "complementary": -8.0, "search": -8.0, "dialog": -8.0, "alert": -8.0, "form": -8.0, "menu": -8.0, "menubar": -8.0, "main": 3.0, "article": 3.0}
#: Names that set no side of their own inside an article's body.
CLOSED_BY = {"p": frozenset(("p",)), "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p"))}
ADJACENT, SIBLING, NESTED, SCALE = 0.8, 0.7, 1.0, 1000
#: Terminal capacity of what is certain.
CERTAIN = 10.0**6
#: Elements around a whole page, on which names against main text tell of its parts, and words before what a name says is there or not.
WHOLE = frozenset("html body main".split())
STATES = frozenset("has no not with without".split())
#: Least that names alone leave of a hint, and what each word of a block from the twentieth to the fiftieth gives back of it.
NAMED, FIRMLY, PROSE = -8.0, -12.0, 0.2


def _side(tag: str, value: str, named: float) -> float:
    """What the names in a class or id say: of names for and against main text the first one sets the side.  FIRMLY if
    a firm one is among those against."""
    names = {x.lower() for x in _NAME.findall(value)}
    if not names & AGAINST or names & FOR and names & AGAINST <= {"header"}:
        return 1.5 if names & FOR else 0.0
    if tag in WHOLE or tag == "article" and named >= 0:
        return 1.5 if names & FOR else 0.0
    sides = []
    for token in value.split():
        own = [x.lower() for x in _NAME.findall(token)]
        if not AGAINST.isdisjoint(own):
            if own[0] not in STATES:
                sides.append(FIRMLY if not FIRM.isdisjoint(own) else NAMED)
        elif not FOR.isdisjoint(own):
            sides.append(1.5)
    if min(sides, default=0.0) >= 0:
        return 1.5 if sides else 0.0
    return min(sides) if sides[0] < 0 else 0.0


def _weight(tag: str, attributes: str, inside: float, named: float) -> tuple[float, float]:
    """What an element adds to the score of the blocks in it: itself, its role and hiding; its names."""
    out, names = ELEMENT.get(tag, 0.0), 0.0
    if tag == "header" and inside > 0:
        out = -1.0  # of an article: holds its heading
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id"):
                side = _side(tag, value, named)
                if side == FIRMLY:
                    out += side
                else:
                    names += side
            elif name == "role":
                out += ROLES.get(value.lower(), 0.0)
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out -= 12.0
    return out, names


class Node:
    """An element that says something of what stands in it, added to what those around it say: hint, firm without names."""

    __slots__ = ("around", "firm", "hint")

    def __init__(self, hint: float, firm: float, around: Node | None):
        self.hint, self.firm, self.around = hint, firm, around


class Block:
    __slots__ = ("links", "node", "parent", "tag", "text")

    def __init__(self, tag: str, parent: int, node: Node | None, text: str, links: int):
        self.tag, self.parent, self.node, self.text, self.links = tag, parent, node, text, links


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    # open elements: name, number, the innermost node that it is in or is
    stack: list[tuple[str, int, Node | None]] = [("#", 0, None)]
    number, pos, links = 0, 0, 0
    parts: list[str] = []
    linked = 0
    # open elements from the outermost one in MUTED: its name and what stands in it
    muted: list[str] = []
    last_end: dict[str, int] = {}

    def ends_later(tag: str) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)), default=-1)
        return last_end[tag] >= pos

    def reach(tag: str) -> int:
        """Place on the stack of what an end tag closes, 0 for nothing."""
        k = len(stack) - 1
        while k and stack[k][0] != tag:
            if tag in INLINE and stack[k][0] not in INLINE:  # an inline end tag reaches no further than its block
                return 0
            k -= 1
        return k

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                k = len(stack) - 1
                while k and stack[k][0] in INLINE:
                    k -= 1
                out.append(Block(stack[k][0], stack[max(0, k - 1)][1], stack[-1][2], text, linked))
            parts.clear()
        linked = 0

    while True:
        m = _TAG.search(page, pos)
        end = m.start() if m else len(page)
        if end > pos and not muted:
            parts.append(page[pos:end])
            if links:
                linked += end - pos
        if not m:
            break
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                parts.append(" ") if tag == "textarea" and not muted else None
                e = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos)
                pos = e.end() if e else len(page)
            continue
        if muted:
            if closing:
                if tag in muted:
                    del muted[len(muted) - 1 - muted[::-1].index(tag) :]
                    continue
                if not reach(tag):
                    continue
                muted.clear()
            elif tag == "body" and any(x[0] == "head" for x in stack):
                muted.clear()
            else:
                if tag in FLOW:
                    k = next((k for k, x in enumerate(muted) if x in MUTED and not ends_later(x)), len(muted))
                    del muted[k:]
                if muted:
                    while len(muted) > 1 and muted[-1] in (("option",) if tag in ("option", "optgroup") else CLOSED_BY.get(tag, ())):
                        muted.pop()
                    if muted == ["option"] and tag in ("option", "optgroup"):
                        muted.clear()
                    if tag not in VOID and not attributes.endswith("/"):
                        muted.append(tag)
                    continue
        if not closing:
            if stack[-1][0] == "head" and tag not in IN_HEAD:
                flush()
                stack.pop()
            elif tag == "body":
                k = next((k for k, x in enumerate(stack) if x[0] == "head"), len(stack))
                del stack[k:]
            if tag == "br":
                parts.append(" ")
                continue
            if tag in MUTED:
                if not attributes.endswith("/"):
                    parts.append(" ") if tag == "select" else None
                    muted.append(tag)
                continue
            block = tag not in INLINE
            if block:
                flush()
                if tag in CLOSED_BY or tag not in INLINE:
                    close = CLOSED_BY.get(tag, CLOSED_BY["p"])
                    k = len(stack) - 1
                    while k and (stack[k][0] in INLINE or stack[k][0] in close):
                        if stack[k][0] in close:
                            del stack[k:]
                        k -= 1
                    links = sum(x[0] == "a" for x in stack)
            if tag in VOID or attributes.endswith("/") and not block:
                continue
            number += 1
            node = stack[-1][2]
            around, firm = (node.hint, node.firm) if node else (0.0, 0.0)
            own, names = _weight(tag, attributes, around, around - firm) if attributes or tag in ELEMENT else (0.0, 0.0)
            if own or names:
                node = Node(around + own + names, firm + own, node)
            stack.append((tag, number, node))
            links += tag == "a"
        elif tag not in VOID:
            k = reach(tag)
            if tag not in INLINE:
                flush()
            if k:
                del stack[k:]
                links = sum(x[0] == "a" for x in stack)
    flush()
    return out


def words_of(b: Block) -> int:
    return b.text.count(" ") + 1


def score(b: Block) -> float:
    """Classifier of a block's own text: above 0 for main text."""
    out = -1.2 + 0.06 * min(words_of(b), 40) + 0.4 * min(3, sum(map(b.text.count, ".!?")))
    if b.tag in ("p", "pre", "blockquote"):
        out += 1.0
    elif b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        out += 1.0
    elif b.tag == "li":
        out -= 0.3
    out -= 5.0 * min(1.0, b.links / max(1, len(b.text)))
    if "©" in b.text[:40]:
        out -= 2.5
    return out


def hint(b: Block) -> float:
    """What the elements around a block say of it; names say less of a long text."""
    return max(b.node.hint, min(b.node.firm, NAMED + PROSE * min(30, max(0, words_of(b) - 20)))) if b.node else 0.0


def graph(found: list[Block]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(terminal capacities of the blocks and then of the nodes of elements, above 0 for main text; edges)."""
    terminal = [score(b) for b in found]
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    at: dict[int, int] = {}

    def place(node: Node) -> int:
        if id(node) not in at:
            at[id(node)] = len(terminal)
            names_alone = node.hint < 0 <= node.firm
            terminal.append(node.hint if names_alone else CERTAIN if node.hint >= 0 else -CERTAIN)
        return at[id(node)]

    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, ADJACENT))
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
        if b.node:
            known = id(b.node) in at
            edges.append((i, place(b.node), abs(hint(b))))
            if not known and b.node.around:
                edges.append((place(b.node), place(b.node.around), NESTED))
    return [int(x * SCALE) for x in terminal], [(i, j, int(w * SCALE)) for i, j, w in edges]


def main_blocks(page: str) -> list[str]:
    found = blocks(page)
    side = min_cut(*graph(found))
    return [b.text for b, s in zip(found, side, strict=False) if s]


def main_text(page: str | None) -> str:
    return "\n".join(main_blocks(page)) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", others: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, others, text, n_chars of every row of pages."""
    ship(pages.sparkSession)
    kept = [id_col, *others]
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(v.as_py()) for v in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*kept, "text", "n_chars"])

    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in kept)
    return pages.select(*kept, html_col).mapInArrow(slim(run), f"{schema}, text string, n_chars long")
