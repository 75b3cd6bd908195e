"""A small DOM on the standard library's parser, and the page functions that need one.

Tree rules: no implied end tags, end tags without a start are passed over, void elements are never open, script
and style hold raw text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from html.parser import HTMLParser

from harrow.functions.normal import normalize_html_text, normalize_text

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = ("script", "style")
EXTRA = ("header", "footer")
#: What direct extraction drops.
DIRECT = ("style", "script", "head", "img", "base", "noscript")
_TOKEN = re.compile(r"\w+|[^\w\s]")


class Comment(str):
    """A comment's text."""

    __slots__ = ()


class Doctype(str):
    """A declaration's text."""

    __slots__ = ()


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: list | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or [], parent, []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        """Texts below, in document order, without comments and declarations."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                stack += reversed(n.children)
            elif type(n) is str:
                yield n

    def text(self, joint: str = "", strip: bool = False) -> str:
        return joint.join(s for s in (x.strip() if strip else x for x in self.strings()) if s or not strip)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, [(k, v if v is not None else "") for k, v in attrs], self.stack[-1])
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def _add(self, text):
        at = self.stack[-1].children
        if type(text) is str and at and type(at[-1]) is str:
            at[-1] += text
        else:
            at.append(text)

    def handle_data(self, data):
        self._add(data)

    def handle_comment(self, data):
        self._add(Comment(data))

    def handle_decl(self, decl):
        self._add(Doctype(decl))


def parse(page: str | None) -> Node:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


def _attributes(node: Node) -> str:
    return "".join(f' {k}="{html.escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in node.attrs)


def serialise(node: Node) -> str:
    out: list[str] = []
    stack: list = list(reversed(node.children)) if node.tag == "[document]" else [node]
    raw = 0
    while stack:
        n = stack.pop()
        if isinstance(n, tuple):
            out.append(n[0])
            raw -= n[1]
        elif isinstance(n, Node):
            if n.tag in VOID:
                out.append(f"<{n.tag}{_attributes(n)}/>")
                continue
            out.append(f"<{n.tag}{_attributes(n)}>")
            is_raw = n.tag in DROPPED
            raw += is_raw
            stack.append((f"</{n.tag}>", is_raw))
            stack += reversed(n.children)
        elif isinstance(n, Comment):
            out.append(f"<!--{n}-->")
        elif isinstance(n, Doctype):
            out.append(f"<!{n}>")
        else:
            out.append(n if raw else html.escape(n, quote=False))
    return "".join(out)


def _prune(node: Node, drop: frozenset[str], links: bool, attrs: bool) -> None:
    """Drops elements and comments, unwraps links, clears attributes; then drops elements without text."""
    order: list[Node] = []
    stack = [node]
    while stack:
        n = stack.pop()
        order.append(n)
        kept: list = []
        for c in n.children:
            if isinstance(c, Comment) or isinstance(c, Node) and c.tag in drop:
                continue
            if isinstance(c, Node) and attrs:
                c.attrs = []
            if isinstance(c, Node) and links and c.tag == "a":
                c = c.text()
            if type(c) is str and kept and type(kept[-1]) is str:
                kept[-1] += c
            else:
                kept.append(c)
        n.children = kept
        stack += [c for c in kept if isinstance(c, Node)]
    filled: dict[int, bool] = {}
    for n in reversed(order):  # children before their parents
        n.children = [c for c in n.children if not isinstance(c, Node) or filled[id(c)]]
        filled[id(n)] = any(isinstance(c, Node) or type(c) is str and c.strip() for c in n.children)


def _plain(page: str, drop: frozenset[str], links: bool, attrs: bool, unescape: Callable[[str], str] | None) -> str:
    mark = ""
    if unescape:  # the parser meets no reference: a character that the page has not stands for each &
        mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in page)
        page = page.replace("&", mark)
    root = parse(page)
    _prune(root, drop, links, attrs)
    text = root.text("\n")
    return normalize_html_text(unescape(text.replace(mark, "&")) if unescape else text)


def clean_html(page: str | None, extra_remove_tags: tuple[str, ...] = EXTRA, strip_attrs: bool = True, strip_links: bool = True, keep_tags: bool = True, rag: bool = False, unescape: Callable[[str], str] | None = None) -> str:
    """rag: of a page without tags, markup that its texts spell goes too.

    unescape: of a page without tags, reads its character references in place of the parser's HTML rules.
    """
    drop = frozenset((*DROPPED, *extra_remove_tags))
    if keep_tags:
        root = parse(page)
        _prune(root, drop, strip_links, strip_attrs)
        return re.sub(r"(?m)^[ \t]*\n", "", serialise(root)).strip()
    text = _plain(page or "", drop, strip_links, strip_attrs, unescape)
    return _plain(text, frozenset(DROPPED), True, True, unescape) if rag else text


def chunk_html(page: str | None, max_tokens: int = 500, is_clean: bool = True, attr_cutoff_len: int = 5) -> list[str]:
    """Text nodes in document order, packed into chunks of at most max_tokens tokens (words and marks).

    Each chunk repeats the tags around its texts; attributes are cut to attr_cutoff_len characters where the page
    is not clean; a text longer than a chunk is cut between tokens.
    """
    root = parse(page)
    leaves: list[tuple[list[Node], str, int]] = []
    stack: list[tuple[object, list[Node]]] = [(c, []) for c in reversed(root.children)]
    while stack:
        n, around = stack.pop()
        if isinstance(n, Node):
            stack += [(c, [*around, n]) for c in reversed(n.children)]
        elif type(n) is str and n.strip():
            spans = [m.span() for m in _TOKEN.finditer(n)]
            for i in range(0, max(1, len(spans)), max_tokens):
                last = i + max_tokens
                a = 0 if i == 0 else spans[i][0]
                b = len(n) if last >= len(spans) else spans[last][0]
                leaves.append((around, n[a:b], min(last, len(spans)) - i))
    chunks, now, size = [], [], 0
    for leaf in leaves:
        if now and size + leaf[2] > max_tokens:
            chunks.append(now)
            now, size = [], 0
        now.append(leaf)
        size += leaf[2]
    if now:
        chunks.append(now)
    return [_wrapped(c, is_clean, attr_cutoff_len) for c in chunks]


def _wrapped(leaves: list[tuple[list[Node], str, int]], is_clean: bool, cut: int) -> str:
    out: list[str] = []
    opened: list[Node] = []
    for around, text, _ in leaves:
        k = 0
        while k < min(len(opened), len(around)) and opened[k] is around[k]:
            k += 1
        out += [f"</{n.tag}>" for n in reversed(opened[k:])]
        for n in around[k:]:
            attrs = "" if not n.attrs else "".join(f' {a}="{html.escape(v if is_clean else v[:cut])}"' for a, v in n.attrs)
            out.append(f"<{n.tag}{attrs}>")
        opened = around
        out.append(html.escape(text, quote=False))
    return "".join([*out, *(f"</{n.tag}>" for n in reversed(opened))])


def text_chunks(node: Node) -> list[str]:
    """An element's own texts between its children, and each child's whole text."""
    out, run = [], []

    def flush():
        out.append("".join(run).strip())
        run.clear()

    for c in node.children:
        if type(c) is str:
            run.append(c)
        else:
            flush()
            if isinstance(c, Node):
                out.append(c.text(" ", strip=True))
    flush()
    return [x for x in out if x]


def _shape(n) -> object:
    return (n.tag, tuple(n.attrs), tuple(_shape(c) for c in n.children)) if isinstance(n, Node) else n


def xpath(node: Node) -> str:
    """/html/body/p[2]; an index only among siblings of one name.  Equal twins share the first one's index."""
    steps = []
    while node.parent is not None:
        same = [c for c in node.parent.children if isinstance(c, Node) and c.tag == node.tag]
        if len(same) > 1:
            shape = _shape(node)
            steps.append(f"{node.tag}[{next(i for i, c in enumerate(same) if c is node or _shape(c) == shape) + 1}]")
        else:
            steps.append(node.tag)
        node = node.parent
    return "/" + "/".join(reversed(steps))


def closest_node(page: str | None, search: str | None) -> dict:
    """The page's text that is most like the one searched for: text, xpath, sub_index, score, found.

    Elements in document order, each with its own chunks; one takes over if neither likeness nor shared words are
    less than the best so far, so of equals the later stays.
    """
    out = {"text": search or "", "xpath": None, "sub_index": None, "score": 0.0, "found": False}
    wanted = normalize_text(search)
    if not wanted:
        return out
    words, target = set(wanted.split()), (search or "").strip()
    best_score, best_shared = 0.0, 0
    found = None
    for node in parse(page).walk():
        for i, chunk in enumerate(text_chunks(node)):
            norm = normalize_text(chunk)
            shared = len(words & set(norm.split()))
            if not shared and wanted not in norm or shared < best_shared:
                continue
            m = SequenceMatcher(None, chunk.strip(), target)
            if m.real_quick_ratio() < best_score or m.quick_ratio() < best_score:
                continue  # bounds from above: the ratio cannot reach the best
            score = m.ratio()
            if score >= best_score:
                best_score, best_shared, found = score, shared, (node, i, chunk)
    if found:
        out.update(text=found[2], xpath=xpath(found[0]), sub_index=found[1], score=best_score, found=True)
    return out


def main_text(page: str) -> str | None:
    """The text of a chunk for direct extraction; None where there is none."""
    return normalize_html_text(parse(page).text(" ", strip=True)) or None


def direct_clean(page: str | None, max_tokens: int = 500, attr_cutoff_len: int = 50) -> str:
    """For direct extraction: pruned, cut into chunks, the text of each, one a line."""
    root = parse(page)
    _prune(root, frozenset(DIRECT), False, False)
    return "".join(t + "\n" for t in map(main_text, chunk_html(serialise(root), max_tokens, False, attr_cutoff_len)) if t)
