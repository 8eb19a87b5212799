"""Main-text extraction by tree scoring.

A tolerant tokenizer builds a tree of elements; text is gathered into blocks at
the borders of block-level elements. Each block passes points for its length
and its commas to its ancestors, in full to the parent, half to the next, a quarter
to the one after and so on; an element's points are discounted by its link density. The element
with the most points is the container; siblings with enough points of their own
are kept too, as are headings and figures beside it. Elements that can't hold the
article (scripts, menus, headers, footers, by tag or role, and what is hidden) are left out before
scoring. So are forms and elements with a name of adverts, menus, notices and the like, unless
they hold the article all the same; those of reader comments always. A figure is a frame only: what is in it counts for
the elements around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

SCHEMA = "page_id long, url string, text string, n_chars long"

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas audio video textarea select title".split())
DROPPED = frozenset("nav header footer aside button dialog menu head input".split()) | RAW
FORMS = frozenset("form fieldset".split())
FIELDS = frozenset("input select textarea button".split())
HEAD = frozenset("title meta link base script style noscript template".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"body", "html"}
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
# Words of class names and ids. Those of what goes, of reader comments, those that may follow them, and those that turn them round.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended widget toolbar pagination pager skip hidden side".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
FOLLOWERS = frozenset(
    "list area box block section wrapper wrap container content inner outer bar bars button buttons link links item items group panel left right top bottom main text title heading body form policy slot unit space zone region column col row post posts article articles story stories news entry entries card cards feed thread icon icons tools small large primary secondary desktop mobile inline fixed sticky".split()
)
TURNERS = frozenset("no not non has have with without".split())
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|main|content|entry|post-?body|story|body-?text)(?:$|[\s_-])", re.I)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[\s\x00]+")
POINT_CHARS, MOST_LENGTH_POINTS, SIBLING_SHARE = 100, 3, 0.2
FIELD_CHARS = 200


# Elements that the end tag of an inline element doesn't cross, that end the search for an open paragraph or
# item, and that are paragraphs themselves: their points go to the element around them.
BARRIERS = frozenset("article main body table td th".split())
SCOPES = frozenset("article main body html div section table ul ol td th blockquote nav header footer aside form".split())
PARAGRAPHS = frozenset("p pre h1 h2 h3 h4 h5 h6 li dd dt td th blockquote tr figcaption".split())
ITEMS = frozenset("li tr option dd dt".split())


class Node:
    """An element. block and holder are the nearest block-level elements, itself included; holder isn't a figure."""

    __slots__ = ("tag", "parent", "children", "dropped", "points", "chars", "linked", "bonus", "block", "holder", "first", "depth", "inline", "scope", "kept", "doubt", "prose", "fields", "marks")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, bonus: float = 0.0, doubt: str = ""):
        self.tag, self.parent, self.dropped, self.bonus, self.doubt = tag, parent, dropped, bonus, doubt
        self.prose, self.fields, self.marks = 0, 0, 0
        self.children: list = []
        self.points, self.chars, self.linked, self.first, self.kept = 0.0, 0, 0, -1, False
        self.depth = parent.depth + 1 if parent is not None else 0
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.holder = self if tag in BLOCK and tag != "figure" or parent is None else parent.holder


class _Open:
    """Which elements are open, so that a search among them is begun only where it finds something.

    inline counts those within the innermost barrier, scope those within the innermost scope.
    """

    def __init__(self, root: Node):
        self.all: dict[str, int] = {}
        root.inline, root.scope = {}, {}

    def enter(self, node: Node) -> None:
        for counts in (self.all, node.parent.inline, node.parent.scope):
            counts[node.tag] = counts.get(node.tag, 0) + 1
        node.inline = {} if node.tag in BARRIERS else node.parent.inline
        node.scope = {} if node.tag in SCOPES else node.parent.scope

    def leave(self, here: Node, until: Node) -> Node:
        """Closes all from here to until."""
        while True:
            for counts in (self.all, here.parent.inline, here.parent.scope):
                counts[here.tag] -= 1
            if here is until:
                return here.parent
            here = here.parent


def doubt_of(names: str) -> str:
    """What class names and an id say of an element: "comments", "name" (of what goes), or nothing.

    A name counts if it ends in such a word or only in followers of one, and not
    where a word before it turns it round; nothing counts beside the name layout.
    """
    out = ""
    for name in (tokens := names.lower().split()):
        words = _WORDS.findall(name)
        at = next((i for i in range(len(words) - 1, -1, -1) if not words[i].isdigit() and words[i] not in FOLLOWERS), -1)
        if at < 0 or TURNERS & set(words[:at]):
            continue
        if words[at] in COMMENT_WORDS:
            out = "comments"
        elif words[at] in BAD_WORDS and (words[at] != "side" or at == 0):
            out = out or "name"
    return "" if "layout" in tokens else out


def _judged(tag: str, attributes: str) -> tuple[bool, str, float]:
    """Whether an element is left out, what speaks against it, and its bonus by name."""
    if tag in DROPPED:
        return True, "", 0.0
    doubt, bonus = "form" if tag in FORMS else "", 5.0 if tag in ("article", "main") else 0.0
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False, doubt, bonus
    found = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    name, role = f"{found.get('class', '')} {found.get('id', '')}", found.get("role", "").lower()
    if role in DROPPED_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True, "", 0.0
    if tag not in ("html", "body", "article", "main"):
        doubt = doubt_of(name) or doubt or ("form" if role == "form" else "")
    return False, doubt, 5.0 if bonus or _GOOD.search(name) and not doubt else 0.0


def _settle(nodes: list[Node]) -> None:
    """Drops the elements that something speaks against, but not those that hold the article.

    An element does if it holds main, or more than half of the page's text outside links and
    comments and one of its articles and main headings, if it has any; a form also where it has FIELD_CHARS of text and more for each of its fields.
    """
    holds_main = set()
    for node in reversed(nodes):  # children before parents
        node.marks += node.tag in ("article", "main", "h1")
        if node.dropped or node.doubt == "comments" or node.tag == "a":
            node.prose, node.marks = 0, 0
        else:
            node.prose += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.fields += node.tag in FIELDS
        if node.tag == "main" or node in holds_main:
            holds_main.add(node)
            if node.parent is not None:
                holds_main.add(node.parent)
        if node.parent is not None:
            node.parent.prose += node.prose if node.tag != "label" else 0
            node.parent.fields += node.fields
            node.parent.marks += node.marks
    half = nodes[0].prose / 2
    for node in nodes:
        if node.doubt and not node.dropped:
            holds = node.doubt != "comments" and (node.prose > half and (node.marks or not nodes[0].marks) or node in holds_main)
            node.dropped = not holds and not (node.doubt == "form" and node.prose >= FIELD_CHARS * max(1, node.fields))


def parse(html: str) -> tuple[Node, list[Node]]:
    """A tree whose leaves are strings, character references still in place, and its elements, parents first.

    Loops over tokens; each search in the text or among open elements passes what it
    goes over, so time is linear, whatever is left open.
    """
    root = Node("#root", None)
    at, here, size = 0, root, len(html)
    nodes, opened = [root], _Open(root)
    low, quoted, never = None, True, set()  # never: what isn't found any more

    def find(what: str, start: int, text: str) -> int:
        if what in never:
            return -1
        end = text.find(what, start)
        if end < 0:
            never.add(what)
        return end

    def out_of_head(here: Node) -> Node:
        node = here
        while node.tag != "head":
            node = node.parent
        return opened.leave(here, node)

    while at < size:
        lt = html.find("<", at)
        if lt < 0 or lt > at:
            text = html[at : lt if lt >= 0 else size]
            if here.tag == "head" and not text.isspace():
                here = out_of_head(here)
            here.children.append(text)
        if lt < 0:
            break
        at = lt + 1
        if html.startswith("<!--", lt):
            end = find("-->", lt + 4, html)
            at = end + 3 if end >= 0 else size
            continue
        if html.startswith("<![CDATA[", lt):
            end = find("]]>", lt + 9, html)
            here.children.append(html[lt + 9 : end if end >= 0 else size].replace("&", "&amp;"))
            at = end + 3 if end >= 0 else size
            continue
        m = _NAME.match(html, lt)
        if m is None and html[at : at + 1] not in ("!", "?"):
            here.children.append("<")
            continue
        end = -1
        if m is not None and quoted and ">" not in never:
            inside = _ATTRIBUTES.match(html, m.end())
            end = inside.end() if inside is not None else -1
            quoted = inside is not None  # from a quote or tag that never ends on, quotes are letters like others
        if end < 0:
            end = find(">", m.end() if m is not None else at, html)
        if end < 0:
            here.children.append("<")
            continue
        at = end + 1
        if m is None:
            continue
        tag, attributes = m[2].lower(), html[m.end() : end]
        if not m[1] and tag not in HEAD and opened.all.get("head", 0):  # a head ends where something begins that it can't hold
            here = out_of_head(here)
        if m[1]:  # an end tag closes the nearest open one of its name; others are ignored
            if (opened.all if tag in BLOCK else here.inline).get(tag, 0):
                node = here
                while node.tag != tag:
                    node = node.parent
                here = opened.leave(here, node)
            continue
        if tag in RAW:
            if attributes.endswith("/") and tag not in ("script", "style"):
                continue
            low = html.lower() if low is None else low
            end = find(f"</{tag}", at, low) if len(low) == size else find(f"</{m[2]}", at, html)
            if end < 0:
                if tag in ("script", "style", "textarea", "title"):
                    at = size
                continue
            close = html.find(">", end)
            at = size if close < 0 else close + 1
            nodes.append(Node(tag, here, True))
            here.children.append(nodes[-1])
            continue
        closes = ("p",) if tag in CLOSES_P else ()
        closes += (tag,) if tag in ITEMS else ()
        if any(here.scope.get(c, 0) for c in closes) and here.tag not in SCOPES:
            node = here
            while node.tag not in closes:
                node = node.parent
            here = opened.leave(here, node)
        dropped, doubt, bonus = _judged(tag, attributes)
        node = Node(tag, here, dropped, bonus, doubt)
        nodes.append(node)
        here.children.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            opened.enter(node)
            here = node
    return root, nodes


def _blocks(root: Node) -> list[tuple[str, Node, int]]:
    """(text, nearest block-level element, linked characters), in page order, without dropped elements."""
    out: list[tuple[str, Node, int]] = []
    parts: list[tuple[str, bool]] = []
    owner = [root]

    def end_block() -> None:
        if parts:
            text = _SPACE.sub(" ", unescape("".join(p for p, _ in parts))).strip()
            if text:
                out.append((text, owner[0], sum(len(p) for p, linked in parts if linked)))
            parts.clear()

    stack: list = [(root, 0, False)]
    while stack:
        node, i, linked = stack.pop()
        if i == 0 and node.tag in BLOCK:
            end_block()
        if i < len(node.children):
            stack.append((node, i + 1, linked))
            child = node.children[i]
            if isinstance(child, str):
                if not parts:
                    owner[0] = node.block
                parts.append((child, linked))
            elif not child.dropped:
                if child.tag == "br":
                    parts.append((" ", linked)) if parts else None
                else:
                    stack.append((child, 0, linked or child.tag == "a"))
            elif child.tag in BLOCK:
                end_block()
        elif node.tag in BLOCK:
            end_block()
    end_block()
    return out


def _score(nodes: list[Node], found: list[tuple[str, Node, int]]) -> list[Node]:
    """Gives points and sizes to the elements around the blocks; those with points, inner before outer, by their first block."""
    for i, (text, owner, linked) in enumerate(found):
        points = 1 + text.count(",") + text.count("，") + min(MOST_LENGTH_POINTS, len(text) // POINT_CHARS)
        to = owner.holder
        if owner.tag in PARAGRAPHS and owner.parent is not None:  # the block's own element is the paragraph
            to = owner.parent.holder
        to.points += points
        to.first = i if to.first < 0 else to.first
        owner.chars += len(text)
        owner.linked += min(linked, len(text))
    for node in reversed(nodes):  # children before parents
        up = node.parent
        if up is None:
            continue
        up.chars += node.chars
        up.linked += node.linked
        if node.points and node.holder is node:
            to = up.holder
            to.points += node.points / 2
            to.first = node.first if to.first < 0 else min(to.first, node.first)
    return sorted((n for n in nodes if n.points), key=lambda n: (n.first, -n.depth))


def extract(html: str | None) -> str:
    """The article's blocks joined by newlines; empty where there is none.

    Every element gets points only from blocks inside it, so ties (of a lone
    child and its parent) go to the inner, of siblings to the first. Linear in the
    page's length, however deep it is and however long.
    """
    if not html:
        return ""
    root, nodes = parse(html)
    _settle(nodes)
    found = _blocks(root)
    if not found:
        return ""
    scored = _score(nodes, found)

    def worth(n: Node) -> float:
        return (n.points + (n.bonus if n.points else 0)) * (1 - n.linked / max(1, n.chars))

    best = max(scored, key=worth)
    while best.parent is not None and best.parent.tag in ("p", "b", "i", "em", "strong", "span", "blockquote", "pre"):
        best = best.parent
    best.kept = True
    if best.parent is not None:
        limit = SIBLING_SHARE * worth(best)
        for s in best.parent.children:
            if isinstance(s, Node) and not s.dropped and s is not best and s.chars:
                density = s.linked / s.chars
                s.kept = bool(worth(s) >= limit and s.points or s.tag in ("p", "h1", "h2", "figure") and density < 0.25 and (s.chars >= 80 or s.tag != "p"))
    for node in nodes:  # parents before children
        node.kept = node.kept or node.parent is not None and node.parent.kept
    return "\n".join(text for text, owner, _ in found if owner.kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null or empty html gives an empty text; page_id and url are passed through, nulls too; very long pages take time in
    proportion to their length. Nothing is shuffled; repeated rows
    give their rows; other columns aren't looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [extract(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").transform(mapped, run, SCHEMA)
