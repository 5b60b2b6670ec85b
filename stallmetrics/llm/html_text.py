r"""Main text of web pages by a minimum cut over their blocks.

A page's blocks are the stretches of text between block-level tags. A classifier adds up what is known of
a block: its words, the share of its letters in links, whether it has a sentence's end or is a title, and
the tags, roles and names around it, which count by their strength. article and main inside a marked
element begin anew. Names say nothing on main and on a wrapper around the title or most of the page, and on
an article only as whole names; names of a layout or state ("comments-open") never do. The sum, as log odds, is the block's capacity to the source (content) or the sink (boilerplate). Blocks that follow
each other are tied by an edge whose capacity falls with their distance in the DOM, and blocks of one
parent by one more; so a short line between paragraphs stays, and a sentence among menu entries goes. The
minimum cut, by max-flow, labels the blocks; content blocks are joined in page order.

Character references are decoded, white space inside a block becomes one blank, ends are trimmed. Scripts,
styles, templates and the head have no blocks. Nothing else is dropped and no page is shortened.

Cases: null or empty html, and a page without content, give an empty text; any markup is read, in time that
grows with its length, and open tags end where they must (see sources/markup.py); repeated rows get equal results; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import functools
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.markup import Reader
from .common import in_arrow
from .words import strings

# HTML's tags by what they mean for blocks.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
SILENT_TAGS = frozenset("script style head title noscript template svg math iframe object canvas audio video map select textarea datalist".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE_TAGS = frozenset("br td th option img".split())

# What tags, roles and parts of class and id names say of the text inside; the weak ones also stand on wrappers and articles.
BOILERPLATE_TAGS = frozenset("nav footer aside menu dialog button search".split())
WEAK_TAGS = frozenset("form fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
BOILERPLATE_NAMES = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer sidebar sidebars aside masthead topbar toolbar "
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner adsbygoogle "
    "cookie cookies consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist reply replies disqus respond share sharing social related recommended recommendations outbrain taboola copyright".split()
)
WEAK_NAMES = frozenset("legal form search skip hidden widget widgets alert".split())
CONTENT_TAGS = frozenset("article main".split())
CONTENT_NAMES = frozenset("article post entry story content main body text prose".split())
#: Parts of a class that speak of a wrapper's layout or state, not of what is in it: "comments-open", "sidebar-right-layout".
STATE_NAMES = frozenset("layout open opened closed enabled disabled on off yes no none has with without active inactive visible true false supports support".split())

#: Log odds of content: of any text, of its words up to a limit, of the share of its letters in links, of a sentence's end, of a title, of content and boilerplate marks.
ANY, WORDS, WORDS_MOST, LINKS, SENTENCE, TITLE, CONTENT, STRONG, WEAK, MARKS_MOST = -2.0, 1.5, 5.0, -3.0, 1.0, 2.0, 1.5, -8.0, -2.5, -10.0
#: A wrapper around the title or main says nothing of them by its names from this share of the page's words on; any wrapper does not from the second on, in a page without title and main.
TITLE_SHARE, MOST_OF_PAGE = 0.5, 0.8
#: Capacities between neighbours at DOM distance 0, and between blocks of one parent.
NEIGHBOUR, SIBLING = 1.2, 0.6
_SCALE = 1000


def _named(names: str) -> tuple[bool, bool, bool, bool, bool]:
    """Of class and id names: boilerplate, by a whole name; weak; content; header."""
    strong = whole = weak = content = header = False
    for name in names.split():
        parts = re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower())
        known = set(parts)
        if known & STATE_NAMES:
            continue
        content |= bool(known & CONTENT_NAMES)
        header |= "header" in known and not known & CONTENT_NAMES
        weak |= bool(known & WEAK_NAMES)
        # What a name says stands at its end or, in front of a part of it, at its beginning: "left-sidebar", "comment-list".
        marked = [p for p in parts if p in BOILERPLATE_NAMES]
        if marked and (parts[0] in BOILERPLATE_NAMES or parts[-1] in BOILERPLATE_NAMES):
            strong = True
            whole |= len(marked) == len(parts)
    return strong, whole, weak, content, header


def _hint_of(tag: str, names: str, role: str, hidden: bool) -> tuple[float, float, bool, bool, bool]:
    """What an element says: the boilerplate mark of its tag, that of its names, role and attributes, whether the latter is weak, whether it is content, whether it is a header (boilerplate unless in content)."""
    strong, whole, weak, content, header = _named(names)
    if tag == "main" or role == "main":
        strong = weak = False
    elif tag == "article" or (content and not whole and set(names.lower().split()) & CONTENT_NAMES):
        strong = whole  # "post social-post" is a post
    said = hidden or role in BOILERPLATE_ROLES or strong
    weak = (tag in WEAK_TAGS or role == "form" or weak) and not said
    by_name = STRONG if said else WEAK if weak else 0.0
    return STRONG if tag in BOILERPLATE_TAGS else 0.0, by_name, weak, tag in CONTENT_TAGS or role == "main" or content, tag == "header" or header


_hint = functools.lru_cache(20_000)(_hint_of)
#: Names that are longer are looked at each time.
_KEPT = 300


class Block:
    """A stretch of text; node is the innermost block-level element that it stands in."""

    __slots__ = ("links", "marks", "node", "text", "title", "words")

    def __init__(self, node: int, text: str, links: int, title: bool):
        self.node, self.text, self.links, self.title, self.marks = node, text, links, title, 0.0
        self.words = text.count(" ") + 1


class _Blocks(Reader):
    """Reads a page in time and memory that grow with its length: an element is a number with its parent's, never a path."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self._open: list[tuple[str, int]] = []  # tag, node
        self._at: dict[str, list[int]] = {}  # of each tag, where in _open it stands; "" has the block-level ones
        self._silent = self._links = self._linked = 0
        self._parts: list[str] = []
        # Of each node, 0 being the page: parent, depth among blocks, nearest block-level node, mark of the tag and of the names, weak, content, begins anew, holds a title or main.
        self.parent, self.depth, self.block = [0], [0], [0]
        self.mark, self.named, self.weak, self.good, self.resets, self.holds = [0.0], [0.0], [False], [False], [False], [False]

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append(Block(self._open[-1][1] if self._open else 0, text, self._linked, any(x[0] in ("h1", "h2") for x in self._open[-3:])))
            self._parts, self._linked = [], 0

    def _close(self, at: int) -> None:
        for tag, _ in reversed(self._open[at:]):
            self._silent -= tag in SILENT_TAGS
            self._links -= tag == "a"
            self._at[tag].pop()
            if tag in BLOCK_TAGS:
                self._at[""].pop()
        del self._open[at:]

    def _end_head(self, tag: str) -> None:
        """The head's end tag may be missing: the body ends it, and so does whatever else cannot stand in it."""
        if heads := self._at.get("head"):
            if tag == "body":
                self._close(heads[0])
            elif self._open[-1][0] == "head" and tag not in HEAD_TAGS:
                self._close(len(self._open) - 1)

    def _node(self, tag: str, a: dict[str, str]) -> int:
        up, node = self._open[-1][1] if self._open else 0, len(self.parent)
        mark, named, weak, good, header = 0.0, 0.0, False, False, False
        if tag not in ("html", "body"):
            hidden = "hidden" in a or "display:none" in a.get("style", "").replace(" ", "") or a.get("aria-hidden") == "true"
            names = f"{a.get('class', '')} {a.get('id', '')}"
            mark, named, weak, good, header = (_hint if len(names) <= _KEPT else _hint_of)(tag, names, a.get("role", "").lower()[:_KEPT], hidden)
        if header and not self.good[up]:
            mark = STRONG
        self.parent.append(up)
        self.depth.append(self.depth[up] + (tag in BLOCK_TAGS))
        self.block.append(node if tag in BLOCK_TAGS else self.block[up])
        self.mark.append(mark)
        self.named.append(named)
        self.weak.append(weak)
        self.good.append(good or self.good[up])
        self.resets.append(tag in CONTENT_TAGS)
        self.holds.append(tag in ("h1", "main"))
        if tag in ("h1", "main"):
            while not self.holds[up]:
                self.holds[up] = True
                up = self.parent[up]
        return node

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        self._end_head(tag)
        if tag in SPACE_TAGS:
            self._parts.append(" ")
        if tag in BLOCK_TAGS:
            self._flush()
            if blocks := self._at.get(""):
                other = self._open[blocks[-1]][0]
                if other == "p" or other == tag and tag in ("li", "tr", "dt", "dd"):
                    self._close(blocks[-1])
        if tag in VOID_TAGS:
            return
        node = self._node(tag, attrs)
        self._silent += tag in SILENT_TAGS
        self._links += tag == "a"
        for key in (tag, "") if tag in BLOCK_TAGS else (tag,):
            self._at.setdefault(key, []).append(len(self._open))
        self._open.append((tag, node))
        if closed:
            self.end(tag)

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self._flush()
        # An inline tag's end doesn't reach across the block that it stands in.
        if (at := self._at.get(tag)) and (tag in BLOCK_TAGS or not (blocks := self._at.get("")) or blocks[-1] < at[-1]):
            self._close(at[-1])

    def text(self, data: str) -> None:
        if data.strip():
            self._end_head("")
        if not self._silent:
            self._parts.append(data)
            if self._links:
                self._linked += len("".join(data.split()))

    def page(self) -> Page:
        """The page: each block gets the marks of the elements around it."""
        self._flush()
        words = [0] * len(self.parent)
        for b in self.blocks:
            words[b.node] += b.words
        for i in range(len(words) - 1, 0, -1):
            words[self.parent[i]] += words[i]
        marks = [0.0] * len(self.parent)
        for i in range(1, len(marks)):
            # Names of an article say little, and those of a wrapper around the title, main or most of the page nothing; article and main begin anew.
            wraps = self.holds[i] and words[i] >= TITLE_SHARE * words[0] if self.holds[0] else words[i] >= MOST_OF_PAGE * words[0]
            void = wraps or self.weak[i] and (self.resets[i] or self.holds[i])
            marks[i] = (0.0 if self.resets[i] else marks[self.parent[i]]) + self.mark[i] + (0.0 if void else self.named[i])
        for b in self.blocks:
            b.marks = max(MARKS_MOST, marks[b.node]) + CONTENT * self.good[b.node]
            b.node = self.block[b.node]
        up = [self.block[p] for p in self.parent]
        return Page(self.blocks, up, self.depth)


class Page:
    def __init__(self, blocks: list[Block], parent: list[int], depth: list[int]):
        self.blocks, self.parent, self.depth = blocks, parent, depth

    def apart(self, a: int, b: int) -> int:
        """Steps in the DOM from one block-level node to the other, besides the two into them."""
        n = 0
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            n += 1
        return max(0, n - 2)


def read(html: str) -> Page:
    reader = _Blocks()
    reader.feed(html)
    return reader.page()


_SENTENCE = re.compile(r"[.!?:;\u2026\u3002][\"')\u201d\u00bb]*(\s|$)")


def log_odds(b: Block) -> float:
    """The classifier: above 0 content is likelier."""
    linked = min(1.0, b.links / max(1, len(b.text.replace(" ", ""))))
    said = min(WORDS_MOST, WORDS * math.log1p(b.words)) + SENTENCE * bool(_SENTENCE.search(b.text)) + TITLE * b.title
    return ANY + said + LINKS * linked + b.marks


class Flow:
    """Max-flow by shortest augmenting paths in level graphs; the cut is what the source still reaches."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.left: list[int] = []
        self.edges: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, there: int, back: int = 0) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)

    def levels(self, source: int) -> list[int]:
        level, queue = [-1] * len(self.edges), deque([source])
        level[source] = 0
        while queue:
            x = queue.popleft()
            for e in self.edges[x]:
                if self.left[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def run(self, source: int, sink: int) -> list[int]:
        while (level := self.levels(source))[sink] >= 0:
            tried, path, x = [0] * len(self.edges), [], source
            while True:
                if x == sink:
                    flow = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= flow
                        self.left[e ^ 1] += flow
                    path, x = [], source
                while tried[x] < len(self.edges[x]):
                    e = self.edges[x][tried[x]]
                    if self.left[e] and level[self.to[e]] == level[x] + 1:
                        break
                    tried[x] += 1
                else:
                    if not path:
                        break
                    x = self.to[path.pop() ^ 1]
                    tried[x] += 1
                    continue
                path.append(e)
                x = self.to[e]
        return level


def content(page: Page) -> list[bool]:
    """Which blocks are content, by the minimum cut."""
    n = len(page.blocks)
    source, sink, flow = n, n + 1, Flow(n + 2)
    last: dict[int, int] = {}
    for i, b in enumerate(page.blocks):
        odds = round(log_odds(b) * _SCALE)
        flow.add(source, i, max(0, odds))
        flow.add(i, sink, max(0, -odds))
        if i:
            tie = round(NEIGHBOUR / (1 + page.apart(page.blocks[i - 1].node, b.node)) * _SCALE)
            flow.add(i - 1, i, tie, tie)
        parent = page.parent[b.node]
        if (j := last.get(parent)) is not None:
            flow.add(j, i, round(SIBLING * _SCALE), round(SIBLING * _SCALE))
        last[parent] = i
    level = flow.run(source, sink)
    return [level[i] >= 0 for i in range(n)]


def main_text(html: str) -> str:
    page = read(html)
    return "\n".join(b.text for b, ok in zip(page.blocks, content(page), strict=True) if ok)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 512):
            rows = batch.slice(i, 512)
            texts = [main_text(h) for h in strings(rows.column("html")).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return in_arrow(rows, _extracted, "page_id long, url string, text string, n_chars long")
