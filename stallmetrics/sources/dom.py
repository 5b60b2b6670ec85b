"""A page's elements in page order, for the readers of captured pages."""

from __future__ import annotations

import re
from collections import Counter

from .markup import RAW, RAW_WITH_REFERENCES, Reader, unescape

# HTML's elements without an end tag, and those whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style template".split())
NOT_PLAIN = RAW | RAW_WITH_REFERENCES | NO_TEXT

#: What is inside of a tag that reads the same whatever comes behind it: its quotation marks are closed, and its content is plain text.
_SOUND = re.compile(
    rf"""(?!(?:{"|".join(sorted(NOT_PLAIN))})(?:[\s/]|$))[A-Za-z][^\s/<>"'=]*(?:\s+[^\s/<>"'=]+(?:=(?:"[^"<>]*"|'[^'<>]*'|[^\s/<>"'=]+))?)*\s*/?|/[A-Za-z][^\s/<>"'=]*\s*""", re.IGNORECASE
)
#: A link, written with nothing to decode.
_LINK = re.compile(r'a href="([^"<>&]*)"')
#: Tags that are kept, and the longest one of them.
_KEPT, _LONGEST = 4096, 400


class Tag:
    """A start tag; attrs is None: an end tag. found: what a reader of pages makes of it, made once."""

    __slots__ = ("attrs", "found", "name", "single")

    def __init__(self, name: str, attrs: dict[str, str] | None, closed: bool = False):
        self.name, self.attrs, self.found = name, attrs, None
        self.single = closed or name in VOID


class _Alone(Reader):
    """The tag that a text is."""

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        self.tag = Tag(tag, attrs, closed)

    def end(self, tag: str) -> None:
        self.tag = Tag(tag, None)


_tags: dict[str, Tag] = {}


def _tag(inside: str) -> Tag | None:
    """A sound tag, else None. Pages have the same ones again and again, so they are kept."""
    if link := _LINK.fullmatch(inside):
        # Links are all different and by far the most; none is kept.
        return Tag("a", {"href": link[1]})
    if not _SOUND.fullmatch(inside):
        return None
    alone = _Alone()
    alone.feed(f"<{inside}>")
    if len(inside) <= _LONGEST:
        if len(_tags) >= _KEPT:
            _tags.clear()
        _tags[inside] = alone.tag
    return alone.tag


class Page:
    """By element, the page itself first: its tag, its parent (-1: none), the place behind the last element inside it (ends), and its words from first to last."""

    def __init__(self) -> None:
        self.tags, self.parents, self.ends, self.first, self.last = [Tag("", {})], [-1], [0], [0], [0]
        self.words: list[str] = []

    def text(self, i: int = 0) -> str:
        """All text inside an element, with one blank between stretches and words; what is inside of NO_TEXT is none."""
        return " ".join(self.words[self.first[i] : self.last[i]])


class _Builder(Reader):
    def __init__(self) -> None:
        self.page, self._at, self._hidden = Page(), 0, 0
        self._open: Counter[str] = Counter()

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        p, found = self.page, Tag(tag, attrs, closed)
        i, words = len(p.tags), len(p.words)
        p.tags.append(found)
        p.parents.append(self._at)
        p.ends.append(i + 1)
        p.first.append(words)
        p.last.append(words)
        if not found.single:
            self._at = i
            self._open[tag] += 1
            self._hidden += tag in NO_TEXT

    def _close(self) -> None:
        p, i = self.page, self._at
        tag = p.tags[i].name
        p.ends[i], p.last[i], self._at = len(p.tags), len(p.words), p.parents[i]
        self._open[tag] -= 1
        self._hidden -= tag in NO_TEXT

    def end(self, tag: str) -> None:
        if self._open.get(tag):
            while self.page.tags[self._at].name != tag:
                self._close()
            self._close()

    def text(self, data: str) -> None:
        if not self._hidden:
            self.page.words += data.split()

    def whole(self) -> Page:
        while self._at >= 0:
            self._close()
        return self.page


def _sound(html: str) -> Page | None:
    """A page of nothing but sound tags, each closed in turn, and texts: as most of them are, and read much faster than by a Reader. Else None."""
    page, at, kept = Page(), 0, _tags.get
    tags, parents, ends, first, last, words = page.tags, page.parents, page.ends, page.first, page.last, page.words
    began, *pieces = html.split("<")
    words += unescape(began).split()
    for piece in pieces:
        inside, shut, said = piece.partition(">")
        if not shut:
            return None
        tag = kept(inside) or _tag(inside)
        if tag is None:
            return None
        if tag.attrs is None:
            if not at or tags[at].name != tag.name:
                return None
            ends[at], last[at], at = len(tags), len(words), parents[at]
        else:
            i, n = len(tags), len(words)
            tags.append(tag)
            parents.append(at)
            ends.append(i + 1)
            first.append(n)
            last.append(n)
            if not tag.single:
                at = i
        if said:
            words += (unescape(said) if "&" in said else said).split()
    if at:
        return None
    ends[0], last[0] = len(tags), len(words)
    return page


def tree(html: str) -> Page:
    """The page; broken markup is read as far as it goes."""
    page = _sound(html)
    if page is None:
        builder = _Builder()
        builder.feed(html)
        page = builder.whole()
    return page
