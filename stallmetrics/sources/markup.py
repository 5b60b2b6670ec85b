"""A reader of HTML text that takes any input and time in proportion to its length.

Reader.feed() calls start(), end() and text() in page order, as the HTML standard cuts a page: a comment or a
raw text (script, style, title, ...) without its end goes on to the end of the page, an unfinished tag at the
end of the page is dropped, and whatever else begins with "<" but is no tag is text or a bogus comment. A
quotation mark that is never closed is part of its value, so that it doesn't take the rest of the page.
"""

from __future__ import annotations

import functools
import html
import re

# Elements whose content is text up to their own end tag, with and without character references.
RAW = frozenset("script style xmp iframe noembed noframes".split())
RAW_WITH_REFERENCES = frozenset("title textarea".split())

_PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)\s*>")
#: A tag as most are: its attributes, if any, with values in double quotes.
_USUAL = re.compile(r"""<([A-Za-z][^\s/>]*)((?:\s+[^\s/>="'<]+="[^"<>]*")*)\s*>""")
_QUOTED = re.compile(r"""([^\s/>="'<]+)="([^"<>]*)\"""")
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*(=?[^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_COMMENT_END = re.compile(r"--!?>")
_ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
_TOO_LARGE = re.compile(r"&#(?:[1-9][0-9]{7,}|[xX][1-9a-fA-F][0-9a-fA-F]{7,});?")
_IN_VALUE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9])))")


def unescape(text: str) -> str:
    """The text with its character references decoded; numbers of any length are read."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _TOO_LARGE.sub("�", _ZEROS.sub(r"&#\1", text))
    return html.unescape(text)


def _value(text: str) -> str:
    """An attribute's value: there "&copy=" is no reference."""
    return _IN_VALUE.sub(lambda m: unescape(m[0]), text) if "&" in text else text


@functools.lru_cache(4096)
def _usual(name: str, attributes: str) -> tuple[str, dict[str, str]]:
    """Tag and attributes of a usual tag; pages have the same ones again and again, so the dict is not to be changed."""
    attrs: dict[str, str] = {}
    for k, v in _QUOTED.findall(attributes):
        attrs.setdefault(k.lower(), _value(v))
    return name.lower(), attrs


class Reader:
    """To be subclassed; a self-closing tag is a start, and an end too if the subclass asks for it."""

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        """attrs: names in lower case, the first of each counts, not to be changed; closed: written as <tag/>."""

    def end(self, tag: str) -> None: ...

    def text(self, data: str) -> None: ...

    def feed(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            i = page.find("<", at)
            if i < 0:
                return self.text(unescape(page[at:]))
            if i > at:
                self.text(unescape(page[at:i]))
            at = self._markup(page, i)

    def _markup(self, page: str, i: int) -> int:
        """Reads what begins at the "<" of place i; gives the place behind it."""
        if m := _USUAL.match(page, i):
            (tag, attrs), closed, end = _usual(m[1], m[2]), False, m.end()
        elif m := _PLAIN.match(page, i):
            tag, attrs, closed, end = m[2].lower(), {}, False, m.end()
        elif m := _NAME.match(page, i):
            tag, attrs, at = m[1].lower(), {}, m.end()
            while True:
                m = _ATTRIBUTE.match(page, at)
                at = m.end()
                if not m[1]:
                    break
                value = m[2] or ""
                attrs.setdefault(m[1].lower(), _value(value[1:-1] if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0] else value))
            if at >= len(page):
                return at
            closed, end = m[0].endswith("/"), at + 1
        else:
            return self._no_tag(page, i)
        if page[i + 1] == "/":
            self.end(tag)
            return end
        self.start(tag, attrs, closed)
        if tag not in RAW and tag not in RAW_WITH_REFERENCES:
            return end
        m = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, end)
        to = m.start() if m else len(page)
        if to > end:
            self.text(page[end:to] if tag in RAW else unescape(page[end:to]))
        return to

    def _no_tag(self, page: str, i: int) -> int:
        if page.startswith("<!--", i):
            if page.startswith(">", i + 4) or page.startswith("->", i + 4):
                return page.index(">", i) + 1
            m = _COMMENT_END.search(page, i + 4)
            return m.end() if m else len(page)
        if page[i + 1 : i + 2] in ("!", "?", "/") and page[i + 1 : i + 2]:
            return (page.find(">", i) + 1) or len(page)
        self.text("<")
        return i + 1
