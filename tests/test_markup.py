"""The HTML reader: cuts of pages, and any input in time that grows with its length."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stallmetrics.sources.dom import tree
from stallmetrics.sources.markup import Reader, unescape


class Log(Reader):
    def __init__(self, page):
        self.seen = []
        self.feed(page)

    def start(self, tag, attrs, closed):
        self.seen.append((tag, attrs) if not closed else (tag, attrs, "/"))

    def end(self, tag):
        self.seen.append(f"/{tag}")

    def text(self, data):
        if self.seen and self.seen[-1][0] == "text":
            data = self.seen.pop()[1] + data
        self.seen.append(("text", data))


@pytest.mark.parametrize(
    ("page", "seen"),
    [
        ("", []), ("a<b>c</b >d", [("text", "a"), ("b", {}), ("text", "c"), "/b", ("text", "d")]), ("<P CLASS=x id='y z' Class=no hidden data-a = \"1>2\">", [("p", {"class": "x", "id": "y z", "hidden": "", "data-a": "1>2"})]),
        ("<br/><img src=a/b/ alt='/'/>", [("br", {}, "/"), ("img", {"src": "a/b/", "alt": "/"}, "/")]), ("a < b <3 & c", [("text", "a < b <3 & c")]), ("<p>a<![foo]>b</p>", [("p", {}), ("text", "ab"), "/p"]), ("<p>a <![ x", [("p", {}), ("text", "a ")]),
        ("a<!-- <b> -->b<!-->c<!--->d<!-- --!>e<!-- f", [("text", "abcde")]), ("<!DOCTYPE html><?x y?></>a</ b>c", [("text", "ac")]), ("<script>if (a</b) '<p>'</SCRIPT >x", [("script", {}), ("text", "if (a</b) '<p>'"), "/script", ("text", "x")]),
        ("<title>a &amp; <b></title>c", [("title", {}), ("text", "a & <b>"), "/title", ("text", "c")]), ("<style>x", [("style", {}), ("text", "x")]), ("<a href='?x=1&copy=2&amp;y&lt;'>&copy &#x41;&#65", [("a", {"href": "?x=1&copy=2&y<"}), ("text", "© AA")]),
        ("a<b", [("text", "a")]), ("a<b c", [("text", "a")]), ("<", [("text", "<")]), ("</", []), ("<a b=\"c>d", [("a", {"b": '"c'}), ("text", "d")]), ("<a =x ==y>", [("a", {"=x": "=y"})]), ("<a b=c/>", [("a", {"b": "c/"})]),
    ],
)
def test_cuts(page, seen):
    assert Log(page).seen == seen


def test_references_of_any_length():
    assert unescape("&#" + "9" * 6000 + ";&#" + "0" * 6000 + "65;&#x" + "f" * 6000 + ";&#38;lt;") == "�A�&lt;"


_MARKUP = st.lists(st.one_of(st.text(max_size=6), st.sampled_from(["<", ">", "</", "<!", "<!--", "-->", "<![", "]]>", "<?", "<a ", "='", '="', "/>", "<p>", "</p>", "<script>", "</script", "<title>", "&#", "&amp", "&#x", ";", "<div class=", " hidden", "\x00"])), max_size=25).map("".join)


@settings(max_examples=600, deadline=None)
@given(_MARKUP)
def test_any_markup_is_read(page):
    Log(page)
    assert tree(page).text() is not None


@pytest.mark.parametrize("piece", ["<a ", "</a ", "<!--", "<a b=\"", "<a b='", "<![", "<p x", "<", "</", "&#", "&", "<title>", "<style>", "<div>x", "</i>", "<a =", "<a / ", "<a" + " " * 9, "--", "<!-- --", "<div></span>", "<p>a</div>"])
def test_time_grows_with_length(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    tree(page)
    Log(page[:300_000])
    assert time.perf_counter() - began < 8


def test_usual_tags_are_read_as_any_other():
    usual = '<div class="a &amp; b" CLASS="no" data-x=""><p id="y">z</p\n></div>'
    assert Log(usual).seen == Log(usual.replace('"', "'")).seen == [("div", {"class": "a & b", "data-x": ""}), ("p", {"id": "y"}), ("text", "z"), "/p", "/div"]
