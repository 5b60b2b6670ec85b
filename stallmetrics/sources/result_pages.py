r"""Captured result pages as rows (survey S1-S12).

read_cards() is the one Python function: it turns a page's HTML into its text, its links and its cards in page
order, each card with the short texts where a date or a price may be, the surest place first. All the rest, what in
these is a date and a price, which cards are kept, counters, the page's number and stride, its fingerprint, location
feeds and signs of a challenge, are columns over that struct.

Cases: null or empty HTML has no cards and no range; a null requested_page counts as 1, a null final_url as
empty; cards without a link or title give no item; of cards with one address or id the first counts.
"""

from __future__ import annotations

import functools
import re
from itertools import accumulate
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .dom import Page, Tag, tree

#: posted: where a date may be, moment: written as for machines; priced: where a price may be.
CARDS = "text string, cards array<struct<url: string, title: string, promoted: boolean, text: string, posted: array<struct<said: string, moment: boolean>>, priced: array<string>>>, links array<struct<href: string, url: string, count: string>>"
_HOST, _PATH, _FEED, _COUNT = re.compile(r"https?://[a-z0-9.-]+"), re.compile(r"(?:/[A-Za-z0-9_-]+)+"), re.compile(r"c\d+l\d+"), re.compile(r"\(([0-9.]+)\)")

# The site's markup. Where a card has its date and its price, the surest place first: what is looked at, a whole word of it or a part, and its value.
DATE_PLACES = (
    ("names", "word", "aditem-main--top--right"), ("names", "part", "top--right"), ("tag", "word", "time"), ("names", "part", "timestamp"), ("names", "part", "date"), ("testid", "part", "date"), ("testid", "part", "time"),
    ("label", "part", "Heute"), ("label", "part", "Gestern"), ("title", "part", "Heute"), ("title", "part", "Gestern"),
)
DATE_ATTRIBUTES = ("aria-label", "title", "data-date", "data-time", "data-timestamp")
PRICE_PLACES = (("names", "word", "aditem-main--middle--price-shipping--price"), ("names", "part", "price-shipping--price"), ("inside", "", ""), ("testid", "part", "price"), ("names", "part", "price"))
DATES = (r"(?iU)\bHeute(?:,?\s*\d{1,2}:\d{2})?\b", r"(?iU)\bGestern(?:,?\s*\d{1,2}:\d{2})?\b", r"(?iU)\b\d{1,2}\.\d{1,2}\.\d{4}(?:,?\s*\d{1,2}:\d{2})?\b")
PRICE = r"(?<!\d)(?:\d{1,3}(?:\.\d{3})*|\d+)\s*€(?:\s*(?:VB|Festpreis))?"
#: Texts of dates and prices are short: characters of a stretch that is read at all (None: any), of a date that stands alone, of a price; elements that are looked through for a date that stands alone (None: all).
LONGEST, ALONE, PRICE_CHARS, LOOKED_AT = 400, 48, 90, 80
#: What a text with a date, and one without a price but for free, has.
DATE_LIKE, FREE = re.compile(r"\..*\.|heute|gestern", re.I | re.S), ("zu verschenken", "vb")
#: Pages whose rows are in Python at once.
SLICE = 256
#: Feeds of other places that are given (None: all): those with counts, and where none has one.
FEEDS, PLAIN_FEEDS = 120, 40
FEATURES = "bumpup bump-up topad top-ad highlight gallery galerie promoted sponsored".split()
PROMOTED_CLASS = re.compile(rf"(?:featurelabel|featuretag|icon-feature|badge|is)[-_](?:{'|'.join(FEATURES)}|advertisement)\b", re.I)
PROMOTED_VALUE = re.compile(rf"(?:^|[-_: ])(?:{'|'.join(FEATURES)}|hochgeschoben|hochschieben)(?:$|[-_: ])", re.I)
PROMOTED_LABEL = re.compile(r"(?:Top[- ]?Anzeige|Werbeanzeige|Gesponsert|Sponsored|Promoted|Hochgeschoben|Hochschieben|Highlight|Galerie)", re.I)
CHALLENGE = (
    "captcha", "ungewöhnliche aktivität", "ungewoehnliche aktivitaet", "zugriff verweigert", "access denied", "bist du ein roboter", "sind sie ein roboter", "are you a robot", "robot verification",
    "verify you are human", "human verification",
)
MIN_COVERAGE = 0.20


def _first(texts: Column, of) -> Column:
    """The first value that of() finds in one of the texts."""
    return F.aggregate(texts, F.lit(None).cast("string"), lambda found, text: F.coalesce(found, of(text)))


def date_in(text: Column) -> Column:
    return F.coalesce(*[X.found(text, p, 0) for p in DATES])


def posted_text(card: Column) -> Column:
    """What the surest place says, shown before in attributes; else a short stretch that is a date's alone. Never a title."""
    return _first(card["posted"], lambda x: F.when(~x["moment"], date_in(x["said"])).when(x["said"].rlike(r"\d{4}-\d{2}-\d{2}"), F.trim(x["said"])))


def clean_price(text: Column) -> Column:
    """The price in a short text, with the word behind it; or that there is none to pay, or to be agreed on."""
    free = F.when(F.lower(text) == FREE[0], "Zu verschenken").when(F.lower(text) == FREE[1], "VB")
    return F.when(F.length(text) <= PRICE_CHARS, F.coalesce(F.trim(X.found(text, rf"(?iU){PRICE}(?:\s*(?:VB|Festpreis)\b)?", 0)), free))


def price_text(card: Column) -> Column:
    """What the surest place says; else of all stretches the price that is not shipping's, is named one, and stands in the shortest text; else the first in the card's text that doesn't come right behind shipping."""
    # The sign is looked for first, as the pattern looks back at each place.
    whole = F.when(card["text"].contains("€"), F.trim(X.found(card["text"], rf"(?iU)(?<!versand.{{0,13}}){PRICE}", 0)))
    free = F.lower(X.found(card["text"], r"(?iU)\b(Zu verschenken|VB)\b", 1))
    return F.coalesce(_first(card["priced"], clean_price), whole, X.let(free, lambda f: F.when(f == FREE[0], "Zu verschenken").when(f == FREE[1], "VB")))


def _place(places: tuple, values: dict[str, str]) -> int | None:
    """The surest of the places that an element is by its own values; "inside" is none of these."""
    return next((n for n, (field, how, value) in enumerate(places) if field != "inside" and (value in values[field].split(" ") if how == "word" else value in values[field])), None)


_INSIDE = next(n for n, place in enumerate(PRICE_PLACES) if place[0] == "inside")


class _Kind:
    """What an element is by its tag; link, feed: of an ad, of another place."""

    __slots__ = ("card", "dates", "dull", "feed", "link", "marked", "moment", "paid", "paid_class", "posted", "price", "priced", "prices", "shipping", "small", "title", "unnamed", "wrapper")

    def __init__(self, tag: str, link: bool, feed: bool, attrs: dict[str, str]):
        names, classes = attrs.get("class", ""), attrs.get("class", "").split()
        values = {"tag": tag, "names": " ".join(classes), "testid": attrs.get("data-testid", ""), "label": attrs.get("aria-label", ""), "title": attrs.get("title", "")}
        self.link, self.feed, self.title = link, feed, tag == "h2" or "title" in names or "ellipsis" in classes
        self.card, self.wrapper = tag == "article" or "ad-listitem" in classes, "ad-listitem" in map(str.lower, classes)
        self.small, self.priced = tag in ("span", "div", "small"), tag in ("p", "div", "span", "strong")
        self.paid_class = any(map(PROMOTED_CLASS.match, classes))
        self.paid = self.paid_class or any(PROMOTED_VALUE.search(attrs[a].strip()) for a in ("id", "data-testid", "aria-label", "title") if a in attrs)
        self.marked = self.paid or tag in ("span", "small", "label") or any("badge" in c.lower() for c in classes)
        self.posted, self.price = _place(DATE_PLACES, values), _place(PRICE_PLACES, values)
        self.shipping, self.unnamed = "price-shipping" in names, "price" not in values["names"].lower()
        #: A surer place for a price if it is inside of one with shipping.
        self.prices = "price" in names and (self.price is None or self.price > _INSIDE)
        self.dates, self.moment = [" ".join(attrs[a].split()) for a in DATE_ATTRIBUTES if attrs.get(a)], attrs.get("datetime", "")
        self.dull = self.posted is None and self.price is None and not (self.small or self.priced or self.prices)


@functools.lru_cache(4096)
def _kind(tag: str, link: bool, feed: bool, attrs: tuple[tuple[str, str], ...]) -> _Kind:
    return _Kind(tag, link, feed, dict(attrs))


def _found(tag: Tag) -> _Kind:
    """The tag's kind. Addresses are all different; no more is in a kind than what they lead to."""
    if tag.found is None:
        a = tag.attrs
        href = a.get("href", "") if tag.name == "a" else ""
        more = tuple((k, v) for k, v in a.items() if k != "href") if len(a) > ("href" in a) else ()
        tag.found = _kind(tag.name, "/s-anzeige/" in href, _FEED.search(href) is not None, more)
    return tag.found


def promoted(page: Page, kinds: list[_Kind], card: int) -> bool:
    """Marked as paid by a class of the card's wrapper, or inside it by a class, an attribute or a small label."""
    wrapper = card
    while wrapper >= 0 and not kinds[wrapper].wrapper:
        wrapper = page.parents[wrapper]
    wrapper = card if wrapper < 0 else wrapper
    if kinds[wrapper].paid_class:
        return True
    for e in range(wrapper + 1, page.ends[wrapper]):
        k = kinds[e]
        # Labels of at most 24 characters have at most 12 words.
        if k.marked and (k.paid or (0 < page.last[e] - page.first[e] <= 12 and len(said := page.text(e)) <= 24 and PROMOTED_LABEL.fullmatch(said))):
            return True
    return False


def _joined(base: str, href: str) -> str:
    """urljoin(); a plain path on a bare host is only put behind it."""
    return base + href if _HOST.fullmatch(base) and _PATH.fullmatch(href) else urljoin(base, href)


def _own(page: Page, e: int) -> bool:
    """All the text of an element is its own, or all that of one inside it."""
    n, c, end = page.last[e] - page.first[e], e + 1, page.ends[e]
    while c < end:
        if page.last[c] - page.first[c] not in (0, n):
            return False
        c = page.ends[c]
    return True


def _shipping(page: Page, kinds: list[_Kind], card: int, named: list[int]) -> set[int]:
    """Which elements of a card are inside of a price with shipping."""
    up = page.parents
    around, e = False, card
    while e >= 0 and not around:
        around, e = kinds[e].shipping, up[e]
    within = {card: around}
    for e in range(card + 1, page.ends[card]):
        within[e] = within[up[e]] or kinds[e].shipping
    return {e for e in named if within[up[e]]}


class _Rows:
    """Pages as the rows of CARDS; offsets tell where the cards and links of a page and the texts of a card begin."""

    def __init__(self, base: str, longest: int | None, looked_at: int | None):
        self.base, self.longest, self.looked_at = base, float("inf") if longest is None else longest, float("inf") if looked_at is None else looked_at
        self.texts, self.cards, self.links, self.posted, self.priced = [], [], [], [], []
        self.cards_of, self.links_of, self.posted_of, self.priced_of = [0], [0], [0], [0]

    def add(self, html: str | None) -> None:
        page, counts = tree(html or ""), {}
        tags, kinds = page.tags, [tag.found or _found(tag) for tag in page.tags]
        chars = [0, *accumulate(map(len, page.words))]
        for e, k in enumerate(kinds):
            if k.card:
                self._card(page, kinds, chars, e)
            if k.feed:
                href, around = tags[e].attrs["href"], page.parents[e]
                if around not in counts:
                    counts[around] = _COUNT.search(page.text(around))
                self.links.append((href, _joined(self.base, href), counts[around] and counts[around][1]))
        self.texts.append(page.text())
        self.cards_of.append(len(self.cards))
        self.links_of.append(len(self.links))

    def _card(self, page: Page, kinds: list[_Kind], chars: list[int], card: int) -> None:
        first, last = page.first, page.last
        link = title = None
        small, alone, posted, priced = 0, [], [], []
        named = [e for e in range(card + 1, page.ends[card]) if kinds[e].prices]
        shipping = _shipping(page, kinds, card, named) if named else ()
        for e in range(card + 1, page.ends[card]):
            k = kinds[e]
            if link is None and k.link:
                link = e
            if title is None and k.title:
                title = e
            if k.dull:
                continue
            small += k.small
            a, b = first[e], last[e]
            # Its characters, with the blanks between words.
            n = chars[b] - chars[a] + b - a - 1
            text = page.text(e) if 0 < n <= self.longest else ""
            if k.posted is not None:
                posted.append((k.posted, e, text, k))
            if not text:
                continue
            if k.small and small <= self.looked_at and n <= ALONE and DATE_LIKE.search(text) and _own(page, e):
                alone.append((text, False))
            if n <= PRICE_CHARS and ("€" in text or text.lower() in FREE):
                if e in shipping:
                    priced.append((_INSIDE, False, False, 0, e, text))
                elif k.price is not None:
                    priced.append((k.price, False, False, 0, e, text))
                elif k.priced:
                    priced.append((len(PRICE_PLACES), "versand" in text.lower(), k.unnamed, n, e, text))
        for _, _, text, k in sorted(posted, key=lambda x: x[:2]) if len(posted) > 1 else posted:
            self.posted += [(said, False) for said in (text, *k.dates) if DATE_LIKE.search(said)]
            if k.moment:
                self.posted.append((k.moment, True))
        self.posted += alone
        self.priced += [x[-1] for x in sorted(priced)]
        name = link if title is None else title
        self.cards.append((None if link is None else _joined(self.base, page.tags[link].attrs["href"]), None if name is None else page.text(name), promoted(page, kinds, card), page.text(card)))
        self.posted_of.append(len(self.posted))
        self.priced_of.append(len(self.priced))

    def array(self) -> pa.Array:
        """As CARDS in Arrow."""
        text, flag = pa.string(), pa.bool_()

        def structs(names: str, *values: pa.Array) -> pa.Array:
            return pa.StructArray.from_arrays(values, names.split())

        def columns(rows: list[tuple], *types: pa.DataType) -> list[pa.Array]:
            return [pa.array(values, t) for values, t in zip(list(zip(*rows)) or [()] * len(types), types, strict=True)]

        def lists(offsets: list[int], values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

        posted, priced = structs("said moment", *columns(self.posted, text, flag)), pa.array(self.priced, text)
        cards = structs("url title promoted text posted priced", *columns(self.cards, text, text, flag, text), lists(self.posted_of, posted), lists(self.priced_of, priced))
        links = structs("href url count", *columns(self.links, text, text, text))
        return structs("text cards links", pa.array(self.texts, text), lists(self.cards_of, cards), lists(self.links_of, links))


def read_cards(html: Column, base: str, longest: int | None = LONGEST, looked_at: int | None = LOOKED_AT) -> Column:
    """Struct CARDS of each page. longest: characters of a stretch's text, looked_at: elements of a card that may be a date's alone; None for no limit."""

    @F.arrow_udf(CARDS)
    def read(pages: pa.Array) -> pa.Array:
        # In slices, as the rows of a page take more memory here than in Arrow.
        def part(i: int) -> pa.Array:
            rows = _Rows(base, longest, looked_at)
            for html in pages.slice(i, SLICE).to_pylist():
                rows.add(html)
            return rows.array()

        return pa.concat_arrays([part(i) for i in range(0, max(1, len(pages)), SLICE)])

    return read(html)


def _german(value: Column) -> Column:
    """A whole number whose thousands dots may group."""
    return F.nullif(F.regexp_replace(value, r"\D", ""), F.lit("")).cast("long")


def pages(captured: DataFrame, base: str, host: str, longest: int | None = LONGEST, looked_at: int | None = LOOKED_AT, feeds: int | None = FEEDS, plain_feeds: int | None = PLAIN_FEEDS) -> DataFrame:
    """captured (html, requested_page, final_url and any more columns) with the struct info: items and all that is known of the page.

    longest, looked_at, feeds, plain_feeds: see LONGEST, LOOKED_AT, FEEDS, PLAIN_FEEDS; None for no limit.
    """
    c = F.col
    limited = lambda found, most: found if most is None else F.slice(found, 1, most)
    rows = captured.select("*", read_cards(c("html"), base, longest, looked_at).alias("_r"))
    decoded = F.coalesce(F.try_url_decode("final_url"), "final_url", F.lit(""))
    known = F.transform(F.filter("_r.cards", lambda x: x["url"].isNotNull() & X.allowed_url(x["url"], host)), lambda x: F.struct(X.external_id(x["url"]).alias("id"), x.alias("card")))
    # Only what is still looked at goes on from step to step.
    rows = rows.select(
        *captured.columns, F.greatest(F.lit(1), F.coalesce(c("requested_page").cast("int"), F.lit(1))).alias("_page"), decoded.alias("_final"), known.alias("_known"), c("_r.text").alias("_text"), c("_r.links").alias("_links"), F.size("_r.cards").alias("_raw"),
        F.size(F.filter("_r.cards", lambda x: x["promoted"])).alias("_paid"),
    )
    rows = rows.withColumn("_plain", F.filter("_known", lambda k: ~k["card"]["promoted"])).withColumn("_promoted", F.array_distinct(F.transform(F.filter("_known", lambda k: k["card"]["promoted"]), lambda k: k["id"]))).drop("_known")
    keys = F.struct(F.transform("_plain", lambda k: k["card"]["url"]).alias("urls"), F.transform("_plain", lambda k: k["id"]).alias("ids"))
    first = X.let(keys, lambda of: F.filter("_plain", lambda k, i: (F.array_position(of["urls"], k["card"]["url"]) == i + 1) & (F.array_position(of["ids"], k["id"]) == i + 1)))
    rows = rows.withColumn("_first", first).withColumn("_copies", F.size("_plain") - F.size("_first")).drop("_plain")
    read = F.transform(F.filter("_first", lambda k: F.coalesce(k["card"]["title"], F.lit("")) != ""), lambda k: F.struct(k["id"].alias("id"), k["card"]["title"].alias("title"), k["card"]["url"].alias("url"), price_text(k["card"]).alias("price"), posted_text(k["card"]).alias("posted")))
    rows = rows.withColumn("_read", read).drop("_first")
    items = F.transform("_read", lambda k: F.struct(k["id"].alias("external_id"), k["title"].alias("title"), k["price"].alias("price_text"), X.parse_price(k["price"]).alias("price_eur"), k["url"].alias("url"), k["posted"].alias("posted_text")))
    missing = lambda field: F.size(F.filter("_items", lambda x: x[field].isNull()))
    rows = rows.withColumn("_items", items).drop("_read").withColumn("_undated", missing("posted_text")).withColumn("_coverage", F.when(F.size("_items") > 0, (F.size("_items") - c("_undated")) / F.size("_items")).otherwise(0.0))

    # The range of results, the stride that it implies, and the page that it is.
    span = r"(?i)(?<!\d)(\d[\d.]*)\s*[-–]\s*(\d[\d.]*)\s+von\s+(\d[\d.]*)"
    # The range is cut out of the text once, its numbers out of the range.
    rows = rows.withColumns({"_range": F.regexp_extract("_text", span, 0), "_low": F.lower("_text")}).drop("_text")
    rows = rows.withColumns({f"_{name}": _german(F.regexp_extract("_range", span, i)) for i, name in enumerate(("start", "end", "total"), 1)})
    ranged = (c("_start") > 0) & (c("_end") >= c("_start"))
    rows = rows.withColumn("_guess", F.rint((c("_start") - 1) / F.nullif(c("_page") - 1, F.lit(0))).cast("int"))
    guess = c("_guess")
    near = guess.between(10, 50) & (F.abs(c("_start") - 1 - guess * (c("_page") - 1)) <= F.greatest(F.lit(2), F.floor(F.greatest(F.lit(1), guess) * 0.15)))
    size = c("_end") - c("_start") + 1
    rows = rows.withColumn("_stride", F.when(ranged & (c("_page") > 1) & near, guess).when(ranged & (c("_page") == 1) & (size >= 10), F.least(F.lit(50), size)).otherwise(25).cast("int"))
    rows = rows.withColumn("_by_range", F.when(ranged, F.floor((c("_start") - 1) / c("_stride")) + 1).cast("int")).withColumn("_last", F.when(c("_total").isNotNull(), F.greatest(F.lit(1), F.ceil(c("_total") / c("_stride")))).cast("int"))
    rows = rows.withColumn("_by_url", X.found(c("_final"), r"/seite:(\d+)(?:/|$)", 1).cast("int"))
    confirmed = F.when(c("_by_url").isNotNull(), c("_by_url") == c("_page")).otherwise(c("_page") == 1)
    off = F.coalesce(c("_start") != 1 + (c("_page") - 1) * c("_stride"), F.lit(False)) | F.coalesce(c("_page") > c("_last"), F.lit(False))
    matches = F.when(c("_by_url") != c("_page"), False).otherwise(confirmed | ~off)
    verified = F.when(confirmed, True).when(c("_by_range").isNotNull(), c("_by_range") == c("_page")).otherwise(c("_page") <= 1)

    # All ids of a short page, the first and last of a longer one.
    own = F.transform("_items", lambda x: x["external_id"])
    print_ = F.array_join(F.when(F.size(own) <= 9, own).otherwise(F.concat(F.slice(own, 1, 6), F.slice(own, -3, 3))), "|")

    # Feeds of the same category in other places; those with counts, the smallest first, else as they come.
    feed = r"/(c\d+)l(\d+)(?:$|[/?])"
    rows = rows.withColumn("_code", X.found(c("_final"), r"/(c\d+)(?:l\d+)?(?:$|[/?])", 1)).withColumn("_here", F.regexp_extract("_final", r"/c\d+l(\d+)(?:$|[/?])", 1))
    elsewhere = lambda href: (F.regexp_extract(href, feed, 1) == c("_code")) & (F.regexp_extract(href, feed, 2) != c("_here"))
    other = F.filter("_links", lambda x: c("_code").isNotNull() & X.let(F.coalesce(F.try_url_decode(x["href"]), x["href"]), elsewhere) & X.allowed_url(x["url"], host))
    rows = rows.withColumn("_feeds", other).drop("_links")
    once = X.let(F.transform("_feeds", lambda x: x["url"]), lambda at: F.filter("_feeds", lambda x, i: F.array_position(at, x["url"]) == i + 1))
    rows = rows.withColumn("_feeds", F.transform(once, lambda x: F.struct(_german(x["count"]).alias("count"), x["url"].alias("url")))).withColumn("_counted", F.array_sort(F.filter("_feeds", lambda x: x["count"].isNotNull())))
    shards = F.when(F.size("_counted") > 0, limited(c("_counted"), feeds)).otherwise(limited(c("_feeds"), plain_feeds))

    challenge = functools.reduce(Column.__or__, (c("_low").contains(w) for w in CHALLENGE))
    info = F.struct(
        c("_page").alias("requested_page"), c("_items").alias("items"), c("_start").alias("result_start"), c("_end").alias("result_end"), c("_total").alias("total_results"),
        F.when(confirmed & c("_by_url").isNotNull(), c("_page")).otherwise(c("_by_range")).alias("actual_page"), c("_last").alias("max_page"), c("_stride").alias("stride"),
        F.coalesce(matches, F.lit(True)).alias("request_matches_page"), verified.alias("page_verified"), print_.alias("fingerprint"), c("_raw").alias("raw_candidates"),
        c("_paid").alias("promoted_filtered"), c("_promoted").alias("promoted_ids"),
        c("_copies").alias("duplicate_cards"), c("_undated").alias("missing_date_count"), missing("price_text").alias("missing_price_count"), c("_coverage").alias("date_coverage"),
        challenge.alias("suspicious"), ((F.size("_items") > 0) & (c("_coverage") < MIN_COVERAGE)).alias("low_coverage"), shards.alias("location_shards"),
    )
    return rows.select(*captured.columns, info.alias("info"))


def items(read: DataFrame, *keys: str) -> DataFrame:
    """S3: one row for each item of pages()."""
    # Outer: else Spark infers a filter on the number of items and computes all that they are made of once more for it.
    return read.select(*keys, F.posexplode_outer("info.items").alias("ordinal", "item")).filter("ordinal IS NOT NULL").select(*keys, "ordinal", "item.*")
