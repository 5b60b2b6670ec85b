r"""View counters and availability from captured answers (survey S13-S17, T20, X2-X3).

A counter is taken only where it says that it is one; values that disagree give none. Nulls give nulls.
"""

from __future__ import annotations

import functools
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

# Names of the public counter, phrases of pages that are gone, are a challenge or need a script.
OFFICIAL_KEYS = frozenset({"numvisits", "numvisitsstr"})
VIEW_KEYS = frozenset("views view viewcount view_count aufrufe aufruf counter cntr viewcounter view_counter".split())
VIEW_TEXT = re.compile(r'(?i)(?:"|\b)(num[_-]?visits?(?:str)?|views?|view[_-]?count|view[_-]?counter|counter|cntr|aufrufe?)(?:"|\b)\s*[:=]\s*"?(\d{1,9})"?')
GONE = ("die gewünschte anzeige ist nicht mehr verfügbar", "die gewuenschte anzeige ist nicht mehr verfuegbar", "anzeige nicht mehr verfügbar", "anzeige nicht mehr verfuegbar")
CHALLENGE = ("captcha", "access denied", "sicherheitsüberprüfung", "sicherheitsueberpruefung", "ungewöhnliche aktivität", "ungewoehnliche aktivitaet", "bot protection")
NEEDS_SCRIPT = ("javascript ist deaktiviert", "javascript aktivieren", "enable javascript")
MOST = 999_999_999
#: Entries of a list in JSON that are read, characters of a document and of a page's text by which its kind is told (None: all).
LIST_ITEMS, DOCUMENT_CHARS, PAGE_CHARS = 100, 20_000, 12_000


def counter_value(value: object) -> int | None:
    """A whole number from 0 to MOST, as a number or as digits that dots or blanks may group; truth values are none."""
    if isinstance(value, str):
        said = value.strip()
        return int(re.sub(r"\D", "", said)) if re.fullmatch(r"[0-9]{1,9}|[0-9]{1,3}(?:[.\s][0-9]{3})+", said) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or value in (float("inf"), float("-inf")) or value != int(value):
        return None
    return int(value) if 0 <= value <= MOST else None


def _named(data: object, wanted, items: int | None) -> list[tuple[str, int]]:
    """Path and value of the counters whose key is wanted, in the order of the tree."""
    found, todo = [], [("$", data)]
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                if wanted(k) and (n := counter_value(v)) is not None:
                    found.append((f"{path}.{k}", n))
            todo += [(f"{path}.{k}", v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            todo += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(x[:items])))]
    return found


@functools.lru_cache(4096)
def _official(key: str) -> bool:
    return re.sub(r"[^a-z0-9]", "", key.lower()) in OFFICIAL_KEYS


@functools.lru_cache(4096)
def _strict(key: str) -> bool:
    name = re.sub(r"[-\s]+", "_", key.strip().lower())
    return name in VIEW_KEYS or name.replace("_", "") in VIEW_KEYS


def payload_counter(body: str | None, items: int | None = LIST_ITEMS) -> tuple[int | None, str | None]:
    """Value and where it is from: official keys, else strict keys, anywhere in the JSON and all alike; else a key in the text. items: entries of each list that are read."""
    body = (body or "").strip()
    try:
        data = json.loads(body)
    except (ValueError, RecursionError):
        data = None
    for kind, wanted in (("official", _official), ("explicit", _strict)):
        if found := _named(data, wanted, items):
            if len({n for _, n in found}) > 1:
                return None, f"json-{kind}-conflict"
            path, n = found[0] if kind == "official" else min(found, key=lambda x: (len(x[0]), x[0]))
            return n, f"json-{kind}:{path}"
    m = VIEW_TEXT.search(body)
    return (int(m[2]), f"text:{m[1]}") if m else (None, None)


def payload_views(body: Column, items: int | None = LIST_ITEMS) -> Column:
    """S13 as a struct: views, source."""

    @F.arrow_udf("views long, source string")
    def read(bodies: pa.Array) -> pa.Array:
        found = [payload_counter(b, items) for b in bodies.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.string())], names=["views", "source"])

    return read(body)


def html_views(html: Column) -> Column:
    """The counter element's number."""
    said = F.regexp_extract(html, r"""(?is)id=["']?viewad-cntr-num["']?[^>]*>(?:\s|<[^>]*>)*([0-9][0-9.\s]*)""", 1)
    return F.nullif(F.regexp_replace(said, r"\D", ""), F.lit("")).cast("long")


def text_views(text: Column) -> Column:
    """The first whole number, its thousands grouped or not, up to MOST."""
    n = F.nullif(F.regexp_replace(F.regexp_extract(F.regexp_replace(text, r"\s+", " "), r"(?<!\d)(\d{1,3}(?:[. ]\d{3})+|\d{1,9})(?!\d)", 1), r"\D", ""), F.lit("")).cast("decimal(30)")
    return F.when(n <= MOST, n.cast("long"))


def extra_views(text: Column) -> Column:
    """The last number that is no date or time."""
    rest = F.regexp_replace(text, r"(?i)\b\d{1,2}\.\d{1,2}\.\d{4}\b|\b(?:Heute|Gestern)\b|\b\d{1,2}:\d{2}\b", " ")
    return F.try_element_at(F.regexp_extract_all(rest, F.lit(r"(?<!\d)(\d{1,9})(?!\d)"), F.lit(1)), F.lit(-1)).cast("long")


def first_counter(*sources: tuple[str, Column]) -> Column:
    """Struct views, source of the first source that has a counter; null views and source without any."""
    # A source's value is computed once, and only if those before it have none.
    counted = lambda name, c: F.get(F.transform(F.array(c), lambda n: F.when(n.isNotNull(), F.struct(n.cast("long").alias("views"), F.lit(name).alias("source")))), F.lit(0))
    return F.get(F.transform(F.array(F.coalesce(*[counted(name, c) for name, c in sources])), lambda x: F.struct(x["views"].alias("views"), x["source"].alias("source"))), F.lit(0))


def _has(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is in the text, which is computed once for all of them."""
    return F.exists(F.array(text), lambda t: functools.reduce(Column.__or__, [t.contains(w) for w in words]))


def _plain(html: Column) -> Column:
    """Lower-case text of a page, about as a reader sees it."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return F.lower(F.regexp_replace(bare, r"\s+", " "))


def available(url: Column, status: Column, html: Column, final_url: Column) -> Column:
    """False if gone, true if the ad's number is in the page or the address is still an ad's, null where neither can be said."""
    known = F.coalesce(html.contains(X.external_id(url)), F.lit(False)) | F.coalesce(final_url.contains("/s-anzeige/"), F.lit(False))
    return F.when(status.isin(404, 410), False).when(status.isin(403, 429) | (status >= 500), None).when(_has(_plain(html), GONE), False).when(known, True)


def _start(text: Column, chars: int | None) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return low if chars is None else F.substring(low, 1, chars)


def document_kind(html: Column, chars: int | None = DOCUMENT_CHARS) -> Column:
    """Challenge, script (too short or needs one) or page, by its first characters."""
    low = _start(html, chars)
    return F.when(_has(low, CHALLENGE), "challenge").when((F.length(F.coalesce(html, F.lit(""))) < 200) | _has(low, NEEDS_SCRIPT), "script").otherwise("page")


def page_kind(body: Column, final_url: Column, chars: int | None = PAGE_CHARS) -> Column:
    """Challenge, consent-only, redirected or normal, by the first characters of the text."""
    low = _start(body, chars)
    consent = low.contains("cookie") & low.contains("zustimmen") & (F.length(low) < 3500)
    return F.when(_has(low, (*CHALLENGE, "robot")), "challenge").when(consent, "consent-only").when(~F.coalesce(final_url, F.lit("")).contains("/s-anzeige/"), "redirected").otherwise("normal")
