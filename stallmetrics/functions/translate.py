r"""Texts in another language by phrases and words (survey T22).

translated() takes a dictionary of phrases and one of words, as parameters. Phrases go first, the longest before
the shorter ones, so that a phrase wins over its parts; one of letters alone is replaced as a whole word, any other
wherever it stands. Then words, in any case, a capital kept. Then the units behind numbers. All of it are built-in
expressions, folded over the dictionaries; a pattern is only run where its text has the word at all.

Cases: null and empty texts stay as they are; so does every text for another language than TO; an empty dictionary
changes nothing; phrases of one length go in the dictionary's order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages, and units behind a number.
LANGUAGES, TO = ("ru", "en"), "en"
UNITS = ((r"(?iU)(?<=\d)\s*стр\.?\b", " pages"), (r"(?iU)(?<=\d)\s*сек\.?\b", " sec"), (r"(?iU)(?<=\d)\s*мин\.?\b", " min"), (r"(?iU)(?<=\d)\s*ч\b", "h"))


def language(value: Column) -> Column:
    """A language that is known, or null."""
    said = F.lower(F.trim(value))
    return F.when(said.isin(*LANGUAGES), said)


def _pairs(of: dict[str, str]) -> Column:
    if not of:
        return F.array().cast("array<struct<source: string, target: string>>")
    return F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in of.items()])


def _quoted(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), text, F.lit(r"\E"))


def _plain(target: Column) -> Column:
    """As a replacement: no character of it is special."""
    return F.regexp_replace(target, r"([\\$])", r"\\$1")


def with_phrases(text: Column, phrases: dict[str, str]) -> Column:
    """The text with its phrases replaced, the longest first."""
    ordered = _pairs(dict(sorted(phrases.items(), key=lambda x: -len(x[0]))))

    def one(done: Column, p: Column) -> Column:
        whole = F.regexp_replace(done, F.concat(F.lit(r"(?U)(?<!\w)"), _quoted(p["source"]), F.lit(r"(?!\w)")), _plain(p["target"]))
        return F.when(~done.contains(p["source"]), done).when(p["source"].rlike("^[A-Za-zА-Яа-яЁё]+$"), whole).otherwise(F.replace(done, p["source"], p["target"]))

    return F.aggregate(ordered, text, one)


def with_words(text: Column, words: dict[str, str]) -> Column:
    """The text with its words replaced; one that begins with a capital gets one."""
    ordered = _pairs({k.lower(): v for k, v in sorted(words.items(), key=lambda x: -len(x[0]))})

    def one(done: Column, p: Column) -> Column:
        bare = F.concat(_quoted(p["source"]), F.lit(r")\b"))
        capital = F.concat(F.upper(F.substring(p["target"], 1, 1)), F.substring(p["target"], 2, 1000))
        upper = F.regexp_replace(done, F.concat(F.lit(r"(?U)\b(?=\p{Lu})(?i:"), bare), _plain(capital))
        return F.when(F.lower(done).contains(p["source"]), F.regexp_replace(upper, F.concat(F.lit(r"(?U)\b(?i:"), bare), _plain(p["target"]))).otherwise(done)

    return F.aggregate(ordered, text, one)


def translated(text: Column, to: Column, phrases: dict[str, str], words: dict[str, str]) -> Column:
    """T22."""
    out = with_words(with_phrases(text, phrases), words)
    for pattern, by in UNITS:
        out = F.regexp_replace(out, pattern, by)
    return F.when((F.coalesce(text, F.lit("")) == "") | ~F.coalesce(language(to) == TO, F.lit(False)), text).otherwise(out)
