"""Titles as normal forms, duplicate keys and families (survey T1-T11, T18-T23).

Folding needs Unicode decomposition, which Spark lacks: one Arrow UDF. All else is built-in expressions over the
folded title, so it is folded once a row and the rest stays in the JVM.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words of ads by what they do to a title.
STOPWORDS = (
    "verkaufe verkauft biete angebot original top sehr guter gute gutes guten zustand neu neuwertig gebraucht inkl inklusive mit ohne und oder der die das "
    "ein eine einer einen für fuer von zu zum zur aus ovp vb festpreis verkauf privat abholung versand moglich moeglich sofort edition wie auf bei im in an nur "
    "noch super perfekt funktioniert funktionierend voll wifi wi-fi wlan ethernet lieferung rechnung garantie"
).split()
NOISE_WORDS = "suche gesucht ankauf kaufe kaufen reparatur repariere service dienstleistung vermietung verleih tausche tausch wanted".split()
COLORS = (
    "schwarz black weiss weis white silber silver grau grey gray blau blue rot red grun green gruen gelb yellow pink rosa gold golden lila violett beige "
    "braun brown orange space spacegrau"
).split()
CONDITIONS = (
    "defekt kaputt beschadigt beschaedigt ungepruft ungeprueft unbenutzt originalverpackt geoffnet geoeffnet kratzer gebrauchsspuren bware b-ware restposten"
).split()
TYPES = (
    "controller gamepad headset dock dockingstation ladestation konsole console monitor fernseher tv kamera camera objektiv lens notebook laptop tablet "
    "smartphone handy drucker printer router receiver lautsprecher speaker soundbar beamer projektor uhr watch kopfhorer kopfhörer earbuds keyboard tastatur maus mouse"
).split()
VARIANTS = (
    "slim pro max mini plus ultra oled lite digital disc disk edge portal air studio classic fold flip fe se xl seriesx seriess elite"
).split()
BRANDS = (
    "apple sony nintendo microsoft samsung google meta valve lenovo dell asus acer hp huawei xiaomi oneplus oppo motorola canon nikon fujifilm panasonic lg "
    "philips bose jbl sennheiser dyson bosch makita"
).split()
ROOTS = (
    "ps5 ps4 ps3 psportal xbox seriesx seriess switch iphone ipad macbook imac macmini airpods appletv galaxy pixel steamdeck metaquest quest surface dualsense "
    "thinkpad ideapad legion vivobook zenbook rog"
).split()
ROOTS_OF_BRAND = {
    "sony": "ps5 ps4 ps3 psportal",
    "nintendo": "switch",
    "microsoft": "xbox seriesx seriess surface",
    "apple": "iphone ipad macbook imac macmini airpods appletv",
    "samsung": "galaxy",
    "google": "pixel",
    "valve": "steamdeck",
    "meta": "metaquest quest",
}
FAMILY_STOPWORDS = (
    "verkaufe verkaufen biete angebot neu neuwertig gebraucht top sehr gut guter gute gutes zustand original ovp mit ohne und oder fur fuer von der die das ein "
    "eine einer einem inkl inklusive versand abholung privat set bundle schwarz weiss white black blau blue rot red"
).split()

# Spellings and what they become, in this order.
SPELLINGS = (
    (r"\bplay\s*station\s*5\b", "ps5"), (r"\bplay\s*station\s*4\b", "ps4"), (r"\bplay\s*station\s*3\b", "ps3"), (r"\bplay\s*station\s*portal\b", "psportal"),
    (r"\bps\s*5\b", "ps5"), (r"\bps\s*4\b", "ps4"), (r"\bps\s*3\b", "ps3"), (r"\bx\s*box\b", "xbox"), (r"\bxbox\s+series\s+x\b", "xbox seriesx"),
    (r"\bxbox\s+series\s+s\b", "xbox seriess"), (r"\bmac\s*book\b", "macbook"), (r"\bmac\s+mini\b", "macmini"), (r"\bair\s*pods\b", "airpods"),
    (r"\bapple\s+tv\b", "appletv"), (r"\bsteam\s+deck\b", "steamdeck"), (r"\bmeta\s+quest\b", "metaquest"), (r"\b(\d+)\s*(gb|tb)\b", "$1$2"),
    (r"\b(\d+)\s*\.?\s*(?:generation|gen\.?|generationen)\b", "gen$1"), (r"\bgen\.?\s*(\d+)\b", "gen$1"),
)
IDENTITY_SPELLINGS = (
    (r"\bplay\s*station\s*portal\b", "ps portal"), (r"\bplay\s*station\s*5\b", "ps5"), (r"\bplay\s*station\s*4\b", "ps4"), (r"\bps\s*5\b", "ps5"), (r"\bps\s*4\b", "ps4"),
    (r"\bx\s*box\b", "xbox"), (r"\bmac\s*book\b", "macbook"), (r"\bmac\s+mini\b", "mac mini"), (r"\bair\s*pods\b", "airpods"), (r"\bapple\s+tv\b", "apple tv"),
    (r"\bsteam\s+deck\b", "steam deck"), (r"\bmeta\s+quest\b", "meta quest"),
)


def fold_text(text: str) -> str:
    """Sharp s spelled out, letters without their marks."""
    plain = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ẞ", "SS"))
    return "".join(c for c in plain if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def folded(titles: pd.Series) -> pd.Series:
    """Lower case and T1; null is empty."""
    return titles.fillna("").map(lambda t: t.lower() if t.isascii() else fold_text(t.lower()))


def _rewritten(text: Column, rules) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, f"(?U){pattern}", by)
    return text


def canonical(fold: Column) -> Column:
    """T2, of a folded title: spellings made one, words of a-z and 0-9 one blank apart."""
    return F.trim(F.regexp_replace(_rewritten(fold, SPELLINGS), "[^a-z0-9]+", " "))


def canonical_for_identity(fold: Column) -> Column:
    """T3, of a folded title: fewer spellings; punctuation stays, + is plus."""
    text = F.replace(_rewritten(fold, IDENTITY_SPELLINGS), F.lit("+"), F.lit(" plus "))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _words(*lists) -> Column:
    return F.array(*[F.lit(w) for w in dict.fromkeys(w for ws in lists for w in ws)])


def let(value: Column, of) -> Column:
    """of(value), with value computed once a row however often of uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def found(text: Column, pattern: str, group: int) -> Column:
    """The pattern's first match, null if there is none; unlike nullif(regexp_extract()), looked for once also in a lambda."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def title_words(fold: Column) -> Column:
    """T4 as a list: canonical words that aren't stop words."""
    return F.filter(F.split(canonical(fold), " "), lambda w: (w != "") & ~F.array_contains(_words(STOPWORDS), w))


def normalize_title(fold: Column) -> Column:
    """T4."""
    return F.array_join(title_words(fold), " ")


def normalize_word(text: str) -> str:
    """T4 of a search word, in the driver."""
    out = fold_text(text.lower())
    for pattern, by in SPELLINGS:
        out = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", by), out)
    return " ".join(w for w in re.sub("[^a-z0-9]+", " ", out).split() if w not in STOPWORDS)


def contains_any(normal: Column, words: list[str]) -> Column:
    """one of the words as whole tokens of a normalized title. A word that is all stop words is in no title."""
    needles = [n for w in words if (n := normalize_word(w))]
    padded = F.concat(F.lit(" "), normal, F.lit(" "))
    found = F.lit(False)
    for n in needles:
        found = found | padded.contains(f" {n} ")
    return found


def identity_words(fold: Column) -> Column:
    """T5: title words without colours, conditions, counts, and brands that a root implies."""
    plain = F.filter(title_words(fold), lambda w: ~F.array_contains(_words(COLORS, CONDITIONS), w) & ~w.rlike(r"^\d+x$"))

    def without_implied(words: Column) -> Column:
        implied = lambda w: F.greatest(*[(w == brand) & F.arrays_overlap(words, _words(roots.split())) for brand, roots in ROOTS_OF_BRAND.items()])
        return F.filter(words, lambda w: ~implied(w))

    return let(plain, without_implied)


def is_model_word(word: Column) -> Column:
    """T6."""
    return F.array_contains(_words(ROOTS, VARIANTS, TYPES), word) | word.rlike("[0-9]")


def family_of(words: Column) -> Column:
    """T7 without the recognizer, of identity words: struct key, confidence."""
    is_brand = lambda w: F.array_contains(_words(BRANDS), w)
    first = lambda a, n: F.slice(a, 1, n)

    def chosen(parts: Column) -> Column:
        models, brands, other = parts["models"], parts["brands"], parts["other"]
        picked = F.when(F.size(models) > 0, F.concat(models, first(brands, 1), first(other, 2))).otherwise(F.concat(first(brands, 1), first(other, 5)))
        return F.struct(F.sort_array(F.array_distinct(picked)).alias("key"), F.size(models).alias("models"))

    def scored(found: Column) -> Column:
        key = found["key"]
        score = (
            F.lit(25)
            + F.when(F.arrays_overlap(key, _words(ROOTS)), 35).otherwise(0)
            + F.when(F.exists(key, lambda w: w.rlike("[0-9]")), 20).otherwise(0)
            + F.when(F.arrays_overlap(key, _words(VARIANTS, TYPES)), 10).otherwise(0)
            + F.when(F.size(key) >= 2, 10).otherwise(0)
            - F.when((found["models"] == 0) & (F.size(key) < 2), 20).otherwise(0)
        )
        none = F.size(key) == 0
        return F.struct(F.when(none, "").otherwise(F.array_join(key, " ")).alias("key"), F.when(none, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score))).alias("confidence"))

    split = F.struct(F.filter(words, is_model_word).alias("models"), F.filter(words, is_brand).alias("brands"), F.filter(words, lambda w: ~is_model_word(w) & ~is_brand(w)).alias("other"))
    return let(let(split, chosen), scored)


def duplicate_key(category: Column, normal: Column, price_eur: Column, price_text: Column) -> Column:
    """Struct of lower-case category, normalized title and price."""
    price = F.coalesce(F.concat(F.lit("eur:"), price_eur.cast("string")), F.concat(F.lit("txt:"), F.lower(F.trim(F.coalesce(price_text, F.lit(""))))))
    return F.struct(F.lower(F.coalesce(category, F.lit(""))).alias("category"), normal.alias("title"), price.alias("price"))


def opportunity_family(fold: Column, category: Column) -> Column:
    """Fam:category:head|tail from a first name and model codes, or two more names; empty if too little is there."""
    tokens = F.filter(F.regexp_extract_all(canonical_for_identity(fold), F.lit("([a-z0-9]+(?:-[a-z0-9]+)*)"), 1), lambda t: (F.length(t) >= 2) & ~F.array_contains(_words(FAMILY_STOPWORDS), t))

    def named(ts: Column) -> Column:
        codes = F.filter(ts, lambda t: t.rlike("[a-z]") & t.rlike(r"\d") & ~t.rlike(r"^\d+(?:gb|tb|v|w|kw|mah|ah|mm|cm|hz|kg)$"))
        names = F.filter(ts, lambda t: t.rlike("^[a-z]+$") & (F.length(t) >= 3))
        return F.struct(F.coalesce(F.get(names, F.lit(0)), F.lit("product")).alias("head"), F.sort_array(F.array_distinct(F.when(F.size(codes) > 0, F.slice(codes, 1, 2)).otherwise(F.slice(names, 2, 2)))).alias("tail"))

    def key(n: Column) -> Column:
        whole = F.concat(F.lit("fam:"), F.coalesce(F.nullif(category, F.lit("")), F.lit("unknown")), F.lit(":"), F.array_join(F.concat(F.array(n["head"]), n["tail"]), "|"))
        return F.when(F.size(n["tail"]) > 0, whole).otherwise("")

    return let(let(tokens, named), key)


def cohort_key(identity_key: Column, identity_confidence: Column, family_key: Column) -> Column:
    """T10."""
    strong = (F.coalesce(identity_key, F.lit("")) != "") & (F.coalesce(identity_confidence, F.lit(0)) >= 70)
    return F.when(strong, F.concat(F.lit("id:"), identity_key)).otherwise(F.coalesce(family_key, F.lit("")))


def slug(fold: Column) -> Column:
    """T11."""
    return F.trim(F.regexp_replace(canonical_for_identity(fold), "[^a-z0-9]+", "-"), F.lit("-"))


# Values in texts and addresses

# How prices and addresses are written.
PRICE = r"(?i)(?<!\d)(\d{1,3}(?:\.\d{3})*|\d+)\s*€"


def parse_price(text: Column) -> Column:
    """Whole euros of the first price; dots group thousands."""
    return F.replace(found(text, PRICE, 1), F.lit("."), F.lit("")).cast("int")


def external_id(url: Column) -> Column:
    """The number of an ad's address, else the first long number, else the address."""
    return F.coalesce(found(url, r"/(\d{6,})-\d+-\d+(?:[/?#]|$)", 1), found(url, r"(\d{6,})", 1), url)


def page_url(url: Column, page: Column) -> Column:
    """the address of a later page of a category; an address without a category code is an error."""
    code = r"/(c\d+(?:l\d+)?)(\?.*|#.*|)$"
    paged = F.regexp_replace(url, F.lit(code), F.concat(F.lit("/seite%3A"), page.cast("string"), F.lit("/$1$2")))
    bad = F.raise_error(F.concat(F.lit("no category code in "), url)).cast("string")
    return F.when(page <= 1, url).when(url.rlike(code), paged).otherwise(bad)


def private_url(url: Column) -> Column:
    """the address with the private-seller segment, once."""
    segment, code = r"(?i)/anbieter(?:%3A|:)(?:privat|gewerblich)(?=/)", r"/(c\d+(?:l\d+)?)(\?.*|#.*|)$"
    bad = F.raise_error(F.concat(F.lit("no category code in "), url)).cast("string")
    return F.when(url.rlike(segment), F.regexp_replace(url, segment, "/anbieter%3Aprivat")).when(url.rlike(code), F.regexp_replace(url, code, "/anbieter%3Aprivat/$1$2")).otherwise(bad)


def allowed_url(url: Column, host: str) -> Column:
    """https on the host or below it."""
    # Plain addresses of the host, as most are, need no parsing.
    plain = url.rlike(rf"^https://(?:[a-z0-9]+\.)*{re.escape(host)}(?:/[A-Za-z0-9_/:.-]*)?$(?!\n)") if re.fullmatch(r"[a-z][a-z0-9]*(?:\.[a-z][a-z0-9]*)*", host) else F.lit(False)
    name = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(plain | ((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & ((name == host) | name.endswith(f".{host}"))), F.lit(False))


def hash_id(length: int, *parts: Column) -> Column:
    """The first digits of a SHA-1 of parts joined by |."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, length)


def grouped_int(text: Column) -> Column:
    """The first whole number, whose thousands may be grouped by dots or blanks."""
    found = F.nullif(F.regexp_extract(text, r"(\d{1,3}(?:[.\s]\d{3})+|\d+)", 1), F.lit(""))
    return F.try_to_number(F.regexp_replace(found, r"\D", ""), F.lit("999999999999")).cast("long")
