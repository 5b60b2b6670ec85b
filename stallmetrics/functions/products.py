r"""Products recognized in titles (survey T12-T17, and with them the first branch of T7).

RULES is an ordered table: the first rule whose marks are all in the title says brand, kind and model, which
variants and numbers to look for, and how sure that is. recognized() finds the number of the rule that hits by one
lazily evaluated CASE over the canonical title, and what the rule says by that number; all of it are built-in
expressions. Sizes are told apart by what stands beside them ("16GB RAM", "SSD: 512 GB") with
look-around patterns.

Cases: null, empty and unknown titles give empty strings, null sizes and confidence 0.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import IDENTITY_SPELLINGS, canonical_for_identity, family_of, fold_text, identity_words

# Brands in the order in which they are looked for, as they are shown.
BRANDS = {
    "apple": "Apple", "sony": "Sony", "nintendo": "Nintendo", "microsoft": "Microsoft", "valve": "Valve", "meta": "Meta", "samsung": "Samsung", "google": "Google", "nvidia": "NVIDIA", "amd": "AMD", "intel": "Intel", "asus": "ASUS", "acer": "Acer",
    "lenovo": "Lenovo", "dell": "Dell", "hp": "HP", "huawei": "Huawei", "xiaomi": "Xiaomi", "oneplus": "OnePlus", "oppo": "OPPO", "motorola": "Motorola", "canon": "Canon", "nikon": "Nikon", "fujifilm": "Fujifilm", "panasonic": "Panasonic", "lg": "LG",
    "philips": "Philips", "bose": "Bose", "jbl": "JBL", "sennheiser": "Sennheiser", "msi": "MSI", "gigabyte": "Gigabyte", "zotac": "Zotac", "sapphire": "Sapphire", "powercolor": "PowerColor",
}
# Kinds of products by words, in this order, and the code of an unknown model.
KINDS = (
    ("camera", r"\b(kamera|camera|eos|lumix)\b"), ("monitor", r"\b(monitor|display)\b"), ("watch", r"\b(watch|uhr)\b"), ("laptop", r"\b(laptop|notebook|thinkpad|ideapad|vivobook|zenbook)\b"), ("tablet", r"\btablet\b"),
    ("phone", r"\b(smartphone|handy)\b"), ("headphones", r"\b(kopfhorer|headphones|headset|earbuds)\b"), ("controller", r"\b(controller|gamepad)\b"),
)
CODE = r"\b[a-z]{1,12}[- ]?\d[a-z0-9-]{0,15}\b|\b[a-z]{2,8}\d{2,6}[a-z0-9-]*\b"
# What stands beside a size of memory and of storage, and sizes of screens and generations.
_RAM, _STORAGE = "ram|arbeitsspeicher|memory|ddr[345]?", "ssd|speicher|storage|festplatte|nvme"
SCREEN = r"""\b(1[1-7](?:[.,]\d)?)\s*(?:zoll|inch|")"""
GENERATIONS = (r"\b(\d{1,2})\s*\.?\s*(?:generation|gen(?:eration)?\.?)\b", r"\bgen(?:eration)?\.?\s*(\d{1,2})\b")
UNKNOWN = "Не распознано"

_SIZE = r"\d+(?:[.,]\d+)?\s*(?:tb|gb)\b"
_ALONE = r"(?<!\d)(?<!\d[.,])"
#: What may stand between a word and a size; canonical titles have single blanks.
_GAP = r"\s?[:/-]?\s?"
_RAM_AHEAD, _RAM_BEHIND, _ANOTHERS_RAM = rf"(?=\s*(?:{_RAM})\b)", rf"(?<=(?:{_RAM}){_GAP})", rf"(?<=\d\s?(?:gb|tb)\s(?:{_RAM}){_GAP})"
_STORAGE_AHEAD, _STORAGE_BEHIND = rf"(?=\s*(?:{_STORAGE})\b)", rf"(?<=(?:{_STORAGE}){_GAP})"


def _not(look: str) -> str:
    return look.replace("(?=", "(?!", 1).replace("(?<=", "(?<!", 1)


#: Sizes of memory, and those that may be of storage: not of memory, or said to be of storage.
RAM_SIZES = rf"{_ALONE}(?:{_SIZE}{_RAM_AHEAD}|{_RAM_BEHIND}{_not(_ANOTHERS_RAM)}{_SIZE})"
STORAGE_SIZES = rf"{_ALONE}(?:(?:{_not(_RAM_BEHIND)}|{_ANOTHERS_RAM}){_SIZE}{_not(_RAM_AHEAD)}|{_STORAGE_BEHIND}{_SIZE}|{_SIZE}{_STORAGE_AHEAD})"


class Rule(NamedTuple):
    """marks: patterns that are all in the title. models: the first whose pattern is found; $1... are groups of `code` as codes are spelled, $[1]... with capital initials.

    variants: of each group the first whose pattern is found. sure: a condition and the confidence if it holds, then that without it.
    """

    marks: tuple[str, ...]
    brand: str
    kind: str
    models: tuple[tuple[str, str], ...]
    sure: tuple[tuple[str, int], ...]
    code: str = ""
    variants: tuple[tuple[tuple[str, str], ...], ...] = ()
    storage: tuple[int, int] | None = None
    ram: str = ""  # "said" or "guessed" too
    specs: tuple[str, ...] = ()
    chips: str = ""  # what may follow a chip's name


def _w(words: str) -> str:
    return rf"\b{words}\b"


def _each(*pairs: tuple[str, str]) -> tuple[tuple[str, str], ...]:
    return tuple((_w(p), v) for p, v in pairs)


_PHONE_SIZES = (("pro\\s+max", "Pro Max"), ("pro", "Pro"), ("plus", "Plus"), ("mini", "Mini"))
_IPHONE = r"\biphone\s*(se(?:\s*[123])?|x(?:s|r)?|(?:[6-9]|1\d)(?:e)?)\b"
_GALAXY = r"\bgalaxy\s+(s\s*\d{2}|a\s*\d{2}|note\s*\d{1,2}|z\s*(?:fold|flip)\s*\d+)\b"
_CONSOLE = (_each(("pro", "Pro"), ("slim", "Slim")), _each((r"(?:digital|ohne\s+laufwerk)", "Digital"), (r"(?:disc|disk|mit\s+laufwerk)", "Disc")))
_SWITCH = (_each((r"switch\s*2", ""), ("oled", "OLED"), ("lite", "Lite")),)
_NVIDIA, _RADEON = r"\b(rtx|gtx)\s*(\d{3,4})(?:\s*(ti))?(?:\s*(super))?\b", r"\brx\s*(\d{4})(?:\s*(xtx|xt))?\b"
_RYZEN, _CORE, _CORE_ULTRA = r"\bryzen\s*([3579])\s*(\d{4,5}[a-z0-9]{0,3})\b", r"\b(?:intel\s+)?(?:core\s+)?i([3579])[-\s]?(\d{4,5}[a-z]{0,2})\b", r"\b(?:intel\s+)?core\s+ultra\s*([579])\s*(\d{3}[a-z]?)\b"

# The known products, in the order in which they are tried.
RULES = (
    Rule((_IPHONE,), "apple", "phone", (("", "iPhone $1"),), (("storage", 94), ("", 90)), _IPHONE, (_each(*_PHONE_SIZES),), (32, 2000)),
    Rule(("iphone",), "apple", "phone", (("", "iPhone"),), (("", 58),)),
    Rule((_w("ipad"),), "apple", "tablet", (*_each((r"ipad\s+pro", "iPad Pro"), (r"ipad\s+air", "iPad Air"), (r"ipad\s+mini", "iPad mini")), ("", "iPad")), (("storage or specs", 92), ("", 84)), storage=(32, 4000), specs=("screen", "chip", "generation")),
    Rule(("macbook",), "apple", "laptop", (*_each((r"macbook\s+air", "MacBook Air"), (r"macbook\s+pro", "MacBook Pro")), ("", "MacBook")), (("chip", 96), ("", 86)), storage=(128, 8000), ram="guessed", specs=("screen", "chip"), chips="pro|max|ultra"),
    Rule((r"\bapple\s+tv\b", _w("4k")), "apple", "streamer", (("", "Apple TV 4K"),), (("", 96),), variants=((("ethernet", "Ethernet"),),), storage=(16, 512), specs=("generation",)),
    Rule((r"\bapple\s+tv\b",), "apple", "streamer", ((_w("hd"), "Apple TV HD"), ("", "Apple TV")), (("", 88),), variants=((("ethernet", "Ethernet"),),), storage=(16, 512), specs=("generation",)),
    Rule(("airpods",), "apple", "headphones", (*_each((r"airpods\s+pro", "AirPods Pro"), (r"airpods\s+max", "AirPods Max")), ("", "AirPods")), (("", 90),), specs=("generation",)),
    Rule((r"\bmac\s+mini\b",), "apple", "desktop", (("", "Mac mini"),), (("chip", 92), ("", 82)), storage=(128, 8000), ram="said", specs=("chip",), chips="pro|max"),
    Rule((_w("imac"),), "apple", "desktop", (("", "iMac"),), (("", 88),), storage=(128, 8000), ram="said", specs=("screen", "chip")),
    Rule((r"\b(ps\s+portal|psportal|playstation\s+portal)\b",), "sony", "handheld", (("", "PlayStation Portal"),), (("", 98),)),
    Rule((r"\bdualsense\s+edge\b",), "sony", "controller", (("", "DualSense Edge"),), (("", 99),)),
    Rule((_w("dualsense"),), "sony", "controller", (("", "DualSense"),), (("", 92),)),
    Rule(("controller", "ps5|playstation"), "sony", "controller", (("", "DualSense"),), (("", 92),)),
    Rule(("ps5|playstation 5", r"\b(laufwerk|disc\s+drive|disk\s+drive)\b", r"\b(fur|fuer|for)\s+(?:die\s+)?(?:ps5|playstation)\b|\bps5\s+(?:disc\s+)?laufwerk\b"), "sony", "accessory", (("", "PS5 Disc Drive"),), (("", 93),)),
    Rule(("ps5",), "sony", "console", (("", "PlayStation 5"),), (("variant", 98), ("", 92)), variants=_CONSOLE, storage=(250, 8000)),
    Rule(("ps4",), "sony", "console", (("", "PlayStation 4"),), (("variant", 98), ("", 92)), variants=_CONSOLE, storage=(250, 8000)),
    Rule((_w("xbox"), "controller|gamepad"), "microsoft", "controller", (("", "Xbox Controller"),), (("", 88),)),
    Rule((_w("xbox"), r"\b(?:series\s*[xs]|xbox\s+one)\b"), "microsoft", "console", (*_each((r"series\s*x", "Xbox Series X"), (r"series\s*s", "Xbox Series S"), (r"xbox\s+one\s+x", "Xbox One X"), (r"xbox\s+one\s+s", "Xbox One S")), ("", "Xbox One")), (("", 94),), storage=(250, 8000)),
    Rule((_w("xbox"),), "microsoft", "console", (("", "Xbox"),), (("", 70),), storage=(250, 8000)),
    Rule(("switch", r"\b(pro\s+)?controller\b"), "nintendo", "controller", (("", "Switch Controller"),), (("", 88),), variants=_SWITCH),
    Rule(("switch",), "nintendo", "console", ((r"\bswitch\s*2\b", "Nintendo Switch 2"), ("", "Nintendo Switch")), (("", 96),), variants=_SWITCH, storage=(32, 4000)),
    Rule((r"\bsteam\s+deck\b",), "valve", "handheld", (("", "Steam Deck"),), (("", 98),), variants=((("oled", "OLED"),),), storage=(64, 4000)),
    Rule((r"\b(?:meta\s+)?quest\s*(3s|[123]|pro)?\b",), "meta", "headset", (("", "Meta Quest $1"),), (("code", 94), ("", 78)), r"\b(?:meta\s+)?quest\s*(3s|[123]|pro)?\b", storage=(64, 2000)),
    Rule((_GALAXY,), "samsung", "phone", (("", "Galaxy $1"),), (("", 92),), _GALAXY, (_each(("ultra", "Ultra"), ("plus", "Plus")), _each(("fe", "FE"))), (32, 2000)),
    Rule((r"\bpixel\s*(\d{1,2}[a-z]?)\b",), "google", "phone", (("", "Pixel $1"),), (("", 94),), r"\bpixel\s*(\d{1,2}[a-z]?)\b", (_each((r"pro\s+xl", "Pro XL"), ("pro", "Pro"), ("xl", "XL"), ("fold", "Fold")),), (32, 2000)),
    Rule((_NVIDIA,), "nvidia", "gpu", (("", "$1 $2"),), (("", 98),), _NVIDIA, ((("", "$[3]"),), (("", "$[4]"),))),
    Rule((_RADEON,), "amd", "gpu", (("", "RX $1"),), (("", 98),), _RADEON, ((("", "$2"),),)),
    Rule((_RYZEN,), "amd", "cpu", (("", "Ryzen $1 $2"),), (("", 99),), _RYZEN),
    Rule((_CORE,), "intel", "cpu", (("", "Core i$1-$2"),), (("", 99),), _CORE),
    Rule((_CORE_ULTRA,), "intel", "cpu", (("", "Core Ultra $1 $2"),), (("", 99),), _CORE_ULTRA),
)

IDENTITY = "struct<brand: string, product_type: string, model: string, variant: string, storage_gb: int, ram_gb: int, specs: string, key: string, label: string, confidence: int>"


def _u(pattern: str) -> str:
    return f"(?U){pattern}"


def _let(value: Column, of) -> Column:
    """of(value), with value computed once a row however often of uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _by(hit: Column, values: list) -> Column:
    """Of a value for each rule that of the rule that hit."""
    return F.get(F.array(*map(F.lit, values)), hit)


def _case(hit: Column, of: dict[int, Column], otherwise: Column) -> Column:
    found = F
    for i, value in of.items():
        found = found.when(hit == i, value)
    return found.otherwise(otherwise) if of else otherwise


def _spelled(code: Column, brand: str) -> Column:
    """A model's code as it is shown: in capitals but for the e of some phones, folding phones by words."""
    plain = F.regexp_replace(code, r"\s+", "")
    if brand == "apple":
        return F.when(code.rlike("^se"), F.concat(F.lit("SE"), F.substring(code, 3, 9))).when(code.rlike(r"^\d+e$"), code).otherwise(F.upper(plain))
    if brand == "samsung":
        return F.when(plain.rlike("^z(fold|flip)"), F.initcap(F.regexp_replace(plain, r"^z(fold|flip)", "z $1 "))).otherwise(F.upper(plain))
    return F.upper(plain)


def _filled(codes: Column, rule: Rule, template: str) -> Column:
    """The template with groups of the rule's code in it."""
    parts = [p for p in re.split(r"(\$\[?\d\]?)", template) if p]
    at = lambda p: F.get(codes, F.lit(int(p.strip("$[]")) - 1))
    shown = [F.initcap(at(p)) if p.startswith("$[") else _spelled(at(p), rule.brand) if p[0] == "$" else F.lit(p) for p in parts]
    return F.lit(template) if "$" not in template else F.trim(F.concat(*shown)) if len(shown) > 1 else shown[0]


def _first(text: Column, codes: Column, rule: Rule, choices: tuple[tuple[str, str], ...]) -> Column:
    found = F
    for pattern, value in choices:
        filled = _filled(codes, rule, value)
        if not pattern:
            return filled if found is F else found.otherwise(filled)
        found = found.when(text.rlike(_u(pattern)), filled)
    return found.otherwise("")


def sizes(text: Column, pattern: str = _ALONE + _SIZE) -> Column:
    """Gigabytes of all sizes that the pattern finds in a canonical title; a terabyte has 1000."""
    number = lambda s: F.regexp_extract(F.replace(s, F.lit(","), F.lit(".")), r"^[0-9.]+", 0).cast("double")
    return F.transform(F.regexp_extract_all(text, F.lit(_u(pattern)), F.lit(0)), lambda s: F.bround(number(s) * F.when(s.endswith("tb"), 1000).otherwise(1)).cast("int"))


def storage_size(text: Column, least: Column | int, most: Column | int) -> Column:
    """The largest size in range that is not memory's alone."""
    return F.array_max(F.filter(sizes(text, STORAGE_SIZES), lambda gb: gb.between(least, most)))


def ram_size(text: Column, guessed: bool = False) -> Column:
    """The largest size said to be memory's; guessed: else the least small one beside a large one."""
    said = F.array_max(F.filter(sizes(text, RAM_SIZES), lambda gb: gb.between(2, 128)))
    if not guessed:
        return said
    every = sizes(text)
    return F.coalesce(said, F.when((F.size(every) >= 2) & F.exists(every, lambda gb: gb >= 128), F.array_min(F.filter(every, lambda gb: gb.between(4, 128)))))


def generation(text: Column) -> Column:
    """T15."""
    found = [F.regexp_extract(text, _u(p), 1) for p in GENERATIONS]
    n = F.when(found[0] != "", found[0]).otherwise(found[1])
    return F.when(n != "", F.concat(F.lit("Gen "), n.cast("int").cast("string"))).otherwise("")


def screen_size(text: Column) -> Column:
    """Inches, from 11 to 17."""
    found = F.regexp_extract(text, _u(SCREEN), 1)
    return F.when(found != "", F.concat(F.replace(found, F.lit(","), F.lit(".")), F.lit('"'))).otherwise("")


def chip(text: Column, more: Column) -> Column:
    """A chip's name, with what may follow it if more says so ("pro", "max" and, if more is 2, "ultra")."""
    name = F.upper(F.regexp_extract(text, _u(r"\b(m[1-6])\b"), 1))
    follows = F.regexp_extract(text, _u(r"\b(?:m[1-6])(?:\s+(pro|max|ultra))?\b"), 1)
    return F.when((more > 0) & (follows != "") & ((more > 1) | (follows != "ultra")), F.concat(name, F.lit(" "), F.initcap(follows))).otherwise(name)


def memory_label(gb: Column) -> Column:
    """T13."""
    tb = F.regexp_replace((gb / 1000).cast("decimal(12,3)").cast("string"), r"\.?0+$", "")
    return F.when(gb >= 1000, F.concat(tb, F.lit(" TB"))).otherwise(F.concat(gb.cast("string"), F.lit(" GB")))


def _slug_of(text: str) -> str:
    """T11 of a fixed text, in the driver."""
    out = fold_text(text.lower())
    for pattern, by in IDENTITY_SPELLINGS:
        out = re.sub(pattern, by, out)
    return re.sub("[^a-z0-9]+", "-", out.replace("+", " plus ")).strip("-")


def _slug(shown: Column) -> Column:
    """T11 of a model, variant or spec: of the spellings only the console's can be in one."""
    plain = F.regexp_replace(F.lower(shown), r"play\s*station ([45])", "ps$1")
    return F.trim(F.regexp_replace(F.replace(plain, F.lit("playstation portal"), F.lit("ps portal")), "[^a-z0-9]+", "-"), F.lit("-"))


def composed(brand: Column, kind: Column, model: Column, variants: Column, storage: Column, ram: Column, specs: Column, confidence: Column) -> Column:
    """The struct IDENTITY; key of slugs and sizes, label of what is shown."""
    kept = lambda cs: F.array_distinct(F.filter(cs, lambda c: c != ""))
    variant, spec = F.array_join(kept(variants), " "), kept(specs)
    some = lambda cs: F.filter(cs, lambda c: F.coalesce(c, F.lit("")) != "")
    sized = F.array(F.concat(F.lit("ram-"), ram.cast("string"), F.lit("gb")), F.concat(F.lit("storage-"), storage.cast("string"), F.lit("gb")))
    key = F.array_join(some(F.concat(F.array(_slug(brand), _slug(kind), _slug(model), _slug(variant)), sized, F.transform(spec, _slug))), "|")
    told = F.array(F.when(F.lower(model).startswith(F.lower(brand)), "").otherwise(brand), model, variant, F.array_join(spec, " · "), F.concat(ram.cast("string"), F.lit(" GB RAM")), memory_label(storage))
    return F.struct(
        brand.alias("brand"), kind.alias("product_type"), model.alias("model"), variant.alias("variant"), storage.cast("int").alias("storage_gb"), ram.cast("int").alias("ram_gb"), F.array_join(spec, " · ").alias("specs"),
        key.alias("key"), F.array_join(some(told), " · ").alias("label"), confidence.cast("int").alias("confidence"),
    )


def _hit(text: Column) -> Column:
    """The number of the first rule whose marks are all in the text, or null."""
    found = F
    for i, rule in enumerate(RULES):
        marks = [text.rlike(_u(m)) if re.search(r"[\\|\[(]", m) else text.contains(m) for m in rule.marks]
        found = found.when(functools.reduce(Column.__and__, marks), F.lit(i))
    return found


def _by_rule(text: Column, hit: Column, codes: Column) -> Column:
    none = F.lit(None).cast("int")
    low, high = (_by(hit, [r.storage and r.storage[k] for r in RULES]) for k in (0, 1))
    storage = F.when(low.isNotNull(), storage_size(text, low, high))
    ram = F.when(_by(hit, [r.ram for r in RULES]) == "guessed", ram_size(text, True)).when(_by(hit, [r.ram for r in RULES]) == "said", ram_size(text)).otherwise(none)
    has = lambda name: _by(hit, [name in r.specs for r in RULES])
    specs = [F.when(has("screen"), screen_size(text)).otherwise(""), F.when(has("chip"), chip(text, _by(hit, [len(r.chips.split("|")) - 1 for r in RULES]))).otherwise(""), F.when(has("generation"), generation(text)).otherwise("")]
    # Rules with the same groups of variants share them.
    groups: dict[tuple, list[int]] = {}
    for i, r in enumerate(RULES):
        for k, choices in enumerate(r.variants):
            groups.setdefault((k, choices, r.brand if r.code else ""), []).append(i)
    variants = [F, F]
    for (k, choices, _), of in groups.items():
        variants[k] = variants[k].when(hit.isin(of), _first(text, codes, RULES[of[0]], choices))
    variants = [v.otherwise("") for v in variants]
    fixed = _by(hit, [r.models[0][1] if r.models[0][0] == "" and "$" not in r.models[0][1] else None for r in RULES])
    model = _case(hit, {i: _first(text, codes, r, r.models) for i, r in enumerate(RULES) if r.models[0][0] or "$" in r.models[0][1]}, fixed)
    brand, kind, condition = (_by(hit, x) for x in ([BRANDS[r.brand] for r in RULES], [r.kind for r in RULES], [r.sure[0][0] for r in RULES]))

    def sure(parts: Column) -> Column:
        told = F.array_join(parts["specs"], "")
        holds = (
            F.when(condition == "storage", parts["storage"].isNotNull()).when(condition == "storage or specs", parts["storage"].isNotNull() | (told != "")).when(condition == "chip", parts["specs"][1] != "")
            .when(condition == "variant", F.array_join(parts["variants"], "") != "").when(condition == "code", F.get(codes, F.lit(0)) != "").otherwise(F.lit(True))
        )
        confidence = F.when(holds, _by(hit, [r.sure[0][1] for r in RULES])).otherwise(_by(hit, [r.sure[-1][1] for r in RULES]))
        return composed(brand, kind, parts["model"], parts["variants"], parts["storage"], parts["ram"], parts["specs"], confidence)

    return _let(F.struct(model.alias("model"), storage.alias("storage"), ram.alias("ram"), F.array(*variants).alias("variants"), F.array(*specs).alias("specs")), sure)


def _generic(text: Column, category: Column) -> Column:
    """A known brand, with the first thing that looks like a model's code."""
    names = F.array(*map(F.lit, BRANDS))
    place = F.array_min(F.transform(F.regexp_extract_all(text, F.lit(_u(rf"\b({'|'.join(BRANDS)})\b")), F.lit(1)), lambda b: F.array_position(names, b)))
    brand = F.get(F.array(*map(F.lit, BRANDS.values())), (place - 1).cast("int"))
    source = F.concat(text, F.lit(" "), category)
    kind = F.coalesce(*[F.when(source.rlike(_u(p)), F.lit(k)) for k, p in KINDS], F.lit("device"))
    code = F.upper(F.regexp_replace(F.regexp_extract(text, _u(CODE), 0), r"\s+", ""))
    none = F.lit(None).cast("int")
    no = F.array().cast("array<string>")
    known = lambda p: composed(p["brand"], p["kind"], F.when(p["code"] != "", p["code"]).otherwise(p["brand"]), no, none, none, no, F.when(p["code"] != "", 58).otherwise(38))
    return F.when(place.isNotNull(), _let(F.struct(brand.alias("brand"), kind.alias("kind"), code.alias("code")), known)).otherwise(_nothing())


def _nothing() -> Column:
    e, none = F.lit(""), F.lit(None).cast("int")
    return F.struct(e.alias("brand"), e.alias("product_type"), e.alias("model"), e.alias("variant"), none.alias("storage_gb"), none.alias("ram_gb"), e.alias("specs"), e.alias("key"), e.alias("label"), F.lit(0).alias("confidence"))


def recognized(fold: Column, category: Column | None = None) -> Column:
    """Struct IDENTITY of a folded title. category, folded too, tells the kind of products that no rule knows."""

    def of(s: Column) -> Column:
        text, hit = s["text"], s["hit"]
        codes = _case(hit, {i: F.array(*[F.regexp_extract(text, _u(r.code), g + 1) for g in range(re.compile(r.code).groups)]) for i, r in enumerate(RULES) if r.code}, F.array().cast("array<string>"))
        known = _let(F.struct(text.alias("text"), hit.alias("hit"), codes.alias("codes")), lambda k: _by_rule(k["text"], k["hit"], k["codes"]))
        return F.when(text == "", _nothing()).when(hit.isNotNull(), known).otherwise(_generic(text, canonical_for_identity(category) if category is not None else F.lit("")))

    return _let(_let(canonical_for_identity(F.coalesce(fold, F.lit(""))), lambda text: F.struct(text.alias("text"), _hit(text).alias("hit"))), of)


def product_family(fold: Column) -> Column:
    """Struct key, confidence: of a product that is recognized with at least 70, else of the title's identity words."""
    known = recognized(fold)
    return _let(known, lambda p: F.when((p["key"] != "") & (p["confidence"] >= 70), F.struct(p["key"].alias("key"), p["confidence"].alias("confidence"))).otherwise(family_of(identity_words(fold))))


def summary(identity: Column) -> Column:
    """What is shown of a product."""
    return F.when(identity["key"] == "", UNKNOWN).otherwise(F.coalesce(*[F.nullif(identity[f], F.lit("")) for f in ("label", "model", "key")]))
