r"""Repair of a conversation's structure by the cheapest edits, found by a scan of min-plus matrices.

A row has the first fault that it shows: blank (no `[^\x20\x09-\x0D]`), duplicate (role and text stood earlier
in its conversation), truncated (the last such character is not one of `[.!?]`). The roles' initials of a whole
conversation read `(s?(ua)+)?`. Edits are Keep (0), Rerole to user or assistant (2), Delete (3; a blank or
duplicate row must go) and Insert (2) of an empty turn of user or assistant anywhere; a truncated row that
stays adds 1. The audit is the initials of the edits in their order; of the cheapest the ASCII-least is taken.

The grammar is an automaton of 4 states, in each of which one of the two roles that may be inserted leads on,
so an audit says what each edit is. A row is a 4x4 matrix: the least (cost, audit) from state to state by one
edit of the row and any inserts behind it (the closure). Matrices multiply by joining audits and adding costs
and taking the least. Two audits of equal cost are never one the other's beginning (what is longer has more
inserts, at the same edits of the rows), so joining keeps their order and the product is associative. So rows
are multiplied in runs of at most RUN by their places, and runs in groups of FAN, until each conversation is
one element; no task holds more than a run or a group, however long a conversation is and wherever its rows
lie. What has to be read in order, the repaired turns of a conversation, streams through one task by a sort
that spills; nothing of it is held but its audit.

Cases: rows go by turn (nulls first), and those of one turn by role and text; null roles and texts are one
space; a role that begins with none of s, u, a cannot stay; a null conv_id is a conversation like another; rows
that repeat are duplicates; an empty table gives no rows; texts may be of any length; other columns are not
read. A conversation's audit is one value, and has to fit in a row.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, in_arrow

#: Places of a run of rows, and of how many elements one is made, as powers of two.
RUN, FAN = 10, 6
#: Costs of the edits, and of leaving a truncated row.
KEEP, REROLE, DELETE, INSERT, LEFT = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: Of each state the initials that lead on, and the state they lead to. 0: nothing yet, 1: system, 2: user, 3: assistant.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
END = (0, 3)
LEGAL = ("su", "ua", "au")
#: The role that may be inserted, or put in a role's place, in each state.
LED = tuple(next(r for r in "ua" if r in n) for n in NEXT)

Element = tuple[int, str]
Matrix = tuple[tuple[Element | None, ...], ...]
#: A letter for each initial (s, u, a, another) with each fault (none, truncated, to be deleted).
INITIALS, FAULTS = ("s", "u", "a", ""), ("", "truncated", "gone")
_LETTERS = "".join(chr(97 + i) for i in range(len(INITIALS) * len(FAULTS)))


def _least(x: Element | None, y: Element | None) -> Element | None:
    return y if x is None else x if y is None else min(x, y)


def times(x: Matrix, y: Matrix) -> Matrix:
    """The min-plus product."""
    out = []
    for row in x:
        held: list[Element | None] = [None] * 4
        for left, right in zip(row, y, strict=True):
            if left is not None:
                for j, e in enumerate(right):
                    if e is not None:
                        held[j] = _least(held[j], (left[0] + e[0], left[1] + e[1]))
        out.append(tuple(held))
    return tuple(out)


def _closure() -> Matrix:
    """From state to state by inserts alone: going on without a turn is cheapest, so two inserts lead as far as any."""
    rows = []
    for p in range(4):
        row: list[Element | None] = [None] * 4
        at = p
        for n in range(3):
            row[at] = _least(row[at], (n * INSERT, "I" * n))
            at = NEXT[at][LED[at]]
        rows.append(tuple(row))
    return tuple(rows)


CLOSURE = _closure()


@functools.cache
def turn(letter: str) -> Matrix:
    """The matrix of a row."""
    initial, fault = INITIALS[_LETTERS.index(letter) // len(FAULTS)], FAULTS[_LETTERS.index(letter) % len(FAULTS)]
    rows = []
    for p in range(4):
        row: list[Element | None] = [None] * 4
        row[p] = (DELETE, "D")
        if fault != "gone":
            left = LEFT if fault == "truncated" else 0
            to = NEXT[p][LED[p]]
            row[to] = _least(row[to], (REROLE + left, "R"))
            if initial in NEXT[p]:
                to = NEXT[p][initial]
                row[to] = _least(row[to], (KEEP + left, "K"))
        rows.append(tuple(row))
    return times(tuple(rows), CLOSURE)


@functools.lru_cache(50_000)
def _short(letters: str) -> Matrix:
    return run(letters)


def run(letters: str) -> Matrix:
    """The product of the rows' matrices, by halves; short runs come again and are kept."""
    if len(letters) == 1:
        return turn(letters)
    of = _short if len(letters) <= 32 else run
    half = len(letters) // 2
    return times(of(letters[:half]), of(letters[half:]))


def cheapest(m: Matrix) -> Element:
    """Of a whole conversation."""
    start = times((CLOSURE[0], *[(None,) * 4] * 3), m)[0]
    return min(e for e in (start[j] for j in END) if e is not None)


def illegal(letters: str) -> int:
    """How many neighbours have initials that may not follow each other."""
    initials = [INITIALS[_LETTERS.index(c) // len(FAULTS)] for c in letters]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


# ---- rows -----------------------------------------------------------------------------------------------------------

_MARK = r"[^\x20\x09-\x0D]"


def _column(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)


def placed(turns: DataFrame) -> Stored:
    """conv_id, turn, role, text, at, in a written table: rows sorted over the whole corpus, at grows in that order."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _column("role"), _column("text"))
    return Stored(rows.orderBy(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text").withColumn("at", F.monotonically_increasing_id()), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, at, role, blank, duplicate, truncated (at most one is true). rows: see placed()."""
    # The first of equal turns is found by partial minima and joined back by its place: a turn that often comes again is no hot key.
    first = rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("same")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    last = F.regexp_extract("text", rf"({_MARK})[\x20\x09-\x0D]*\z", 1)
    seen = rows.select("conv_id", "at", "role", last.alias("last")).join(first, "at", "left")
    blank, duplicate = F.col("last") == "", F.col("first").isNull()
    return seen.select("conv_id", "at", "role", blank.alias("blank"), (~blank & duplicate).alias("duplicate"), (~blank & ~duplicate & ~F.col("last").isin(".", "!", "?")).alias("truncated"))


_COST = ", ".join(f"c{i} long" for i in range(16))
_AUDIT = ", ".join(f"a{i} string" for i in range(16))
#: An element: what lies at both ends, how many illegal neighbours are within, and a matrix.
ELEMENT = f"conv_id long, at long, first string, last string, illegal long, {_COST}, {_AUDIT}"
_ELEMENT = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), *[(f"c{i}", pa.int64()) for i in range(16)], *[(f"a{i}", pa.string()) for i in range(16)]])


def _row(conv_id: int | None, at: int, first: str, last: str, wrong: int, m: Matrix) -> dict:
    flat = [e for row in m for e in row]
    costs = {f"c{i}": e and e[0] for i, e in enumerate(flat)}
    return {"conv_id": conv_id, "at": at, "first": first, "last": last, "illegal": wrong} | costs | {f"a{i}": e and e[1] for i, e in enumerate(flat)}


def _matrix(row: dict) -> Matrix:
    flat = [None if row[f"c{i}"] is None else (row[f"c{i}"], row[f"a{i}"]) for i in range(16)]
    return tuple(tuple(flat[4 * i : 4 * i + 4]) for i in range(4))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 256):
            out = []
            for r in batch.slice(i, 256).to_pylist():
                letters = r["letters"]
                ends = [INITIALS[_LETTERS.index(c) // len(FAULTS)] for c in (letters[0], letters[-1])]
                out.append(_row(r["conv_id"], r["at"], *ends, illegal(letters), run(letters)))
            yield pa.RecordBatch.from_pylist(out, _ELEMENT)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            (r,) = batch.slice(i, 1).to_pylist()
            parts = [x["element"] for x in r["parts"]]
            m = functools.reduce(times, map(_matrix, parts))
            wrong = sum(x["illegal"] for x in parts) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
            yield pa.RecordBatch.from_pylist([_row(r["conv_id"], r["at"], parts[0]["first"], parts[-1]["last"], wrong, m)], _ELEMENT)


def elements(flagged: DataFrame) -> DataFrame:
    """conv_id and an ELEMENT for each conversation. flagged: see faults()."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("blank") | F.col("duplicate"), 2).when(F.col("truncated"), 1).otherwise(0)
    letter = F.substring(F.lit(_LETTERS), kind * len(FAULTS) + fault + 1, F.lit(1))
    rows = flagged.select("conv_id", "at", letter.alias("letter")).groupBy("conv_id", F.shiftright("at", RUN).alias("part")).agg(F.sort_array(F.collect_list(F.struct("at", "letter"))).alias("in_order"))
    strings = rows.select("conv_id", F.col("in_order")[0]["at"].alias("at"), F.array_join(F.col("in_order.letter"), "").alias("letters"))
    held, shift = Stored(in_arrow(strings, _runs, ELEMENT), "runs"), RUN
    several = held.df.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("_several"))
    on = F.col("conv_id").eqNullSafe(F.col("_several"))
    rest = Stored(held.df.join(several, on, "left_semi"), "parts")
    if rest.df.isEmpty():
        rest.drop()
        return held.df
    # Conversations that are one element already wait for the others.
    done = held.df.join(several, on, "left_anti")
    while (rest.df.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > 1:
        shift += FAN
        parts = F.sort_array(F.collect_list(F.struct("at", F.struct("first", "last", "illegal", *[f"c{i}" for i in range(16)], *[f"a{i}" for i in range(16)]).alias("element"))))
        many = rest.df.groupBy("conv_id", F.shiftright("at", min(shift, 63)).alias("part")).agg(parts.alias("parts"))
        new = Stored(in_arrow(many.select("conv_id", F.col("parts")[0]["at"].alias("at"), "parts"), _products, ELEMENT), "products")
        rest.drop()
        rest = new
    return done.unionByName(rest.df)


def _cheapest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "at", "illegal", "cost", "audit"]
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            best = [cheapest(_matrix(r)) for r in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("at"), part.column("illegal"), pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.string())], names=names)


def assess(rows: DataFrame) -> DataFrame:
    """conv_id, at (of its first row), gaps, blank, duplicate, truncated, illegal, cost, audit for each conversation. rows: see placed()."""
    flagged = Stored(faults(rows), "faults").df
    best = in_arrow(elements(flagged), _cheapest, "conv_id long, at long, illegal long, cost long, audit string")
    counts = flagged.groupBy("conv_id").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    once = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count("turn").alias("n"))
    gaps = once.select("conv_id", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).alias("gaps"))
    for other in (counts, gaps):
        other = other.withColumnRenamed("conv_id", "_c")
        best = best.join(other, best["conv_id"].eqNullSafe(other["_c"])).drop("_c")
    return best.select("conv_id", "at", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


# ---- repaired turns ---------------------------------------------------------------------------------------------------

_TURNS = pa.schema([("conv_id", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


class _Walk:
    """Follows a conversation's audit."""

    def __init__(self, conv_id: int | None, audit: str):
        self.conv_id, self.audit, self.at, self.state = conv_id, audit, 0, 0

    def _on(self, edit: str, role: str, text: str) -> dict:
        self.state = NEXT[self.state][role[:1]]
        return {"conv_id": self.conv_id, "edit": edit, "role": role, "text": text}

    def inserts(self) -> Iterator[dict]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._on("I", ROLES[LED[self.state]], "")

    def row(self, role: str, text: str) -> Iterator[dict]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._on(edit, ROLES[LED[self.state]] if edit == "R" else role, text)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = None
    for batch in batches:
        for i in range(0, len(batch), 256):
            out: list[dict] = []
            for r in batch.slice(i, 256).to_pylist():
                if r["audit"] is not None:  # a conversation's first row
                    out += walk.inserts() if walk else ()
                    walk = _Walk(r["conv_id"], r["audit"])
                out += walk.row(r["role"], r["text"])
            yield pa.RecordBatch.from_pylist(out, _TURNS)
    if walk:
        yield pa.RecordBatch.from_pylist(list(walk.inserts()), _TURNS)


def repaired(rows: DataFrame, assessed: DataFrame) -> DataFrame:
    """conv_id, edit (K, R, I), role, text: the turns of repaired conversations, each in one partition and in order. rows, assessed: see placed() and assess()."""
    heads = assessed.select(F.col("at").alias("_at"), "audit")
    told = rows.join(heads, rows["at"] == heads["_at"], "left").select("conv_id", "at", "audit", "role", "text")
    return in_arrow(told.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "at").drop("at"), _repaired, "conv_id long, edit string, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv_id, held, n = None, None, 0
    row = lambda: pa.RecordBatch.from_pylist([{"conv_id": conv_id, "n_turns": n, "sha256": held.hexdigest()}], pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("sha256", pa.string())]))
    for batch in batches:
        for i in range(0, len(batch), 256):
            for r in batch.slice(i, 256).to_pylist():
                if held is None or r["conv_id"] != conv_id:
                    if held:
                        yield row()
                    conv_id, held, n = r["conv_id"], hashlib.sha256(), 0
                held.update(f"{chr(10) if n else ''}{r['role']}:{r['text']}".encode())
                n += 1
    if held:
        yield row()


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, sha256 (hex, of `role:text` joined by newlines) of repaired conversations. turns: see repaired()."""
    return in_arrow(turns, _digests, "conv_id long, n_turns long, sha256 string")
