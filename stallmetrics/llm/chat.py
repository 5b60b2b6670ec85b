r"""Chat template with a grammar round trip.

    conversation = turn*
    turn         = "<|im_start|>" role "\n" text "<|im_end|>" "\n"

parse() reads that grammar deterministically, one control string after the other. render() writes a
turn as it is, parses it, and where what comes back isn't the turn, or ends elsewhere, escapes the
part in conflict and tries again until it is identical: a backslash goes into each control string
(and one more into each that has backslashes already), and a role's line breaks become \n with their
backslashes doubled. Unescaping is exact, so every text survives.

Cases: null role or text is empty; null turn sorts first; rows that repeat a turn are turns of their
own, ordered by role and text; a null conv_id is a conversation like another; an empty table gives no
conversations; other columns are not read. Turns are formatted as they stream by in order; of a
conversation only its text is held, which is the unit of training.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<\|(?:im_start|im_end)\|>")
_ESCAPABLE = re.compile(r"<\|(\\*)(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\|\\(\\*)(im_start|im_end)\|>")
TRAINED_ROLE = "assistant"


class Malformed(ValueError):
    """The text isn't a sentence of the grammar."""


def _escape(text: str) -> str:
    return _ESCAPABLE.sub(r"<|\\\1\2|>", text)


def _unescape(text: str) -> str:
    return _ESCAPED.sub(r"<|\1\2|>", text)


def _escape_role(role: str) -> str:
    return _escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return _unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text), unescaped."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise Malformed(f"a turn has to begin at {at}")
        line = formatted.find("\n", at)
        mark = _CONTROL.search(formatted, line + 1) if line >= 0 else None
        if not mark or mark[0] != END or not formatted.startswith("\n", mark.end()) or _CONTROL.search(formatted, at + len(START), line):
            raise Malformed(f"the turn at {at} has no end")
        turns.append((_unescape_role(formatted[at + len(START) : line]), _unescape(formatted[line + 1 : mark.start()])))
        at = mark.end() + 1
    return turns


def _turn(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def _read_back(formatted: str) -> list[tuple[str, str]] | None:
    try:
        return parse(formatted)
    except Malformed:
        return None


def render(role: str, text: str) -> str:
    """The turn as it is if it comes back identical, else with its text, its role or both escaped."""
    for r, t in ((role, text), (role, _escape(text)), (_escape_role(role), text), (_escape_role(role), _escape(text))):
        formatted = _turn(r, t)
        if _read_back(formatted) == [(role, text)]:
            return formatted
    raise Malformed("a turn doesn't survive escaping")


_FORMATTED = "conv_id long, n_turns long, formatted string"


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.string())], names=["conv_id", "n_turns", "formatted"])

    now, parts, done, held = None, [], [], 0
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if parts and conv_id != now:
                done.append((now, len(parts), "".join(parts)))
                held += len(done[-1][2])
                parts = []
                if held > 4_000_000:
                    yield out(done)
                    done, held = [], 0
            now = conv_id
            parts.append(render(role, text))
    if parts:
        done.append((now, len(parts), "".join(parts)))
    if done:
        yield out(done)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted: each conversation in the template."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_formatted, _FORMATTED)


_PARSED = "conv_id long, formatted_chars long, turns array<struct<role: string, text: string>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    for batch in batches:
        formatted = batch.column("formatted").to_pylist()
        turns = [[{"role": r, "text": t} for r, t in parse(x)] for x in formatted]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(list(map(len, formatted)), pa.int64()), pa.array(turns, pa.list_(turn))], names=["conv_id", "formatted_chars", "turns"])


def parse_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted_chars (code points), turns: those recovered from column formatted."""
    return formatted.select("conv_id", "formatted").mapInArrow(_parsed, _PARSED)


def loss_text(turns: str = "turns"):
    """The text under the loss mask: that of the assistant's turns, unescaped, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == TRAINED_ROLE), lambda t: t["text"]), "")
