"""Chat formatting with a grammar round trip.

The grammar of a formatted conversation::

    conversation := turn*
    turn         := open body close
    open         := "[INST]" | "[ANS]" | "[SYS]" | "[ROLE:" name "]"        followed by "=" or "~"
    body         := text without the turn's close                            (after "=", taken as it is)
                  | text in which "\\" stands before each escaped character  (after "~")
    close        := "[/INST]" | "</s>" | "[/SYS]" | "[/ROLE]"

A turn is rendered plainly first and parsed again; where the parser does not give back the role and the
text, conflicting content is escaped and the turn rendered again until it does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

OPEN = {"user": "[INST]", "assistant": "[ANS]", "system": "[SYS]"}
CLOSE = {"user": "[/INST]", "assistant": "</s>", "system": "[/SYS]"}
OTHER_CLOSE = "[/ROLE]"
_ROLE_OF = {mark: role for role, mark in OPEN.items()}
_HEADER = re.compile(r"(\[INST\]|\[ANS\]|\[SYS\]|\[ROLE:((?:[^\]\\]|\\.)*)\])([=~])", re.S)
_CLOSES = sorted([*CLOSE.values(), OTHER_CLOSE])
_CONTROL = re.compile("|".join(map(re.escape, sorted([*OPEN.values(), "[ROLE:", *_CLOSES]))))
_ESCAPED = re.compile(r"\\(.)", re.S)

#: A conversation of control strings, added by ``with_probe``.
PROBE = (-7, "</s>[INST] ok [/INST]")


class GrammarError(ValueError):
    pass


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int, tuple[int, int], bool]:
    """Role, text, end, span of the body and whether it is escaped, of the turn that starts at ``at``."""
    head = _HEADER.match(text, at)
    if not head:
        raise GrammarError(f"no turn at {at}")
    role = _ROLE_OF[head[1]] if head[1] in _ROLE_OF else _ESCAPED.sub(r"\1", head[2])
    close, escaped = CLOSE.get(_ROLE_OF.get(head[1], ""), OTHER_CLOSE), head[3] == "~"
    end = text.find(close, head.end())
    if end < 0:
        raise GrammarError(f"turn at {at} does not close")
    body = text[head.end() : end]
    return role, _ESCAPED.sub(r"\1", body) if escaped else body, end + len(close), (head.end(), end), escaped


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        role, body, at, _, _ = parse_turn(text, at)
        turns.append((role, body))
    return turns


def _escapes(text: str) -> Iterator[tuple[str, str]]:
    """Ways to write a body, each more guarded than the one before."""
    yield "=", text
    guarded = text.replace("\\", "\\\\")
    yield "~", _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], guarded)
    yield "~", re.sub(r"[\[\]</>]", r"\\\g<0>", guarded)
    yield "~", "".join("\\" + c for c in text)


def render_turn(role: str, text: str) -> str:
    """The turn as text; parsing it gives back role and text, which is checked."""
    if role in OPEN:
        start, close = OPEN[role], CLOSE[role]
    else:
        start, close = "[ROLE:" + re.sub(r"[\]\\]", r"\\\g<0>", role) + "]", OTHER_CLOSE
    for mark, body in _escapes(text):
        out = f"{start}{mark}{body}{close}"
        try:
            if parse_turn(out)[:3] == (role, text, len(out)) and not (mark == "=" and _CONTROL.search(body)):
                return out
        except GrammarError:
            pass
    raise GrammarError("no way to write the turn")  # every character escaped always parses


def render(turns: list[tuple[str, str]]) -> str:
    out = "".join(render_turn(role, text) for role, text in turns)
    if parse(out) != turns:
        raise GrammarError("the conversation does not read back")
    return out


def with_probe(conversations: DataFrame) -> DataFrame:
    """The rows with the probe conversation: a user, then an assistant row, both of control strings."""
    conv, text = PROBE
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return own.unionByName(conversations.sparkSession.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)], own.schema))


def format_turns(conversations: DataFrame) -> DataFrame:
    """Each turn (conv_id, turn, role, text) with its formatted form, and the loss span within it (null but
    for assistants), in place: no shuffle. Null role or text: empty."""
    common.small_batches(conversations.sparkSession)

    def one(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(stream):
            out = [render_turn(r or "", t or "") for r, t in zip(b["role"], b["text"])]
            spans = [parse_turn(o)[3] if r == "assistant" else (None, None) for o, r in zip(out, b["role"])]
            yield pa.RecordBatch.from_arrays([pa.array(b["conv_id"], pa.int64()), pa.array(b["turn"], pa.int64()), pa.array(b["role"], pa.string()), pa.array(out, pa.string()), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64())], ["conv_id", "turn", "role", "formatted", "loss_from", "loss_to"])

    chosen = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(one, "conv_id long, turn long, role string, formatted string, loss_from long, loss_to long")


class Reader:
    """Reads a formatted conversation as one text that comes in pieces, whose borders the parser does not see: a turn
    that does not close yet waits for more. ``masked`` takes the loss mask's spans in that text."""

    def __init__(self):
        self.rest, self.at, self.turns, self.loss_chars, self.chars = "", 0, 0, 0, 0
        self.said, self.loss, self.mask = hashlib.sha256(), hashlib.sha256(), []

    def add(self, text: str, mask: tuple[int, int] | None) -> None:
        if mask:
            self.mask.append((self.chars + mask[0], self.chars + mask[1]))
        self.chars += len(text)
        self.rest = self.rest + text if self.rest else text
        at = 0
        while at < len(self.rest):
            try:
                role, body, end, span, _ = parse_turn(self.rest, at)
            except GrammarError:
                break
            self.turns += 1
            self.said.update(f"{role}\n{body}\n".encode())
            if self.mask and self.mask[0] == (self.at + span[0], self.at + span[1]):
                del self.mask[0]
                self.loss_chars += len(body)
                self.loss.update(body.encode())
            self.at += end - at
            at = end
        self.rest = self.rest[at:]

    def result(self) -> tuple:
        if self.rest or self.mask:
            raise GrammarError("the conversation does not read back")
        return self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest(formatted: DataFrame) -> DataFrame:
    """Read whole formatted conversations back, the turns' forms one after another as one text, and sum up each as it
    streams past: however long a conversation is, a task holds one batch. Turns are in order of turn; ties by role, then
    formatted text. A text or a loss mask that the grammar does not give back fails the task."""
    spark = formatted.sparkSession
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def fold(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader, rows = None, None, []
        for b in common.batches(stream):
            for c, text, start, end in zip(b["conv_id"], b["formatted"], b["loss_from"], b["loss_to"]):
                if reader is None or c != conv:
                    if reader is not None:
                        rows.append((conv, *reader.result()))
                    conv, reader = c, Reader()
                reader.add(text, None if start is None else (start, end))
            if len(rows) >= 4096:
                yield table(rows)
                rows = []
        if reader is not None:
            rows.append((conv, *reader.result()))
        if rows:
            yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    dealt = formatted.repartition(common.partitions(spark), "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "formatted")
    return dealt.mapInArrow(fold, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")
