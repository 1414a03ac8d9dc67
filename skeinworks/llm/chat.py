"""Chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation and sorted by turn and sequence; streamed deltas, edits and
regenerations are folded into final messages, and these are rendered. All of it is one shuffle and one pass that
holds a message at a time, so a conversation may be as long as it likes.

Events: ``message`` begins a turn (role, text), ``delta`` appends text, ``edit`` replaces the text, ``regenerate``
begins the turn anew and drops every later turn that began before it, ``delete`` drops the turn. ``turn`` is a turn
finished already, a message of its own even where another has its number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Rendered turns are put together up to about this many characters.
CHUNK = 1 << 16
LEARNED_ROLE = "assistant"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_FORMATTED = "conv_id long, chunk int, formatted string, learned array<struct<start:long,end:long>>"
_LEARNED_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def escape(text: str) -> str:
    """Text in which no control string begins; ``unescape`` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its escaped text begins and ends."""
    head = f"{OPEN}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a rendered text."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("not a rendered conversation")
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line)
        yield unescape_role(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end])
        at = end + len(CLOSE) + 1


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, role, text, alive) from events sorted by conversation, turn and sequence."""
    conv = turn = object()
    message, barrier = None, None

    def ended():
        alive = not message["dropped"] and (barrier is None or message["began"] is None or message["began"] > barrier)
        return conv, message["role"], "".join(message["text"]), alive

    for batch in batches:
        for c, t, seq, kind, role, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if c != conv or t != turn or kind == "turn":
                if message is not None:
                    yield ended()
                    if message["again"] is not None and c == conv:
                        barrier = message["again"] if barrier is None else max(barrier, message["again"])
                if c != conv:
                    barrier = None
                conv, turn = c, t
                message = {"role": role or "", "text": [], "began": seq, "again": None, "dropped": False}
            if kind == "delta":
                message["text"].append(text or "")
            elif kind == "delete":
                message["dropped"] = True
            else:
                message["text"] = [text or ""]
                if kind != "edit":
                    message |= {"role": message["role"] if role is None else role, "began": seq, "dropped": False}
                if kind == "regenerate":
                    message["again"] = seq
    if message is not None:
        yield ended()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, chunk, parts, spans, size, begun = None, 0, [], [], 0, False

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array([chunk], pa.int32()), pa.array(["".join(parts)], pa.string()), pa.array([spans], _LEARNED_TYPE)], names=["conv_id", "chunk", "formatted", "learned"]
        )

    for c, role, text, alive in _messages(batches):
        if not begun or c != conv:
            if begun:
                yield out()
            conv, chunk, parts, spans, size, begun = c, 0, [], [], 0, True
        if not alive:
            continue
        if size > CHUNK:
            yield out()
            chunk, parts, spans, size = chunk + 1, [], [], 0
        piece, start, end = render(role, text)
        if role == LEARNED_ROLE:
            spans.append({"start": size + start, "end": size + end})
        parts.append(piece)
        size += len(piece)
    if begun:
        yield out()


def formatted(events: DataFrame) -> DataFrame:
    """``events`` (conv_id, turn, seq, kind, role, text) rendered: rows of conv_id, chunk, formatted, learned.

    A conversation's text is its chunks in order; each holds whole turns, and ``learned`` has the code point spans of
    assistant texts in it (the loss mask). Null: a text is empty, a role is the turn's earlier one or empty, a
    conv_id is a conversation of its own, a turn or seq comes first. Events of equal turn and seq are in the order of
    kind, role and text. A conversation whose turns are all dropped has an empty chunk. Other columns are not read.
    """
    order = ("conv_id", "turn", "seq", "kind", "role", "text")
    columns = [F.col(x).cast("long") if x in ("conv_id", "turn", "seq") else F.col(x).cast("string") for x in order]
    return events.select(*(c.alias(x) for c, x in zip(columns, order, strict=True))).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_write, _FORMATTED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state = None, None

    def out():
        row = (conv, state["turns"], state["all"].hexdigest(), state["loss"], state["learned"].hexdigest(), state["chars"])
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        for c, text, spans in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if state is None or c != conv:
                if state is not None:
                    yield out()
                conv, state = c, {"turns": 0, "all": hashlib.sha256(), "loss": 0, "learned": hashlib.sha256(), "chars": 0}
            state["chars"] += len(text)
            for role, said in parse(text):
                state["turns"] += 1
                state["all"].update(f"{role}\n{said}\n".encode())
            for span in spans:
                learned = unescape(text[span["start"] : span["end"]])
                state["loss"] += len(learned)
                state["learned"].update(learned.encode())
    if state is not None:
        yield out()


def read_back(chunks: DataFrame) -> DataFrame:
    """What the rendered text of each conversation holds: turns, digests, and what lies under the loss mask.

    ``chunks`` come as ``formatted`` gives them, in order within a partition.
    """
    return chunks.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log: every row is a message, in the order of turn, null last, role and text."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1))
    return conversations.select("conv_id", turn.alias("turn"), turn.alias("seq"), F.lit("turn").alias("kind"), "role", "text")
