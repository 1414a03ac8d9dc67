"""Fill-in-middle: documents cut at lines into prefix, middle and suffix, in a form that says which is which.

Lines are counted, sentinels found and cuts selected by one automaton over bytes, run in parallel. A part of a text is
scanned from every state at once and says, for each state it may be entered in, in which it is left and how many lines
and sentinels it has seen; such functions compose associatively. A text of up to ``chunk_bytes`` is one such part, cut
where it is read. A longer one is dealt over tasks in chunks: composing their functions gives the state and the count
with which each is entered, and from these each chunk knows by itself which of its bytes are prefix, middle or suffix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.store import written
from skeinworks.llm.words import buffers

SENTINELS = ("<P>", "<S>", "<M>")
#: Texts beyond this are scanned in chunks of it, by as many tasks as there are chunks.
CHUNK_BYTES = 1 << 20
#: Bytes that one step of the scan takes in a row, and bytes of texts that are scanned together.
BLOCK, TOGETHER = 128, 1 << 20
_NEXT, _LINE, _FOUND = 0x3FFF, 14, 15


@dataclass
class Automaton:
    """``table[symbol, state]``: the next state, with a bit for a line that begins and one for a sentinel that ends. State 0 starts a text."""

    symbol: np.ndarray  # of each byte
    table: np.ndarray  # its last row is of no byte
    starts: np.ndarray  # states in which the next byte begins a line

    @property
    def states(self) -> int:
        return self.table.shape[1]


def automaton(sentinels: tuple[str, ...]) -> Automaton:
    """Lines end after a line feed. A state is whether a line is to begin, and the longest end of what was read that a sentinel begins with."""
    marks = [s.encode() for s in sentinels]
    if any(not m or any(m[k:] == n[: len(m) - k] for k in range(0 if m is not n else 1, len(m))) for m in marks for n in marks):
        raise ValueError("a sentinel is empty, or begins as another one ends")
    begun = {m[:k] for m in marks for k in range(len(m))}
    alphabet = sorted({b for m in marks for b in m} | {10})
    states, rows = [(True, b"")], {}
    for state in states:  # grows as states are reached
        for b in [*alphabet, None]:
            read = state[1] + (b"\x00" if b is None else bytes([b]))
            rest = b"" if b is None else next(read[k:] for k in range(len(read) + 1) if read[k:] in begun)
            to = (b == 10, rest)
            if to not in states:
                states.append(to)
            rows[b, state] = states.index(to) | state[0] << _LINE | any(read.endswith(m) for m in marks) << _FOUND
    symbol = np.full(256, len(alphabet), np.uint16)
    symbol[alphabet] = np.arange(len(alphabet))
    table = np.array([[rows[b, s] for s in states] for b in [*alphabet, None]] + [range(len(states))], np.uint16)
    return Automaton(symbol, table, np.array([s[0] for s in states]))


@dataclass
class Functions:
    """What each of some parts of texts does to each state that it is entered in: the state it is left in, lines begun and sentinels ended."""

    to: np.ndarray  # (parts, states)
    lines: np.ndarray
    found: np.ndarray

    def then(self, other: Functions) -> Functions:
        """Each part with the part of ``other`` after it."""
        follow = lambda x: np.take_along_axis(x, self.to, axis=1)
        return Functions(follow(other.to), self.lines + follow(other.lines), self.found + follow(other.found))

    def at(self, parts: np.ndarray) -> Functions:
        return Functions(self.to[parts], self.lines[parts], self.found[parts])

    def put(self, parts: np.ndarray, new: Functions) -> None:
        self.to[parts], self.lines[parts], self.found[parts] = new.to, new.lines, new.found


def scan(machine: Automaton, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Functions:
    """The functions of ``data[start:end]`` of each part: blocks side by side, a byte of all at a time, then composed in pairs."""
    blocks = np.maximum(1, -(-(end - start) // BLOCK))
    part = np.repeat(np.arange(len(start)), blocks)
    place = np.arange(len(part)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = (start[part] + place * BLOCK)[None, :] + np.arange(BLOCK)[:, None]
    padded = np.append(data, np.uint8(0))
    symbols = np.where(at < end[part][None, :], machine.symbol[padded[np.minimum(at, len(data))]], len(machine.table) - 1).astype(np.uint16)
    flat, n = machine.table.ravel(), machine.states
    symbols *= np.uint16(n)
    to = np.tile(np.arange(n, dtype=np.uint16), (len(part), 1))
    lines, found = np.zeros(to.shape, np.uint16), np.zeros(to.shape, np.uint16)
    for column in symbols:
        read = flat[to + column[:, None]]
        to = read & np.uint16(_NEXT)
        lines += (read >> np.uint16(_LINE)) & np.uint16(1)
        found += read >> np.uint16(_FOUND)
    done = Functions(to.astype(np.int64), lines.astype(np.int64), found.astype(np.int64))
    while len(part) > len(start):
        first = place % 2 == 0
        pair = np.flatnonzero(first[:-1] & (part[1:] == part[:-1]))
        done.put(pair, done.at(pair).then(done.at(pair + 1)))
        done, part, place = done.at(first), part[first], place[first] // 2
    return done


def cut_at(lines: np.ndarray, begins: np.ndarray, begins_line: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where line ``place`` (from 0; negative: before the part) begins in each part, its end if none of its ``lines`` does.

    ``begins`` are all places after a line feed; ``begins_line``: the part's first byte begins a line too.
    """
    first = np.searchsorted(begins, start, side="right") - begins_line
    inner = begins[np.clip(first + place, 0, max(len(begins) - 1, 0))] if len(begins) else start
    found = np.where((place == 0) & begins_line, start, inner)
    return np.where(place < 0, start, np.where(place >= lines, end, found))


def drawn(seed: int) -> list[Column]:
    """Four numbers below 2^32 of a doc_id; a null one counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def plans(draws: list[np.ndarray], lines: np.ndarray, plain: np.ndarray, rate: int, spm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(form, lines before the middle, lines before the suffix) of each text."""
    one, two = (h % (lines + 1) for h in draws[:2])
    form = np.where(plain | (draws[2] % 100 >= rate), "plain", np.where(draws[3] % 100 < spm, "spm", "psm"))
    return form, np.minimum(one, two), np.maximum(one, two)


_MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def _short(docs: DataFrame, sentinels: tuple[str, ...], rate: int, spm: int) -> DataFrame:
    """``docs`` (doc_id, text, h1 to h4) cut where they are read."""
    machine, (p, s, m) = automaton(sentinels), (x.encode() for x in sentinels)
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _MADE.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column(1))
            row = 0
            while row < batch.num_rows:
                stop = max(row + 1, int(np.searchsorted(at, at[row] + TOGETHER, side="right")) - 1)
                data, edge = raw[at[row] : at[stop]], at[row : stop + 1] - at[row]
                start, end = edge[:-1], edge[1:]
                seen = scan(machine, data, start, end)
                lines = seen.lines[:, 0]
                draws = [batch.column(i).slice(row, stop - row).to_numpy() for i in range(2, 6)]
                form, a, b = plans(draws, lines, (start == end) | (seen.found[:, 0] > 0), rate, spm)
                begins = np.flatnonzero(data == 10) + 1
                whole = np.ones(len(start), bool)
                x, y = (cut_at(lines, begins, whole, start, end, k) for k in (a, b))
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                text = data.tobytes()
                out = []
                for f, i, j, k, e in zip(form.tolist(), start.tolist(), x.tolist(), y.tolist(), end.tolist(), strict=True):
                    before, middle, after = text[i:j], text[j:k], text[k:e]
                    out.append(text[i:e] if f == "plain" else b"".join((p, before, s, after, m, middle) if f == "psm" else (s, after, p, before, m, middle)))
                plain = form == "plain"
                columns = [batch.column(0).slice(row, stop - row), lines, form, pa.array(chars[x] - chars[start], mask=plain), pa.array(chars[y] - chars[x], mask=plain), out]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, (np.ndarray, list)) else c for c, t in zip(columns, types, strict=True)], names=names)
                row = stop

    return docs.mapInArrow(cut, _MADE).withColumn("output", F.col("output").cast("string"))


def _long(docs: DataFrame, sentinels: tuple[str, ...], rate: int, spm: int, chunk_bytes: int) -> DataFrame:
    """The same for texts of many chunks, each a row of a written table; a text has 2^31 / ``chunk_bytes`` chunks at most."""
    machine = automaton(sentinels)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "h1", "h2", "h3", "h4", "text")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column(6))
            for i in range(batch.num_rows):
                for chunk, place in enumerate(range(int(at[i]), int(at[i + 1]), chunk_bytes)):
                    data = raw[place : min(place + chunk_bytes, int(at[i + 1]))].tobytes()
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(6)), pa.array([chunk], pa.int32()), pa.array([data], pa.binary())], names=names)

    names = ["row", "doc_id", "h1", "h2", "h3", "h4", "chunk", "data"]
    chunks = written(numbered.mapInArrow(dealt, "row long, doc_id long, h1 long, h2 long, h3 long, h4 long, chunk int, data binary"), **{"parquet.block.size": 16 * chunk_bytes})

    def parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        raw, at = buffers(column)
        for i in range(len(column)):
            data = raw[at[i] : at[i + 1]]
            yield i, i + 1, data, np.array([0]), np.array([len(data)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, start, end in parts(batch.column(6)):
                seen = scan(machine, data, start, end)
                told = [pa.array([x[0].tolist()], pa.list_(pa.int64())) for x in (seen.to, seen.lines, seen.found)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(6)), *told], names=["row", "h1", "h2", "h3", "h4", "chunk", "to", "lines", "found"])

    def entered(group: pd.DataFrame) -> pd.DataFrame:
        """The state and the lines with which each chunk of a text is entered, and what the text is to become."""
        group = group.sort_values("chunk")
        steps = Functions(*(np.array(group[k].tolist()) for k in ("to", "lines", "found")))
        every = Functions(np.arange(machine.states)[None, :], *np.zeros((2, 1, machine.states), int))
        state, before = [], []
        for i in range(len(group)):
            state.append(every.to[0, 0])
            before.append(every.lines[0, 0])
            every = every.then(steps.at(np.array([i])))
        n = every.lines[0, 0]
        form, a, b = plans([group[f"h{i}"].to_numpy()[:1] for i in range(1, 5)], np.array([n]), every.found[:, 0] > 0, rate, spm)
        return pd.DataFrame({"row": group["row"], "chunk": group["chunk"], "state": state, "before": before, "n": n, "form": form[0], "a": a[0], "b": b[0]})

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state, before, a, b = (batch.column(k).to_numpy() for k in (6, 7, 8, 9))
            for i, j, data, start, end in parts(batch.column(3)):
                begins, opens = np.flatnonzero(data == 10) + 1, machine.starts[state[i:j]]
                lines = opens + np.searchsorted(begins, end, side="left")
                x, y = (int(cut_at(lines, begins, opens, start, end, k[i:j] - before[i:j])[0]) for k in (a, b))
                pieces = data[:x], data[x:y], data[y:]
                chars = [int(np.count_nonzero((z & 0xC0) != 0x80)) for z in pieces]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, j - i) for k in (0, 1, 2, 4, 5)), *(pa.array([z.tobytes()], pa.binary()) for z in pieces), *(pa.array([c], pa.int64()) for c in chars[:2])],
                    names=["row", "chunk", "doc_id", "n", "form", "prefix", "middle", "suffix", "prefix_chars", "middle_chars"],
                )

    summary = chunks.select("row", "h1", "h2", "h3", "h4", "chunk", "data").mapInArrow(summed, "row long, h1 long, h2 long, h3 long, h4 long, chunk int, to array<long>, lines array<long>, found array<long>")
    entries = summary.groupBy("row").applyInPandas(entered, "row long, chunk int, state long, before long, n long, form string, a long, b long")
    met = chunks.join(entries, ["row", "chunk"]).select("row", "chunk", "doc_id", "data", "n", "form", "state", "before", "a", "b")
    pieces = met.mapInArrow(sliced, "row long, chunk int, doc_id long, n long, form string, prefix binary, middle binary, suffix binary, prefix_chars long, middle_chars long")
    joined = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.col(k).cast("string").alias("data")))), lambda x: x.data), "").alias(k)
    texts = pieces.groupBy("row", "doc_id", "n", "form").agg(F.sum("prefix_chars").alias("prefix_chars"), F.sum("middle_chars").alias("middle_chars"), *map(joined, ("prefix", "middle", "suffix")))
    p, s, m = map(F.lit, sentinels)
    psm, spm_ = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.concat("prefix", "middle", "suffix"))
    shown = [F.when(F.col("form") != "plain", F.col(k)).alias(k) for k in ("prefix_chars", "middle_chars")]
    return texts.select("doc_id", "n", "form", *shown, output.alias("output"))


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n (lines), form, prefix_chars, middle_chars, output.

    Lines are what a line feed ends, and the rest behind the last one. The cuts are after two numbers of lines, drawn
    from ``seed`` and doc_id. ``form`` is ``psm`` (prefix, suffix, middle behind their ``sentinels``), ``spm`` (suffix
    first) in ``spm`` of 100 cases, or ``plain``: the text as it is, where it is empty or null, holds a sentinel, or is
    not among the ``rate`` of 100 that are transformed; its chars are null. Rows that repeat a doc_id, or have none,
    are cut each by itself; a null doc_id draws as no digits. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", *drawn(seed))
    long = F.octet_length("text") > chunk_bytes
    return _short(rows.filter(~long), sentinels, rate, spm).unionByName(_long(rows.filter(long), sentinels, rate, spm, chunk_bytes))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made from."""
    p, s, m = sentinels
    head = lambda x, mark: F.substring_index(x, mark, 1)
    tail = lambda x, mark: F.substring_index(x, mark, -1)
    middle = tail(output, m)
    psm = F.concat(head(tail(output, p), s), middle, head(tail(output, s), m))
    spm = F.concat(head(tail(output, p), m), middle, head(tail(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
