"""Best-fit packing of token sequences by a linear grouping scheme.

There are only ``capacity`` different lengths, so a plan is made from their counts alone: large lengths are rounded
up to the largest of their equal-cardinality group; the best mix of configurations of these few sizes is a linear
program, solved by column generation; real lengths take the places of the rounded ones; the rest, and then the
small ones, go best-fit, largest first, into what is left. A plan is a few thousand runs of equal bins, whatever
the number of documents. Every piece then finds its place from its length and its rank among the pieces of that
length, and ranks are counted in many parts at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.llm.store import stable
from skeinworks.llm.tokens import crc32, whole_ids
from skeinworks.llm.tokens import _texts as texts_of

#: Groups of large lengths; lengths up to capacity / SMALL are small. RANK_PARTS: parts in which a length's ranks are counted.
GROUPS, SMALL, RANK_PARTS = 512, 3, 512
#: The program is solved to within this part of its optimum.
CLOSE = 1e-3
#: It also ends where so many rounds have gained less than that.
STALL = 60
END_ID = 0
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` tokens: one if it fits, else full ones after a first that may be shorter."""
    if total <= capacity:
        return [(0, total)]
    head = total % capacity or capacity
    return [(0, head), *((at, capacity) for at in range(head, total, capacity))]


def pieces_of(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces of ``docs`` (doc_id, text), each text's ids followed by id 0."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            owner, rows = [], []
            for at, part in texts_of(batch.column(1)):
                for i, text in enumerate(part, at):
                    ids = whole_ids(text, path) + end
                    for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        owner.append(i)
                        rows.append((n, start, length, crc32(ids[4 * start : 4 * (start + length)])))
            piece, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokenize, _PIECES)


def grouped_sizes(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths in falling order dealt into groups of equal cardinality, as (length, count) runs; a group's size is its first length."""
    total = sum(counts.values())
    out, room = [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = -(-total // groups)
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
    return out


def _richest(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the greatest worth within the capacity (unbounded knapsack)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i in np.flatnonzero(worth > 1e-12):
        size = int(sizes[i])
        for at in range(size, capacity + 1, size):
            part = slice(at, min(at + size, capacity + 1))
            value = best[at - size : part.stop - size] + worth[i]
            better = value > best[part] + 1e-12
            best[part][better] = value[better]
            last[part][better] = i
    take, c = np.zeros(len(sizes)), capacity
    while last[c] >= 0:
        take[last[c]] += 1
        c -= int(sizes[last[c]])
    return best[capacity], take


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(items of each size, bins) that serve most of ``need`` with the fewest bins: the linear program, rounded down.

    Any basis on the way serves ``need`` too, so stopping where the program gains no more costs bins, never items.
    """
    k = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse, cost = np.diag(1 / np.diag(columns)), np.ones(k)
    seen = []
    for _ in range(20 * k):
        amount, price = inverse @ need, cost @ inverse
        seen.append(cost @ amount)
        if len(seen) > STALL and seen[-STALL - 1] - seen[-1] < CLOSE * seen[-1]:
            break
        if price.min() < -1e-9:
            entering, new_cost = -np.eye(k)[int(price.argmin())], 0.0
        else:
            value, entering = _richest(sizes, price, capacity)
            new_cost = 1.0
            if value <= 1 + CLOSE:
                break
        change = inverse @ entering
        steps = np.where(change > 1e-9, np.maximum(amount, 0) / np.where(change > 1e-9, change, 1), np.inf)
        leaving = int(steps.argmin())
        columns[:, leaving], cost[leaving] = entering, new_cost
        pivot = inverse[leaving] / change[leaving]
        inverse -= np.outer(change, pivot)
        inverse[leaving] = pivot
    amount = inverse @ need
    return [(columns[:, j].astype(int), int(amount[j] + 1e-6)) for j in range(k) if cost[j] and amount[j] >= 1 - 1e-6]


class Bins:
    """Runs of bins with equal contents, by the room that is left in them."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.rank = capacity, defaultdict(list), defaultdict(int)

    def add(self, count: int, lengths: list[int]) -> None:
        """New bins, each with ``lengths``."""
        run = []
        for x in lengths:
            run.append((x, self.rank[x]))
            self.rank[x] += count
        self.by_room[self.capacity - sum(lengths)].append((count, run))

    def best_fit(self, length: int, count: int) -> None:
        room = length
        while count:
            while room < self.capacity and not self.by_room[room]:
                room += 1
            if not self.by_room[room]:
                fresh = -(-count // (self.capacity // length))
                self.add(fresh, [length])
                count, room = count - fresh, length
                continue
            have, run = self.by_room[room].pop()
            take = min(have, count)
            if have > take:
                self.by_room[room].append((have - take, [(x, at + take) for x, at in run]))
            self.by_room[room - length].append((take, [*run, (length, self.rank[length])]))
            self.rank[length] += take
            count -= take
            if room - length >= length:
                room = length

    def number(self) -> int:
        return sum(count for runs in self.by_room.values() for count, _ in runs)

    def places(self) -> np.ndarray:
        """Rows of length, first rank, number, first bin, offset."""
        rows, first = [], 0
        for room in sorted(self.by_room):
            for count, run in self.by_room[room]:
                offset = 0
                for length, at in run:
                    rows.append((length, at, count, first, offset))
                    offset += length
                first += count
        return np.array(rows, np.int64).reshape(-1, 5)


def _substituted(mix: list[tuple[np.ndarray, int]], groups: list[list[tuple[int, int]]]) -> Iterator[tuple[int, list[int]]]:
    """(bins, real lengths) of the configurations, each size giving way to the group's lengths, longest first."""
    supply = [[list(x) for x in reversed(group)] for group in groups]
    for items, number in mix:
        used = np.flatnonzero(items > 0)
        while number:
            for g in used:
                while supply[g] and not supply[g][-1][1]:
                    supply[g].pop()
            taken = {g: min(int(items[g]), supply[g][-1][1]) for g in used if supply[g]}
            if not taken:
                break
            part = min([number, *(supply[g][-1][1] // n for g, n in taken.items())])
            yield part, [supply[g][-1][0] for g, n in taken.items() for _ in range(n)]
            for g, n in taken.items():
                supply[g][-1][1] -= part * n
            number -= part


def configured(counts: dict[int, int], capacity: int, groups: int = GROUPS, small: int = SMALL) -> list[tuple[int, list[int]]]:
    """(bins, real lengths) of the program's configurations of the large lengths; what its amounts are rounded down by is in none."""
    by_size: dict[int, list] = {}
    for group in grouped_sizes({x: n for x, n in counts.items() if capacity // small < x < capacity and n}, groups):
        by_size.setdefault(group[0][0], []).extend(group)  # groups of one size are one
    if not by_size:
        return []
    need = np.array([sum(n for _, n in group) for group in by_size.values()], float)
    return list(_substituted(configurations(np.array(list(by_size)), need, capacity), list(by_size.values())))


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS, small: int = SMALL) -> np.ndarray:
    """Where the pieces of each length go; ``counts``: the number of pieces of each length from 1 to ``capacity``."""
    bins, left = Bins(capacity), {x: n for x, n in counts.items() if x < capacity and n}
    if counts.get(capacity):
        bins.add(counts[capacity], [capacity])
    for number, lengths in configured(counts, capacity, groups, small):
        bins.add(number, lengths)
        for x in lengths:
            left[x] -= number
    for length in sorted(left, reverse=True):
        bins.best_fit(length, left[length])
    return bins.places()


def ranked(rows: DataFrame, key: str, parts: int = RANK_PARTS) -> DataFrame:
    """``rows`` (kept with ``stable``, with a unique _row) with ``rank`` from 0 among the rows of the key, counted in parts."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_part").orderBy("_row")) - 1)
    return numbered.join(starts, [key, "_part"]).withColumn("rank", (F.col("_start") + F.col("_at")).cast("long")).drop("_part", "_at", "_start")


def packed(docs: DataFrame, path: str, capacity: int = 2048, groups: int = GROUPS) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): piece, start, length, ids_crc32, sequence_id, offset.

    ``path``: a byte-level tokenizer of ``tokenizers``. A null or empty text is the end token alone. Rows that repeat
    a doc_id are packed one by one; an empty table gives no rows. Other columns are not read.
    """
    pieces = stable(pieces_of(docs, path, capacity).withColumn("_row", F.monotonically_increasing_id()))
    counts = {x["length"]: x["n"] for x in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    places = plan(counts, capacity, groups)
    order = np.lexsort((places[:, 1], places[:, 0]))
    table = docs.sparkSession.sparkContext.broadcast(places[order])

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table.value
        shift = np.int64(1 << 44)  # a length's ranks
        starts = own[:, 0] * shift + own[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            at = np.searchsorted(starts, length * shift + rank, side="right") - 1
            columns = [batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own[at, 3] + rank - own[at, 1]), pa.array(own[at, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces, "length").mapInArrow(seat, f"{_PIECES}, sequence_id long, offset long")
