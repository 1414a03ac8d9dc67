"""Vectors as short codes: each part of a vector becomes the index of the nearest entry of its codebook, in exact integers.

The nearest entry is found by annular norm pruning. Entries are sorted by norm; the entry of the most similar norm gives
a first distance, a binary search gives the interval of norms that can be as near (an entry's norm differs from the
part's by no more than their distance), and only the entries of that annulus, its edges included, are evaluated, from
the inside out, while each better distance narrows it. Codebooks are the only thing that tasks share.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.store import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components below this, of vectors up to this size, are computed with in 64 bits; others in integers without bounds.
SMALL, WIDE, MOST = 1 << 24, 4096, (1 << 63) - 1
#: Sums are shuffled in digits of so many bits, whose own sums can't overflow.
DIGIT = 40
#: Rows of a label are dealt to so many groups, so that a frequent one is no single task's.
SALTS = 32

Codebooks = np.ndarray  # (parts, entries, width)
_integers = np.frompyfunc(lambda x: math.floor(SCALE * int(x)) if abs(x) > 1 << 60 else math.floor(SCALE * x), 1, 1)
_root = np.frompyfunc(math.isqrt, 1, 1)


def quantised(vectors: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, integer vectors): vectors of ``size`` components (any multiple of ``PARTS``, if None: then of the first such row's size), none of them null or non-finite."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    if size is None:
        size = next((int(n) for n in sizes if n and n % PARTS == 0), 0)
    rows = np.flatnonzero(sizes == size) if size else np.empty(0, np.int64)
    flat = vectors.take(pa.array(rows)).flatten()
    x = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), size)
    finite = np.isfinite(x).all(axis=1)
    rows, x = rows[finite], x[finite]
    small = size <= WIDE and (len(x) == 0 or np.abs(x).max() < SMALL / SCALE)
    return rows, np.floor(SCALE * x).astype(np.int64) if small else _integers(x)


def _norms(x: np.ndarray) -> np.ndarray:
    """Whole norms, cut off; one too many or too few for 64-bit numbers."""
    square = (x * x).sum(axis=-1)
    return np.sqrt(square).astype(np.int64) if square.dtype == np.int64 else _root(square)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest of ``entries`` to each row of ``x``; of equal ones the first."""
    own = _norms(x)
    norms = _norms(entries)
    order = np.argsort(norms, kind="stable")
    norms = norms[order]
    seed = np.minimum(np.searchsorted(norms, own), len(norms) - 1)
    index = order[seed]
    best = ((x - entries[index]) ** 2).sum(axis=1)

    def annulus(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        reach = (np.sqrt(best[rows]).astype(np.int64) if best.dtype == np.int64 else _root(best[rows])) + 4  # roots are cut off
        return np.searchsorted(norms, own[rows] - reach, side="left"), np.searchsorted(norms, own[rows] + reach, side="right")

    low, high = annulus(np.arange(len(x)))
    for step in range(1, len(norms)):
        left = False
        for place in (seed - step, seed + step):
            rows = np.flatnonzero((low <= place) & (place < high))
            if not len(rows):
                continue
            left, candidate = True, order[place[rows]]
            distance = ((x[rows] - entries[candidate]) ** 2).sum(axis=1)
            better = (distance < best[rows]) | ((distance == best[rows]) & (candidate < index[rows]))
            rows = rows[better.astype(bool)]
            best[rows], index[rows] = distance[better.astype(bool)], candidate[better.astype(bool)]
            low[rows], high[rows] = annulus(rows)
        if not left:
            break
    return index, best


def assigned(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of each part, total squared error) of each vector."""
    parts = x.reshape(len(x), books.shape[0], books.shape[2])
    found = [nearest(parts[:, p], books[p]) for p in range(books.shape[0])]
    return np.stack([i for i, _ in found], axis=1), sum(d for _, d in found)


def _alike(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, Codebooks]:
    """Both in 64 bits, or both without bounds."""
    return (x, books) if x.dtype == books.dtype else (x.astype(object), books.astype(object))


def _books(values: list) -> Codebooks:
    books = np.array(values, dtype=object)
    return books.astype(np.int64) if all(abs(v) < SMALL for v in books.ravel()) else books


def _first(vectors: DataFrame, entries: int) -> Codebooks | None:
    """The parts of the smallest usable vec_ids, null last; repeated ids in the order of their vectors. At most ``entries`` rows reach the driver."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.filter((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & whole)
    ordered = usable.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding")
    rows = [r[0] for r in ordered.limit(entries).collect()]
    if not rows:
        return None
    if any(len(r) != len(rows[0]) for r in rows):
        rows = [r[0] for r in ordered.filter(F.size("embedding") == len(rows[0])).limit(entries).collect()]
    _, x = quantised(pa.array(rows, pa.list_(pa.float64())))
    return _books(x.reshape(len(rows), PARTS, -1).transpose(1, 0, 2).tolist())


def _moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry as the mean, rounded down, of the parts that it is nearest to; unused ones stay."""
    count, _, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            _, x = quantised(batch.column(0), count * width)
            x, own = _alike(x, books)
            index, _ = assigned(x, own) if len(x) else (np.empty((0, count), int), None)
            parts = x.reshape(len(x), count, width)
            for p in range(count):
                for k in np.unique(index[:, p]):
                    members = parts[index[:, p] == k, p]
                    total[p, k] += members.sum(axis=0)
                    n[p, k] += len(members)
        rows = []
        for p, k in zip(*np.nonzero(n), strict=True):
            rows.append((int(p), int(k), -1, 0, int(n[p, k])))
            for at, value in enumerate(map(int, total[p, k])):
                digit = 0
                while not -1 << DIGIT <= value < 1 << DIGIT:
                    rows.append((int(p), int(k), at, digit, value & ((1 << DIGIT) - 1)))
                    value, digit = value >> DIGIT, digit + 1
                rows.append((int(p), int(k), at, digit, value))
        names = ["part", "entry", "place", "digit", "value"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([(k, pa.int64() if k == "value" else pa.int32()) for k in names]))

    found = vectors.select("embedding").mapInArrow(sums, "part int, entry int, place int, digit int, value long").groupBy("part", "entry", "place", "digit").agg(F.sum("value").alias("value")).collect()
    total, n = np.zeros(books.shape, object), {}
    for r in found:  # a few numbers of each component of the codebooks
        if r["place"] < 0:
            n[r["part"], r["entry"]] = r["value"]
        else:
            total[r["part"], r["entry"], r["place"]] += r["value"] << (DIGIT * r["digit"])
    moved = books.astype(object)
    for (p, k), members in n.items():
        moved[p, k] = [t // members for t in total[p, k]]
    return _books(moved.tolist())


def codebooks(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """The codebook of each part after ``rounds`` passes over all of ``vectors`` (vec_id, embedding); None without usable ones."""
    books = _first(vectors, entries)
    for _ in range(rounds if books is not None else 0):
        books = _moved(vectors, books)
    return books


def books_text(books: Codebooks) -> str:
    """All components by part, entry and position."""
    return ",".join(str(int(v)) for v in books.ravel())


def encoded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of the usable rows; two hex digits for each part. An error beyond 64 bits is null."""
    count, _, width = books.shape

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = quantised(batch.column(2), count * width)
            if not len(rows):
                continue
            index, error = assigned(*_alike(x, books))
            code = [bytes(i).hex() for i in index.astype(np.uint8).tolist()]
            kept = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(code), pa.array([int(e) if e <= MOST else None for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(encode, "vec_id long, label string, code string, error long")


def compressed(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per usable row of ``vectors`` (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256.

    Left out are null vectors, those with null or non-finite components, and those whose size is not that of the
    smallest usable vec_id's, a multiple of 8. Components become floor(4096 * x). ``label_error``: the errors of all
    rows of the label, null labels together; null where an error or the sum is beyond 64 bits. Rows that repeat a
    vec_id, or have none, are rows like others. With fewer usable rows than ``entries`` codebooks have as many entries
    as there are rows; without any there is no row. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    books = codebooks(rows, entries, rounds)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    named = F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("label"))
    codes = written(encoded(rows, books).withColumn("label", named))
    by = codes.groupBy("label").agg(F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error")).alias("label_error"))
    dealt = by.select("label", "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = codes.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return salted.join(dealt, ["label", "salt"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
