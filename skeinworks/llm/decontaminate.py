"""Benchmark decontamination by winnowing.

Training texts and test items keep the least k-gram hash of every window of ``span - k + 1`` k-grams. A shared run
of ``span`` words then always has a kept k-gram in common. Kept hashes are joined, and every hit is extended left
and right, word by word, along its alignment; runs of ``span`` words or more count. Items of fewer words are looked
up whole, by the hash of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from skeinworks.llm.exact_dedup import HOTTEST
from skeinworks.llm.store import numbered, stable, whole
from skeinworks.llm.words import Words, chunks, minimisers, mix, words_of

SPAN, GRAM = 13, 5
#: Most bytes of item texts that are sent to every worker; a larger benchmark is joined by shuffling fingerprints.
BROADCAST_BYTES = 16 << 20
#: Tasks over which the texts of a very frequent fingerprint are dealt.
SPREAD = 64
#: A pair of texts whose common fingerprints meet in more places than this many times their words is searched by its windows.
DENSE = 4
_FOUND = [
    StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("n_items", LongType()), StructField("items", ArrayType(StringType())),
    StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
]
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Index:
    """Fingerprints of items. Items of equal words share an entry."""

    def __init__(self, items: list[tuple[str, str]], span: int = SPAN, gram: int = GRAM):
        raw = [text.encode() for _, text in items]
        self.span, self.gram = span, gram
        self.words = words_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]).astype(np.int64))
        first, self.names, same = self.words.first, [], {}
        alone = []
        for i, (name, _) in enumerate(items):
            key = self.words.hash[first[i] : first[i + 1]].tobytes()
            if key in same:
                self.names[same[key]].append(name)
            else:
                same[key] = i
                alone.append(i)
            self.names.append([name])
        length = np.diff(first)
        distinct = np.zeros(len(items), bool)
        distinct[alone] = True
        at, found = minimisers(self.words, gram, span - gram + 1)
        owner = self.words.owner
        use = distinct[owner[at]] if len(at) else np.empty(0, bool)
        order = np.argsort(found[use], kind="stable")
        self.at, found = at[use][order], found[use][order]
        self.item = owner[self.at] if len(self.at) else np.empty(0, np.int64)
        order = np.lexsort((self.at, self.item, found))
        self.at, self.item, found = self.at[order], self.item[order], found[order]
        self.hash, own = np.unique(found, return_inverse=True)
        new = np.ones(len(found), bool)
        new[1:] = (own[1:] != own[:-1]) | (self.item[1:] != self.item[:-1])
        # entries: a hash in an item, and its places there; slots of hashes have their entries in a row
        self.head = np.append(np.flatnonzero(new), len(found))
        self.entry_item = self.item[self.head[:-1]]
        self.slot_head = np.searchsorted(own[self.head[:-1]], np.arange(len(self.hash) + 1))
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, span):
            if len(which := np.flatnonzero(distinct & (length == n))):
                grams = self.words.grams(n)[0][first[which]]
                order = np.argsort(grams)
                self.short[n] = grams[order], which[order]

    def hits(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, word after the last) of every run of a text that an item has."""
        at, found = minimisers(words, self.gram, self.span - self.gram + 1)
        if len(at) and len(self.hash):
            slot = np.minimum(np.searchsorted(self.hash, found), len(self.hash) - 1)
            same = self.hash[slot] == found
            at, slot = at[same], slot[same]
            if len(at):
                yield from self._met(words, at, slot)
        for n, (hashes, which) in self.short.items():
            grams, inside = words.grams(n)
            if len(grams):
                slot = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
                for p in np.flatnonzero((hashes[slot] == grams) & inside):
                    i, p = int(which[slot[p]]), int(p)
                    if self._equal(words, p, int(self.words.first[i]), n):
                        yield int(np.searchsorted(words.first, p, side="right")) - 1, i, p, p + n

    def _met(self, words: Words, at: np.ndarray, slot: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """The hits of places ``at`` whose fingerprints are those of ``slot``. Places are listed once for each item, and only paired where that is cheap."""
        text = np.searchsorted(words.first, at, side="right") - 1
        order = np.lexsort((at, slot, text))
        at, slot, text = at[order], slot[order], text[order]
        new = np.ones(len(at), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (text[1:] != text[:-1])
        head = np.append(np.flatnonzero(new), len(at))
        slot, text = slot[head[:-1]], text[head[:-1]]
        entries = self.slot_head[slot + 1] - self.slot_head[slot]
        own = np.repeat(np.arange(len(slot)), entries)
        entry = np.repeat(self.slot_head[slot] - np.cumsum(entries) + entries, entries) + np.arange(len(own))
        text, item = text[own], self.entry_item[entry]
        pairs = np.diff(head)[own] * np.diff(self.head)[entry]
        order = np.lexsort((item, text))
        text, item, own, entry, pairs = (x[order] for x in (text, item, own, entry, pairs))
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        cuts = np.append(np.flatnonzero(new), len(text))
        total = np.add.reduceat(pairs, cuts[:-1])
        for a, b, n in zip(cuts[:-1], cuts[1:], total, strict=True):
            t, i = int(text[a]), int(item[a])
            size = int(words.first[t + 1] - words.first[t] + self.words.first[i + 1] - self.words.first[i])
            if n > DENSE * size:
                yield from self._windows(words, t, i)
                continue
            shifts = set()
            for o, e in zip(own[a:b], entry[a:b], strict=True):
                shifts.update(np.subtract.outer(at[head[o] : head[o + 1]], self.at[self.head[e] : self.head[e + 1]]).ravel().tolist())
            for shift in sorted(shifts):
                yield from self._extend(words, t, i, shift)

    def _windows(self, words: Words, text: int, item: int) -> Iterator[tuple[int, int, int, int]]:
        """Runs of a text all of whose windows an item has: for texts that repeat themselves, where alignments are too many."""
        own, low, high = self.words.first, int(words.first[text]), int(words.first[text + 1])
        mine = _slid(self.words.hash[own[item] : own[item + 1]], self.span)
        theirs = _slid(words.hash[low:high], self.span)
        order = np.argsort(mine, kind="stable")
        place = np.minimum(np.searchsorted(mine[order], theirs), len(mine) - 1)
        hit = np.flatnonzero(mine[order][place] == theirs)
        for p, q in zip(hit.tolist(), order[place[hit]].tolist(), strict=True):
            if self._equal(words, low + p, int(own[item]) + q, self.span):
                yield text, item, low + p, low + p + self.span

    def _extend(self, words: Words, text: int, item: int, shift: int) -> Iterator[tuple[int, int, int, int]]:
        own = self.words.first
        low, high = max(words.first[text], own[item] + shift), min(words.first[text + 1], own[item + 1] + shift)
        same = np.concatenate([[False], words.hash[low:high] == self.words.hash[low - shift : high - shift], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= self.span and self._equal(words, int(low + a), int(low + a - shift), int(b - a)):
                yield text, item, int(low + a), int(low + b)

    def _equal(self, words: Words, at: int, own: int, n: int) -> bool:
        return all(words.word(at + j) == self.words.word(own + j) for j in range(n))


def _slid(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words."""
    out = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for j in range(n):
        out = mix(out + hashes[j : j + len(out)] * np.uint64(2 * j + 1))
    return out


def _marked(words: Words, index: Index, kept: pa.Array) -> pa.RecordBatch:
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    for text, item, a, b in index.hits(words):
        spans.setdefault(text, []).append((a - int(words.first[text]), b - int(words.first[text])))
        items.setdefault(text, set()).update(index.names[item])
    out: dict[str, list] = {"n_hit": [], "items": [], "spans": []}
    for t in range(words.texts):
        merged: list[dict] = []
        for a, b in sorted(spans.get(t, ())):
            if merged and a <= merged[-1]["end"]:
                merged[-1]["end"] = max(b, merged[-1]["end"])
            else:
                merged.append({"start": a, "end": b})
        out["spans"].append(merged)
        out["n_hit"].append(sum(x["end"] - x["start"] for x in merged))
        out["items"].append(sorted(items.get(t, ())))
    return pa.RecordBatch.from_arrays(
        [
            kept, pa.array(np.diff(words.first), pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array([len(x) for x in out["items"]], pa.int64()),
            pa.array(out["items"], pa.list_(pa.string())), pa.array(out["spans"], _SPAN_TYPE),
        ],
        names=["kept", *(f.name for f in _FOUND)],
    )


def _judged(docs: DataFrame, benchmark: DataFrame, span: int, gram: int, broadcast_bytes: int) -> DataFrame:
    """Every row of ``docs`` as ``kept``, with n_words, n_hit, n_items, items, spans; up to ``broadcast_bytes`` of items no row is shuffled."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size > broadcast_bytes:
        return _joined(docs, items, span, gram)
    index = docs.sparkSession.sparkContext.broadcast(Index([tuple(x) for x in items.collect()], span, gram))
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in chunks(batch.column(0).flatten()[at]):
                yield _marked(words, index.value, batch.column(0).slice(a, b - a))

    rows = docs.select(whole(docs).alias("kept"))
    return rows.mapInArrow(scan, StructType([*rows.schema.fields, *_FOUND]))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): its words, hit words, items (ids as strings, sorted) and hit word spans.

    A hit word lies in a run of ``span`` words that an item of ``benchmark`` (item_id, text) has too, or in a whole
    item of fewer words. Null and wordless texts have no words and hit nothing; a null item_id is the string "null".
    Rows that repeat a doc_id, or have none, are judged one by one. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _judged(docs, benchmark, span, gram, broadcast_bytes).select("kept.doc_id", *(f.name for f in _FOUND))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` of which less than a twentieth is hit, each judged by itself, with all their columns."""
    return _judged(docs, benchmark, span, gram, broadcast_bytes).filter(~is_contaminated()).select("kept.*")


def _joined(docs: DataFrame, items: DataFrame, span: int, gram: int) -> DataFrame:
    """The same for a benchmark of any size: fingerprints meet in a shuffle join, each text then sees its own candidates.

    Fingerprints that very many texts have are dealt over SPREAD tasks by the text, and the items' copied to these.
    """
    rows, keyed = numbered(docs), numbered(items)

    def fingerprints(is_item: bool):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, words in chunks(batch.column(1)):
                    owner = words.owner
                    found = [minimisers(words, gram, span - gram + 1)]
                    for n in range(1, span):
                        grams, inside = words.grams(n)
                        if is_item:
                            starts = words.first[:-1][np.diff(words.first) == n]
                            found.append((starts, grams[starts]))
                        elif len(grams):
                            found.append((np.flatnonzero(inside), grams[inside]))
                    at, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
                    own = batch.column(0).slice(a, b - a).take(pa.array(owner[at] if len(at) else at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([own, pa.array(hashes.view(np.int64))], names=["own", "hash"])

        return scan

    asked = keyed.select("row", "kept.text").mapInArrow(fingerprints(True), "own long, hash long").withColumnRenamed("own", "item_row").distinct()
    given = rows.select("row", "kept.text").mapInArrow(fingerprints(False), "own long, hash long").withColumnRenamed("own", "row")
    given = stable(given.join(asked.select("hash").distinct(), "hash", "left_semi").distinct())
    often = stable(given.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPREAD * SPREAD).orderBy(F.desc("n"), "hash").limit(HOTTEST))
    hot = F.col("n").isNotNull()
    dealt = given.join(F.broadcast(often), "hash", "left").select("row", "hash", F.when(hot, F.pmod(F.xxhash64("row"), F.lit(SPREAD))).otherwise(0).cast("int").alias("part"))
    copied = asked.join(F.broadcast(often), "hash", "left").select("item_row", "hash", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))).alias("part"))
    pairs = dealt.join(copied, ["hash", "part"]).select("row", "item_row").distinct().join(keyed.select(F.col("row").alias("item_row"), "kept.item", "kept.text"), "item_row")
    candidates = pairs.groupBy("row").agg(F.collect_list(F.struct("item", "text")).alias("candidates"))
    at = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).flatten()[at]
            for i, found in enumerate(batch.column(1).to_pylist()):
                for _, _, words in chunks(texts.slice(i, 1)):
                    yield _marked(words, Index([(x["item"], x["text"]) for x in found or ()], span, gram), batch.column(0).slice(i, 1))

    both = rows.join(candidates, "row", "left").select("kept", "candidates")
    return both.mapInArrow(judge, StructType([StructField("kept", rows.schema["kept"].dataType), *_FOUND]))


def is_contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """A twentieth of the words or more are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
