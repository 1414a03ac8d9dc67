"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are hashed words and word beginnings, which also meet inflected forms. One weight vector serves all
thresholds: P(grade > j) = logistic(w x - t_j), with t_0 < t_1. The expected severity is the sum of these.

Labels say only whether a text is toxic (``quality`` is another matter, and as often good in toxic rows), so severity
among toxic texts is defined, not learned: grade 0 is clean, and of toxic training rows those are 2 in which toxic
words are denser than in the median one, else 1. The regression carries that order over to unlabelled texts by all
features together. Features are counted and selected on Spark; the driver gets one row for each selected feature, and
for each training row its counts of these.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from skeinworks.llm.store import stable, whole
from skeinworks.llm.words import Words, chunks

#: The classifier is fitted on at most this many labelled rows of either class, the first in the order of a hash.
TRAIN_ROWS = 3000
#: One label in FOLDS is held out of training.
FOLDS = 5
#: Slots of hashed features, how many are selected, the least significance, and the word beginnings in bytes.
SLOTS, SELECTED, SIGNIFICANT, BEGINNINGS = 1 << 20, 2048, 4.0, (4, 5, 6)
#: Of selected features, this share of a class's training rows has them, and three rows at least.
LEAST_SHARE = 0.01
#: Words with a feature of more log odds than this are distinctive.
DISTINCTIVE = 4.0
STEPS, RATE, DECAY = 400, 0.1, 2e-4
#: Tasks that training rows, of whatever length, are dealt to.
TRAIN_TASKS = 16


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit(7)), F.lit(FOLDS)) == 0


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot) of every feature occurrence."""
    word, slot = [np.arange(len(words))], [words.hash % np.uint64(SLOTS)]
    for n in BEGINNINGS:
        at, hashes = words.prefixes(n)
        word.append(at)
        slot.append((hashes + np.uint64(n)) % np.uint64(SLOTS))
    return np.concatenate(word), np.concatenate(slot).astype(np.int64)


@dataclass
class Model:
    """``column`` maps a slot to its place in ``weight``, -1 for most; the last weight is of the distinctive words' share."""

    column: np.ndarray
    distinctive: np.ndarray
    weight: np.ndarray
    thresholds: np.ndarray

    def counted(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, column, times) of the selected features, and each text's share of distinctive words."""
        word, slot = features(words)
        column = self.column[slot]
        known = column >= 0
        word, column = word[known], column[known]
        text = words.owner[word] if len(word) else np.empty(0, np.int64)
        pairs, times = np.unique(text * len(self.distinctive) + column, return_counts=True) if len(word) else (np.empty(0, np.int64),) * 2
        marked = np.unique(word[self.distinctive[column]]) if len(word) else word
        share = np.bincount(words.owner[marked], minlength=words.texts) if len(marked) else np.zeros(words.texts)
        width = max(len(self.distinctive), 1)
        return pairs // width, pairs % width, times, share / np.maximum(np.diff(words.first), 1)

    def inputs(self, words: Words) -> np.ndarray:
        """A row of inputs for each text."""
        out = np.zeros((words.texts, len(self.distinctive) + 1), np.float32)
        text, column, times, share = self.counted(words)
        out[text, column] = np.log1p(times)
        out[:, -1] = np.log1p(1000 * share)
        return out

    def severity(self, inputs: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - (inputs @ self.weight)[:, None], -50, 50)))


def _weighed(texts: DataFrame) -> DataFrame:
    """``texts`` (toxic, text) with ``weight``: near copies, known by the least hash of three words, share the weight of one row."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in chunks(batch.column(1)):
                grams, inside = words.grams(3)
                least = np.zeros(words.texts, np.uint64) - np.uint64(1)
                np.minimum.at(least, words.owner[np.flatnonzero(inside)], grams[inside])
                short = np.flatnonzero(np.diff(words.first) < 3)
                for t in short:
                    least[t] = zlib.crc32(words.hash[words.first[t] : words.first[t + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1)), pa.array(least.view(np.int64))], names=["toxic", "text", "key"])

    keyed = stable(texts.repartition(TRAIN_TASKS).mapInArrow(key, "toxic boolean, text string, key long"))
    copies = keyed.groupBy("toxic", "key").agg((1 / F.count(F.lit(1))).alias("weight"))  # of TRAIN_ROWS a class
    return stable(keyed.join(F.broadcast(copies), ["toxic", "key"]).select("toxic", "text", "weight"))


def _selected(texts: DataFrame) -> tuple[list, float, float]:
    """Rows of slot and odds, SELECTED at most, the most significant first, and the weights of toxic and clean rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SLOTS))
        for batch in batches:
            toxic, weight = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            for a, _, words in chunks(batch.column(1)):
                word, slot = features(words)
                present = np.unique(words.owner[word] * SLOTS + slot)
                owner = present // SLOTS + a
                np.add.at(total, (toxic[owner].astype(int), present % SLOTS), weight[owner])
        full = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[1][full]), pa.array(total[0][full])], names=["slot", "w1", "w0"])

    n1, n0 = texts.agg(F.sum(F.when(F.col("toxic"), F.col("weight"))), F.sum(F.when(~F.col("toxic"), F.col("weight")))).first()
    if not n1 or not n0:
        return [], n1 or 0.0, n0 or 0.0
    slots = texts.select("toxic", "text", "weight").mapInArrow(count, "slot long, w1 double, w0 double").groupBy("slot").agg(F.sum("w1").alias("w1"), F.sum("w0").alias("w0"))
    logit = lambda w, n: F.log((w + 0.5) / (n + 0.5 - w))
    w1, w0 = F.least("w1", F.lit(n1)), F.least("w0", F.lit(n0))
    odds = logit(w1, n1) - logit(w0, n0)
    spread = F.sqrt(1 / (w1 + 0.5) + 1 / (n1 - w1 + 0.5) + 1 / (w0 + 0.5) + 1 / (n0 - w0 + 0.5))
    judged = slots.select("slot", odds.alias("odds"), F.round(odds / spread, 9).alias("z"), w1.alias("w1"), w0.alias("w0"))
    common = F.when(F.col("odds") > 0, (F.col("w1") >= 3) & (F.col("w1") >= LEAST_SHARE * n1)).otherwise((F.col("w0") >= 3) & (F.col("w0") >= LEAST_SHARE * n0))
    best = judged.filter((F.abs("z") >= SIGNIFICANT) & common).orderBy(F.desc(F.abs("z")), "slot").limit(SELECTED).select("slot", "odds")
    return best.collect(), n1, n0


def fit(texts: DataFrame, share_toxic: float) -> Model | None:
    """``texts``: training rows of toxic, text. They hold more toxic ones than ``share_toxic``, their share of all labels; the thresholds make up for it."""
    weighed = _weighed(texts)
    chosen, n1, n0 = _selected(weighed)
    if not n1 or not n0 or not 0 < share_toxic < 1:
        return None
    column = np.full(SLOTS, -1, np.int32)
    column[[r["slot"] for r in chosen]] = np.arange(len(chosen))
    model = Model(column, np.array([r["odds"] for r in chosen]) > DISTINCTIVE, np.zeros(0), np.zeros(0))
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in chunks(batch.column(1)):
                text, at, times, share = shared.value.counted(words)
                cuts = pa.array(np.searchsorted(text, np.arange(words.texts + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (at, times)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 2)), *lists, pa.array(share)], names=["toxic", "weight", "at", "times", "share"])

    # 2 * TRAIN_ROWS rows of SELECTED counts at most, however long the texts
    got = weighed.select("toxic", "text", "weight").mapInArrow(read, "toxic boolean, weight double, at array<int>, times array<int>, share double").collect()
    got = sorted(got, key=lambda r: (r["toxic"], r["at"], r["times"], r["weight"]))  # the same fit in whatever order tasks end
    x = np.zeros((len(got), len(chosen) + 1), np.float32)
    for i, r in enumerate(got):
        x[i, r["at"]] = np.log1p(r["times"])
    share, toxic, weight = (np.array([r[k] for r in got]) for k in ("share", "toxic", "weight"))
    x[:, -1] = np.log1p(1000 * share)
    grade = np.where(toxic, 1 + (share > np.median(share[toxic])), 0)
    model.weight, thresholds = ordinal(x, grade, weight)
    model.thresholds = thresholds + np.log(n1 / n0) - np.log(share_toxic / (1 - share_toxic))
    return model


def ordinal(x: np.ndarray, grade: np.ndarray, worth: np.ndarray, levels: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of the proportional-odds model, by Adam on the mean log-likelihood, by rows' ``worth``, with a ridge."""
    worth = worth / worth.sum()
    weight, gap = np.zeros(x.shape[1]), np.zeros(levels - 1)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weight, gap)]
    rows = np.arange(len(x))
    for step in range(1, STEPS + 1):
        t = np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])]))
        up = 1 / (1 + np.exp(np.clip(t[None, :] - (x @ weight)[:, None], -50, 50)))  # P(grade > j)
        edge = np.concatenate([np.ones((len(x), 1)), up, np.zeros((len(x), 1))], axis=1)
        slope = edge * (1 - edge)
        chance = np.maximum(edge[rows, grade] - edge[rows, grade + 1], 1e-9)
        by_score = (slope[rows, grade] - slope[rows, grade + 1]) / chance
        by_t = np.zeros_like(up)
        low, high = grade > 0, grade < levels - 1
        by_t[rows[low], grade[low] - 1] -= slope[rows[low], grade[low]] / chance[low]
        by_t[rows[high], grade[high]] += slope[rows[high], grade[high] + 1] / chance[high]
        t_slope = worth @ by_t
        gap_slope = np.array([t_slope[j:].sum() * (1 if j == 0 else np.exp(gap[j])) for j in range(len(gap))])
        for p, g, m in zip((weight, gap), (x.T @ (by_score * worth) - DECAY * weight, gap_slope), moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p += RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return weight, np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])]))


def trained(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """A model from ``labels`` (doc_id, toxic) outside the held-out fold; None where a class has no row."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = usable.groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max("toxic") > 0).alias("_toxic"))
    order = F.xxhash64("_id")
    seen = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_toxic").cast("int")).alias("toxic")).first()
    sample = known.filter("_toxic").orderBy(order, "_id").limit(train_rows).unionByName(known.filter("NOT _toxic").orderBy(order, "_id").limit(train_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    rows = texts.join(F.broadcast(sample), "_id").groupBy("_id").agg(F.any_value("_toxic").alias("toxic"), F.min(F.coalesce("text", F.lit(""))).alias("text"))  # sample: 2 * train_rows at most
    return fit(rows.select("toxic", "text"), (seen["toxic"] or 0) / max(seen["n"], 1))


def _scored(docs: DataFrame, labels: DataFrame, train_rows: int, known: DataFrame | None) -> DataFrame:
    """Every row of ``docs`` as ``kept``, with n_words, severity, grade, toxic; no row is shuffled or joined."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs if known is None else known, labels, train_rows))
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for a, b, words in chunks(batch.column(0).flatten()[at]):
                up = own.severity(own.inputs(words)) if own else np.zeros((words.texts, 2))
                chance = np.concatenate([1 - up[:, :1], up[:, :1] - up[:, 1:], up[:, 1:]], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(words.first), pa.int64()), pa.array(up.sum(axis=1)), pa.array(chance.argmax(axis=1), pa.int32()), pa.array(up[:, 0] > 0.5)],
                    names=["kept", "n_words", "severity", "grade", "toxic"],
                )

    rows = docs.select(whole(docs).alias("kept"))
    judged = [StructField("n_words", LongType()), StructField("severity", DoubleType()), StructField("grade", IntegerType()), StructField("toxic", BooleanType())]
    return rows.mapInArrow(score, StructType([*rows.schema.fields, *judged]))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, known: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, severity (expected, 0 to 2), grade (the likeliest), toxic.

    ``toxic``: a grade above 0 is likelier than not. Null and wordless texts are scored by the thresholds alone.
    Labels of null doc_id or toxic are not used; a doc_id that labels call both is toxic, and of rows that repeat a
    labelled doc_id the least text is trained on. Without labels of both classes every severity is 0. ``known`` has
    the texts of the labels' doc_ids, by default ``docs``. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _scored(docs, labels, train_rows, known).select("kept.doc_id", "n_words", "severity", "grade", "toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, known: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that are likelier clean than not, each judged by itself, with all their columns."""
    return _scored(docs, labels, train_rows, known).filter("NOT toxic").select("kept.*")
