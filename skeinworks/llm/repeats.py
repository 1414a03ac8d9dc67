"""Passages that repeat, by a sparse suffix array read in groups of equal prefixes.

Minimisers, word positions whose k-gram hash is least in a window, are chosen by content alone, so copies of a passage
keep the same ones. A run of LEAST words whose minimisers occur once cannot repeat and is dropped. The others are
brought together by 128 bits of hash of all their words: neighbours of a sorted array that agree in LEAST words, found
however many others share parts of them. A run's partner is another place of the same words, and runs of consecutive
places whose partners are consecutive too are extended to one passage. Texts of equal words enter once and stand for
their copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.llm.exact_dedup import grouped, looked_up
from skeinworks.llm.store import stable, written
from skeinworks.llm.words import chunks, minimisers, sliding

#: Fewest words of a passage; words of a minimiser; minimisers of which a window keeps the least.
LEAST, GRAM, WINDOW = 50, 12, 32


def _positions(docs: DataFrame) -> DataFrame:
    """(id, print, n_words, gram): the minimisers of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in chunks(batch.column(1)):
                at, grams = minimisers(words, GRAM, WINDOW)
                cuts = np.searchsorted(at, words.first)
                offsets = pa.array(cuts, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(words.prints(), pa.binary()), pa.array(np.diff(words.first), pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(grams.view(np.int64))),
                    ],
                    names=["id", "print", "n_words", "gram"],
                )

    return docs.mapInArrow(scan, "id long, print binary, n_words long, gram array<long>")


def _runs(docs: DataFrame) -> DataFrame:
    """(h, h2, id, at) of each row's (id, text, gram) runs of LEAST words all of whose minimisers are in ``gram``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in chunks(batch.column(1)):
                whole, inside = words.grams(LEAST)
                if not len(whole):
                    continue
                known = batch.column(2).slice(a, b - a)
                owner = words.owner
                least = sliding(np.minimum, words.grams(GRAM)[0], WINDOW)
                again = np.zeros(len(least), bool)
                for t in range(words.texts):
                    part = slice(int(words.first[t]), int(words.first[t + 1]))
                    again[part] = np.isin(least[part], np.array(known[t].as_py(), np.int64).view(np.uint64))
                kept = np.flatnonzero(inside & sliding(np.minimum, again, LEAST - GRAM - WINDOW + 2))
                own = owner[kept]
                hashes = [pa.array(x[kept].view(np.int64)) for x in (whole, words.grams(LEAST, salt=1)[0])]
                yield pa.RecordBatch.from_arrays([*hashes, batch.column(0).slice(a, b - a).take(pa.array(own)), pa.array(kept - words.first[own], pa.int32())], names=["h", "h2", "id", "at"])

    return docs.mapInArrow(scan, "h long, h2 long, id long, at int")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Rows of doc_id, start_word, end_word (exclusive), n_words, other_doc_id: passages of ``docs`` (doc_id, text) that occur again.

    Every LEAST consecutive words of a passage occur in ``other_doc_id``; where no other document has them, again in
    the same text. A passage ends where that no longer holds, so a document may have passages that overlap, each with
    a partner of its own. Of all documents with some words the least is every other one's partner, so any two texts
    that share a passage are linked through it. Texts of equal words, LEAST or more, repeat as a whole. Null and short
    texts have no passage; rows of null doc_id are left out, and rows that repeat a doc_id are one document, whose
    copies don't count as another place. Other columns are not read.
    """
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    found = written(_positions(rows).filter(F.col("n_words") >= LEAST))
    once = stable(found.select("id", "print", "n_words").distinct())
    member = stable(grouped(once, "print", F.bitwise_not("id")).select("id", "n_words", F.bitwise_not("best").alias("first")))
    copies = member.filter("id != first")
    twin = copies.groupBy("first").agg(F.min("id").alias("other"))
    whole = copies.select("id", "n_words", F.col("first").alias("other")).unionByName(member.filter("id = first").join(twin, "first").select("id", "n_words", "other"))
    whole = whole.select("id", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"), "other")
    kept = found.join(member.filter("id = first").select("id"), "id", "left_semi").dropDuplicates(["id", "print"])
    places = kept.select("id", F.explode("gram").alias("gram"))
    again = stable(places.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    chosen = looked_up(places, again, "gram", how="left_semi").groupBy("id").agg(F.collect_set("gram").alias("gram"))
    runs = written(_runs(rows.join(chosen, "id").select("id", "text", "gram")))
    # the same row again has the same places, so a run that occurs at two has two ids or two positions
    ends = runs.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.min("at").alias("first"), F.max("at").alias("last"))
    table = written(ends.filter("low != high OR first != last").select("h", "h2", "n", "low", "high"))
    other = F.when(F.col("low") != F.col("id"), F.col("low")).otherwise(F.col("high"))
    met = looked_up(runs, table, "h", "h2").select("id", "at", other.alias("other"))
    islands = met.withColumn("island", F.col("at") - F.dense_rank().over(Window.partitionBy("id", "other").orderBy("at")))
    merged = islands.groupBy("id", "other", "island").agg(F.min("at").alias("start"), (F.max("at") + LEAST).cast("int").alias("end"))
    spans = merged.select("id", "start", "end", "other").unionByName(whole)
    return spans.select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), F.col("other").alias("other_doc_id"))
