"""Exact deduplication with a heavy-hitter split, in DataFrame operations alone.

Misra-Gries counters (``freqItems``) find every digest that more than ``support`` of the rows may have. Their
true counts and winners, at most ``1 / support`` rows, are broadcast, so rows of a frequent digest are resolved
where they are read and never shuffled. The other digests go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.store import numbered, stable

#: A digest with more than this share of the rows is resolved map-side; the broadcast has 1 / SUPPORT rows at most.
SUPPORT = 1 / 1000
#: Characters that equality ignores: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = (" ", "\t", "\n", "\x0b", "\f", "\r")


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def frequent(rows: DataFrame, key: str, best: Column, support: float = SUPPORT, size: Column | None = None) -> DataFrame:
    """(key, best, group_size) of the keys that more than ``support`` of the rows have, counted exactly.

    Misra-Gries reports a superset of them, of 1 / support entries at most; the second pass verifies it.
    ``size`` is what makes up group_size, by default the rows.
    """
    number = F.count(F.lit(1))
    total = rows.agg((number * support).alias("_least"))
    found = rows.stat.freqItems([key], support).select(F.explode(F.col(f"{key}_freqItems")).alias(key))
    counted = rows.join(F.broadcast(found), key, "left_semi").groupBy(key).agg(F.max(best).alias("best"), (number if size is None else size).alias("group_size"), number.alias("_rows"))
    return stable(counted.join(F.broadcast(total), F.col("_rows") > F.col("_least")).drop("_least", "_rows"))


def grouped(rows: DataFrame, key: str, best: Column, support: float = SUPPORT, size: Column | None = None, alone: Column | None = None) -> DataFrame:
    """``rows`` (best kept with ``stable``) with ``best``, the largest value in the row's key, and ``group_size``.

    ``size`` sums up a group and ``alone`` is that of a single row; by default both count rows.
    """
    heavy = F.broadcast(frequent(rows, key, best, support, size))
    resolved = rows.join(heavy, key, "inner")
    light = rows.join(heavy, key, "left_anti")
    number = F.count(F.lit(1))
    shared = light.groupBy(key).agg(F.max(best).alias("best"), (number if size is None else size).alias("group_size"), number.alias("_rows")).filter("_rows > 1").drop("_rows")
    one = F.lit(1).cast("long") if alone is None else alone
    return resolved.unionByName(light.join(shared, key, "left").withColumns({"best": F.coalesce("best", best), "group_size": F.coalesce("group_size", one)}))


#: So many of a lookup table's keys are broadcast: any other key has at most this part of all rows.
HOTTEST = 1000


def looked_up(rows: DataFrame, table: DataFrame, *key: str, n: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined by ``how`` (inner or left_semi) to ``table`` (best kept with ``stable``), which has a key once and, in column ``n``, how many rows have it.

    Rows of the HOTTEST keys meet a broadcast of that many entries where they are; the others are shuffled.
    """
    hot = F.broadcast(table.orderBy(F.desc(n), *key).limit(HOTTEST))
    return rows.join(hot, list(key), how).unionByName(rows.join(hot.select(*key), list(key), "left_anti").join(table, list(key), how))


def _resolved(rows: DataFrame, support: float) -> DataFrame:
    """Rows of row, doc_id, text with the digest, group_size and ``best``: the complements of the id and number of the row that stays.

    The complement of a number turns its order around without overflow, and null stays the least, so null loses.
    """
    text = F.coalesce("text", F.lit(""))
    slim = stable(rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).alias("_chars"), text_digest(F.col("text")).alias("text_sha256")))
    best = F.struct(F.col("_chars").alias("chars"), F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row"))
    return grouped(slim, "text_sha256", best, support)


def exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are not read): keep_id, group_size, kept, text_sha256.

    Texts are equal when they are without blanks. Of equal texts the one with the most code points stays, then the
    smallest doc_id; a null doc_id loses every tie. Rows that repeat a doc_id and a text are one group, of which
    exactly one row is kept. A null text counts as empty; an empty table gives no rows.
    """
    rows = _resolved(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), support)
    kept = F.col("row") == F.bitwise_not("best.row")
    return rows.select("doc_id", F.bitwise_not("best.id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; whole rows are shuffled once, by their numbers."""
    rows = numbered(docs)
    keep = _resolved(rows.select("row", "kept.doc_id", "kept.text"), support).filter(F.col("row") == F.bitwise_not("best.row")).select("row")
    return rows.join(keep, "row", "left_semi").select("kept.*")
