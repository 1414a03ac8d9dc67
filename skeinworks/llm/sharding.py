"""Sharding as vector bin packing: bytes, tokens and rows are balanced jointly.

Groups of equal texts stay together, hashed into a fixed number of buckets; a group too large for a bucket is an
item of its own, and one too large for a shard is dealt in pieces. Buckets, groups and pieces are few, however
many rows there are, so the driver can place them largest first, each in the shard where the dot product of its
demand with the residual capacity is highest. Rows then look their bucket up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.llm.store import stable

#: Buckets of ordinary groups; a group of over 1 / HEAVY of any total is placed by itself, in pieces of 1 / PIECES.
BUCKETS, HEAVY, PIECES = 16384, 1024, 2048
_SIZES = ("n_bytes", "n_tokens", "n_rows")


def place(demand: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item. ``demand``: its bytes, tokens and rows. Largest first, by the dot product with what is left.

    An item goes where it fits in every dimension if it can; the last few, which fit nowhere, go by the dot product alone.
    """
    share = demand / np.maximum(demand.sum(axis=0), 1)
    left = np.full((shards, demand.shape[1]), 1 / shards)
    out = np.zeros(len(demand), np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        score = left @ share[i]
        fits = (left >= share[i]).all(axis=1)
        out[i] = np.argmax(np.where(fits, score, -np.inf) if fits.any() else score)
        left[out[i]] -= share[i]
    return out


def _sums() -> list[Column]:
    return [F.sum("size").alias("n_bytes"), F.sum("tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows")]


def _over(total: dict, parts: int) -> Column:
    return F.greatest(*(F.col(k) / F.lit(float(max(total[k] or 0, 1))) for k in _SIZES)) * parts


def sharded(docs: DataFrame, shards: int = 16, tokens: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): size (UTF-8 bytes of the text, null: none, plus 1), text_crc32, shard, slot.

    ``tokens`` counts a row's tokens; by default words between white space, which needs no tokenizer. A group of equal
    texts has one shard unless it is larger than a shard can hold, when it is dealt row by row, whatever the doc_ids.
    Slots are gapless from 0 in every shard. Null and empty texts are one group of size 1 each; repeated rows are
    placed row by row; an empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    if tokens is None:
        tokens = F.regexp_count(text, F.lit(r"\S+")).cast("long")
    rows = stable(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), tokens.cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_group"), F.monotonically_increasing_id().alias("_row"),
        ).withColumn("_bucket", F.pmod("_group", F.lit(buckets)).cast("long"))
    )
    by_bucket = rows.groupBy("_bucket").agg(*_sums()).collect()  # at most BUCKETS rows
    total = {k: sum(x[k] for x in by_bucket) for k in _SIZES}
    suspects = [x["_bucket"] for x in by_bucket if max(x[k] / max(total[k], 1) for k in _SIZES) * HEAVY > 1]
    # only buckets of over 1 / HEAVY, at most 3 * HEAVY of them, can hold a heavy group
    heavy = rows.filter(F.col("_bucket").isin(suspects)).groupBy("_group").agg(*_sums()).filter(_over(total, HEAVY) > 1) if suspects else None
    groups = heavy.withColumn("_pieces", F.ceil(_over(total, PIECES)).cast("long")).collect() if suspects else []
    first_piece, base = {}, buckets
    for x in groups:
        first_piece[x["_group"]], base = base, base + x["_pieces"]
    spark = docs.sparkSession
    dealt = rows
    if groups:
        lookup = spark.createDataFrame([(x["_group"], first_piece[x["_group"]], x["_pieces"]) for x in groups], "_group long, _base long, _pieces long")
        piece = F.col("_base") + F.pmod(F.xxhash64("_row"), F.col("_pieces"))
        dealt = rows.join(F.broadcast(lookup), "_group", "left").withColumn("_bucket", F.coalesce(piece, "_bucket"))
    cells = {x["_bucket"]: tuple(x[k] for k in _SIZES) for x in dealt.groupBy("_bucket").agg(*_sums()).collect()}
    shard_of = _placed(cells, [range(first_piece[x["_group"]], first_piece[x["_group"]] + x["_pieces"]) for x in groups], shards)
    filled, start = [0] * shards, []
    for bucket in sorted(cells):
        start.append((bucket, int(shard_of[bucket]), filled[shard_of[bucket]]))
        filled[shard_of[bucket]] += cells[bucket][2]
    plan = spark.createDataFrame(start, "_bucket long, shard int, _start long")
    within = Window.partitionBy("_bucket").orderBy("doc_id", "text_crc32", "size", "_row")
    return (
        dealt.withColumn("_at", F.row_number().over(within) - 1)
        .join(F.broadcast(plan), "_bucket")
        .select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("_start") + F.col("_at")).cast("long").alias("slot"))
    )


def _placed(cells: dict[int, tuple], groups: list[range], shards: int) -> dict[int, int]:
    """The shard of each bucket and piece; a group's pieces go together if half a shard can hold them."""
    total = np.maximum(np.sum(list(cells.values()) or [[1, 1, 1]], axis=0), 1)
    together = {}
    for pieces in groups:
        own = [p for p in pieces if p in cells]
        if (np.sum([cells[p] for p in own], axis=0) / total).max() <= 0.5 / shards:
            together |= dict.fromkeys(own, own[0])
    items: dict[int, np.ndarray] = {}
    for bucket in sorted(cells):
        item = together.get(bucket, bucket)
        items[item] = items.get(item, np.zeros(3)) + np.array(cells[bucket], float)
    shard = dict(zip(items, place(np.array(list(items.values())).reshape(-1, 3), shards), strict=True))
    return {bucket: int(shard[together.get(bucket, bucket)]) for bucket in cells}
