"""Reuse of earlier results: which functions need no work because their source, or their facts, did not change."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from skeinworks.sources import log

VERSIONS = {"ir_version": 1, "adapter_version": 1, "rules_version": 1}
# --- fixed values: offset and prime of the 64-bit hash ---
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(column: pa.Array) -> np.ndarray:
    """The 64-bit FNV-1a hash of each string, all strings a byte at a time; null counts as empty."""
    encoded = pc.fill_null(column, "").cast(pa.large_binary())
    _, ends, data = encoded.buffers()
    at = np.frombuffer(ends, np.int64)[encoded.offset : encoded.offset + len(encoded) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    out, start, size = np.full(len(encoded), FNV_OFFSET, np.uint64), at[:-1], np.diff(at)
    left = np.argsort(-size, kind="stable")
    for i in range(int(size.max()) if len(size) else 0):
        left = left[: np.searchsorted(-size[left], -i)]  # strings of more than i bytes
        out[left] = (out[left] ^ raw[start[left] + i]) * np.uint64(FNV_PRIME)
    return out


def with_fnv(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the 64-bit FNV-1a hash of a string column as 16 hex digits (unsigned does not fit a long)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            hashed = pa.array([f"{h:016x}" if known else None for h, known in zip(fnv1a(texts).tolist(), texts.is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, hashed], schema=batch.schema.append(pa.field(name, pa.string())))

    return rows.mapInArrow(scan, StructType([*rows.schema.fields, StructField(name, StringType())]))


def with_semantic_hash(facts: DataFrame, *but: str) -> DataFrame:
    """``facts`` with ``semantic_hash``: a digest of all their columns but those named, in order."""
    return facts.withColumn("semantic_hash", F.sha2(F.to_json(F.struct(*(c for c in facts.columns if c not in but)), {"ignoreNullFields": "false"}), 256))


def _common(old: bytes, new: bytes) -> tuple[int, int]:
    """How many bytes of two values are the same in front, and behind what is the same in front."""
    n = min(len(old), len(new))
    a, b = np.frombuffer(old, np.uint8), np.frombuffer(new, np.uint8)
    differ = np.flatnonzero(a[:n] != b[:n])
    front = int(differ[0]) if len(differ) else n
    rest = n - front
    differ = np.flatnonzero(a[len(a) - rest :][::-1] != b[len(b) - rest :][::-1])
    return front, int(differ[0]) if len(differ) else rest


@F.pandas_udf(StructType([StructField("prefix", IntegerType()), StructField("suffix", IntegerType()), StructField("replacement", BinaryType())]))
def delta(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """What turns one binary value into another: the lengths of what stays in front and behind, and what comes between."""
    found = [_common(a, b) for a, b in zip(old, new, strict=True)]
    return pd.DataFrame({"prefix": [x for x, _ in found], "suffix": [y for _, y in found], "replacement": [b[x : len(b) - y] for (x, y), b in zip(found, new, strict=True)]})


def applied_sql(old: str, change: str) -> str:
    """The SQL of a new value from the old one and its ``delta``; null where the old one is too short for it."""
    return f"CASE WHEN {change}.prefix + {change}.suffix <= octet_length({old}) THEN concat(substring({old}, 1, {change}.prefix), {change}.replacement, substring({old}, octet_length({old}) - {change}.suffix + 1)) END"


def applied(old: str, change: str) -> Column:
    """``applied_sql`` as a column."""
    return F.expr(applied_sql(old, change))


def stable_id(source: str = "source", ordinal: str = "ordinal", function: str = "function_name"):
    return F.concat_ws("::", F.col(source), F.col(ordinal).cast("string"), F.col(function))


def compatible():
    """The cached row was made by these versions."""
    return F.greatest(*(F.abs(F.col(k) - v) for k, v in VERSIONS.items())) == 0


def reuse(now: DataFrame, cached: DataFrame, key: str, group: str, source_hash: str, semantic_hash: str) -> DataFrame:
    """``now`` with ``tier``: 1 where all of the group's cached rows have its source hash, 2 where the row's semantic hash is cached, else 0."""
    same = cached.select(F.col(group), F.col(source_hash).alias("_source_hash")).join(now.select(group, F.col(source_hash).alias("_now")).distinct(), group)
    whole = same.groupBy(group).agg(F.bool_and(F.col("_source_hash") == F.col("_now")).alias("_whole"))
    rows = now.join(cached.select(F.col(key), F.col(semantic_hash).alias("_semantic")), key, "left").join(whole, group, "left")
    return rows.withColumn("tier", F.when(F.coalesce("_whole", F.lit(False)), 1).when(F.col("_semantic").eqNullSafe(F.col(semantic_hash)), 2).otherwise(0)).drop("_semantic", "_whole")


def write_status(new: DataFrame, cached: DataFrame, key: str, content: str) -> DataFrame:
    """``new`` with ``status``: created, updated or unchanged."""
    joined = new.join(cached.select(F.col(key), F.col(content).alias("_old"), F.lit(True).alias("_known")), key, "left")
    return joined.withColumn("status", F.when(F.col("_known").isNull(), "created").when(F.col("_old").eqNullSafe(F.col(content)), "unchanged").otherwise("updated")).drop("_old", "_known")


def put(spark: SparkSession, rows: DataFrame, path: str, key: str) -> DataFrame:
    """Adds ``rows`` (a key once) to the cache at ``path``, whose last row of a key counts; returns what was stored, read back.

    They are published as one change or not at all, and another writer's change before it is kept. A cache of more than
    ``MOST_FOLDERS`` changes is compacted.
    """
    name = log.write(rows, path)
    written = log.change(spark, path, lambda last: (*last.folders, name))
    if len(written.folders) > log.MOST_FOLDERS:
        compact(spark, path, key)
    return spark.read.schema(rows.schema).parquet(f"{path}/{name}")


def store(spark: SparkSession, rows: DataFrame, path: str, key: str) -> DataFrame:
    """``put`` with the status of each row: created, updated or unchanged."""
    before, _ = load_recovering(spark, path, key)
    stored = put(spark, rows, path, key)
    return stored.withColumn("status", F.lit("created")) if before is None else write_status(stored, before, key, "semantic_hash")


def compact(spark: SparkSession, path: str, key: str) -> None:
    """The last row of each key in one folder. Files that can't be read are left behind."""
    log.merge(spark, path, lambda found: _latest(log.read(spark, path, found, ignore_corrupt=True), key))


def _latest(rows: DataFrame, key: str) -> DataFrame:
    """The row of each key from the last folder."""
    kept = [c for c in rows.columns if c != "_place"]
    best = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*kept), "_place").alias("_row"))
    return best.select("_row.*")


def load(spark: SparkSession, path: str, key: str, version: int | None = None, columns: tuple[str, ...] = ()) -> DataFrame | None:
    """The last row of each key, as of a version if one is given; None where there is no cache yet. With ``columns`` nothing but these and the key is read."""
    found = log.manifest(spark, path, version)
    rows = log.read(spark, path, found)
    if rows is not None and columns:
        rows = rows.select(*dict.fromkeys((key, *columns)), "_place")
    return rows if rows is None else rows.drop("_place") if len(found.folders) == 1 else _latest(rows, key)


def load_recovering(spark: SparkSession, path: str, key: str) -> tuple[DataFrame | None, DataFrame | None]:
    """What can be read, and (source, reason) of the files that can't; None where there is no cache yet."""
    found = log.manifest(spark, path)
    if not found.folders:
        return None, None
    try:
        rows = log.read(spark, path, found, ignore_corrupt=True)
    except AnalysisException as error:  # a folder without any file that can be read has no schema
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        readable = [f for f in found.folders if not _files(spark, path, [f]).filter("reason IS NULL").isEmpty()]
        rows = log.read(spark, path, log.Manifest(found.version, tuple(readable)), ignore_corrupt=True)
    lost = _files(spark, path, found.folders).filter("reason IS NOT NULL")
    return None if rows is None else rows.drop("_place") if len(found.folders) == 1 else _latest(rows, key), lost


def _files(spark: SparkSession, path: str, folders: Iterable[str]) -> DataFrame:
    """(source, reason) of the files of ``folders``; the reason is null where Parquet's footer can be read. Nothing else of a file is."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = []
            for path in batch.column(0).to_pylist():
                files, own = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                try:
                    with files.open_input_file(own) as stream:
                        pq.read_metadata(stream)
                    reasons.append(None)
                except (pa.ArrowException, OSError):
                    reasons.append("unsupported cache file")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reasons, pa.string())], names=["source", "reason"])

    listed = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.parquet").load([f"{path}/{f}" for f in folders])
    return listed.select(F.col("path").alias("source")).mapInArrow(footers, "source string, reason string")


def stats(cached: DataFrame, size: str, group: str) -> DataFrame:
    """Rows, bytes and whole average bytes of each group."""
    return cached.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).withColumn("average", F.expr("bytes div n"))
