"""Terminal observations committed once, and exports of them that can be checked and repaired.

Observations are rows (key, content) in a log. Committing one that is there already changes nothing, and another one of
the same key is refused, so a commit that was interrupted, or that nobody knows the end of, is simply repeated. An
export is a table of its own with a digest of each row. What is wrong with it is found by joining digests; only a
repair changes it, and keeps what it takes away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.sources import log


class CommitError(ValueError):
    """Observations that cannot be committed, with the least key of these."""


def _digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def canonical(spark: SparkSession, path: str) -> DataFrame | None:
    """(key, content, sha256) of all committed observations; None before the first."""
    rows = log.read(spark, path, log.manifest(spark, path))
    return None if rows is None else rows.drop("_place")


def commit(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Adds the observations ``rows`` (key, content: strings) that are new, all or none; how many.

    A key with another content than the one committed, or with two in ``rows``, is an error, as is a null key or
    content; rows that repeat each other are one. Where another writer publishes first, all is checked again.
    """
    given = rows.select(F.col("key").cast("string").alias("key"), F.col("content").cast("string").alias("content")).distinct()
    added = 0

    def new(base: log.Manifest) -> tuple[str, ...]:
        nonlocal added
        known = log.read(spark, path, base)
        fresh = given if known is None else given.join(known.select("key", "content"), ["key", "content"], "left_anti")
        name = log.write(fresh.withColumn("sha256", _digest(F.col("content"))), path)
        fresh = spark.read.parquet(f"{path}/{name}")
        problems = [(fresh.filter("key IS NULL OR content IS NULL"), "a key or content is null"), (fresh.groupBy("key").count().filter("count > 1"), "two observations of a key")]
        if known is not None:
            problems.append((fresh.join(known.select("key"), "key", "left_semi"), "a terminal observation already exists"))
        for wrong, what in problems:
            if (first := wrong.orderBy("key").first()) is not None:
                raise CommitError(f"{what}: {first['key']}")
        added = fresh.count()
        return (*base.folders, name) if added else base.folders

    base = log.manifest(spark, path)
    while True:
        folders = new(base)
        if folders == base.folders or log.published(spark, path, log.Manifest(base.version + 1, folders)):
            return added
        base = log.manifest(spark, path)


def export(spark: SparkSession, path: str, to: str) -> None:
    """Publishes all committed observations as the table at ``to``, in place of what is there."""
    rows = canonical(spark, path)
    if rows is not None:
        name = log.write(rows, to)
        log.change(spark, to, lambda _: (name,))


def verify(spark: SparkSession, path: str, to: str) -> DataFrame:
    """(key, problem) of the rows of the export at ``to``: missing, unknown, changed (another content), repeated, or digest (a content that its digest doesn't fit)."""
    none = spark.createDataFrame([], "key string, content string, sha256 string")
    right, found = canonical(spark, path), log.read(spark, to, log.manifest(spark, to))
    right, found = none if right is None else right, none if found is None else found
    shown = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("content").alias("content"), F.max("sha256").alias("shown"))
    both = right.select("key", F.col("sha256").alias("expected")).join(shown, "key", "full")
    problem = (
        F.when(F.col("n").isNull(), "missing").when(F.col("expected").isNull(), "unknown").when(F.col("n") > 1, "repeated")
        .when(~_digest(F.col("content")).eqNullSafe(F.col("expected")), "changed").when(~F.col("shown").eqNullSafe(F.col("expected")), "digest")
    )
    return both.select("key", problem.alias("problem")).filter("problem IS NOT NULL")


def repair(spark: SparkSession, path: str, to: str) -> DataFrame:
    """Makes the export at ``to`` what ``verify`` finds nothing wrong with; the rows that it took away, with their problem, kept below ``to``.

    Only what is wrong is written: right rows stay where they are wherever a folder has no others.
    """
    wrong = verify(spark, path, to)
    base = log.manifest(spark, to)
    found = log.read(spark, to, base)
    kept = log.write(wrong if found is None else wrong.join(found.drop("_place"), "key", "left"), f"{to}/corrupt")
    wrong = spark.read.parquet(f"{to}/corrupt/{kept}")
    if wrong.isEmpty():
        return wrong
    touched = [] if found is None else [r["_place"] for r in found.join(wrong.select("key"), "key", "left_semi").select("_place").distinct().collect()]  # at most one for each folder
    rows = canonical(spark, path)
    again = rows.join(wrong.select("key").distinct(), "key", "left_semi")
    if touched:
        again = again.unionByName(found.filter(F.col("_place").isin(touched)).drop("_place").join(wrong.select("key"), "key", "left_anti"))
    name = log.write(again, to)
    gone = {base.folders[i] for i in touched}
    log.change(spark, to, lambda last: (*(f for f in last.folders if f not in gone), name))
    return wrong
