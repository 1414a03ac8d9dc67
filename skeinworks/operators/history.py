"""All versions of keyed values: a value is stored whole once, and then as what changes it from version to version.

A version's folder in the log has one row for each key that is new (its value) or changed (the length of what stays in
front and behind, and what comes between). A value of any version is its first whole value with the later changes
applied in order, which is one shuffle by key and a fold over at most ``log.MOST_FOLDERS`` of them: more folders are
merged into whole values. Earlier versions stay as they are, for as long as ``log.vacuum`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.operators.cache import applied_sql, delta
from skeinworks.sources import log

_CHANGE = "struct<prefix:int,suffix:int,replacement:binary>"


def restored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """(key, value) of a version, by default the last; None of one without any."""
    return _values(log.read(spark, path, log.manifest(spark, path, version)))


def _values(rows: DataFrame | None) -> DataFrame | None:
    """A value that its changes don't fit is null."""
    if rows is None:
        return None
    steps = rows.filter("status <> 'unchanged'").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_place", "value", "change"))).alias("steps"))
    fold = f"aggregate(steps, CAST(NULL AS BINARY), (v, s) -> CASE WHEN s.change IS NULL THEN s.value ELSE {applied_sql('v', 's.change')} END)"
    return steps.select("key", F.expr(fold).alias("value"))


def commit(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Adds ``rows`` (key, value: binary) as a version; (key, status, delta_bytes) of each key.

    ``status`` is created, updated or unchanged, and ``delta_bytes`` what an update has to store, else null. A null value
    counts as empty; rows of a null key are left out, and of rows that repeat a key the greatest value counts. Where
    another writer publishes first, the changes are found again, against what it has published. Other columns are not read.
    """
    given = rows.select(F.col("key").cast("string").alias("key"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("new")).filter("key IS NOT NULL").groupBy("key").agg(F.max("new").alias("new"))
    told: list[DataFrame] = []

    def changes(base: log.Manifest) -> tuple[str, ...]:
        before = _values(log.read(spark, path, base))
        none = F.lit(None)
        if before is None:
            found = given.select("key", F.col("new").alias("value"), none.cast(_CHANGE).alias("change"), F.lit("created").alias("status"))
        else:
            joined = given.join(before.withColumnRenamed("value", "old"), "key", "left")
            fresh = joined.filter("old IS NULL").select("key", F.col("new").alias("value"), none.cast(_CHANGE).alias("change"), F.lit("created").alias("status"))
            changed = joined.filter("old <> new").select("key", none.cast("binary").alias("value"), delta("old", "new").alias("change"), F.lit("updated").alias("status"))
            same = joined.filter("old = new").select("key", none.cast("binary").alias("value"), none.cast(_CHANGE).alias("change"), F.lit("unchanged").alias("status"))
            found = fresh.unionByName(changed).unionByName(same)
        name = log.write(found, path)
        told[:] = [spark.read.parquet(f"{path}/{name}")]
        return (*base.folders, name)

    done = log.change(spark, path, changes)
    status = told[0].select("key", "status", F.octet_length("change.replacement").alias("delta_bytes"))
    if len(done.folders) > log.MOST_FOLDERS:
        compact(spark, path)
    return status


def compact(spark: SparkSession, path: str) -> None:
    """All values of the last version whole, in one folder; a version of its own with the same values."""
    log.merge(spark, path, lambda found: _values(log.read(spark, path, found)).withColumn("change", F.lit(None).cast(_CHANGE)).withColumn("status", F.lit("created")))
