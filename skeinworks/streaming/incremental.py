"""The same analysis on streams: of each function only changed facts are scored, and late or repeated ones change nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from skeinworks.operators import cache
from skeinworks.operators.reasoning import analyzed
from skeinworks.sources import log
from skeinworks.sources.shared import new_folder, remove, written

#: Keeps state on the executors' disks with its changes in the checkpoint, so that it may outgrow their memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def analyzed_stream(facts: DataFrame, name: str = "function_name", counters: dict[str, str] | None = None) -> DataFrame:
    """A stream of facts as a stream of reports; stateless, so appends pass at once."""
    return analyzed(facts, name, counters)


class _Newest(StatefulProcessor):
    """Of each key the version and the hash that were last let through."""

    def __init__(self, version: str, content: str):
        self.version, self.content = version, content

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "version long, hash string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        best, at = None, None
        for row in rows:
            place = (-(2**63) if row[self.version] is None else row[self.version], row[self.content] or "")
            if at is None or place > at:
                best, at = row, place
        known = tuple(self.state.get()) if self.state.exists() else None
        if known is None or at > known:
            self.state.update(at)
            if known is None or at[1] != known[1]:
                yield best

    def close(self) -> None:
        pass


def changed(facts: DataFrame, key: str, version: str, content: str) -> DataFrame:
    """The rows of a stream of ``facts`` that say something new of their ``key``.

    A row passes if its (``version``: a long, ``content``: a hash) is beyond the last one that came, in this order, and
    its hash is another; of a batch's rows of a key only the last one can. So late rows, repeated rows and replayed
    batches pass nothing, and whatever comes in whatever order, the last row to pass is what a batch job would take as
    the newest. A null version is before all others, a null hash counts as empty, null keys are one key. The state is
    a version and a hash for each key. Needs the session's state store to be ``STATE_STORE``.
    """
    schema = StructType(facts.schema.fields)
    return facts.groupBy(key).transformWithState(_Newest(version, content), schema, "Update", "None")


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``work`` on what has arrived; ``checkpoint`` is a folder that all executors share."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update").start()


def kept_reports(spark: SparkSession, facts: DataFrame, path: str, checkpoint: str, key: str = "stable_id", version: str = "version", content: str = "semantic_hash", counters: dict[str, str] | None = None) -> StreamingQuery:
    """Keeps the cache at ``path`` up to date with a stream of ``facts``: what changed is analysed and put, as one change for each batch.

    What passes is what ``changed`` passes, found by grouping a batch with the newest version and hash of each key, a
    log below ``checkpoint``: no key is a call of Python, and a row is moved once. The cache is published first, so a batch that is run again
    after a crash puts the same rows again.
    """

    def put(batch: DataFrame, _: int) -> None:
        folder = new_folder(spark, "batch")
        new = written(_newer(batch, log.read(spark, f"{checkpoint}/newest", log.manifest(spark, f"{checkpoint}/newest")), key, version, content), folder)
        cache.put(spark, analyzed(new.filter("_passes").select(*batch.columns), counters=counters, detail=False), path, key)
        name = log.write(new.select(F.col(key).alias("key"), _at(version, content).alias("_at")), f"{checkpoint}/newest")
        done = log.change(spark, f"{checkpoint}/newest", lambda last: (*last.folders, name))
        if len(done.folders) > log.MOST_FOLDERS:
            log.merge(spark, f"{checkpoint}/newest", lambda found: log.read(spark, f"{checkpoint}/newest", found).groupBy("key").agg(F.max("_at").alias("_at")))
        remove(spark, folder)

    return each_batch(facts, put, checkpoint)


def _at(version: str, content: str) -> Column:
    """A row's place among those of its key."""
    return F.struct(F.coalesce(F.col(version).cast("long"), F.lit(-(2**63))).alias("version"), F.coalesce(content, F.lit("")).alias("hash"))


def _newer(batch: DataFrame, known: DataFrame | None, key: str, version: str, content: str) -> DataFrame:
    """The last row of each key, where it is beyond the last one that came, with ``_passes`` where its hash is another.

    ``known``: (key, _at) that were let through. Rows and these are dealt by key once, together; rows of the same place are the
    same. A row is carried with its version and hash in front, by which the last one is taken, and not with these again.
    """
    others = [c for c in batch.columns if c not in (key, version, content)]
    row = F.struct(_at(version, content).alias("_at"), F.struct(F.col(version), F.col(content).isNull().alias("_none"), *others).alias("_rest"))
    kind = dict(batch.select(row.alias("r")).dtypes)["r"]
    every = batch.select(F.col(key).alias("_key"), row.alias("_row"), F.lit(None).cast("struct<version:bigint,hash:string>").alias("_was"))
    if known is not None:
        every = every.unionByName(known.select(F.col("key").alias("_key"), F.lit(None).cast(kind).alias("_row"), F.col("_at").alias("_was")))
    last = F.max_by("_row", "_row._at") if "map<" in kind else F.max("_row")  # maps have no order
    by = every.repartition("_key").groupBy("_key").agg(last.alias("_row"), F.max("_was").alias("_was")).filter("_row IS NOT NULL")
    own = {key: F.col("_key"), version: F.col(f"_row._rest.{version}"), content: F.when(~F.col("_row._rest._none"), F.col("_row._at.hash"))}
    passes = F.col("_was").isNull() | (F.col("_row._at.hash") != F.col("_was.hash"))
    return by.filter(F.col("_was").isNull() | (F.col("_row._at") > F.col("_was"))).select(*((own[c] if c in own else F.col(f"_row._rest.{c}")).alias(c) for c in batch.columns), passes.alias("_passes"))
