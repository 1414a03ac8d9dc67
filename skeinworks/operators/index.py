"""A search index of reports: lists of what each term finds, so that a query reads only its terms and scores nothing again.

A posting is (term, key, at, order, place): one item of a report that ``query.term`` would find, of which field it is, and
where among the stages it stands. Nothing is moved to make postings: a task sorts those of its own reports, and a term's
are added up by key when it is asked for. Postings lie in folders by a hash of the term, sorted by term, so a query opens one
folder for each of its terms and skips what Parquet's statistics rule out. Terms are then joined by key: ``both`` keeps keys of both,
``either`` all, ``without`` the keys that are not found, ``then`` compares places. The functions here mirror those of
``query``; each gives a function from an index to (key, score, fields).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.operators.query import LEAST_CONFIDENCE, MOST_SCORE, canonical
from skeinworks.sources import log

#: Folders that terms are dealt to.
BUCKETS = 16
# --- fixed values: fields in order, and what a match in each is worth ---
FIELDS = ["primary_intent", "pipeline_stage", "hypothesis", "evidence", "function_metadata"]
WORTH = [100, 80, 60, 40, 20]
_FIELD = "array<struct<order:int,kind:string,value:string>>"
#: Columns that a posting needs to be told from one of an earlier report of the same key.
_KEPT = ["key", "version"]
#: Postings by their columns, of which ``at`` tells those of a report and term apart.
_POSTING = ["term", *_KEPT, "at", "order", "place"]


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(reports: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """The postings of ``reports`` (of ``analyzed`` or ``query.searchable``), whose ``key`` is unique; ``version`` tells reports of a key apart."""
    one = lambda order, term, place=None: F.struct(F.lit(order).cast("tinyint").alias("order"), term.alias("term"), (F.lit(None) if place is None else place).cast("int").alias("place"))
    if "_said" in reports.columns:
        sure, told = F.col("_certain"), F.col("_said")
    else:
        sure = F.transform(F.filter("hypotheses", lambda h: (h.status == "active") & (h.confidence >= LEAST_CONFIDENCE)), lambda h: h.id)
        told = F.transform("evidence", lambda e: F.when(e.kind == "name", e.token).otherwise(F.replace(e.kind, F.lit("_"), F.lit(""))))
    words = F.filter(F.split(F.lower(F.coalesce("function_name", F.lit(""))), "[^a-z0-9]"), lambda w: w != "")
    said = F.concat(
        F.array(one(0, F.col("primary_intent"))), F.transform("pipeline", lambda s, i: one(1, s.id, i + 1)), F.transform(F.array_distinct(sure), lambda h: one(2, h)),
        F.transform(told, lambda e: one(3, e)), F.transform(words, lambda w: one(4, w)),
    )
    every = reports.select(F.col(key).alias("key"), (F.lit("") if version is None else F.col(version)).alias("version"), F.posexplode(said).alias("at", "s"))
    return every.select("key", "version", "at", "s.*").filter("term IS NOT NULL").select(*_POSTING)


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("bucket", "term")


def _shown(reports: DataFrame, key: str, version: str | None, keys: tuple[str, ...]) -> DataFrame:
    """What a search shows of a report."""
    return reports.select(F.col(key).alias("key"), (F.lit("") if version is None else F.col(version)).alias("version"), *keys, "function_name", "primary_intent", F.col("pipeline.id").alias("stages"))


def add(spark: SparkSession, path: str, reports: DataFrame, key: str, version: str | None = None) -> None:
    """Adds the postings of ``reports`` (best a stored table) to those at ``path``, all or none of them."""
    if reports.isEmpty():
        return
    name = log.write(_placed(postings(reports, key, version)), path, "bucket")
    done = log.change(spark, path, lambda last: (*last.folders, name))
    if len(done.folders) > log.MOST_FOLDERS:
        log.merge(spark, path, lambda found: _placed(_once(log.read(spark, path, found))), "bucket")


def _once(rows: DataFrame) -> DataFrame:
    """Reports of a key and version are the same, however often they were added."""
    return rows.select(*_POSTING).dropDuplicates(["term", *_KEPT, "at"])


@dataclass(frozen=True)
class Index:
    """Postings, and the ``rows`` (key, version, and what a search shows) to which they are held: other postings don't count."""

    stored: DataFrame | None
    rows: DataFrame

    def _items(self, name: str) -> DataFrame:
        """(key, order, place): the items that a term finds, dealt by key."""
        term = F.lit(canonical(name))
        if self.stored is None:
            return self.rows.sparkSession.createDataFrame([], f"key {dict(self.rows.dtypes)['key']}, order tinyint, place int")
        own = self.stored.filter((F.col("bucket") == _bucket(term)) & (F.col("term") == term)).select(*_KEPT, "at", "order", "place")
        return own.repartition(*_KEPT).dropDuplicates([*_KEPT, "at"]).join(self.rows.select(*_KEPT), _KEPT, "left_semi").select("key", "order", "place")

    def find(self, name: str) -> DataFrame:
        """(key, score, fields) of a term."""
        worth = F.element_at(F.array(*map(F.lit, WORTH)), F.col("order") + 1)
        by = self._items(name).groupBy("key").agg(F.sum(worth).cast("int").alias("score"), F.bit_or(F.expr("shiftleft(1, CAST(order AS INT))")).alias("_orders"))
        field = lambda i, kind: F.when(F.col("_orders").bitwiseAND(1 << i) != 0, F.struct(F.lit(i).alias("order"), F.lit(kind).alias("kind"), F.lit(canonical(name)).alias("value")))
        return by.select("key", "score", F.array_compact(F.array(*(field(i, kind) for i, kind in enumerate(FIELDS)))).cast(_FIELD).alias("fields"))

    def places(self, name: str) -> DataFrame:
        """(key, places): where among the stages a term stands."""
        return self._items(name).filter("place IS NOT NULL").groupBy("key").agg(F.array_sort(F.collect_list("place")).alias("places"))


Asked = Callable[[Index], DataFrame]


def opened(spark: SparkSession, path: str, reports: DataFrame, key: str, version: str | None = None, keys: tuple[str, ...] = ()) -> Index:
    """The index at ``path``, held to ``reports``, of which only the columns that a search shows are read."""
    return Index(log.read(spark, path, log.manifest(spark, path)), _shown(reports, key, version, keys))


def term(name: str) -> Asked:
    return lambda index: index.find(name)


def without(inner: Asked) -> Asked:
    return lambda index: index.rows.select("key").join(inner(index), "key", "left_anti").select("key", F.lit(1).alias("score"), F.array().cast(_FIELD).alias("fields"))


def _sides(index: Index, left: Asked, right: Asked, how: str) -> DataFrame:
    return left(index).join(right(index).select("key", F.col("score").alias("score2"), F.col("fields").alias("fields2")), "key", how)


def both(left: Asked, right: Asked) -> Asked:
    def found(index: Index) -> DataFrame:
        total, fields = F.least(F.col("score") + F.col("score2"), F.lit(MOST_SCORE)), F.array_sort(F.array_union("fields", "fields2"))
        return _sides(index, left, right, "inner").select("key", total.alias("score"), fields.alias("fields"))

    return found


def either(left: Asked, right: Asked) -> Asked:
    def found(index: Index) -> DataFrame:
        first = F.coalesce("score", F.lit(0)) >= F.coalesce("score2", F.lit(0))
        return _sides(index, left, right, "full").select("key", *(F.when(first, F.col(x)).otherwise(F.col(x + "2")).alias(x) for x in ("score", "fields")))

    return found


def then(first: str, second: str) -> Asked:
    def found(index: Index) -> DataFrame:
        a = index.places(first).select("key", F.array_min("places").alias("start"))
        b = index.places(second)
        gap = F.array_min(F.filter("places", lambda p: p > F.col("start"))) - F.col("start")
        stage = lambda name: F.struct(F.lit(1).alias("order"), F.lit(FIELDS[1]).alias("kind"), F.lit(canonical(name)).alias("value"))
        fields = F.array_sort(F.array_distinct(F.array(stage(first), stage(second)))).cast(_FIELD)
        return a.join(b, "key").withColumn("gap", gap).filter("gap IS NOT NULL").select("key", (F.col("gap") + 179).alias("score"), fields.alias("fields"))

    return found


def search(index: Index, asked: Asked, *keys: str) -> DataFrame:
    """What ``query.search`` gives: keys, function_name, primary_intent, stages, score, matched_fields. Best first."""
    met = asked(index).join(index.rows, "key")
    return met.select(*keys, "function_name", "primary_intent", "stages", "score", F.col("fields").alias("matched_fields")).orderBy(F.desc("score"), *keys, "function_name")
