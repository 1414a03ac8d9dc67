"""Semantic queries over a repository: scan, reuse what is cached, analyse the rest, search."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.operators import cache, index
from skeinworks.operators.query import search
from skeinworks.operators.reasoning import analyzed, facts, spread
from skeinworks.sources import log
from skeinworks.sources.scan import contents, skipped, visits
from skeinworks.sources.shared import new_folder, written

_REPORT = ["stable_id", "source", "ordinal", "function_name", "source_hash", "semantic_hash", "evidence", "hypotheses", "primary_intent", "confidence", "pipeline", *cache.VERSIONS]


class Found(NamedTuple):
    """``matches``, best first; ``counters``, one row; ``skipped``: source and reason; ``reports`` of all functions, with their tier."""

    matches: DataFrame
    counters: DataFrame
    skipped: DataFrame
    reports: DataFrame


def run(spark: SparkSession, root: str, asked: Column, cache_path: str | None = None) -> Found:
    """The functions under ``root`` that ``asked`` finds.

    Sources whose text is cached are not lowered again (tier 1), and functions whose facts are cached are not scored
    again (tier 2). What was scored is added to the cache at ``cache_path``, and its postings to the index there, which
    ``find`` answers from. Files are read for their hashes, and those that changed once more to be lowered; visits and
    reports are written before they are used, so neither is made twice.
    """
    files = contents(spark, root).withColumn("source_hash", F.sha2(F.col("content").cast("binary"), 256))
    scratch = new_folder(spark, "repository")
    hashes = written(files.select("source", "source_hash"), f"{scratch}/hashes")
    known, lost = (None, None) if cache_path is None else _known(spark, cache_path)
    reports, fresh = None, files
    if known is not None:
        one = known.groupBy("source").agg(F.min("source_hash").alias("source_hash"), F.max("source_hash").alias("_high")).filter("source_hash = _high").drop("_high")
        same = one.join(hashes, ["source", "source_hash"])
        reports = known.join(same, ["source", "source_hash"]).select(*_REPORT).withColumn("tier", F.lit(1))
        fresh = files.join(same.select("source"), "source", "left_anti")
    seen = written(visits(fresh), f"{scratch}/visits")
    counted = cache.with_semantic_hash(facts(seen.filter("kind NOT IN ('error', 'empty')")), "source", "ordinal")
    now = counted.withColumn("stable_id", cache.stable_id()).join(hashes, "source").withColumns({k: F.lit(v) for k, v in cache.VERSIONS.items()})
    if known is not None:
        alike = now.select("stable_id", "semantic_hash", F.col("source_hash").alias("_now")).join(known, ["stable_id", "semantic_hash"])
        reports = reports.unionByName(alike.withColumn("source_hash", F.col("_now")).select(*_REPORT).withColumn("tier", F.lit(2)))
        now = now.join(known.select("stable_id", "semantic_hash"), ["stable_id", "semantic_hash"], "left_anti")
    scored = analyzed(spread(now, "stable_id")).select(*_REPORT)
    scored = written(scored, f"{scratch}/reports") if cache_path is None else cache.put(spark, scored, cache_path, "stable_id")
    reports = scored.withColumn("tier", F.lit(0)) if reports is None else reports.unionByName(scored.withColumn("tier", F.lit(0)))
    if cache_path is not None:
        index.add(spark, f"{cache_path}/postings", scored, "stable_id", "semantic_hash")
        shown = log.write(reports.select("stable_id", "semantic_hash", "source", "ordinal", "function_name", "primary_intent", "pipeline"), f"{cache_path}/functions")
        log.change(spark, f"{cache_path}/functions", lambda last: (shown,))
    left = skipped(spark, root).unionByName(seen.filter("kind = 'error'").select("source", F.col("error").alias("reason")))
    counters = reports.agg(F.count_distinct("source").alias("sources"), F.count(F.lit(1)).alias("functions"), *(F.count_if(F.col("tier") == t).alias(n) for t, n in ((1, "reused_sources"), (2, "reused_facts"), (0, "analyzed"))))
    return Found(search(reports, asked, "source", "ordinal"), counters, left if lost is None else left.unionByName(lost), reports)


def find(spark: SparkSession, cache_path: str, asked: index.Asked) -> DataFrame:
    """What ``asked``, of functions of ``index``, finds among the functions of the last ``run``: from the postings, with no source read and nothing scored."""
    functions = log.read(spark, f"{cache_path}/functions", log.manifest(spark, f"{cache_path}/functions"))
    if functions is None:
        raise ValueError(f"{cache_path} holds no run")
    return index.search(index.opened(spark, f"{cache_path}/postings", functions, "stable_id", "semantic_hash", ("source", "ordinal")), asked, "source", "ordinal")


def _known(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Cached reports of these versions, and the cache's files that can't be read."""
    rows, lost = cache.load_recovering(spark, path, "stable_id")
    return (None, None) if rows is None else (rows.filter(cache.compatible()), lost)
