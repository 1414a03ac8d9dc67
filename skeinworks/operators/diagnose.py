"""Compiler diagnostics joined to inferred intents and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions import seeds


def rules(spark) -> DataFrame:
    return spark.createDataFrame(seeds.DIAGNOSTIC_RULES, "rule_id string, category string, hypothesis string, interpretation string, suggestions string")


def with_rule(rule_table: DataFrame, *rule: str) -> DataFrame:
    """``rule_table`` with one more rule (rule_id, category, hypothesis, interpretation, suggestions), which replaces one of its id."""
    more = rule_table.sparkSession.createDataFrame([rule], rule_table.schema)
    return rule_table.join(F.broadcast(more.select("rule_id")), "rule_id", "left_anti").select(*rule_table.columns).unionByName(more)


def read_diagnostics(spark, path: str) -> DataFrame:
    """Diagnostics of JSON files as ``diagnosed`` takes them, with severity, message and location; ``source`` is that of the location."""
    schema = "code string, severity string, category struct<kind:string,name:string>, message string, location struct<source:string,start:long,end:long>, function_name string"
    read = spark.read.schema(schema).option("multiLine", True).json(path)
    category = F.when(F.col("category.kind") == "other", F.concat(F.lit("other:"), F.col("category.name"))).otherwise(F.col("category.kind"))
    return read.select(F.monotonically_increasing_id().alias("diagnostic_id"), "code", "severity", category.alias("category"), "message", "location", F.col("location.source").alias("source"), "function_name")


def suggestions(spark) -> DataFrame:
    rows = [(s, i, *more) for i, (s, *more) in enumerate(seeds.SUGGESTIONS)]
    return spark.createDataFrame(rows, "suggestions string, ordinal int, title string, explanation string, rationale string")


def diagnosed(diagnostics: DataFrame, reports: DataFrame, rule_table: DataFrame | None = None) -> DataFrame:
    """``diagnostics`` (diagnostic_id, source, category, function_name or null) with the best matching intent and its fixes.

    Candidates are hypotheses of the source's functions that a rule names for the category; an eliminated one only
    where the rule is about an incomplete implementation. Active before eliminated, by confidence, function,
    hypothesis and rule. A diagnostic without a candidate stays, with nulls.
    """
    spark = diagnostics.sparkSession
    known = rule_table if rule_table is not None else rules(spark)
    named = known.agg(F.collect_set("hypothesis").alias("_named"))  # one row
    asked = reports.join(F.broadcast(named)).select("source", F.col("function_name").alias("_function"), F.explode(F.filter("hypotheses", lambda h: F.array_contains("_named", h.id))).alias("h"))
    found = asked.select("source", "_function", "h.id", "h.status", "h.status_rank", "h.confidence", "h.supporting")
    ruled = diagnostics.join(F.broadcast(known), "category")
    same = ruled.join(found, (ruled.source == found.source) & (ruled.hypothesis == found.id) & (ruled.function_name.isNull() | (ruled.function_name == found._function)))
    allowed = same.filter("status = 'active' OR interpretation = 'average_implementation_incomplete'")
    order = Window.partitionBy("diagnostic_id").orderBy("status_rank", F.desc("confidence"), "_function", "id", "rule_id")
    best = allowed.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select("diagnostic_id", F.col("_function").alias("matched_function"), F.col("id").alias("intent"), "confidence", "interpretation", "rule_id", "suggestions", F.expr("array_sort(supporting)").alias("evidence"))
    fixes = suggestions(spark).groupBy("suggestions").agg(F.array_sort(F.collect_list(F.struct("ordinal", "title", "explanation", "rationale"))).alias("fixes"))
    return diagnostics.join(best.join(F.broadcast(fixes), "suggestions", "left").drop("suggestions"), "diagnostic_id", "left")
