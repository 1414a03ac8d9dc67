"""Ranked semantic queries over reports, put together from Column functions: term, both, either, without and then.

Each is a struct of score and matched fields; a score of 0 is no match. There is no text syntax: a query is an
expression of these functions, as any other condition on a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.operators.reasoning import findable, once
from skeinworks.sources.shared import new_folder, written

# --- fixed values: phrases that are one term, and other words for a term ---
PHRASES = {
    "maximum finder": "maximum", "minimum finder": "minimum", "max by": "max_by", "min by": "min_by", "binary search": "binary_search",
    "group by": "group_by", "count if": "count_if", "prefix sum": "prefix_sum",
}
ALIASES = {
    "reducers": "reducer", "reduce": "reducer", "map": "mapper", "maps": "mapper", "mapping": "mapper", "filters": "filter", "filtering": "filter",
    "recursive": "recursion", "normalization": "normalize", "normalizes": "normalize",
}
#: The least confidence of an active hypothesis that a term finds, and the most a score can be.
LEAST_CONFIDENCE, MOST_SCORE = 50, 65535
_FIELDS = "array<struct<order:int,kind:string,value:string>>"


def canonical(name: str) -> str:
    """The id that a term stands for."""
    known = name.strip().lower()
    known = PHRASES.get(known, known).strip(".,;:!?\"'")
    return ALIASES.get(known, known)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _found(score: Column, fields: Column | None = None) -> Column:
    return F.struct(score.cast("int").alias("score"), (F.array() if fields is None else fields).cast(_FIELDS).alias("fields"))


def _field(order: int, kind: str, value: Column) -> Column:
    return F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), value.alias("value"))


def term(name: str) -> Column:
    """100 for the primary intent, 80 for each stage, 60 for an active hypothesis, 40 for each item of evidence, 20 for each word of the name. Of rows in ``search``."""
    id_ = F.lit(canonical(name))
    times = lambda array: F.size(array) - F.size(F.array_remove(array, id_))
    sure = F.coalesce(F.array_contains("_certain", id_), F.lit(False))
    words = F.split(F.lower(F.coalesce("function_name", F.lit(""))), "[^a-z0-9]")
    counts = F.struct(F.col("primary_intent").eqNullSafe(id_).cast("int").alias("primary"), times(F.col("pipeline.id")).alias("stages"), sure.cast("int").alias("sure"), times(F.col("_said")).alias("items"), times(words).alias("words"))
    kinds = [("primary", 100, "primary_intent"), ("stages", 80, "pipeline_stage"), ("sure", 60, "hypothesis"), ("items", 40, "evidence"), ("words", 20, "function_metadata")]

    def scored(n: Column) -> Column:
        score = F.lit(0)
        for key, worth, _ in kinds:
            score = score + n[key] * worth
        return _found(score, F.array_compact(F.array(*(F.when(n[key] > 0, _field(i, kind, id_)) for i, (key, _, kind) in enumerate(kinds)))))

    return _let(counts, scored)


def without(inner: Column) -> Column:
    """Matches, with a score of 1, what ``inner`` does not."""
    return _found((inner.score == 0).cast("int"))


def both(left: Column, right: Column) -> Column:
    """The scores add up; all fields of both."""

    def met(x: Column) -> Column:
        all_ = (x.left.score > 0) & (x.right.score > 0)
        return _found(F.when(all_, F.least(x.left.score + x.right.score, F.lit(MOST_SCORE))).otherwise(0), F.when(all_, F.array_sort(F.array_union(x.left.fields, x.right.fields))).otherwise(F.array().cast(_FIELDS)))

    return _let(F.struct(left.alias("left"), right.alias("right")), met)


def either(left: Column, right: Column) -> Column:
    """The better of the two; the left one where they are equal."""
    return _let(F.struct(left.alias("left"), right.alias("right")), lambda x: F.when(x.left.score >= x.right.score, x.left).otherwise(x.right))


def then(first: str, second: str) -> Column:
    """Both are stages of the pipeline, in this order: 179 and their distance."""
    a, b, stages = canonical(first), canonical(second), F.col("pipeline.id")
    start = F.array_position(stages, a).cast("int")
    gap = F.array_position(F.slice(stages, start + 1, F.greatest(F.size(stages), F.lit(1))), b).cast("int")
    fields = F.array_sort(F.array_distinct(F.array(_field(1, "pipeline_stage", F.lit(a)), _field(1, "pipeline_stage", F.lit(b)))))
    return F.when(F.array_contains(stages, a), _let(gap, lambda g: F.when(g > 0, _found(g + 179, fields)).otherwise(_found(F.lit(0))))).otherwise(_found(F.lit(0)))


def searchable(facts: DataFrame, **of) -> DataFrame:
    """What ``search`` needs of reports, made of ``facts`` without the reports. ``of`` is as for ``analyzed``."""
    return findable(facts, LEAST_CONFIDENCE, **of)


def search(reports: DataFrame, query: Column, *keys: str) -> DataFrame:
    """Matching ``reports`` (of ``analyzed`` or ``searchable``): keys, function_name, primary_intent, stages, score, matched_fields. Best first.

    What matches is written before it is sorted: sorting reads its rows twice, and would score all reports twice.
    """
    if "_said" not in reports.columns:
        said = F.transform(F.col("evidence"), lambda e: F.when(e.kind == "name", e.token).otherwise(F.replace(e.kind, F.lit("_"), F.lit(""))))
        sure = F.filter("hypotheses", lambda h: (h.status == "active") & (h.confidence >= LEAST_CONFIDENCE))
        reports = once(reports, _said=said, _certain=F.transform(sure, lambda h: h.id))
    found = once(reports, _found=query).filter("_found.score > 0")
    keys = keys or ("source",)
    shown = found.select(*keys, "function_name", "primary_intent", F.col("pipeline.id").alias("stages"), F.col("_found.score").alias("score"), F.col("_found.fields").alias("matched_fields"))
    return written(shown, new_folder(shown.sparkSession, "found")).orderBy(F.desc("score"), *keys, "function_name")
