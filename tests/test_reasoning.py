"""Expected scores, pipelines and queries on small facts."""

import pytest
from pyspark.sql import functions as F

from skeinworks.functions import seeds
from skeinworks.operators import index, query, reasoning
from skeinworks.plans import catalogue

FACTS = "source string, function_name string, loop_count long, return_count long, assignment_count long, mutation_count long, addition_mutation_count long, increment_mutation_count long, accumulation_count long, numeric_return_count long, conditional_count long, call_count long, comparison_count long, maximum_update_count long"
ROWS = [
    ("a", "calculate", 1, 1, 1, 1, 1, 0, 1, 1, 0, 0, 0, 0),
    ("b", "count_items", 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0),
    ("c", "filter_map_reduce", 1, 1, 1, 0, 0, 0, 0, 1, 1, 2, 1, 1),
    ("d", None, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
]


@pytest.fixture(scope="module")
def reports(spark):
    return reasoning.analyzed(spark.createDataFrame(ROWS, FACTS)).cache()


def test_primary_intents(reports):
    found = {r.source: (r.primary_intent, r.confidence) for r in reports.collect()}
    assert found == {"a": ("accumulator", 85), "b": ("counter", 95), "c": ("mapper", 100), "d": (None, None)}


def test_ranking_of_an_accumulator(reports):
    ranked = reports.filter("source = 'a'").first().hypotheses
    assert [(h.id, h.confidence) for h in ranked[:3]] == [("accumulator", 85), ("sum", 40), ("mapper", 30)]
    assert len(ranked) == len(seeds.hypotheses()) and all(h.confidence == 0 and h.missing for h in ranked if h.status == "eliminated")


def test_scores_by_brute_force(reports):
    for row in reports.collect():
        power = {}
        for e in row.evidence:
            key = f"name:{e.token}" if e.kind == "name" else e.kind
            power[key] = power.get(key, 0) + max(1, min(3, e.strength))
        want = []
        for h in seeds.hypotheses().values():
            gone = any(r.kind not in power for r in h.require)
            raw = h.baseline + sum(r.weight * power.get(r.kind, 0) for r in h.support) - sum(r.weight * power.get(r.kind, 0) for r in h.reject)
            want.append((gone, 0 if gone else -max(0, min(100, raw)), h.id))
        assert [(h.status == "eliminated", -h.confidence, h.id) for h in row.hypotheses] == sorted(want)


def test_pipeline_and_then(reports):
    assert [(s.id, s.confidence) for s in reports.filter("source = 'c'").first().pipeline] == [("filter", 95), ("mapper", 100), ("reducer", 100)]
    assert [(r.source, r.score) for r in query.search(reports, query.then("filter", "reduce")).collect()] == [("c", 181)]


def test_rejecting_rule_counts_against(spark):
    registry = {"x": seeds.Hypothesis("x", support=(seeds.Rule("s", "loop", 50),), reject=(seeds.Rule("r", "return", 20),))}
    got = reasoning.analyzed(spark.createDataFrame(ROWS, FACTS), registry=registry).filter("source = 'a'").first().hypotheses[0]
    assert got.confidence == 40 and [r.id for r in got.contradicting] == ["r"] and [e.kind for e in got.supporting] == ["loop"]


def test_empty_table(spark):
    assert reasoning.analyzed(spark.createDataFrame([], FACTS)).count() == 0


def test_queries_are_columns(reports):
    T = query.term
    scores = lambda q: {r.source: r.score for r in query.search(reports, q).collect()}
    assert scores(T("accumulator")) == {"a": 160, "b": 60} and scores(T("Count")) == {"b": 60}
    assert scores(query.without(T("accumulator"))) == {"c": 1, "d": 1}
    assert scores(query.both(T("accumulator"), T("counter"))) == {"b": 220} and scores(query.either(T("counter"), T("mapper"))) == {"b": 160, "c": 240}
    assert query.canonical("recursive") == "recursion" and query.canonical("max by") == "max_by" and query.canonical("map") == "mapper"
    found = query.search(reports, query.then("filter", "map")).first()
    assert (found.score, [(f.order, f.kind, f.value) for f in found.matched_fields]) == (180, [(1, "pipeline_stage", "filter"), (1, "pipeline_stage", "mapper")])
    assert scores(query.then("map", "filter")) == {}


def test_another_provider_counts(reports, spark):
    registry = {"allocation_observer": seeds.Hypothesis("allocation_observer", support=(seeds.Rule("allocation", "allocation", 25),))}
    rows = spark.createDataFrame(ROWS[:1], FACTS)
    got = reasoning.analyzed(rows, registry=registry, more=[("extra", "allocation", F.lit(1))]).first()
    assert got.hypotheses[0].confidence == 35 and ("extra", "allocation", 1) in {(e.provider_id, e.kind, e.strength) for e in got.evidence}
    assert [e.provider_id for e in got.hypotheses[0].supporting] == ["extra"]


def test_a_filter_does_not_compute_scores_again(reports):
    plan = reports.select("source", "pipeline").filter(F.size("pipeline") > 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort") == 0 or plan.index("Filter") < plan.index("Generate")


def test_facts_of_orders_are_aggregated_without_sorting(spark, sf):
    from skeinworks.plans import catalogue

    assert "SortAggregate" not in catalogue.order_facts(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_searches_need_no_reports(spark, reports):
    """Facts are searched with the same result as their reports, nothing is ranked, and what sorting reads twice is only what matched."""
    rows = spark.createDataFrame(ROWS, FACTS)
    brief = query.searchable(rows)
    for asked in (query.term("accumulator"), query.term("count"), query.term("call"), query.without(query.term("accumulator")), query.both(query.term("counter"), query.term("loop")), query.then("filter", "reduce")):
        assert query.search(brief, asked).collect() == query.search(reports, asked).collect()
    found = query.search(brief, query.without(query.term("accumulator")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "hypotheses" not in brief.columns and [r.source for r in found.collect()] == ["c", "d"]
    assert "sort_array" not in brief.drop("_said")._jdf.queryExecution().optimizedPlan().toString().replace("sort_array(_tokens", "")


def test_postings_are_made_where_reports_lie(spark, sf, tmp_path):
    """No shuffle makes them, and a report that is added twice counts once, words that repeat as often as they do."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([("a", "sum_sum", 1), ("b", "max_by", 0)], "id string, function_name string, loop_count long")
    reports = reasoning.analyzed(rows)
    reports.write.parquet(f"{tmp_path}/reports")
    stored = spark.read.parquet(f"{tmp_path}/reports")
    assert "Exchange" not in plan(index._placed(index.postings(stored, "id")))
    facts = catalogue.order_facts(spark, sf)
    assert plan(facts).count("Exchange hashpartitioning") == 1
    for _ in range(2):
        index.add(spark, f"{tmp_path}/postings", stored, "id")
    found = index.search(index.opened(spark, f"{tmp_path}/postings", stored, "id", keys=("id",)), index.term("sum"), "id").collect()
    want = query.search(reports, query.term("sum"), "id").collect()
    assert [(r.id, r.score, r.matched_fields) for r in found] == [(r.id, r.score, r.matched_fields) for r in want] and found[0].score >= 2 * (40 + 20)
