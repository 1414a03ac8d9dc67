"""Incremental analysis with state: late rows, repeated rows, replays and restarts against one batch job."""

import random

import pytest

from skeinworks.operators import cache, reasoning
from skeinworks.streaming import incremental


@pytest.fixture(scope="module")
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", incremental.STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_state_equals_batch(spark, tmp_path, state_store):
    rng = random.Random(6)
    names = ["count_if_average", "filter_map_reduce", "sum_normalize", "binary_search"]
    row = lambda: (f"s{rng.randrange(8)}", rng.choice([None, 1, 2, 3, 4]), rng.choice(names), rng.randrange(3), rng.randrange(3))
    schema = "stable_id string, version long, function_name string, loop_count long, return_count long"
    every, seen = [], []
    hashed = lambda rows: cache.with_semantic_hash(spark.createDataFrame(rows, schema), "stable_id", "version")
    stream = lambda: spark.readStream.schema(hashed([row()]).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/facts")
    for turn in range(4):
        new = [row() for _ in range(12)] + every[-5:]  # some again
        every += new
        hashed(new).coalesce(1).write.mode("append").parquet(f"{tmp_path}/facts")
        query = incremental.each_batch(incremental.changed(stream(), "stable_id", "version", "semantic_hash"), lambda b, _: seen.append(b.collect()), f"{tmp_path}/c1")  # restarted each turn
        query.awaitTermination(120)
        incremental.kept_reports(spark, stream(), f"{tmp_path}/cache", f"{tmp_path}/c2").awaitTermination(120)
        last = {}
        for r in sorted(hashed(every).collect(), key=lambda r: (-1 if r.version is None else r.version, r.semantic_hash)):
            last[r.stable_id] = r
        shown = {}
        for batch in seen:
            assert len({r.stable_id for r in batch}) == len(batch)
            for r in batch:
                assert r.stable_id not in shown or shown[r.stable_id].semantic_hash != r.semantic_hash
                shown[r.stable_id] = r
        assert {k: r.semantic_hash for k, r in shown.items()} == {k: r.semantic_hash for k, r in last.items()}, turn
        want = {r.stable_id: (r.primary_intent, r.confidence) for r in reasoning.analyzed(spark.createDataFrame(list(last.values())), detail=False).collect()}
        assert {r.stable_id: (r.primary_intent, r.confidence) for r in cache.load(spark, f"{tmp_path}/cache", "stable_id").collect()} == want
    n = len(seen)
    query = incremental.each_batch(incremental.changed(stream(), "stable_id", "version", "semantic_hash"), lambda b, _: seen.append(b.collect()), f"{tmp_path}/c1")
    query.awaitTermination(120)
    assert all(not b for b in seen[n:])  # nothing new
    replay = []
    incremental.each_batch(incremental.changed(stream(), "stable_id", "version", "semantic_hash"), lambda b, _: replay.append(b.collect()), f"{tmp_path}/c3").awaitTermination(120)  # from the start
    assert {r.stable_id: r.semantic_hash for b in replay for r in b} == {k: r.semantic_hash for k, r in last.items()}


def test_kept_reports_call_no_python_for_a_key(spark, tmp_path, monkeypatch):
    """A newer version of the same facts lets nothing pass, and moves the key on: what is older than it is late. Null keys are one key."""
    monkeypatch.setattr(incremental, "changed", None)
    schema = "stable_id string, version long, function_name string, loop_count long, return_count long"
    hashed = lambda rows: cache.with_semantic_hash(spark.createDataFrame(rows, schema), "stable_id", "version")
    a, b = ("count_if", 1, 1), ("find_first", 2, 1)
    turns = [[("x", 1, *a), (None, 1, *a), ("y", None, *a)], [("x", 3, *a), (None, 2, *b), (None, 1, *b)], [("x", 2, *b), ("y", 0, *b), ("x", 3, *a)]]
    turns += [[("z", i, *(a if i % 2 else b))] for i in range(8)]  # more than are merged
    for rows in turns:
        hashed(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/facts")
        stream = spark.readStream.schema(hashed(rows).schema).parquet(f"{tmp_path}/facts")
        incremental.kept_reports(spark, stream, f"{tmp_path}/cache", f"{tmp_path}/c").awaitTermination(120)
    got = {r.stable_id: (r.version, r.function_name) for r in cache.load(spark, f"{tmp_path}/cache", "stable_id").collect()}
    assert got == {"x": (1, "count_if"), None: (2, "find_first"), "y": (0, "find_first"), "z": (7, "count_if")}


def test_a_batch_is_moved_once(spark):
    """Rows and what is known of their keys are dealt by key together; a null key, hash or version is as good as any."""
    schema = "stable_id string, version long, semantic_hash string, extra map<string,int>"
    batch = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", {"k": 1}), (None, None, None, None), ("b", 3, "z", None), ("c", 1, "w", None)], schema)
    known = spark.createDataFrame([("b", (3, "z")), ("c", (0, "w")), ("d", (9, "d"))], "key string, _at struct<version:bigint,hash:string>")
    found = incremental._newer(batch, known, "stable_id", "version", "semantic_hash")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.stable_id: (r.version, r.semantic_hash, r.extra, r._passes) for r in found.collect()}
    assert got == {"a": (2, "y", {"k": 1}, True), None: (None, None, None, True), "c": (1, "w", None, False)}
    plain = incremental._newer(batch.drop("extra"), None, "stable_id", "version", "semantic_hash").collect()
    assert {r.stable_id for r in plain if r._passes} == {"a", "b", "c", None}
