"""Data sources of caches and observations, and evidence providers as table functions."""

import hashlib
import json

import pytest
from pyspark.errors import PySparkException

from skeinworks.functions import providers
from skeinworks.operators import cache
from skeinworks.sources import connectors, log, study


def plan(frame, capsys):
    frame.explain("formatted")
    return capsys.readouterr().out


def test_a_cache_as_a_source(spark, tmp_path, capsys):
    connectors.register(spark)
    path = f"{tmp_path}/c"
    rows = lambda *x: spark.createDataFrame(list(x), "stable_id string, size long, `odd name` string")
    cache.put(spark, rows(("a", 1, "x"), ("b", 2, None), ("é", None, "y")).repartition(3), path, "stable_id")
    cache.put(spark, rows(("a", 7, "z")), path, "stable_id")
    every = spark.read.format("skein_cache").load(path)
    want = lambda version=None: sorted(map(str, log.read(spark, path, log.manifest(spark, path, version)).select(*every.columns).collect()))
    assert sorted(map(str, every.collect())) == want() and len(want()) == 4
    assert sorted(map(str, spark.read.format("skein_cache").option("version", 1).load(path).collect())) == want(1)
    some = every.filter("stable_id = 'a' AND size > 1").select("size", "_place")
    assert [tuple(r) for r in some.collect()] == [(7, 1)] and "stable_id" in plan(some, capsys).split("PushedFilters")[-1]
    assert every.filter("stable_id IN ('b', 'é') AND size IS NOT NULL").count() == 1 and every.filter("_place = 1").count() == 1 and every.filter("size IS NULL").count() == 1
    assert every.filter("size <= 2").count() == 2 and every.filter("size >= 2 AND `odd name` = 'z'").count() == 1
    with pytest.raises(PySparkException):
        spark.read.format("skein_cache").option("version", 9).load(path).count()


def test_observations_of_some_runs(spark, tmp_path, capsys):
    for i in range(150):
        name = f"run-{i}"
        (tmp_path / name).mkdir()
        row = dict.fromkeys(study.REQUIRED, "x") | {"generation_id": name, "terminal_state": "SUCCESS"}
        data = json.dumps({"row": row, "failures": [], "commands": []}).encode()
        (tmp_path / name / "observation.json").write_bytes(data)
        (tmp_path / name / "observation.sha256").write_text(f"sha256:{hashlib.sha256(data).hexdigest()}\n")
    (tmp_path / "empty").mkdir()
    (tmp_path / "run-7" / "observation.json").write_text("{")
    rows, rejected = study.read_observations(spark, str(tmp_path))
    assert rows.count() == 149 and [r.problem for r in rejected.collect()] == ["checksum mismatch"]
    some, none = study.read_observations(spark, str(tmp_path), ["run-3", "run-7", "absent", "../x"])
    assert [r.generation_id for r in some.collect()] == ["run-3"] and none.count() == 1
    one = spark.read.format("skein_observations").load(str(tmp_path)).filter("home = 'run-3'")
    assert one.rdd.getNumPartitions() == 1 and spark.read.format("skein_observations").load(str(tmp_path)).rdd.getNumPartitions() == 3
    assert "home" in plan(one, capsys).split("PushedFilters")[-1]


def test_providers_from_sql(spark):
    def collect(row):
        yield "dense", None if row.loops is None else row.loops // row.size
        yield "negative", -1

    providers.register(spark, "density", "user", collect)
    for kind in ("string", "int"):
        facts = spark.createDataFrame([(1, 6, 2), (2, 1, 2), (3, None, 1), (None, 3, 1)], "k int, loops int, size int").selectExpr(f"CAST(k AS {kind}) AS k", "loops", "size", "1 AS strength", "'x' AS kind")
        found = providers.evidence(facts, "density", "k")
        assert found.dtypes == [("k", kind), ("provider_id", "string"), ("kind", "string"), ("strength", "bigint")]
        assert sorted(map(tuple, found.collect()), key=str) == sorted([(1 if kind == "int" else "1", "user", "dense", 3), (None, "user", "dense", 3)], key=str)
    assert providers.evidence(facts.limit(0), "density", "k").count() == 0
    with pytest.raises(PySparkException):
        providers.evidence(facts, "density", "absent")
