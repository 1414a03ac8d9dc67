"""Commits that are repeated, interrupted or refused, and exports that were tampered with."""

import pytest

from skeinworks.sources import exports, log


def test_commits_and_repairs(spark, tmp_path):
    path, to = f"{tmp_path}/runs", f"{tmp_path}/export"
    rows = lambda *x: spark.createDataFrame(list(x), "key string, content string")
    held = lambda: {r.key: r.content for r in exports.canonical(spark, path).collect()}
    assert exports.canonical(spark, path) is None and exports.verify(spark, path, to).count() == 0
    assert exports.commit(spark, path, rows(("a", "1"), ("b", "2"), ("b", "2"))) == 2
    assert exports.commit(spark, path, rows(("a", "1"))) == 0 and log.manifest(spark, path).version == 1
    log.write(rows(("lost", "1")).selectExpr("*", "'' AS sha256"), path)  # interrupted
    for wrong in ([("a", "other")], [("c", "1"), ("c", "2")], [(None, "1")], [("d", None)], [("e", "1"), ("b", "x")]):
        with pytest.raises(exports.CommitError):
            exports.commit(spark, path, rows(*wrong))
    assert held() == {"a": "1", "b": "2"} and exports.commit(spark, path, rows(("b", "2"), ("c", ""), ("d", "4"))) == 2
    exports.export(spark, path, to)
    assert exports.verify(spark, path, to).count() == 0 and exports.repair(spark, path, to).count() == 0 and log.manifest(spark, to).version == 1
    told = exports.canonical(spark, path)
    bad = told.filter("key <> 'a'").selectExpr("key", "CASE key WHEN 'b' THEN 'x' ELSE content END AS content", "CASE key WHEN 'c' THEN NULL ELSE sha256 END AS sha256")
    names = log.write(bad, to), log.write(told.filter("key = 'd'").unionByName(rows(("z", "9")).selectExpr("*", "'s' AS sha256")), to)
    log.change(spark, to, lambda _: names)
    want = {"a": "missing", "b": "changed", "c": "digest", "d": "repeated", "z": "unknown"}
    assert {r.key: r.problem for r in exports.verify(spark, path, to).collect()} == want
    taken = exports.repair(spark, path, to).collect()
    assert {r.key: r.problem for r in taken} == want and sorted((r.key, r.content) for r in taken if r.content is not None) == [("b", "x"), ("c", ""), ("d", "4"), ("d", "4"), ("z", "9")]
    assert exports.verify(spark, path, to).count() == 0 and held() == {"a": "1", "b": "2", "c": "", "d": "4"}
    assert sorted((r.key, r.content) for r in log.read(spark, to, log.manifest(spark, to)).collect()) == [("a", "1"), ("b", "2"), ("c", ""), ("d", "4")]
