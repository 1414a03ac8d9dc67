"""The log of a table's folders, and values with their versions: two writers, a crash, merging, and any version again."""

import random
import threading

import pytest

from skeinworks.operators import cache, history
from skeinworks.sources import log


def rows(spark, *x):
    return spark.createDataFrame(list(x), "stable_id string, semantic_hash string")


def state(spark, path, version=None):
    return {r.stable_id: r.semantic_hash for r in cache.load(spark, path, "stable_id", version).collect()}


def test_of_two_writers_one_builds_on_the_other(spark, tmp_path):
    path = f"{tmp_path}/t"
    cache.store(spark, rows(spark, ("a", "1")), path, "stable_id")
    base = log.manifest(spark, path)
    mine, theirs = log.write(rows(spark, ("b", "2")), path), log.write(rows(spark, ("c", "3")), path)
    assert log.published(spark, path, log.Manifest(base.version + 1, (*base.folders, theirs)))
    assert not log.published(spark, path, log.Manifest(base.version + 1, (*base.folders, mine)))
    assert state(spark, path) == {"a": "1", "c": "3"}
    log.change(spark, path, lambda last: (*last.folders, mine))
    assert state(spark, path) == {"a": "1", "b": "2", "c": "3"} and state(spark, path, 1) == {"a": "1"}
    failed = []

    def write(k):
        try:
            cache.store(spark, rows(spark, (f"k{k}", str(k)), ("last", "same")), path, "stable_id")
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and state(spark, path) == {"a": "1", "b": "2", "c": "3", "last": "same"} | {f"k{k}": str(k) for k in range(4)}


def test_a_crash_leaves_the_table_as_it_was(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert log.manifest(spark, path) == log.Manifest() and cache.load(spark, path, "stable_id") is None
    log.write(rows(spark, ("lost", "1")), path)  # before its manifest
    assert cache.load(spark, path, "stable_id") is None
    cache.store(spark, rows(spark, ("a", "1")), path, "stable_id")
    (tmp_path / "t" / "_log" / ".half").write_text('{"fol')
    log.write(rows(spark, ("a", "9")), path)
    assert state(spark, path) == {"a": "1"}
    assert log.vacuum(spark, path) == 2 and state(spark, path) == {"a": "1"}


def test_merging_and_vacuum(spark, tmp_path):
    path, want = f"{tmp_path}/t", {}
    for k in range(log.MOST_FOLDERS + 3):
        new = {f"k{k}": "x", f"k{k % 3}": str(k)}
        want |= new
        cache.store(spark, rows(spark, *new.items()), path, "stable_id")
    found = log.manifest(spark, path)
    assert len(found.folders) <= log.MOST_FOLDERS and state(spark, path) == want
    assert state(spark, path, 2) == {"k0": "0", "k1": "1"}
    base = log.manifest(spark, path)
    name = log.write(rows(spark, ("meanwhile", "1")), path)
    log.merge(spark, path, lambda m: (log.change(spark, path, lambda last: (*last.folders, name)), cache.load(spark, path, "stable_id", m.version))[1])
    assert state(spark, path) == want | {"meanwhile": "1"} and len(log.manifest(spark, path).folders) == 2 and base.version + 2 == log.manifest(spark, path).version
    log.vacuum(spark, path)
    assert state(spark, path) == want | {"meanwhile": "1"} and len(list((tmp_path / "t" / "data").iterdir())) == 2
    with pytest.raises(ValueError):
        log.manifest(spark, path, 2)


def test_any_version_of_values(spark, tmp_path):
    rng, path = random.Random(2), f"{tmp_path}/h"
    assert history.restored(spark, path) is None
    now, at = {}, {}
    for k in range(log.MOST_FOLDERS + 4):
        new = {f"k{rng.randrange(30)}": bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(9))) for _ in range(12)}
        given = [(i, v or None, "x") for i, v in new.items()] + [(None, b"z", "x"), *([(next(iter(new)), b"", "x")] if k % 2 else [])]
        told = {r.key: (r.status, r.delta_bytes) for r in history.commit(spark, path, spark.createDataFrame(given, "key string, value binary, status string")).collect()}
        assert {i: s for i, (s, _) in told.items()} == {i: "created" if i not in now else "unchanged" if now[i] == v else "updated" for i, v in new.items()}
        assert all((d is not None) == (s == "updated") for s, d in told.values())
        now = now | new
        at[log.manifest(spark, path).version] = dict(now)
    values = lambda version=None: {r.key: bytes(r.value) for r in history.restored(spark, path, version).collect()}
    assert values() == now and len(log.manifest(spark, path).folders) <= log.MOST_FOLDERS
    for version in rng.sample(sorted(at), 5):
        assert values(version) == at[version]
    history.compact(spark, path)
    assert values() == now and len(log.manifest(spark, path).folders) == 1
