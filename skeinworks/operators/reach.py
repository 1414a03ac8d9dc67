"""What roots reach over tables of nodes and edges, in the order and at the depth in which a walk would first come by.

A walk takes children in order, goes down before it goes on, and enters no node twice. A source of few edges is grouped
into a row and walked where it lies: one shuffle, however deep it is. Larger sources are never one group. There a walk
comes to a node by that path without repeated nodes which is the first of all in the order of its steps, so no walk is
needed to find it: every round extends the paths that were found or bettered in the round before, and keeps the first
path to each node. Shared nodes and cycles are as good as any: a path that comes back to a node is never before the one
that it extends. There are as many rounds as the longest of these paths has steps; a round shuffles what is reached by
root and node, so a node that most roots share is no hot key but in the join with its own edges, where Spark's adaptive
execution splits it.

Nodes that all reach each other, a region, are walked in full from the one that is entered first, and no walk can leave
them and come back. So what is found of a small region does not depend on the root but on that entry: it is worked out
once for each entry, and rounds know a region only by its first entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from skeinworks.sources.shared import new_folder, remove, written

_KEY = ["source", "root", "node"]
#: A source of more edges is not walked as one row.
MOST_EDGES = 1_000
#: How many reached nodes, and steps to them, make a batch.
_BATCH = 100_000
#: Nodes that edges connect are searched for regions if these edges are no more, and if so many rounds connect them.
MOST_REGION, _ROUNDS = 100, 6


def reached(edges: DataFrame, roots: DataFrame, most: int = MOST_EDGES, paths: bool = True) -> DataFrame:
    """One row for each root and each other node that it reaches: source, root, node, depth, and with ``paths`` path.

    ``edges``: source, parent, ordinal (a long), child, deeper. ``roots``: source, root. ``depth`` is the number of
    ``deeper`` edges on the way, and ``path`` the steps (ordinal, node), whose order is the order of the walk. Edges of
    one parent and ordinal are taken in the order of their children. Null nodes and sources lead nowhere, a null
    ordinal comes first, a null ``deeper`` is false; edges and roots that repeat count once, and a root that is reached
    again is not entered. Other columns are not read. Sources of at most ``most`` edges are walked as rows.
    """
    small, large = _dealt(edges, roots, most)
    every = [_walked(*small, paths)]
    if large:
        found = _found(*large, paths).select("source", "root", F.col("depth").alias("_depth"), F.col("path").alias("_path"), F.inline("nodes"))
        way = [F.concat("_path", "path").alias("path")] if paths else []
        every.append(found.filter("node <> root").select("source", "root", "node", (F.col("_depth") + F.col("depth")).alias("depth"), *way))
    return reduce(DataFrame.unionByName, every)


def walks(edges: DataFrame, roots: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """The nodes of ``reached`` in few rows: source, root, nodes (array of node, depth in the order of the walk), place.

    A row holds nodes that a root reaches by one entry: all of a small source, else a small region or one node. Of two
    rows of a root, that whose last node comes later in the walk has the greater ``place``.
    """
    small, large = _dealt(edges, roots, most)
    first = _walked(*small, True).groupBy("source", "root").agg(F.array_sort(F.collect_list(F.struct("path", "node", "depth"))).alias("nodes"))
    every = [first.select("source", "root", F.transform("nodes", lambda x: F.struct(x.node.alias("node"), x.depth.alias("depth"))).alias("nodes"), F.array(F.lit(0).cast("long")).alias("place"))]
    if large:
        found = _found(*large, False).withColumn("nodes", F.filter("nodes", lambda x: x.node != F.col("root"))).filter("size(nodes) > 0")
        shown = F.transform("nodes", lambda x: F.struct(x.node.alias("node"), (F.col("depth") + x.depth).alias("depth")))
        every.append(found.select("source", "root", shown.alias("nodes"), F.concat("path", F.element_at("nodes", -1).path).alias("place")))
    return reduce(DataFrame.unionByName, every)


def _dealt(edges: DataFrame, roots: DataFrame, most: int) -> tuple:
    """What ``_walked`` and ``_found`` are called with; the latter is None if no source has more than ``most`` edges."""
    spark = edges.sparkSession
    folder = new_folder(spark, "reach")
    steps = edges.select("source", F.col("parent").alias("node"), F.struct(F.coalesce(F.col("ordinal").cast("long"), F.lit(-(2**63))).alias("ordinal"), F.col("child").alias("node")).alias("_step"), F.coalesce("deeper", F.lit(False)).alias("_deeper"))
    steps = written(steps.filter("source IS NOT NULL AND node IS NOT NULL AND _step.node IS NOT NULL"), f"{folder}/steps")
    known = roots.select("source", "root").filter("root IS NOT NULL AND source IS NOT NULL")
    large = written(steps.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select("source"), f"{folder}/large")
    if large.isEmpty():
        return (steps, known), None
    of = lambda rows, how: rows.join(large, "source", how)
    return (of(steps, "left_anti"), of(known, "left_anti")), (of(steps, "left_semi"), of(known, "left_semi"), folder)


def _walked(steps: DataFrame, known: DataFrame, paths: bool) -> DataFrame:
    """The rows of ``reached``, each source in a row of its own."""
    either = steps.select("source", F.struct("_step", "node", (~F.col("_deeper")).alias("_level")).alias("e"), F.lit(None).cast(dict(known.dtypes)["root"]).alias("root")).unionByName(known, allowMissingColumns=True)
    grouped = either.groupBy("source").agg(F.array_sort(F.collect_list("e")).alias("e"), F.collect_set("root").alias("roots")).filter("size(roots) > 0")
    rows = grouped.select("source", "roots", *(F.transform("e", of).alias(name) for name, of in (("parent", lambda e: e.node), ("ordinal", lambda e: e._step.ordinal), ("child", lambda e: e._step.node), ("deeper", lambda e: ~e._level))))
    types = dict(rows.select("source", F.col("parent")[0].alias("node")).dtypes)
    step = f", path array<struct<ordinal:bigint,node:{types['node']}>>" if paths else ""
    schema = StructType.fromDDL(f"source {types['source']}, root {types['node']}, node {types['node']}, depth int{step}")
    shown = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shown, strict=True)], schema=shown)
        for batch in batches:
            for source, roots, *edges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                children: dict = {}
                for parent, *step in zip(*edges, strict=True):  # in the order of their ordinals and children, the deeper of two first
                    children.setdefault(parent, []).append(step)
                for root in roots:
                    met, ways = {root}, [(0, (), iter(children.get(root, ())))]
                    while ways:
                        depth, path, left = ways[-1]
                        for ordinal, child, deeper in left:
                            if child not in met:
                                met.add(child)
                                depth, path = depth + deeper, (*path, {"ordinal": ordinal, "node": child}) if paths else path
                                ways.append((depth, path, iter(children.get(child, ()))))
                                out.append((source, root, child, depth, path) if paths else (source, root, child, depth))
                                size += 1 + len(path)
                                break
                        else:
                            ways.pop()
                    if size >= _BATCH:
                        yield batch_of(out)
                        out, size = [], 0
        if out:
            yield batch_of(out)

    return rows.mapInArrow(walk, schema)


def _found(steps: DataFrame, known: DataFrame, folder: str, paths: bool) -> DataFrame:
    """What roots enter, in rounds: source, root, depth and path of an entry, and nodes (array of node, depth and path from there on).

    Paths are of steps (ordinal, node) or, without ``paths``, of the steps' numbers, which have the same order.
    """
    spark = steps.sparkSession
    named = steps.select("source", "node", F.col("_step.ordinal").alias("ordinal"), F.col("_step.node").alias("child"), "_deeper")
    order = ["source", "node", "ordinal", "child"]
    dealt = named.repartitionByRange(*order).groupBy(*order).agg(F.max("_deeper").cast("int").alias("_deeper")).sortWithinPartitions(*order)  # equal steps are dealt to one task
    at = F.struct("ordinal", F.col("child").alias("node")) if paths else F.monotonically_increasing_id()
    steps = written(dealt.select("source", "node", "child", "_deeper", at.alias("_at")), f"{folder}/ways")
    kind = dict(steps.dtypes)["_at"]
    regions = _regions(steps, folder)
    inside = regions.select("source", "node", "region", (F.size("exits") > 0).alias("_on"))
    exits = regions.select("source", "node", F.inline("exits"))
    leads = steps.select("source", "node").distinct().join(inside, ["source", "node"], "left").select("source", F.col("node").alias("child"), "region", F.coalesce("_on", F.lit(True)).alias("_on"))
    hops = steps.withColumn("_before", F.lit(None).cast(f"array<{kind}>")).unionByName(exits)
    hops = written(hops.join(leads, ["source", "child"], "left").withColumn("_on", F.coalesce("_on", F.lit(False))), f"{folder}/hops")
    remove(spark, f"{folder}/ways")
    none = F.array().cast(f"array<{kind}>")
    roots = known.distinct().withColumn("node", F.col("root")).join(inside, ["source", "node"], "left")
    key = ["source", "root", "region"]
    best = lambda when, name: F.min(F.when(when, F.struct("path", "depth", "node", "_on"))).alias(name)
    begun = roots.select("source", "root", F.coalesce("region", "node").alias("region"), none.alias("path"), F.lit(0).alias("depth"), "node", F.coalesce("_on", F.lit(True)).alias("_on"))
    last, found, number, again = written(begun, f"{folder}/begun"), [], 0, False
    found.append(last)
    while not (on := last.filter("_on")).isEmpty():
        hop = on.select("source", "root", "path", "depth", "node").join(hops, ["source", "node"])
        new = hop.select("source", "root", F.coalesce("region", "child").alias("region"), F.concat("path", F.coalesce("_before", none), F.array("_at")).alias("path"), (F.col("depth") + F.col("_deeper")).alias("depth"), F.col("child").alias("node"), "_on")
        both = reduce(DataFrame.unionByName, [x.withColumn("_new", F.lit(False)) for x in found], new.withColumn("_new", F.lit(True)))
        by = both.repartition(*key).groupBy(*key).agg(best(F.col("_new"), "_now"), best(~F.col("_new"), "_before"))
        better = by.filter(F.col("_now").isNotNull() & (F.col("_before").isNull() | (F.col("_now.path") < F.col("_before.path"))))
        told = written(better.select(*key, "_now.*", F.col("_before").isNotNull().alias("_again")), f"{folder}/{number}")
        again = again or not told.filter("_again").isEmpty()
        last = told.drop("_again")
        found, number = [*found, last], number + 1
        if len(found) == 8:  # paths that were bettered need no more reading
            found = [written(_first(found, key), f"{folder}/merged-{number}")]
            for old in range(number - 1):  # the last one's rows are still to be extended
                remove(spark, f"{folder}/{old}")
    every = _first(found, key) if again else reduce(DataFrame.unionByName, found)
    alone = F.array(F.struct("node", F.lit(0).alias("depth"), none.alias("path")))
    return every.join(regions.select("source", "node", "nodes"), ["source", "node"], "left").select("source", "root", "depth", "path", F.coalesce("nodes", alone).alias("nodes"))


def _first(found: list[DataFrame], key: list[str]) -> DataFrame:
    """Of rows of the same ``key`` that with the first path."""
    every = reduce(DataFrame.unionByName, found)
    return every.repartition(*key).groupBy(*key).agg(F.min(F.struct("path", "depth", "node", "_on")).alias("_best")).select(*key, "_best.*")


def _regions(steps: DataFrame, folder: str) -> DataFrame:
    """Small regions by entry: source, node (the entry), region (one of its nodes), nodes (array of node, depth, path in
    the order of the walk from there), exits (array of child, _deeper, _at, _before: first steps to nodes outside)."""
    core, before, work = steps, steps.count(), f"{folder}/search"
    for number in range(_ROUNDS):  # a node without edges to it is in no region
        core = written(core.join(core.select("source", F.col("child").alias("node")).distinct(), ["source", "node"], "left_semi"), f"{work}/core-{number}")
        left = core.count()
        if not left or left > 0.9 * before:
            break
        before = left
    ends = [core.select("source", F.col(a).alias("node"), F.col(b).alias("_by")) for a in ("node", "child") for b in ("node", "child")]
    near = written(reduce(DataFrame.unionByName, ends).distinct(), f"{work}/near")
    label = near.select("source", "node", F.col("node").alias("label")).distinct()
    for number in range(_ROUNDS):
        heard = near.join(label.select("source", F.col("node").alias("_by"), "label"), ["source", "_by"]).groupBy("source", "node").agg(F.min("label").alias("label"), F.max("label").alias("_other"))
        heard = written(heard, f"{work}/heard-{number}")
        label = heard.select("source", "node", "label")
        if heard.filter("label <> _other").isEmpty():
            break
    else:  # what is still connected with another label is no whole part of the graph
        ours, theirs = label, label.select("source", F.col("node").alias("_by"), F.col("label").alias("_other"))
        torn = near.join(ours, ["source", "node"]).join(theirs, ["source", "_by"]).filter("label <> _other")
        label = label.join(torn.select("source", "label").unionByName(torn.select("source", F.col("_other").alias("label"))).distinct(), ["source", "label"], "left_anti")
    parts = core.join(label, ["source", "node"])
    few = parts.groupBy("source", "label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= MOST_REGION).drop("_n")
    rows = parts.join(few, ["source", "label"], "left_semi").groupBy("source", "label").agg(F.array_sort(F.collect_list(F.struct("_at", "node", "child", "_deeper"))).alias("e")).select("source", "e")
    types = dict(steps.dtypes)
    node, at = types["node"], types["_at"]
    schema = StructType.fromDDL(f"source {types['source']}, node {node}, region {node}, nodes array<struct<node:{node},depth:int,path:array<{at}>>>, exits array<struct<child:{node},_deeper:int,_at:{at},_before:array<{at}>>>")
    shown = to_arrow_schema(schema)

    def all_from(node, children: dict) -> set:
        """All that ``node`` leads to, and itself."""
        met, left = {node}, [node]
        while left:
            for _, child, _ in children.get(left.pop(), ()):
                if child not in met:
                    met.add(child)
                    left.append(child)
        return met

    def walk(entry, region: set, children: dict) -> tuple[list[dict], list[dict]]:
        """The walk of ``region`` from ``entry``: its nodes, and the first step to each child outside."""
        nodes, exits, met, ways = [{"node": entry, "depth": 0, "path": []}], [], {entry}, [(0, [], iter(children[entry]))]
        while ways:
            depth, path, left = ways[-1]
            for at, child, deeper in left:
                if child not in met:
                    met.add(child)
                    if child in region:
                        nodes.append({"node": child, "depth": depth + deeper, "path": [*path, at]})
                        ways.append((depth + deeper, [*path, at], iter(children[child])))
                        break
                    exits.append({"child": child, "_deeper": depth + deeper, "_at": at, "_before": path})
            else:
                ways.pop()
        return nodes, exits

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for source, edges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                children: dict = {}
                for e in edges:
                    children.setdefault(e["node"], []).append((e["_at"], e["child"], e["_deeper"]))
                to = {node: all_from(node, children) for node in children}
                for node in children:
                    region = {x for x in to[node] if node in to.get(x, ())}
                    if len(region) > 1:
                        out.append((source, node, min(region), *walk(node, region, children)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shown, strict=True)], schema=shown)

    regions = written(rows.mapInArrow(entered, schema), f"{folder}/regions")
    remove(steps.sparkSession, work)
    return regions
