"""From source texts to intents: frontends, scans, repository queries, explanations and reuse, on programs of our own."""

import json

import pytest
from pyspark.sql import functions as F

from skeinworks.operators import cache, diagnose, explain, graph, index, query, reasoning, repository
from skeinworks.sources import log, scan
from skeinworks.sources.lowering import lowered
from skeinworks.streaming import incremental

#: Python programs, with the intent and the least confidence that are expected of each.
CORPUS = [
    ("accumulate", "def gather(rows: list) -> int:\n    acc = 0\n    for r in rows:\n        acc += r\n    return acc\n", "accumulator", 85),
    ("counter", "def count_rows(rows: list) -> int:\n    k = 0\n    for r in rows:\n        k += 1\n    return k\n", "counter", 95),
    ("filter", "def filter_rows(rows: list):\n    kept = 0\n    for r in rows:\n        if r > 3:\n            kept = r\n    return kept\n", "filter", 95),
    ("mapper", "def map_rows(rows: list):\n    for r in rows:\n        change(r)\n    return rows\n", "mapper", 95),
    ("maximum", "def greatest(rows: list) -> int:\n    best = 0\n    for r in rows:\n        if r > best:\n            best = r\n    return best\n", "maximum", 100),
    ("minimum", "def least(rows: list) -> int:\n    best = 9\n    for r in rows:\n        if r < best:\n            best = r\n    return best\n", "minimum", 100),
    ("average", "def average(rows: list) -> float:\n    total = 0\n    n = 0\n    for r in rows:\n        total += r\n        n += 1\n    return total / n\n", "average", 100),
    ("count_if", "def count_if(rows: list) -> int:\n    k = 0\n    for r in rows:\n        if r == 1:\n            k += 1\n    return k\n", "count_if", 100),
    ("product", "def product(rows: list) -> int:\n    out = 1\n    for r in rows:\n        out *= r\n    return out\n", "product", 100),
    ("reverse", "def reverse(rows: list):\n    for r in rows:\n        show(r)\n    return rows\n", "reverse_traversal", 95),
    ("frequency", "def frequency(rows: list):\n    seen = 0\n    for r in rows:\n        seen -= r\n    return seen\n", "frequency_counter", 95),
    ("validate", "def validate(a: int) -> bool:\n    if a > 3:\n        return True\n    return False\n", "validator", 85),
    ("linear", "def linear_search(rows: list, x: int) -> int:\n    i = 0\n    for r in rows:\n        if r == x:\n            return i\n        i += 1\n    return 0\n", "linear_search", 100),
    ("sum", "def sum_rows(rows: list) -> int:\n    s = 0\n    for r in rows:\n        s += r\n    return s\n", "sum", 100),
    ("prefix", "def prefix_sum(rows: list):\n    s = 0\n    for r in rows:\n        s += r\n    return rows\n", "prefix_sum", 100),
]
BROKEN = [("half", "def half(:\n"), ("huge", "x = 99999999999999999999\n"), ("deep", "x = " + "-" * 5000 + "1\n"), ("none", "x = 1\n")]


def visits(spark, rows, language):
    return lowered(spark.createDataFrame(rows, "source string, content string"), language)


@pytest.fixture(scope="module")
def reports(spark):
    found = reasoning.facts(visits(spark, [(n, t) for n, t, *_ in CORPUS] + BROKEN, "python").filter("kind NOT IN ('error', 'empty')"))
    return reasoning.analyzed(found).cache()


def test_python_corpus(reports):
    got = {r.source: (r.primary_intent, r.confidence) for r in reports.collect()}
    assert set(got) == {n for n, *_ in CORPUS}
    for name, _, intent, least in CORPUS:
        assert got[name][0] == intent and got[name][1] >= least, (name, got[name])


def test_rejected_sources(spark):
    got = {r.source: (r.kind, r.error) for r in visits(spark, BROKEN, "python").collect()}
    assert got["half"] == ("error", "invalid Python source") and got["none"] == ("empty", None)
    assert got["huge"][0] == "error" and got["deep"][0] == "error"


def test_python_statements(spark):
    text = (
        "def f(a: int, b: bool, *, c=1) -> None:\n    x = y = 1\n    x = 2\n    x += 1\n    x **= 2\n    a.b = 3\n    a[0] = 3\n    with a: x = 5\n    for i, j in b: x = 6\n    while a < 3 < b:\n        for k in b:\n            return f(a)\n"
        "    class C:\n        def m(self): return 1\n    def inner():\n        return 1\n    if a in b:\n        x = 1\n    elif a > 1 and b:\n        x = a\n    return x // 2\n"
    )
    found = {r.function_name: r for r in reasoning.facts(visits(spark, [("s", text)], "python")).collect()}
    assert set(found) == {"f", "inner"} and [found["inner"].ordinal, found["f"].ordinal] == [0, 1]
    f = found["f"]
    assert (f.variable_count, f.assignment_count, f.mutation_count, f.increment_mutation_count) == (1, 4, 1, 1)
    assert (f.loop_count, f.nested_loop_count, f.collection_iteration_count, f.loop_return_count, f.return_count, f.return_division_count) == (2, 1, 1, 1, 2, 1)
    assert (f.conditional_count, f.conditional_branch_count, f.call_count, f.recursion_count, f.comparison_count, f.division_count, f.maximum_update_count) == (2, 3, 1, 1, 2, 1, 0)
    assert [(t.role, t.category) for t in f.types] == [("local", "numeric"), ("parameter", "boolean"), ("parameter", "numeric"), ("return", "unknown")]


NAME = lambda n: {"kind": "identifier", "name": n}
NUMBER = {"kind": "literal", "value": "1", "literal_kind": "number"}
JAVA = {"methods": [{
    "name": "countItems", "parameters": [{"name": "xs", "type": "int[]"}, {"name": "p", "type": "Printer"}], "return_type": "boolean",
    "body": [
        {"kind": "for", "init": [{"kind": "variable", "name": "i", "type": "int", "initializer": NUMBER}], "condition": {"kind": "binary", "op": "less_equal", "left": NAME("i"), "right": NAME("n")},
         "body": [{"kind": "unary", "op": "unknown", "operand": NAME("i")}, {"kind": "block", "body": []}], "update": [{"kind": "mutation", "op": "add", "target": NAME("i"), "value": NUMBER}]},
        {"kind": "foreach", "variable": "x", "iterable": NAME("xs"), "body": [{"kind": "call", "callee": NAME("countItems"), "arguments": [NAME("x")]}]},
        {"kind": "if", "condition": {"kind": "binary", "op": "greater_than", "left": NAME("a"), "right": NAME("b")}, "then": [{"kind": "assignment", "target": NAME("b"), "value": NAME("a")}], "else": []},
        {"kind": "return", "value": {"kind": "unsupported"}},
    ],
}]}
REF = lambda n: {"kind": "ImplicitCastExpr", "inner": [{"kind": "DeclRefExpr", "referencedDecl": {"name": n}}]}
CLANG = {"kind": "TranslationUnitDecl", "inner": [{"kind": "TypedefDecl"}, {
    "kind": "FunctionDecl", "name": "sum_all", "type": {"qualType": "_Bool (int *)"}, "inner": [
        {"kind": "ParmVarDecl", "name": "xs", "type": {"qualType": "int *"}},
        {"kind": "CompoundStmt", "inner": [
            {"kind": "DeclStmt", "inner": [{"kind": "VarDecl", "name": "s", "type": {"qualType": "int"}, "inner": [{"kind": "IntegerLiteral", "value": "0"}]}]},
            {"kind": "ForStmt", "inner": [{"kind": "DeclStmt", "inner": []}, {"kind": "BinaryOperator", "opcode": "<", "inner": [REF("i"), REF("n")]}, {"kind": "CompoundStmt", "inner": [
                {"kind": "CompoundAssignOperator", "opcode": "+=", "inner": [REF("s"), {"kind": "IntegerLiteral", "value": "1"}]}, {"kind": "CallExpr", "inner": [REF("f")]}]}]},
            {"kind": "DoStmt", "inner": [{"kind": "CompoundStmt", "inner": [{"kind": "BinaryOperator", "opcode": "=", "inner": [REF("s"), REF("t")]}]}]},
            {"kind": "IfStmt", "inner": [{"kind": "BinaryOperator", "opcode": ">=", "inner": [REF("a"), REF("s")]}, {"kind": "BinaryOperator", "opcode": "=", "inner": [REF("s"), REF("a")]}]},
            {"kind": "ReturnStmt", "inner": [{"kind": "BinaryOperator", "opcode": "/", "inner": [REF("s"), REF("n")]}]},
        ]},
    ],
}]}
SPAN = {"start": 0, "end": 1}
INT = {"kind": "integer"}
TRANSPORT = {"format": "demo.semantic-export", "version": 1, "program": {"modules": [{"name": "m", "statements": [], "functions": [{
    "name": "calculate", "parameters": [{"name": "rows", "type": {"kind": "collection", "element": INT}, "span": SPAN}], "return_type": INT, "span": SPAN,
    "body": [
        {"kind": "variable", "name": "total", "mutable": True, "type": INT, "initializer": {"kind": "literal", "value": {"kind": "integer", "value": 0}, "span": SPAN}, "span": SPAN},
        {"kind": "loop", "loop_kind": {"kind": "while", "condition": NAME("more")}, "span": SPAN, "body": [
            {"kind": "mutation", "target": NAME("total"), "operation": "add", "value": NAME("row"), "span": SPAN}]},
        {"kind": "return", "value": NAME("total"), "span": SPAN},
    ],
}]}]}}


def test_java_and_c(spark):
    j = reasoning.facts(visits(spark, [("j", json.dumps(JAVA))], "java")).first()
    assert (j.function_name, j.loop_count, j.collection_iteration_count, j.increment_mutation_count, j.variable_count, j.call_count, j.recursion_count) == ("countItems", 2, 1, 1, 1, 1, 1)
    assert (j.conditional_count, j.conditional_branch_count, j.maximum_update_count, j.return_count, j.boolean_return_count, j.comparison_count, j.assignment_count) == (1, 1, 1, 1, 1, 2, 2)
    assert [(t.role, t.category) for t in j.types] == [("local", "numeric"), ("parameter", "numeric"), ("return", "boolean")]
    c = reasoning.facts(visits(spark, [("c", json.dumps(CLANG))], "c")).first()
    assert (c.function_name, c.loop_count, c.call_count, c.increment_mutation_count, c.assignment_count, c.variable_count, c.comparison_count) == ("sum_all", 1, 0, 1, 3, 1, 1)
    assert (c.maximum_update_count, c.return_division_count, c.numeric_return_count, c.boolean_return_count, c.accumulation_count) == (1, 1, 1, 0, 1)
    bad = visits(spark, [("x", "{"), ("y", '{"methods": [{"name": 1}]}')], "java").collect()
    assert {r.error for r in bad} == {"invalid Java JSON"}


def test_transport_versions(spark):
    rows = [("ok", json.dumps(TRANSPORT)), ("v", json.dumps(TRANSPORT | {"version": 99})), ("p", json.dumps(TRANSPORT | {"program": {}})), ("n", "{not json")]
    seen = visits(spark, rows, "transport")
    assert {r.source: r.error for r in seen.filter("kind = 'error'").collect()} == {"v": "unsupported export version: 99", "p": "invalid export JSON", "n": "invalid export JSON"}
    top = reasoning.analyzed(reasoning.facts(seen.filter("kind <> 'error'"))).first()
    assert (top.primary_intent, top.confidence) == ("accumulator", 85)
    assert {r.source: (r.functions, r.nodes) for r in graph.summary(seen.filter("source = 'ok'")).collect()} == {"ok": (1, 10)}


def test_graph_integrity(spark):
    nodes = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 1), ("c", 2)], "source string, node_id long")
    edges = spark.createDataFrame([("a", 1, 0, 9), ("b", 1, 0, 2), ("b", 1, 1, 3), ("c", 1, 0, 2)], "source string, parent long, ordinal int, child long")
    assert {(r.source, r.violation, r.parent, r.child) for r in graph.first_violation(nodes, edges).collect()} == {("a", "duplicate", 1, None), ("b", "dangling", 1, 2)}
    spans = spark.createDataFrame([(3, 9), (9, 3)], "start long, end long").select(graph.span_length("start", "end").alias("n"))
    assert [r.n for r in spans.collect()] == [6, 0]


def test_adapters(spark):
    paths = spark.createDataFrame([("/a/x.PY",), ("/a/x.go",), ("/a/x.zzz",), ("/a/Makefile",), ("/a/x.c",)], "source string")
    got = {r.source: (r.language, r.error) for r in scan.with_adapter(paths, spark).collect()}
    assert got["/a/x.PY"] == ("python", None) and got["/a/x.go"][1].startswith("Go frontend is unavailable")
    assert got["/a/x.zzz"] == (None, "UnsupportedExtension") and got["/a/Makefile"] == (None, "MissingExtension")
    more = scan.with_extensions(scan.adapters(spark), (".ZZZ", "zed", True))
    assert scan.with_adapter(paths, spark, more).filter("language = 'zed'").count() == 1
    for wrong, error in ((("py", "x", True), "DuplicateExtension"), (("", "x", True), "NoExtensions")):
        with pytest.raises(ValueError, match=error):
            scan.with_extensions(scan.adapters(spark), wrong)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("x") / "target" / "repo"  # a skipped name above the root counts for nothing
    for name, text in {
        "a/one.py": CORPUS[0][1], "a/two.PY": CORPUS[4][1], "b/j.json": json.dumps(JAVA), "b/c.json": json.dumps(CLANG), "b/t.json": json.dumps(TRANSPORT), "b/other.json": "{}", "b/bad.py": "def (", "node_modules/x.py": CORPUS[1][1],
        "b/.git/y.py": CORPUS[1][1], "s/x.java": "class X {}", "s/x.c": "int x;", "s/x.ving": "x", "s/x.go": "x", "s/notes": "x",
    }.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    return top


def test_repository_query(spark, root, tmp_path):
    asked = query.either(query.term("accumulator"), query.term("maximum"))
    first = repository.run(spark, str(root), asked, f"{tmp_path}/cache")
    short = lambda rows: {r.source.rsplit("/", 1)[1]: r.reason for r in rows.collect()}
    left = short(first.skipped)
    assert set(left) == {"bad.py", "x.java", "x.c", "x.ving", "x.go"} and left["bad.py"] == "invalid Python source" and "compiler" in left["x.java"]
    assert first.counters.first().asDict() == {"sources": 5, "functions": 5, "reused_sources": 0, "reused_facts": 0, "analyzed": 5}
    found = [(r.source.rsplit("/", 1)[1], r.function_name, r.score) for r in first.matches.collect()]
    assert {x[1] for x in found} >= {"gather", "greatest", "calculate"} and [x[2] for x in found] == sorted((x[2] for x in found), reverse=True)
    again = repository.run(spark, str(root), asked, f"{tmp_path}/cache")
    assert again.counters.first().asDict() == {"sources": 5, "functions": 5, "reused_sources": 5, "reused_facts": 0, "analyzed": 0}
    assert [(r.source.rsplit("/", 1)[1], r.function_name, r.score) for r in again.matches.collect()] == found
    warm = lambda: [(r.source.rsplit("/", 1)[1], r.function_name, r.score, r.matched_fields) for r in repository.find(spark, f"{tmp_path}/cache", index.either(index.term("accumulator"), index.term("maximum"))).collect()]
    assert warm() == [(r.source.rsplit("/", 1)[1], r.function_name, r.score, r.matched_fields) for r in again.matches.collect()]
    (root / "a/one.py").write_text("# a comment\n" + CORPUS[0][1])
    (root / "a/two.PY").write_text(CORPUS[5][1])
    third = repository.run(spark, str(root), asked, f"{tmp_path}/cache")
    assert third.counters.first().asDict() == {"sources": 5, "functions": 5, "reused_sources": 3, "reused_facts": 1, "analyzed": 1}
    assert warm() == [(r.source.rsplit("/", 1)[1], r.function_name, r.score, r.matched_fields) for r in third.matches.collect()]
    with pytest.raises(ValueError):
        repository.find(spark, f"{tmp_path}/none", index.term("sum"))


def test_cache_store_and_recovery(spark, tmp_path):
    path = f"{tmp_path}/c"
    rows = lambda *x: spark.createDataFrame(list(x), "stable_id string, semantic_hash string")
    assert cache.load(spark, path, "stable_id") is None
    status = lambda df: {r.stable_id: r.status for r in df.collect()}
    assert status(cache.store(spark, rows(("a", "1"), ("b", "1")), path, "stable_id")) == {"a": "created", "b": "created"}
    assert status(cache.store(spark, rows(("a", "1"), ("b", "2"), ("c", "1")), path, "stable_id")) == {"a": "unchanged", "b": "updated", "c": "created"}
    assert {r.stable_id: r.semantic_hash for r in cache.load(spark, path, "stable_id").collect()} == {"a": "1", "b": "2", "c": "1"}
    (tmp_path / "c" / log.manifest(spark, path).folders[-1] / "part.parquet").write_bytes(b"PAR1 no parquet at all")
    left, lost = cache.load_recovering(spark, path, "stable_id")
    assert {r.stable_id for r in left.collect()} == {"a", "b", "c"} and [r.source.rsplit("/", 1)[1] for r in lost.collect()] == ["part.parquet"]


def test_hashes_and_deltas(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",), (None,), ("é" * 300,)], "t string")
    plain = lambda t: [h := 0xCBF29CE484222325, *[h := (h ^ b) * 0x100000001B3 & (2**64 - 1) for b in t.encode()]][-1]
    got = {r.t: r.h for r in cache.with_fnv(rows, "t", "h").collect()}
    assert got == {t: None if t is None else f"{plain(t):016x}" for t in got} and got["a"] == "af63dc4c8601ec8c"
    pairs = [(b"abcdef", b"abXYef"), (b"", b"new"), (b"same", b"same"), (b"aaa", b"aa"), (b"aa", b"aaa"), (b"old", b"")]
    table = spark.createDataFrame(pairs, "old binary, new binary").withColumn("d", cache.delta("old", "new"))
    out = table.withColumn("back", cache.applied("old", "d")).collect()
    assert all(r.back == r.new for r in out) and [(r.d.prefix, r.d.suffix, bytes(r.d.replacement)) for r in out][:2] == [(2, 2, b"XY"), (0, 0, b"new")]
    facts = spark.createDataFrame([("s", 0, "f", 1), ("t", 4, "f", 1), ("s", 1, "f", 2)], "source string, ordinal int, function_name string, loop_count int")
    hashes = [r.semantic_hash for r in cache.with_semantic_hash(facts, "source", "ordinal").collect()]
    assert hashes[0] == hashes[1] != hashes[2]


def test_explanation(reports):
    text = explain.explained(reports.filter("source = 'accumulate'")).first().explanation
    lines = text.split("\n")
    assert lines[:4] == ["Function: gather", "Primary intent: Accumulator (85%)", "Semantic pipeline: none", "Observed evidence:"]
    assert "  - loop [Control Flow; strength 1]" in lines and "  - name token 'gather' [Naming; strength 1]" in lines
    others, gone = lines.index("Other active hypotheses:"), lines.index("Constraint eliminations:")
    assert [x.split(" (")[0] for x in lines[others + 1 : gone]] == ["  - Mapper", "  - Sum", "  - Iterator"] or gone - others == 4
    assert lines[gone + 4].endswith("additional hypotheses eliminated") and "missing " in lines[gone + 1]


def test_diagnostics(spark, reports, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"code": "E1", "severity": "error", "category": {"kind": "type_mismatch"}, "message": "m", "location": {"source": "accumulate", "start": 1, "end": 2}, "function_name": "gather"}))
    (tmp_path / "e.json").write_text(json.dumps({"code": "E2", "severity": "error", "category": {"kind": "other", "name": "odd"}, "message": "m", "location": {"source": "average", "start": 1, "end": 2}, "function_name": None}))
    said = diagnose.read_diagnostics(spark, str(tmp_path))
    got = {r.code: r for r in diagnose.diagnosed(said, reports).collect()}
    assert (got["E1"].intent, got["E1"].confidence, got["E1"].interpretation, len(got["E1"].fixes)) == ("accumulator", 85, "accumulator_type_conflict", 3) and got["E1"].evidence
    assert got["E2"].intent is None
    more = diagnose.with_rule(diagnose.rules(spark), "odd-average", "other:odd", "average", "odd_average", "average_division")
    assert {r.code: r.intent for r in diagnose.diagnosed(said, reports, more).collect()} == {"E1": "accumulator", "E2": "average"}
    wrong = said.withColumn("function_name", F.lit("another"))
    assert all(r.intent is None for r in diagnose.diagnosed(wrong, reports).collect())


def test_stream_of_facts(spark, reports, tmp_path):
    facts = reasoning.facts(visits(spark, [(n, t) for n, t, *_ in CORPUS[:3]], "python"))
    facts.write.parquet(f"{tmp_path}/facts")
    seen = []
    stream = incremental.analyzed_stream(spark.readStream.schema(facts.schema).parquet(f"{tmp_path}/facts"))
    incremental.each_batch(stream, lambda batch, _: seen.extend((r.source, r.primary_intent) for r in batch.collect()), f"{tmp_path}/checkpoint").awaitTermination(120)
    assert sorted(seen) == [("accumulate", "accumulator"), ("counter", "counter"), ("filter", "filter")]
