"""Reach over node and edge tables against a walk that calls itself."""

import random

from skeinworks.operators import programs
from skeinworks.operators.reach import reached


def walk(edges, root):
    """{node: (depth, place in the walk)} by the definition."""
    found = {}
    children = {}
    for parent, ordinal, child, deeper in edges:
        known = children.setdefault(parent, {})
        known[ordinal, child] = known.get((ordinal, child), False) or bool(deeper)

    def visit(node, depth):
        for (_, child), deeper in sorted(children.get(node, {}).items()):
            if child != root and child not in found:
                found[child] = (depth + deeper, len(found))
                visit(child, depth + deeper)

    visit(root, 0)
    return found


def test_cycles_shared_children_and_ties(spark):
    rng = random.Random(4)
    rows, roots, want = [], [], {}
    for source in range(25):
        nodes = [f"n{i}" for i in range(rng.randrange(1, 12))]
        edges = [(rng.choice(nodes), rng.choice([0, 1, 1, 2, 7]), rng.choice(nodes), rng.choice([True, False, None])) for _ in range(rng.randrange(0, 26))]
        rows += [(f"s{source}", *e, "x") for e in edges + edges[:3]]
        for root in nodes[:3]:
            roots.append((f"s{source}", root))
            want |= {(f"s{source}", root, node): v for node, v in walk(edges, root).items()}
    rows += [("s0", "n0", 1, None, True, "x"), (None, "n0", 1, "n1", True, "x"), ("s0", None, 1, "n1", True, "x")]
    table = spark.createDataFrame(rows, "source string, parent string, ordinal long, child string, deeper boolean, root string")
    got = reached(table, spark.createDataFrame([*roots, ("s0", "n0"), ("s0", None), (None, "n0")], "source string, root string")).collect()
    assert {(r.source, r.root, r.node): r.depth for r in got} == {k: d for k, (d, _) in want.items()} and len(got) == len(want)
    for source, root in set(roots):  # the order of paths is the order of the walk
        own = sorted((r for r in got if (r.source, r.root) == (source, root)), key=lambda r: [tuple(x) for x in r.path])
        assert [r.node for r in own] == sorted((n for s, x, n in want if (s, x) == (source, root)), key=lambda n: want[source, root, n][1])
    assert reached(table.limit(0), spark.createDataFrame(roots, "source string, root string")).count() == 0
    assert reached(table, spark.createDataFrame([], "source string, root string")).count() == 0


def test_long_chains(spark):
    """More rounds than are merged at once, and a shortcut that comes later in order than the way round."""
    edges = [("s", f"n{i}", 0, f"n{i + 1}", i % 2 == 0) for i in range(20)] + [("s", "n0", 1, "n20", False), ("s", "n20", 0, "n3", True)]
    table = spark.createDataFrame(edges, "source string, parent string, ordinal long, child string, deeper boolean")
    got = {r.node: r.depth for r in reached(table, spark.createDataFrame([("s", "n0")], "source string, root string")).collect()}
    assert got == {n: d for n, (d, _) in walk([e[1:] for e in edges], "n0").items()} and got["n20"] == 10


def test_small_sources_take_no_rounds(spark, monkeypatch):
    """A deep source is one row; beyond the bound it takes rounds, with the same result."""
    from skeinworks.operators import reach

    rng = random.Random(5)
    edges = [("deep", f"n{i:03}", 0, f"n{i + 1:03}", i % 3 == 0) for i in range(300)] + [("deep", "n000", 0, "n001", False), ("deep", "n000", 0, "n001", True)]
    edges += [("wide", f"n{rng.randrange(6)}", rng.randrange(3), f"n{rng.randrange(6)}", rng.choice([True, False, None])) for _ in range(14)]
    table = spark.createDataFrame(edges, "source string, parent string, ordinal long, child string, deeper boolean")
    roots = spark.createDataFrame([("deep", "n000"), ("wide", "n0"), ("wide", "n1"), ("wide", "n1"), ("none", "n0")], "source string, root string")
    wide = table.filter("source = 'wide'")
    rounds = reached(wide, roots, most=1).collect()
    mixed = reached(table.filter("source = 'wide' OR parent < 'n005'"), roots, most=10).filter("source = 'wide'").collect()
    monkeypatch.delattr(reach, "_found")
    got = reached(table, roots).collect()
    for source, root in (("deep", "n000"), ("wide", "n0"), ("wide", "n1")):
        want = {n: d for n, (d, _) in walk([e[1:] for e in edges if e[0] == source], root).items()}
        assert {r.node: r.depth for r in got if (r.source, r.root) == (source, root)} == want
    key = lambda r: (r.root, r.node, r.depth, [tuple(x) for x in r.path])
    own = sorted(key(r) for r in got if r.source == "wide")
    assert own == sorted(map(key, rounds)) == sorted(map(key, mixed)) and len(got) == len(own) + 300
    assert reached(wide, roots, paths=False).columns == ["source", "root", "node", "depth"]


def test_regions_are_known_by_their_entry(spark, monkeypatch):
    """Nodes that reach each other are one row for each root, also where regions are too large or too far apart to be found."""
    from skeinworks.operators import reach

    rng = random.Random(6)
    rows, roots = [], []
    for source in range(16):
        nodes = [f"n{i}" for i in range(8)]
        rows += [(source, rng.choice(nodes), rng.randrange(3), rng.choice(nodes), rng.choice([True, False, None])) for _ in range(14)]
        rows += [(source, f"r{i}", k, n, k == 1) for i in range(2) for k, n in enumerate(rng.sample(nodes, 3))]
        roots += [(source, root) for root in ("r0", "r1", "n0")]
    table = spark.createDataFrame(rows, "source int, parent string, ordinal long, child string, deeper boolean")
    known = spark.createDataFrame(roots, "source int, root string")
    want = {(s, root): walk([e[1:] for e in rows if e[0] == s], root) for s, root in roots}

    def told(most):
        got = reach.walks(table, known, most=most).collect()
        for (source, root), nodes in want.items():
            own = sorted((r for r in got if (r.source, r.root) == (source, root)), key=lambda r: r.place)
            assert {x.node: x.depth for r in own for x in r.nodes} == {n: d for n, (d, _) in nodes.items()} and sum(len(r.nodes) for r in own) == len(nodes)
            assert all([nodes[x.node][1] for x in r.nodes] == sorted(nodes[x.node][1] for x in r.nodes) for r in own)
            assert [nodes[r.nodes[-1].node][1] for r in own] == sorted(nodes[r.nodes[-1].node][1] for r in own)
        return len(got)

    every = sum(map(len, want.values()))
    assert told(10**6) == sum(map(bool, want.values())) and told(0) < 0.7 * every
    monkeypatch.setattr(reach, "MOST_REGION", 12)
    monkeypatch.setattr(reach, "_ROUNDS", 1)
    told(0)


def test_programs_walked_whole_are_as_joined(spark):
    """Sources of few edges are dealt once with all that belongs to them, and say the same as joins, odd rows included."""
    rng = random.Random(11)
    kinds, roles = ["function", "loop", "conditional", "assignment", "return", "call", "binary", "literal", "identifier", None, "loop", "loop", "loop"], ["body", "body", "value", "condition", "then", "callee", "guard", None]
    nodes, edges, types = [], [], []
    for s in ["s%d" % i for i in range(12)] + [None]:
        ids = ["n%d" % i for i in range(9)]
        nodes += [(s, n, rng.choice(kinds) if i > 1 else ("function", "loop")[i], rng.choice([None, "add", "divide", "greater_than", "less_than"]), rng.choice(["f", "g", None]), rng.choice([0, 1, None]), rng.choice([True, False, None]), rng.choice([1, None])) for i, n in enumerate(ids)]
        edges += [(s, rng.choice([*ids, "gone", None]) if i > 3 else "n0", rng.choice(roles) if i > 3 else "body", rng.choice([None, 0, 1, 2]), rng.choice([*ids, "gone", None]) if i else "n1") for i in range(24)]
        types += [(s, rng.choice([*ids, "gone"]), rng.choice(["parameter", "return", "local", None]), rng.choice(["numeric", "text", None])) for _ in range(8)]
    made = {"f": ("function", None, "f"), "a": ("assignment", None, None), "r": ("return", None, None), "c": ("call", None, None), "i": ("conditional", None, None), "one": ("literal", None, None), "d": ("binary", "divide", None), "g": ("binary", "greater_than", None), "name": ("identifier", None, "f")}
    nodes += [("t", n, kind, op, name, 1 if n == "one" else None, None, 2 if n == "i" else None) for n, (kind, op, name) in made.items()]
    edges += [("t", *e) for e in (("f", "body", 0, "a"), ("f", "body", 1, "r"), ("f", "body", 2, "c"), ("f", "body", 3, "i"), ("a", "value", 0, "one"), ("r", "value", 0, "d"), ("c", "callee", 0, "name"), ("i", "condition", 0, "g"), ("i", "then", 1, "a"))]
    tables = spark.createDataFrame(nodes, "source string, node string, kind string, op string, name string, value int, foreach boolean, branches int"), spark.createDataFrame(edges, "source string, parent string, role string, ordinal int, child string"), spark.createDataFrame(types, "source string, node string, role string, category string")
    whole, joined = programs._whole(*tables), programs._joined(*tables)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    shown = lambda df: sorted(map(repr, df.select(*sorted(joined.columns)).collect()))
    want = shown(joined)
    assert shown(whole) == want and whole.filter("depth > 0").count() and all(whole.filter(f"source = 't' AND {c}").count() == 1 for c in ("one", "divides", "recursive", "maximum"))
    assert shown(programs.visits(*tables, most=23)) == want == shown(programs.visits(*tables))
