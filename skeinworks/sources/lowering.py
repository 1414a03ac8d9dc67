"""Trees of programs as rows of visits: what each function reaches, at which depth of loops.

A frontend turns one source text into plain tuples; everything after that is a DataFrame. Frontends: a transport
JSON of versioned programs (which other tools' trees can be written in), and Python by its standard ``ast``.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VISITS = "source string, ordinal int, function_name string, kind string, op string, depth int, one boolean, foreach boolean, branches int, maximum boolean, minimum boolean, divides boolean, recursive boolean, role string, category string, error string"
# --- fixed values: categories of types, operators of Python ---
CATEGORIES = {"integer": "numeric", "decimal": "numeric", "boolean": "boolean", "text": "text", "unit": "unit", "collection": "collection", "map": "map", "optional": "optional", "result": "result", "reference": "reference", "pointer": "pointer", "function": "callable", "named": "named"}
PYTHON_TYPES = {"int": "numeric", "float": "numeric", "bool": "boolean", "str": "text", "None": "unit"}
PYTHON_OPS = {"Add": "add", "Sub": "subtract", "Mult": "multiply", "Div": "divide", "FloorDiv": "divide", "Mod": "remainder", "Eq": "equal", "NotEq": "not_equal", "Lt": "less_than", "LtE": "less_than_or_equal", "Gt": "greater_than", "GtE": "greater_than_or_equal", "And": "and", "Or": "or"}
#: The greatest integer that a program may hold.
MOST = (1 << 63) - 1
GREATER, LESS = ("greater_than", "greater_than_or_equal"), ("less_than", "less_than_or_equal")


class FrontendError(ValueError):
    """A source that has no program, with the reason."""


# A tree: {"kind", "op", "name", "value", "types": [(role, category)], "outer": [trees at this depth], "body": [trees one deeper], ...}
def node(kind: str, **more) -> dict:
    return {"kind": kind, "op": None, "outer": (), "body": ()} | more


def assign(target: dict, value: dict, op: str | None = None) -> dict:
    return node("assignment", op=op, outer=(target, value), one=value["kind"] == "literal" and value.get("value") == 1 and value.get("value") is not True)


def conditional(condition: dict, then: list[dict], other: list[dict] | None) -> dict:
    plain = any(x["kind"] == "assignment" and x["op"] is None for x in then)
    compares = condition["op"] if condition["kind"] == "binary" else None
    return node("conditional", outer=(condition, *then, *(other or ())), branches=1 + (other is not None), maximum=compares in GREATER and plain, minimum=compares in LESS and plain)


def returned(value: dict | None) -> dict:
    return node("return", outer=() if value is None else (value,), divides=value is not None and value["kind"] == "binary" and value["op"] == "divide")


def function(name: str, parameters: list[str], returns: str | None, body: list[dict]) -> dict:
    types = [("parameter", c) for c in parameters] + ([("return", returns)] if returns else [])
    return node("function", name=name, types=types, outer=tuple(body))


def transport_functions(text: str, version: int = 1, format_suffix: str = ".semantic-export") -> list[dict]:
    """Functions of a transport document, whose format ends in ``format_suffix``."""
    try:
        document = json.loads(text)
        modules = document["program"]["modules"]
    except (ValueError, KeyError, TypeError) as error:
        raise FrontendError("invalid export JSON") from error
    if not str(document.get("format", "")).endswith(format_suffix):
        raise FrontendError(f"unsupported export format: {document.get('format')}")
    if document.get("version") != version:
        raise FrontendError(f"unsupported export version: {document.get('version')}")
    try:
        return [function(f["name"], [CATEGORIES.get(p["type"]["kind"], "unknown") for p in f["parameters"]], CATEGORIES.get(f["return_type"]["kind"], "unknown"), [_statement(x) for x in f["body"]]) for m in modules for f in m["functions"]]
    except (KeyError, TypeError) as error:
        raise FrontendError("invalid export JSON") from error


def _statement(s: dict) -> dict:
    match s["kind"]:
        case "variable":
            return node("variable", types=[("local", CATEGORIES.get(s["type"]["kind"], "unknown"))] if s.get("type") else [], outer=(_expression(s["initializer"]),) if s.get("initializer") else ())
        case "assignment":
            return assign(_expression(s["target"]), _expression(s["value"]))
        case "mutation":
            return assign(_expression(s["target"]), _expression(s["value"]), s["operation"])
        case "call":
            return _expression(s["call"] | {"kind": "call"})
        case "return":
            return returned(_expression(s["value"]) if s.get("value") else None)
        case "loop":
            return node("loop", outer=(_expression(s["loop_kind"]["condition"]),), body=tuple(_statement(x) for x in s["body"]))
        case "conditional":
            other = s.get("else_body")
            return conditional(_expression(s["condition"]), [_statement(x) for x in s["then_body"]], None if other is None else [_statement(x) for x in other])
    raise FrontendError("invalid export JSON")


def _expression(e: dict) -> dict:
    match e["kind"]:
        case "identifier":
            return node("identifier", name=e["name"])
        case "literal":
            return node("literal", value=e["value"].get("value") if e["value"]["kind"] == "integer" else None)
        case "call":
            callee = e["callee"]
            return node("call", outer=((_expression(callee) if isinstance(callee, dict) else node("identifier", name=callee)), *(_expression(a) for a in e["arguments"])))
        case "binary":
            return node("binary", op=e["operation"], outer=(_expression(e["left"]), _expression(e["right"])))
        case "unary":
            return node("unary", outer=(_expression(e["operand"]),))
        case "collection":
            return node("collection", outer=tuple(_expression(x) for x in e["elements"]))
    return node("extension")


def python_functions(text: str) -> list[dict]:
    """Functions of a Python source, in the order in which they end; classes, with, try and match are left out with their bodies."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as error:
        raise FrontendError("invalid Python source") from error
    found: list[dict] = []
    _block(tree.body, set(), found)
    return found


def _block(body: list, known: set[str], found: list[dict]) -> list[dict]:
    return [x for s in body if (x := _python(s, known, found)) is not None]


def _python(s: ast.stmt, known: set[str], found: list[dict]) -> dict | None:
    match s:
        case ast.FunctionDef() | ast.AsyncFunctionDef():
            inner = {a.arg for a in s.args.args}
            body = _block(s.body, inner, found)
            found.append(function(s.name, [_annotated(a.annotation) for a in s.args.args], _annotated(s.returns), body))
            return None
        case ast.Assign(targets=[ast.Name(id=name), *_]) | ast.AnnAssign(target=ast.Name(id=name), value=ast.expr()):
            value = _value(s.value)
            if name in known:
                return assign(node("identifier", name=name), value)
            known.add(name)
            kind = _annotated(s.annotation) if isinstance(s, ast.AnnAssign) else _inferred(s.value)
            return node("variable", types=[("local", kind)] if kind else [], outer=(value,))
        case ast.AugAssign(target=ast.Name(id=name)) if type(s.op).__name__ in PYTHON_OPS:
            return assign(node("identifier", name=name), _value(s.value), PYTHON_OPS[type(s.op).__name__])
        case ast.Return():
            return returned(None if s.value is None else _value(s.value))
        case ast.Expr(value=ast.Call()):
            return _value(s.value)
        case ast.If():
            return conditional(_value(s.test), _block(s.body, known, found), _block(s.orelse, known, found) if s.orelse else None)
        case ast.While():
            return node("loop", outer=(_value(s.test),), body=tuple(_block(s.body, known, found)))
        case ast.For(target=ast.Name(id=name)):
            known.add(name)
            return node("loop", foreach=True, outer=(_value(s.iter),), body=tuple(_block(s.body, known, found)))
    return None


def _value(e: ast.expr) -> dict:
    match e:
        case ast.Name():
            return node("identifier", name=e.id)
        case ast.Constant():
            if isinstance(e.value, int) and e.value > MOST:
                raise FrontendError("an integer is beyond 64 bits")
            return node("literal", value=e.value if isinstance(e.value, int) else None)
        case ast.Call():
            return node("call", outer=(_value(e.func), *map(_value, e.args)))
        case ast.BinOp() if type(e.op).__name__ in PYTHON_OPS:
            return node("binary", op=PYTHON_OPS[type(e.op).__name__], outer=(_value(e.left), _value(e.right)))
        case ast.Compare() if type(e.ops[0]).__name__ in PYTHON_OPS:
            return node("binary", op=PYTHON_OPS[type(e.ops[0]).__name__], outer=(_value(e.left), _value(e.comparators[0])))
        case ast.BoolOp():
            out = _value(e.values[0])
            for x in e.values[1:]:
                out = node("binary", op=PYTHON_OPS[type(e.op).__name__], outer=(out, _value(x)))
            return out
        case ast.UnaryOp(op=ast.USub() | ast.Not()):
            return node("unary", outer=(_value(e.operand),))
        case ast.List() | ast.Tuple() | ast.Set():
            return node("collection", outer=tuple(map(_value, e.elts)))
    return node("extension")


def _annotated(a: ast.expr | None) -> str:
    match a:
        case ast.Name(id=name):
            return PYTHON_TYPES.get(name, "named")
        case ast.Subscript(value=ast.Name(id="list" | "set" | "tuple")):
            return "collection"
        case ast.Subscript(value=ast.Name()):
            return "named"
    return "unknown"


def _inferred(e: ast.expr) -> str | None:
    match e:
        case ast.Constant(value=bool()):
            return "boolean"
        case ast.Constant(value=int() | float()):
            return "numeric"
        case ast.Constant(value=str()):
            return "text"
        case ast.List() | ast.Tuple() | ast.Set():
            return "collection"
    return None


def visits_of(functions: list[dict]) -> Iterator[dict]:
    """A row for each function, each type of it, and each node that it reaches."""
    for ordinal, function in enumerate(functions):
        base = {"ordinal": ordinal, "function_name": function["name"]}
        yield base | {"kind": "function"}
        stack = [(x, 0) for x in reversed(function["outer"])]
        for role, category in function["types"]:
            yield base | {"kind": "type", "role": role, "category": category}
        while stack:
            x, depth = stack.pop()
            row = {k: x.get(k) for k in ("kind", "op", "one", "foreach", "branches", "maximum", "minimum", "divides")} | {"depth": depth}
            if x["kind"] == "call":
                callee = x["outer"][0]
                row["recursive"] = callee["kind"] == "identifier" and callee.get("name") == function["name"]
            yield base | row
            for role, category in x.get("types", ()):
                yield base | {"kind": "type", "role": role, "category": category}
            stack += [(c, depth + 1) for c in reversed(x["body"])] + [(c, depth) for c in reversed(x["outer"])]


def lowered(sources: DataFrame, language: str | None = None) -> DataFrame:
    """Visits of ``sources`` (source, content, language unless one is given). A source that its frontend rejects is one row of kind ``error``; no functions, one of kind ``empty``."""
    from skeinworks.sources.compiled import clang_functions, java_functions

    frontends = {"python": python_functions, "transport": transport_functions, "java": java_functions, "c": clang_functions}
    names = [x.split()[0] for x in VISITS.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in VISITS.split(", ")])

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content, spoken in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    rows = list(visits_of(frontends[spoken](content or ""))) or [{"kind": "empty"}]
                except FrontendError as error:
                    rows = [{"kind": "error", "error": str(error)}]
                except (RecursionError, MemoryError):
                    rows = [{"kind": "error", "error": "nested too deeply"}]
                yield pa.RecordBatch.from_pylist([dict.fromkeys(names) | {"source": source} | r for r in rows], schema=schema)

    return sources.select("source", "content", F.col("language") if language is None else F.lit(language).alias("language")).mapInArrow(lower, VISITS)
