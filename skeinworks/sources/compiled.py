"""Programs as compilers describe them in JSON: methods of Java sources, and Clang's syntax trees of C sources.

Both become the trees of ``lowering``; what a compiler's frontend leaves out stays out.
"""

from __future__ import annotations

import json

from skeinworks.sources.lowering import FrontendError, assign, conditional, function, node, returned

# --- fixed values: types by a part of their name, the first that fits; operators of Java's and C's frontends ---
JAVA_TYPES = [("boolean", "boolean"), ("double", "numeric"), ("float", "numeric"), ("int", "numeric"), ("long", "numeric"), ("short", "numeric"), ("byte", "numeric"), ("String", "text")]
JAVA_OPS = {
    "add": "add", "subtract": "subtract", "multiply": "multiply", "divide": "divide", "remainder": "remainder", "equal": "equal", "not_equal": "not_equal", "less_than": "less_than",
    "greater_than": "greater_than", "less_equal": "less_than_or_equal", "greater_equal": "greater_than_or_equal", "and": "and", "or": "or",
}
C_OPS = {"+": "add", "-": "subtract", "*": "multiply", "/": "divide", "%": "remainder", "<": "less_than", ">": "greater_than"}


def java_type(name: str) -> str:
    return next((category for part, category in JAVA_TYPES if part in name), "unknown")


def _java(v: dict) -> dict:
    """A statement or an expression; anything unknown is an extension without parts."""
    every = lambda key: [_java(x) for x in v[key]]
    match v["kind"]:
        case "variable":
            return node("variable", types=[("local", java_type(v["type"]))], outer=(_java(v["initializer"]),))
        case "assignment":
            return assign(_java(v["target"]), _java(v["value"]))
        case "mutation":
            return assign(_java(v["target"]), _java(v["value"]), JAVA_OPS.get(v["op"], "equal"))
        case "return":
            return returned(_java(v["value"]))
        case "if":
            return conditional(_java(v["condition"]), every("then"), every("else") or None)
        case "while":
            return node("loop", outer=(_java(v["condition"]),), body=tuple(every("body")))
        case "for":  # a while loop whose body begins with the initializers and ends with the updates
            return node("loop", outer=(_java(v["condition"]),), body=(*every("init"), *every("body"), *every("update")))
        case "foreach":
            return node("loop", foreach=True, outer=(_java(v["iterable"]),), body=tuple(every("body")))
        case "call":
            return node("call", outer=(_java(v["callee"]), *every("arguments")))
        case "identifier":
            return node("identifier", name=v["name"])
        case "literal":
            whole = v["literal_kind"] == "number" and "." not in v["value"]
            return node("literal", value=int(v["value"]) if whole and v["value"].lstrip("-").isdigit() else None)
        case "binary":
            return node("binary", op=JAVA_OPS.get(v["op"], "equal"), outer=(_java(v["left"]), _java(v["right"])))
        case "unary":
            return node("unary", outer=(_java(v["operand"]),))
        case "collection":
            return node("collection", outer=tuple(every("elements")))
    return node("extension")


def java_functions(text: str) -> list[dict]:
    """Methods of a Java source's JSON: {"methods": [{"name", "parameters", "return_type", "body"}]}."""
    try:
        return [function(m["name"], [java_type(p["type"]) for p in m["parameters"]], java_type(m["return_type"]), [_java(x) for x in m["body"]]) for m in json.loads(text)["methods"]]
    except (ValueError, KeyError, TypeError, AttributeError) as error:
        raise FrontendError("invalid Java JSON") from error


def _inner(n: dict) -> list[dict]:
    return n.get("inner") or []


def _c_name(n: dict) -> str:
    return n.get("name") or n.get("referencedDecl", {}).get("name") or "unknown"


def _c_type(n: dict) -> str:
    """Every type of C counts as a number."""
    return "numeric"


def _c_expression(n: dict) -> dict:
    match n.get("kind"):
        case "ImplicitCastExpr" | "ParenExpr":
            return _c_expression(_inner(n)[0])
        case "DeclRefExpr":
            return node("identifier", name=_c_name(n))
        case "IntegerLiteral":
            value = str(n.get("value", "0"))
            return node("literal", value=int(value) if value.isdigit() else 0)
        case "BinaryOperator":
            left, right = _inner(n)[:2]
            return node("binary", op=C_OPS.get(n.get("opcode", "").rstrip("="), "equal"), outer=(_c_expression(left), _c_expression(right)))
    return node("identifier", name="unsupported")  # calls too


def _c_statements(n: dict) -> list[dict]:
    """Statements of a node; those that are none themselves give those inside them."""
    parts = _inner(n)
    match n.get("kind"):
        case "DeclStmt":
            return [node("variable", types=[("local", _c_type(d))], outer=tuple(_c_expression(x) for x in _inner(d)[:1])) for d in parts if d.get("kind") == "VarDecl"]
        case "ReturnStmt":
            return [returned(_c_expression(parts[0]) if parts else None)]
        case "IfStmt":
            then, other = (_c_statements(parts[i]) if len(parts) > i else [] for i in (1, 2))
            return [conditional(_c_expression(parts[0]), then, other or None)]
        case "WhileStmt" | "ForStmt":  # only bodies in braces count, and no header
            return [node("loop", outer=(node("literal", value=None),), body=tuple(s for x in parts if x.get("kind") == "CompoundStmt" for s in _c_statements(x)))]
        case "BinaryOperator" | "CompoundAssignOperator":
            code = n.get("opcode", "=")
            return [assign(_c_expression(parts[0]), _c_expression(parts[1]), None if code == "=" else C_OPS.get(code.rstrip("="), "equal"))]
        case "CallExpr":
            return [_c_expression(n)]
    return [s for x in parts for s in _c_statements(x)]


def clang_functions(text: str) -> list[dict]:
    """Functions of a C source's tree, as ``clang -ast-dump=json`` gives it."""
    found = []
    try:
        for f in _inner(json.loads(text)):
            if f.get("kind") == "FunctionDecl":
                parameters = [_c_type(x) for x in _inner(f) if x.get("kind") == "ParmVarDecl"]
                bodies = [x for x in _inner(f) if x.get("kind") == "CompoundStmt"]
                found.append(function(_c_name(f), parameters, _c_type(f), _c_statements(bodies[0]) if bodies else []))
    except (ValueError, KeyError, TypeError, AttributeError, IndexError) as error:
        raise FrontendError("invalid Clang JSON") from error
    return found
