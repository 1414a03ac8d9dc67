"""Fixed values of the rule system: evidence kinds, hypotheses, pipelines, diagnostics and adapters."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: evidence kinds in their order, with provider, counter of the facts and label ---
EVIDENCE = [
    ("loop", "control_flow", "loop_count", "loop"),
    ("nested_loop", "control_flow", "nested_loop_count", "nested loop"),
    ("collection_iteration", "control_flow", "collection_iteration_count", "collection iteration"),
    ("conditional", "control_flow", "conditional_count", "conditional"),
    ("return", "control_flow", "return_count", "return"),
    ("boolean_return", "control_flow", "boolean_return_count", "boolean return"),
    ("call", "control_flow", "call_count", "call"),
    ("recursion", "control_flow", "recursion_count", "recursion"),
    ("assignment", "mutation", "assignment_count", "assignment"),
    ("mutation", "mutation", "mutation_count", "mutation"),
    ("addition_mutation", "mutation", "addition_mutation_count", "addition mutation"),
    ("multiplication_mutation", "mutation", "multiplication_mutation_count", "multiplication mutation"),
    ("increment_mutation", "mutation", "increment_mutation_count", "increment mutation"),
    ("division", "mutation", "division_count", "division"),
    ("comparison", "data_flow", "comparison_count", "comparison"),
    ("maximum_update", "data_flow", "maximum_update_count", "maximum update"),
    ("minimum_update", "data_flow", "minimum_update_count", "minimum update"),
    ("loop_return", "data_flow", "loop_return_count", "loop-local return"),
    ("numeric_parameter", "type", "numeric_parameter_count", "numeric parameter"),
    ("numeric_return", "type", "numeric_return_count", "numeric return"),
    ("allocation", "ownership", "allocation_count", "allocation"),
    ("ownership_transfer", "ownership", "ownership_transfer_count", "ownership transfer"),
    ("reference", "ownership", "reference_count", "reference"),
    ("api_usage", "api_usage", "api_usage_count", "API usage"),
    ("accumulation", "mutation", "accumulation_count", "accumulation"),
]

# --- fixed values: hypothesis, rules of required evidence (name, kind), rules of supporting evidence (name, kind, weight) ---
HYPOTHESES = [
    ("accumulator", [("loop", "loop"), ("addition", "addition_mutation")], [("accumulation", "accumulation", 45), ("numeric_return", "numeric_return", 20), ("return", "return", 10)]),
    ("average", [("loop", "loop"), ("addition", "addition_mutation"), ("division", "division"), ("numeric_return", "numeric_return")], [("accumulation", "accumulation", 30), ("numeric_parameter", "numeric_parameter", 20), ("division", "division", 45), ("name", "name:average", 45)]),
    ("builder", [("allocation", "allocation")], [("mutation", "mutation", 20), ("return", "return", 20)]),
    ("cache", [("conditional", "conditional"), ("mutation", "mutation")], [("call", "call", 20)]),
    ("counter", [("loop", "loop"), ("increment", "increment_mutation")], [("mutation", "mutation", 15), ("return", "return", 20), ("name", "name:count", 50)]),
    ("event_dispatcher", [("conditional", "conditional"), ("call", "call")], [("api", "api_usage", 25)]),
    ("factory", [("allocation", "allocation"), ("return", "return")], [("name", "name:create", 20)]),
    ("filter", [("loop", "loop"), ("conditional", "conditional")], [("collection", "collection_iteration", 15), ("name", "name:filter", 85)]),
    ("iterator", [("collection", "collection_iteration")], [("loop", "loop", 25), ("return", "return", 15)]),
    ("lookup", [("conditional", "conditional"), ("return", "return")], [("comparison", "comparison", 25)]),
    ("mapper", [("loop", "loop")], [("return", "return", 20), ("collection", "collection_iteration", 15), ("call", "call", 35), ("name", "name:map", 65), ("name", "name:mapper", 65)]),
    ("maximum", [("loop", "loop"), ("selection_update", "maximum_update"), ("numeric_return", "numeric_return")], [("selection_update", "maximum_update", 70), ("conditional", "conditional", 20), ("return", "return", 15), ("collection", "collection_iteration", 10)]),
    ("minimum", [("loop", "loop"), ("selection_update", "minimum_update"), ("numeric_return", "numeric_return")], [("selection_update", "minimum_update", 70), ("conditional", "conditional", 20), ("return", "return", 15), ("collection", "collection_iteration", 10)]),
    ("sum", [("loop", "loop"), ("addition", "addition_mutation"), ("numeric_return", "numeric_return")], [("sum_name", "name:sum", 75), ("accumulation", "accumulation", 30)]),
    ("count_if", [("loop", "loop"), ("conditional", "conditional"), ("increment", "increment_mutation")], [("count_name", "name:count", 55), ("conditional", "conditional", 20), ("increment", "increment_mutation", 20)]),
    ("any", [("loop", "loop"), ("conditional", "conditional"), ("return", "return")], [("boolean_return", "boolean_return", 25), ("early_return", "loop_return", 35), ("any_name", "name:any", 70)]),
    ("all", [("loop", "loop"), ("conditional", "conditional"), ("return", "return")], [("boolean_return", "boolean_return", 25), ("early_return", "loop_return", 35), ("all_name", "name:all", 70)]),
    ("find_first", [("loop", "loop"), ("conditional", "conditional"), ("early_return", "loop_return")], [("find_name", "name:find", 30), ("first_name", "name:first", 60)]),
    ("find_last", [("loop", "loop"), ("conditional", "conditional"), ("return", "return")], [("find_name", "name:find", 30), ("last_name", "name:last", 60)]),
    ("reverse_traversal", [("loop", "loop"), ("return", "return")], [("reverse_name", "name:reverse", 85)]),
    ("prefix_sum", [("loop", "loop"), ("addition", "addition_mutation")], [("prefix_name", "name:prefix", 60), ("sum_name", "name:sum", 35)]),
    ("frequency_counter", [("loop", "loop"), ("mutation", "mutation")], [("frequency_name", "name:frequency", 85)]),
    ("histogram", [("loop", "loop"), ("mutation", "mutation")], [("histogram_name", "name:histogram", 85)]),
    ("max_by", [("loop", "loop"), ("selection_update", "maximum_update")], [("max_name", "name:max", 40), ("by_name", "name:by", 45), ("selection_update", "maximum_update", 20)]),
    ("min_by", [("loop", "loop"), ("selection_update", "minimum_update")], [("min_name", "name:min", 40), ("by_name", "name:by", 45), ("selection_update", "minimum_update", 20)]),
    ("group_by", [("loop", "loop"), ("return", "return")], [("group_name", "name:group", 45), ("by_name", "name:by", 45)]),
    ("partition", [("loop", "loop"), ("conditional", "conditional")], [("partition_name", "name:partition", 85)]),
    ("unique", [("loop", "loop"), ("conditional", "conditional")], [("unique_name", "name:unique", 85)]),
    ("distinct", [("loop", "loop"), ("conditional", "conditional")], [("distinct_name", "name:distinct", 85)]),
    ("zip", [("loop", "loop"), ("return", "return")], [("zip_name", "name:zip", 85)]),
    ("flatten", [("loop", "loop"), ("nested_loop", "nested_loop")], [("flatten_name", "name:flatten", 85)]),
    ("contains", [("loop", "loop"), ("conditional", "conditional"), ("return", "return")], [("boolean_return", "boolean_return", 25), ("contains_name", "name:contains", 85), ("early_return", "loop_return", 30)]),
    ("product", [("loop", "loop"), ("multiplication", "multiplication_mutation"), ("numeric_return", "numeric_return")], [("multiplication", "multiplication_mutation", 70), ("return", "return", 20), ("name", "name:product", 30)]),
    ("parser", [("conditional", "conditional")], [("name", "name:parse", 35), ("call", "call", 15)]),
    ("reducer", [("loop", "loop"), ("assignment", "assignment"), ("return", "return")], [("call", "call", 35), ("name", "name:reducer", 65), ("name", "name:reduce", 65)]),
    ("resource_manager", [("allocation", "allocation"), ("ownership", "ownership_transfer")], [("reference", "reference", 20)]),
    ("search", [("loop", "loop"), ("conditional", "conditional"), ("return", "return")], [("comparison", "comparison", 25)]),
    ("sort", [("nested_loop", "nested_loop")], [("comparison", "comparison", 25), ("name", "name:sort", 60), ("return", "return", 15)]),
    ("normalize", [("division", "division"), ("numeric_return", "numeric_return")], [("name", "name:normalize", 70), ("return", "return", 15)]),
    ("index", [("loop", "loop"), ("return", "return")], [("conditional", "conditional", 15), ("name", "name:index", 70)]),
    ("linear_search", [("loop", "loop"), ("conditional", "conditional"), ("comparison", "comparison"), ("early_return", "loop_return")], [("early_return", "loop_return", 60), ("name", "name:linear", 40)]),
    ("binary_search", [("loop", "loop"), ("conditional", "conditional"), ("comparison", "comparison"), ("midpoint", "division"), ("early_return", "loop_return")], [("midpoint", "division", 45), ("early_return", "loop_return", 40), ("name", "name:binary", 30)]),
    ("serializer", [("return", "return")], [("name", "name:serialize", 35), ("call", "call", 15)]),
    ("state_machine", [("conditional", "conditional"), ("mutation", "mutation")], [("nested_loop", "nested_loop", 15)]),
    ("validator", [("conditional", "conditional"), ("comparison", "comparison")], [("return", "return", 20), ("name", "name:validate", 35)]),
]
BASELINE = 10

# --- fixed values: pipeline, stages, words of the name ---
PIPELINES = [
    ("filter_map_reduce", ["filter", "mapper", "reducer"], ["filter", "map", "reduce"]),
    ("histogram_maximum", ["histogram", "maximum"], ["histogram", "maximum"]),
    ("group_by_count", ["group_by", "counter"], ["group", "by", "count"]),
    ("prefix_sum_search", ["prefix_sum", "search"], ["prefix", "sum", "search"]),
    ("partition_sort", ["partition", "sort"], ["partition", "sort"]),
    ("flatten_filter", ["flatten", "filter"], ["flatten", "filter"]),
    ("unique_sort", ["unique", "sort"], ["unique", "sort"]),
    ("binary_search_validation", ["binary_search", "validator"], ["binary", "search", "validate"]),
    ("count_if_average", ["count_if", "average"], ["count", "if", "average"]),
    ("sum_normalize", ["sum", "normalize"], ["sum", "normalize"]),
    ("minimum_index", ["minimum", "index"], ["minimum", "index"]),
    ("maximum_index", ["maximum", "index"], ["maximum", "index"]),
    ("filter_map", ["filter", "mapper"], ["filter", "map"]),
    ("map_reduce", ["mapper", "reducer"], ["map", "reduce"]),
    ("filter_reduce", ["filter", "reducer"], ["filter", "reduce"]),
]

# --- fixed values: diagnostic rule, category, hypothesis, interpretation, suggestion set ---
DIAGNOSTIC_RULES = [
    ("accumulator-type-mismatch", "type_mismatch", "accumulator", "accumulator_type_conflict", "accumulator_type"),
    ("average-missing-division", "missing_division", "average", "average_implementation_incomplete", "average_division"),
    ("resource-move-after-use", "move_after_use", "resource_manager", "ownership_violation", "ownership"),
]
# --- fixed values: suggestion set, title, explanation, rationale ---
SUGGESTIONS = [
    ("accumulator_type", "change_accumulator_type", "Use an accumulator type compatible with incoming values.", "The inferred accumulator performs addition inside iteration."),
    ("accumulator_type", "convert_incoming_value", "Convert each incoming value before accumulation.", "Conversion can make the addition operands compatible."),
    ("accumulator_type", "use_compatible_addition", "Use an addition operation defined for both operand types.", "The compiler reported an incompatible addition in the inferred accumulation flow."),
    ("average_division", "add_division", "Divide the accumulated value by the item count.", "Average intent requires a final division after accumulation."),
    ("ownership", "restore_ownership", "Retain or transfer ownership before the later use.", "The inferred resource-management intent conflicts with a move-after-use diagnostic."),
    ("ownership", "avoid_use_after_move", "Avoid accessing the resource after it has moved.", "The diagnostic identifies a use after ownership transfer."),
]
# --- fixed values: extension, language, whether a frontend runs ---
ADAPTERS = [
    ("py", "python", True),
    ("pyw", "python", True),
    ("ving", "transport", True),
    ("json", "transport", True),
    ("java", "java", True),
    ("c", "c", True),
    ("rs", "rust", False),
    ("go", "go", False),
    ("cc", "cpp", False),
    ("cpp", "cpp", False),
    ("cxx", "cpp", False),
    ("hpp", "cpp", False),
    ("hxx", "cpp", False),
    ("cs", "csharp", False),
    ("kt", "kotlin", False),
    ("kts", "kotlin", False),
    ("swift", "swift", False),
    ("js", "javascript", False),
    ("mjs", "javascript", False),
    ("cjs", "javascript", False),
    ("ts", "typescript", False),
    ("tsx", "typescript", False),
]
# --- fixed values: directories that a repository scan leaves out ---
SKIPPED_FOLDERS = [".git", ".idea", ".venv", ".vscode", "__pycache__", "node_modules", "target", "verification"]
# --- fixed values: failure category and its markers; the first match counts ---
FAILURES = [
    ("security", ["security", "injection", "unsafe", "vulnerability", "cve"]),
    ("concurrency", ["race", "deadlock", "concurrent", "thread"]),
    ("memory", ["memory", "leak", "use-after-free", "overflow", "allocation"]),
    ("transaction", ["transaction", "rollback", "commit", "atomic"]),
    ("parser", ["parse", "syntax", "token", "lexer"]),
    ("semantic", ["semantic", "type error", "type mismatch", "invalid value"]),
    ("algorithm", ["algorithm", "incorrect result", "wrong result", "assertionerror"]),
    ("architecture", ["architecture", "module boundary", "coupling"]),
    ("state_management", ["state", "cache", "mutation"]),
    ("optimization", ["timeout", "performance", "slow"]),
    ("api", ["api", "interface", "endpoint"]),
    ("documentation", ["documentation", "docstring", "readme"]),
    ("testing", ["test", "coverage", "fixture"]),
]


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str  # an evidence kind, or name:token
    weight: int = 0


@dataclass(frozen=True)
class Hypothesis:
    id: str
    require: tuple[Rule, ...] = ()
    support: tuple[Rule, ...] = ()
    reject: tuple[Rule, ...] = ()
    baseline: int = BASELINE


def hypotheses() -> dict[str, Hypothesis]:
    """By id, in order; registering an id again replaces it."""
    made = {name: Hypothesis(name, tuple(Rule(*r) for r in require), tuple(Rule(*r) for r in support)) for name, require, support in HYPOTHESES}
    return dict(sorted(made.items()))


def pipelines() -> list[tuple[str, list[str], list[str]]]:
    return PIPELINES


def evidence_kinds() -> list[tuple[int, str, str, str, str]]:
    """(order, kind, provider, counter, label); a name's token has order 0."""
    return [(i, *kind) for i, kind in enumerate(EVIDENCE, 1)]


def failures() -> list[tuple[str, list[str]]]:
    return FAILURES
