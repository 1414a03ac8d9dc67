"""Facts to evidence to scored, ranked hypotheses: one row per function all the way.

Only the aggregation of visits to facts shuffles. Evidence, rules, ranking and pipelines are arrays of the row, so
nothing after it moves data, and no row grows with the number of functions. Every hypothesis is a plain sum of its
weights times columns: the rules are unrolled when the plan is made, and no lambda runs over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.functions import seeds

COUNTERS = [c for _, _, _, c, _ in seeds.evidence_kinds() if c not in ("numeric_parameter_count", "numeric_return_count", "accumulation_count", "boolean_return_count")]
_ITEM = "struct<provider_id:string,kind_ord:int,kind:string,token:string,strength:bigint>"
#: A provider of more evidence: its id, the kind, and the column of its strength.
Provider = tuple[str, str, Column]


def facts(visits: DataFrame) -> DataFrame:
    """One row per (source, ordinal): counters of ``visits``, a row for each node that a function reaches.

    Visits have kind, op, depth (of loops), and flags one (literal 1), foreach, branches, maximum, minimum, divides,
    recursive; and role, category of a type. A function has a visit of kind ``function``, so it has a row in any case.
    """
    kind, op, depth = F.col("kind"), F.col("op"), F.col("depth")
    n = lambda test: F.count_if(test).alias
    assigned, ops = kind == "assignment", op.isNotNull()
    return visits.groupBy("source", "ordinal", "function_name").agg(
        n(kind == "variable")("variable_count"), n(assigned)("assignment_count"), n(assigned & ops)("mutation_count"), n(assigned & (op == "add"))("addition_mutation_count"),
        n(assigned & (op == "add") & F.col("one"))("increment_mutation_count"), n(assigned & (op == "multiply"))("multiplication_mutation_count"),
        n(kind == "loop")("loop_count"), n((kind == "loop") & (depth > 0))("nested_loop_count"), n((kind == "loop") & F.col("foreach"))("collection_iteration_count"),
        n(kind.isin("conditional", "match"))("conditional_count"), F.coalesce(F.sum(F.when(kind.isin("conditional", "match"), F.col("branches"))), F.lit(0)).alias("conditional_branch_count"),
        n(kind == "return")("return_count"), n((kind == "return") & (depth > 0))("loop_return_count"), n((kind == "return") & F.col("divides"))("return_division_count"),
        n(kind == "call")("call_count"), n((kind == "call") & F.col("recursive"))("recursion_count"),
        n((kind == "binary") & op.isin("equal", "not_equal", "less_than", "less_than_or_equal", "greater_than", "greater_than_or_equal"))("comparison_count"),
        n(kind.isin("binary", "assignment") & (op == "divide"))("division_count"), n((kind == "conditional") & F.col("maximum"))("maximum_update_count"), n((kind == "conditional") & F.col("minimum"))("minimum_update_count"),
        n(kind == "allocation")("allocation_count"), n(kind == "drop")("ownership_transfer_count"), n(kind == "reference")("reference_count"), n(kind == "api_usage")("api_usage_count"),
        F.array_sort(F.collect_set(F.when(F.col("role").isNotNull() & F.col("category").isNotNull(), F.struct("role", "category")))).alias("types"),
        n(F.col("role") == "parameter")("parameter_count"),
    ).withColumns(
        {
            "numeric_parameter_count": F.size(F.filter("types", lambda t: (t.role == "parameter") & (t.category == "numeric"))).cast("long"),
            "numeric_return_count": F.size(F.filter("types", lambda t: (t.role == "return") & (t.category == "numeric"))).cast("long"),
            "boolean_return_count": F.size(F.filter("types", lambda t: (t.role == "return") & (t.category == "boolean"))).cast("long"),
            "accumulation_count": ((F.col("loop_count") > 0) & (F.col("addition_mutation_count") > 0)).cast("long"),
        }
    )


def name_tokens(name: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; duplicates stay."""
    return F.array_remove(F.split(F.lower(name), "[^a-z0-9]+"), "")


def _providers(rows: DataFrame, counters: dict[str, str] | None, more: list[Provider]) -> list[tuple[int, str, str, Column]]:
    """(order, kind, provider, strength) of all that is counted, in the order of evidence."""
    orders, out = {}, []
    for order, kind, provider, counter, _ in seeds.evidence_kinds():
        orders[kind] = order
        column = (counters or {}).get(kind, counter if counters is None else None)
        if column in rows.columns:
            out.append((order, kind, provider, F.coalesce(F.col(column).cast("long"), F.lit(0))))
    out += [(orders.get(kind, len(orders) + 1), kind, provider, F.coalesce(strength.cast("long"), F.lit(0))) for provider, kind, strength in more]
    return sorted(out, key=lambda x: (x[2], x[0], x[1]))


def _text(value: str | None) -> str:
    """A string in SQL."""
    return "NULL" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _item(order: int, kind: str, provider: str, strength: str, token: str | None = None) -> str:
    return f"named_struct('provider_id', {_text(provider)}, 'kind_ord', {order}, 'kind', {_text(kind)}, 'token', CAST({_text(token)} AS STRING), 'strength', CAST({strength} AS BIGINT))"


def _split(value: str, column: str) -> str:
    """SQL of ``value`` that Spark compiles in methods of a size that the JIT takes.

    Whole-stage code would be one method far beyond that. A lambda over the array ``column`` keeps the projection out
    of whole-stage code; it runs once, over one element.
    """
    return f"if(size(transform(slice({column}, 1, 1), x -> x)) > 1, NULL, {value})"


def with_evidence(rows: DataFrame, name: str = "function_name", counters: dict[str, str] | None = None, more: list[Provider] = ()) -> DataFrame:
    """``rows`` with ``evidence``: what counters above zero, ``more`` providers and words of the name say, in order.

    ``counters`` maps kinds to columns; by default those of ``facts``, of which missing ones count as zero.
    """
    given = _providers(rows, counters, list(more))
    listed = _told(rows, name, given).select("*", F.expr(_split(_items(given), "_strength")).alias("_evidence"))
    return once(listed, evidence=F.col("_evidence")).drop("_strength", "_tokens", "_evidence")


def _told(rows: DataFrame, name: str, given: list[tuple[int, str, str, Column]]) -> DataFrame:
    """``rows`` with ``_strength`` of what is given, and the ``_tokens`` of the name."""
    return once(rows, _strength=F.array(*(x[3] for x in given)) if given else F.array().cast("array<bigint>"), _tokens=name_tokens(F.coalesce(F.col(name), F.lit(""))))


def _items(given: list[tuple[int, str, str, Column]]) -> str:
    """SQL of ``evidence``. What is given is in order, and words have a place in it, so nothing but the words is sorted."""
    places = [(provider, order, kind) for order, kind, provider, _ in given]
    items = [f"if(_strength[{i}] > 0, {_item(*x[:3], f'_strength[{i}]')}, NULL)" for i, x in enumerate(given)]
    before = sum(x < ("naming", 0, "name") for x in places)
    tokens = f"transform(sort_array(_tokens), t -> {_item(0, 'name', 'naming', '1').replace('CAST(NULL AS STRING)', 't')})"
    parts = [f"array_compact(array({', '.join(part)}))" for part in (items[:before], items[before:]) if part]
    shown = f"concat({', '.join([*parts[: before > 0], tokens, *parts[before > 0 :]])})"
    return shown if len(set(places)) == len(places) and ("naming", 0, "name") not in places else f"sort_array({shown})"


def evidence_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """The items of ``evidence``, one a row."""
    return rows.select(*keys, F.explode("evidence").alias("e")).select(*keys, "e.*")


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with ``columns`` from a generator of one row: unlike aliases of a projection, its output is never put in
    place of its name, so neither a filter nor a later expression computes it again."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


_RULES = "array<struct<id:string,kind:string,weight:int>>"


def _known(registry: dict[str, seeds.Hypothesis] | None) -> list[seeds.Hypothesis]:
    return sorted((registry or seeds.hypotheses()).values(), key=lambda h: h.id)


def _powers(known: list[seeds.Hypothesis]) -> dict[str, str]:
    """SQL of how much there is of each kind that a rule asks for."""
    kinds = sorted({r.kind for h in known for r in (*h.require, *h.support, *h.reject)})
    return {k: f"_power[{i}]" for i, k in enumerate(kinds)}


def _judged(rows: DataFrame, known: list[seeds.Hypothesis], name: str, given: list[tuple[int, str, str, Column]]) -> DataFrame:
    """``rows`` with ``_sure``, the confidence of each of ``known``, -1 for an eliminated one, and what that was worked out from."""
    p = _powers(known)
    told = _told(rows, name, given)

    def power(kind: str) -> str:
        if kind.startswith("name:"):
            return f"size(_tokens) - size(array_remove(_tokens, {_text(kind[5:])}))"
        return " + ".join([f"CAST(greatest(0, least(3, _strength[{i}])) AS INT)" for i, x in enumerate(given) if x[1] == kind] or ["0"])

    powered = once(told.select("*", F.expr(_split(f"array({', '.join(map(power, p))})", "_strength")).alias("_powers")), _power=F.col("_powers"))

    def confidence(h: seeds.Hypothesis) -> str:
        raw = " + ".join([str(h.baseline), *(f"{r.weight} * {p[r.kind]}" for r in h.support), *(f"{-r.weight} * {p[r.kind]}" for r in h.reject)])
        sure = f"greatest(0, least(100, {raw}))"
        return f"if({' OR '.join(f'{p[r.kind]} = 0' for r in h.require)}, -1, {sure})" if h.require else sure

    return once(powered.select("*", F.expr(_split(f"array({', '.join(map(confidence, known))})", "_power")).alias("_confidences")), _sure=F.col("_confidences"))


def with_primary_intent(rows: DataFrame, registry: dict[str, seeds.Hypothesis] | None = None, name: str = "function_name", counters: dict[str, str] | None = None, more: list[Provider] = ()) -> DataFrame:
    """``rows`` with ``primary_intent`` and its ``confidence`` as ``analyzed`` gives them, null without an active hypothesis, and nothing else of a report.

    Confidence and place by id are one number for each hypothesis, of which the greatest is taken: nothing is sorted.
    """
    known = _known(registry)
    return _with_best(_judged(rows, known, name, _providers(rows, counters, list(more))), known).drop(*_WORK)


def _with_best(judged: DataFrame, known: list[seeds.Hypothesis]) -> DataFrame:
    """``judged`` with ``primary_intent`` and ``confidence``."""
    n = len(known)
    best = once(judged, _best=F.expr(f"array_max(transform(_sure, (c, i) -> if(c < 0, -1, c * {n} + {n - 1} - i)))"))
    active = F.col("_best") >= 0
    ids = F.array(*(F.lit(h.id) for h in known))
    return best.withColumns({"primary_intent": F.when(active, F.element_at(ids, F.lit(n) - F.pmod("_best", F.lit(n)))), "confidence": F.when(active, F.expr(f"CAST(_best div {n} AS INT)"))})


def findable(
    rows: DataFrame, least: int, name: str = "function_name", counters: dict[str, str] | None = None, registry: dict[str, seeds.Hypothesis] | None = None, more: list[Provider] = ()
) -> DataFrame:
    """``rows`` with what a search asks of ``analyzed``, and nothing else of a report: primary_intent, confidence, pipeline,
    ``_certain``, the ids of active hypotheses of a confidence of ``least`` or more, and ``_said``, kinds (without
    underscores) and words of the evidence, both with nulls for all others: leaving these out would be a lambda, which
    Spark doesn't compile. Nothing is ranked, and no struct is made of evidence or hypotheses."""
    known, given = _known(registry), _providers(rows, counters, list(more))
    said = ", ".join(f"if(_strength[{i}] > 0, {_text(kind.replace('_', ''))}, NULL)" for i, (_, kind, _, _) in enumerate(given))
    certain = ", ".join(f"if(_sure[{i}] >= {max(0, least)}, {_text(h.id)}, NULL)" for i, h in enumerate(known))
    made = {"_said": f"concat(array({said}), _tokens)" if given else "_tokens", "_certain": f"array({certain})" if known else "CAST(array() AS array<string>)", "_pipe": _fits(known)}
    worked = _with_best(_judged(rows, known, name, given), known).select("*", *(F.expr(_split(sql, "_power")).alias(f"_{key}") for key, sql in made.items()))
    return once(once(worked, **{key: F.col(f"_{key}") for key in made}), pipeline=F.expr(_piped(known))).drop(*_WORK, *(f"_{key}" for key in made))


def with_hypotheses(
    rows: DataFrame, registry: dict[str, seeds.Hypothesis] | None = None, detail: bool | set[str] = True, name: str = "function_name", counters: dict[str, str] | None = None, more: list[Provider] = ()
) -> DataFrame:
    """``rows`` with ``hypotheses``, ranked: active before eliminated, by confidence, then id.

    A hypothesis is eliminated, with confidence 0, if it requires evidence that is missing. Else its baseline, plus
    weight times strength (1 to 3) of every supporting item, less those of rejecting ones, is its confidence, 0 to 100.
    With ``detail``, of all or of the ids named, they also hold their supporting evidence, and the missing and
    contradicting rules; those of others are null. ``name``, ``counters`` and ``more`` are as for ``with_evidence``.
    """
    known, given = _known(registry), _providers(rows, counters, list(more))
    ranked = _ranked(_judged(rows, known, name, given), known, given, detail)
    return once(ranked.select("*", F.expr(_shown(known, detail)).alias("_hypotheses")), hypotheses=F.col("_hypotheses")).drop(*_WORK, "_hypotheses")


#: Columns that lead to a report and are none of it.
_WORK = ["_strength", "_tokens", "_power", "_powers", "_sure", "_confidences", "_best", "_ranks", "_made", "_pipe"]


def _ranked(judged: DataFrame, known: list[seeds.Hypothesis], given: list[tuple[int, str, str, Column]], detail: bool | set[str]) -> DataFrame:
    """``judged`` with ``_ranks``: a number for each of ``known``, in whose order they are ranked, from elimination, confidence and
    place by id; so numbers are sorted, not structs. With ``_pipe``, the number of the pipeline that fits or -1, and ``_made``, what
    ``detail`` asks for."""
    n, p = len(known), _powers(known)

    def rules(which: tuple[seeds.Rule, ...], test: str) -> str:
        shown = ", ".join(f"if({p[r.kind]} {test}, named_struct('id', {_text(r.id)}, 'kind', {_text(r.kind)}, 'weight', {r.weight}), NULL)" for r in which)
        return f"array_compact(array({shown}))" if which else f"CAST(array() AS {_RULES})"

    def supporting(h: seeds.Hypothesis) -> str:
        wanted = list(dict.fromkeys(r.kind for r in h.support))
        items = [(provider, order, kind, f"if(_strength[{i}] > 0, {_item(order, kind, provider, f'_strength[{i}]')}, NULL)") for i, (order, kind, provider, _) in enumerate(given) if kind in wanted]
        items += [("naming", 0, k, f"if({p[k]} > 0, {_item(0, 'name', 'naming', '1', k[5:])}, NULL)") for k in wanted if k.startswith("name:")]
        return f"array_compact(array({', '.join(x[3] for x in sorted(items))}))" if items else f"CAST(array() AS array<{_ITEM}>)"

    def one(h: seeds.Hypothesis) -> str:
        full = detail is True or h.id in detail
        parts = {"supporting": (lambda: supporting(h), f"array<{_ITEM}>"), "missing": (lambda: rules(h.require, "= 0"), _RULES), "contradicting": (lambda: rules(h.reject, "> 0"), _RULES)}
        return f"named_struct({', '.join(f'{_text(key)}, {of() if full else f"CAST(NULL AS {kind})"}' for key, (of, kind) in parts.items())})"

    columns = {"_ranks": f"sort_array(array({', '.join(f'if(_sure[{i}] < 0, 101, 100 - _sure[{i}]) * {n} + {i}' for i in range(n))}))", "_pipe": _fits(known)}
    if detail is not False:
        columns["_made"] = f"array({', '.join(map(one, known))})"
    worked = judged.select("*", *(F.expr(_split(sql, "_power")).alias(f"_{name}") for name, sql in columns.items()))
    return once(worked, **{name: F.col(f"_{name}") for name in columns}).drop(*(f"_{name}" for name in columns))


def _shown(known: list[seeds.Hypothesis], detail: bool | set[str]) -> str:
    """SQL of ``hypotheses`` from what ``_ranked`` gives: unrolled, as an array of numbers would be turned into structs one by one in a lambda."""
    n, ids = len(known), f"array({', '.join(_text(h.id) for h in known)})"

    def one(r: str) -> str:
        sure = f"greatest(0, 100 - CAST({r} div {n} AS INT))"
        extra = "".join(f", '{key}', get(_made, {r} % {n}).{key}" for key in ("supporting", "missing", "contradicting")) if detail is not False else ""
        return f"named_struct('status_rank', if({r} >= {101 * n}, 1, 0), 'order', -{sure}, 'id', get({ids}, {r} % {n}), 'status', if({r} >= {101 * n}, 'eliminated', 'active'), 'confidence', {sure}{extra})"

    return _split(f"array({', '.join(one(f'_ranks[{i}]') for i in range(n))})", "_ranks")


def _pipelines() -> list[tuple[int, tuple[str, list[str], list[str]]]]:
    """Known pipelines by number, the longest first."""
    return list(enumerate(sorted(seeds.pipelines(), key=lambda x: (-len(x[1]), x[0]))))


def _fits(known: list[seeds.Hypothesis]) -> str:
    """SQL of the number of the pipeline that fits, or -1."""
    place, fits = {h.id: i for i, h in enumerate(known)}, []
    for number, (_, stages, words) in _pipelines():
        if all(x in place for x in stages):
            test = " AND ".join([*(f"array_contains(_tokens, {_text(x)})" for x in words), *(f"_sure[{place[x]}] >= 0" for x in stages)])
            fits.append(f"WHEN {test or 'true'} THEN {number}")
    return f"CASE {' '.join(fits)} ELSE -1 END" if fits else "-1"


def _piped(known: list[seeds.Hypothesis]) -> str:
    """SQL of ``pipeline`` from its number."""
    place, empty = {h.id: i for i, h in enumerate(known)}, "CAST(array() AS array<struct<id:string,confidence:int>>)"
    staged = lambda stages: "array(" + ", ".join(f"named_struct('id', {_text(x)}, 'confidence', _sure[{place[x]}])" for x in stages) + ")"
    pipes = [f"WHEN {number} THEN {staged(stages)}" for number, (_, stages, _) in _pipelines() if all(x in place for x in stages)]
    return f"CASE _pipe {' '.join(pipes)} ELSE {empty} END" if pipes else empty


def analyzed(
    rows: DataFrame, name: str = "function_name", counters: dict[str, str] | None = None, registry: dict[str, seeds.Hypothesis] | None = None, detail: bool | set[str] = True, more: list[Provider] = ()
) -> DataFrame:
    """Facts with evidence, hypotheses, primary_intent, the first active one, its confidence, and pipeline, the longest
    known one whose stages are all active and whose words are all in the name."""
    known, given = _known(registry), _providers(rows, counters, list(more))
    ranked = _ranked(_judged(rows, known, name, given), known, given, detail)
    n, first = len(known), "_ranks[0]"
    made = {
        "evidence": _items(given), "hypotheses": _shown(known, detail), "primary_intent": f"if({first} < {101 * n}, get(array({', '.join(_text(h.id) for h in known)}), {first} % {n}), NULL)",
        "confidence": f"if({first} < {101 * n}, 100 - CAST({first} div {n} AS INT), NULL)", "pipeline": _piped(known),
    }
    worked = ranked.select("*", *(F.expr(sql if key == "hypotheses" else _split(sql, "_power")).alias(f"_{key}") for key, sql in made.items()))
    return once(worked, **{key: F.col(f"_{key}") for key in made}).drop(*_WORK, *(f"_{key}" for key in made))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by keys over as many tasks as may run at once: scoring costs far more than its few bytes make Spark expect."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def query_metadata() -> Column:
    """The sorted distinct ids that a report can be found by: primary intent, stages and active hypotheses."""
    return F.expr("array_sort(array_distinct(filter(concat(array(primary_intent), transform(pipeline, s -> s.id), transform(filter(hypotheses, h -> h.status = 'active'), h -> h.id)), x -> x IS NOT NULL)))")
