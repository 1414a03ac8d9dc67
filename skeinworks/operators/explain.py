"""Text reports of analyzed functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.functions import seeds


def title(identifier: str) -> str:
    """SQL that shows an identifier: words with a capital."""
    return f"array_join(transform(filter(split({identifier}, '_'), w -> w != ''), w -> concat(upper(left(w, 1)), substr(w, 2))), ' ')"


def _label(kind: str, token: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{label}'" for _, k, _, _, label in seeds.evidence_kinds())
    return f"CASE {kind} WHEN 'name' THEN concat('name token ''', {token}, '''') {cases} END"


def explanation() -> Column:
    """The report of a row of ``analyzed``: intent, pipeline, evidence, three alternatives, three eliminations."""
    lines = f"""concat(array(concat('Function: ', function_name),
        if(primary_intent IS NULL, 'Primary intent: no active hypothesis', concat('Primary intent: ', {title("primary_intent")}, ' (', confidence, '%)')),
        if(size(pipeline) = 0, 'Semantic pipeline: none', concat('Semantic pipeline: ', array_join(transform(pipeline, s -> concat({title("s.id")}, ' (', s.confidence, '%)')), ' -> '))),
        'Observed evidence:'),
      if(size(evidence) = 0, array('  - none'), transform(evidence, e -> concat('  - ', {_label("e.kind", "e.token")}, ' [', {title("e.provider_id")}, '; strength ', e.strength, ']'))),
      if(size(_others) = 0, array(), concat(array('Other active hypotheses:'), transform(slice(_others, 1, 3), h -> concat('  - ', {title("h.id")}, ' (', h.confidence, '%)')))),
      if(size(_gone) = 0, array(), concat(array('Constraint eliminations:'),
        transform(slice(_gone, 1, 3), h -> concat('  - ', {title("h.id")}, ': ', array_join(transform(h.missing, r -> concat('missing ', {_label("if(r.kind LIKE 'name:%', 'name', r.kind)", "substr(r.kind, 6)")}, ' (', {title("r.id")}, ')')), '; ')))),
      ),
      if(size(_gone) > 3, array(concat('  - ', size(_gone) - 3, ' additional hypotheses eliminated')), array()))"""
    return F.concat(F.array_join(F.expr(lines.replace(",\n      ),", "),")), "\n"), F.lit("\n"))


def explained(reports: DataFrame) -> DataFrame:
    """``reports`` of ``analyzed`` with ``explanation``."""
    gone = "transform(array_sort(transform(filter(hypotheses, h -> h.status = 'eliminated'), h -> struct(-size(h.supporting) AS few, h.id AS id, h AS h))), x -> x.h)"
    prepared = reports.withColumn("_others", F.expr("filter(hypotheses, h -> h.status = 'active' AND NOT (h.id <=> primary_intent))")).withColumn("_gone", F.expr(gone))
    return prepared.withColumn("explanation", explanation()).drop("_others", "_gone")
