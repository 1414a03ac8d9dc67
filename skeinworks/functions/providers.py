"""Evidence from outside the built-in rules: providers as table functions, to be used from SQL over any table of facts.

A provider is a plain function of a row of facts. As a table function it takes a whole table and the name of its key
column, and gives (key, provider_id, kind, strength): the key's name and type are those of the table it is given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: What a provider says of one row: kinds and strengths.
Collect = Callable[[Row], Iterable[tuple[str, int]]]


def register(spark: SparkSession, name: str, provider_id: str, collect: Collect) -> None:
    """Makes ``collect`` the table function ``name``: ``SELECT * FROM name(TABLE(facts), 'key')``.

    Strengths of zero or less, or null, are no evidence. A row of a null key keeps it. Rows go to Python in Arrow batches.
    """

    class Evidence:
        @staticmethod
        def analyze(facts: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
            if not facts.isTable or not key.isConstantExpression or not isinstance(key.value, str):
                raise ValueError(f"{name} takes a table and the name of its key column")
            found = [f for f in facts.dataType.fields if f.name == key.value]
            if len(found) != 1:
                raise ValueError(f"the table has no column {key.value}, or several")
            return AnalyzeResult(StructType([StructField(key.value, found[0].dataType), StructField("provider_id", StringType()), StructField("kind", StringType()), StructField("strength", LongType())]))

        def eval(self, facts: Row, key: str):
            for kind, strength in collect(facts):
                if strength is not None and strength > 0:
                    yield facts[key], provider_id, kind, int(strength)

    spark.udtf.register(name, F.udtf(Evidence, useArrow=True))


def evidence(facts: DataFrame, name: str, key: str) -> DataFrame:
    """What the table function ``name`` says of ``facts``."""
    return facts.sparkSession.sql(f"SELECT * FROM {name}(TABLE({{facts}}), {{key}})", facts=facts, key=key)
