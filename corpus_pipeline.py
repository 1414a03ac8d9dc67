"""Documents made ready for training, stage by stage: toxic ones go, exact and near copies go, contaminated ones go, the rest is packed.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``docs``. Each row is judged by itself, under a number of its own or where it is read, so no row goes or
stays for another row of its doc_id, null or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinworks.llm.decontaminate import drop_contaminated
from skeinworks.llm.exact_dedup import drop_exact_duplicates
from skeinworks.llm.near_dedup import drop_near_duplicates
from skeinworks.llm.packing import packed
from skeinworks.llm.store import new_folder
from skeinworks.llm.tokens import tokenizer_path
from skeinworks.llm.toxicity import drop_toxic


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier clean than not."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks, the longest, then the smallest doc_id."""
    return drop_exact_duplicates(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the smallest doc_id, null last. A document without words is no near duplicate."""
    return drop_near_duplicates(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are in passages of ``benchmark``."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, and where they lie in sequences of at most 2048."""
    return packed(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048)


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("MinHash near-dedup", dissimilar), ("benchmark decontamination", untested), ("best-fit packing", pack)]

#: A fitted classifier, weighted sampling and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
