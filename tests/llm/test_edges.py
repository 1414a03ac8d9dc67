"""Every operator and stage on least and greatest ids, null and repeated rows, very long texts, and columns of any name that the operators use themselves."""

import random

import pytest

import corpus_pipeline
from skeinworks.llm.decontaminate import contamination
from skeinworks.llm.exact_dedup import exact_duplicates
from skeinworks.llm.fim import fill_in_middle
from skeinworks.llm.near_dedup import near_duplicates
from skeinworks.llm.packing import packed
from skeinworks.llm.pii import personal_data
from skeinworks.llm.repeats import repeated_passages
from skeinworks.llm.sharding import sharded
from skeinworks.llm.tokens import token_counts, tokenizer_path
from skeinworks.llm.toxicity import toxicity
from skeinworks.llm.vectors import compressed
from skeinworks.llm.warc import archived

NAMES = "id row kept key band root n size best group_size _id _toxic _row _rows copies a b items words n_words shard slot text_crc32 part length start offset h1 output form state place label code error salt value path record".split()
LEAST, GREATEST = -(2**63), 2**63 - 1


def texts():
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    prose = [" ".join(word() for _ in range(n)) for n in (70, 90, 8)]
    long = "\n".join(" ".join(word() for _ in range(40)) for _ in range(3000))
    return [(LEAST, prose[0]), (GREATEST, prose[0]), (None, prose[0]), (0, prose[1]), (0, prose[1]), (1, None), (2, ""), (None, None), (3, prose[2] + " a@b.co +1 (269) 555-3296 4524132264652876"), (4, long), (5, long + " end"), (6, "x" * 300_000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "web", 1, *(f"{k}" for k in range(len(NAMES)))) for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.fixture(scope="module")
def labels(spark, docs):
    return spark.createDataFrame([(LEAST, 1, 0, "x"), (GREATEST, 0, 1, "x"), (0, 1, 0, "x"), (3, None, 1, "x"), (None, 1, 1, "x"), (4, 1, None, "x")], "doc_id long, quality int, toxic int, text string")


BENCHMARK = [(LEAST, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "x"), (None, "short item", "x"), (1, None, "x")]
OPERATORS = {
    "contamination": lambda d, lab, b: contamination(d, b), "sharded": lambda d, lab, b: sharded(d, shards=4), "token_counts": lambda d, lab, b: token_counts(d, tokenizer_path("word_bpe_49k.json"), limit=2048), "toxicity": lambda d, lab, b: toxicity(d, lab),
    "near_duplicates": lambda d, lab, b: near_duplicates(d), "exact_duplicates": lambda d, lab, b: exact_duplicates(d), "fill_in_middle": lambda d, lab, b: fill_in_middle(d), "personal_data": lambda d, lab, b: personal_data(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_keep_every_row(spark, docs, labels, name):
    benchmark = spark.createDataFrame(BENCHMARK, "item_id long, text string, doc_id string")
    got = OPERATORS[name](docs, labels, benchmark).select("doc_id").collect()
    order = lambda ids: sorted(ids, key=lambda i: (i is not None, i or 0))
    assert order(r.doc_id for r in got) == order(i for i, _ in texts())
    assert OPERATORS[name](docs.limit(0), labels.limit(0), benchmark.limit(0)).count() == 0


def test_pieces_and_passages(spark, docs):
    pieces = packed(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in texts()} and all(0 < r.length <= 2048 for r in pieces)
    assert repeated_passages(docs).count() > 0


def test_pages(spark):
    pages = spark.createDataFrame([(i, "u", t, *(str(k) for k in range(len(NAMES)))) for i, t in texts()], "page_id long, url string, html string, " + ", ".join(f"`{n}` string" for n in NAMES))
    got = archived(pages).collect()
    assert len(got) == len(texts()) and {r.page_id for r in got if r.record_type == "response"} >= {LEAST, 0, 1, 3, 4, 5, 6}


def test_vectors(spark):
    rows = [(LEAST, [0.5] * 8), (GREATEST, [3e38] * 8), (None, [0.0] * 8), (None, None), (0, [-0.25] * 8), (0, [-0.25] * 8)]
    table = spark.createDataFrame([(i, v, None, *(str(k) for k in range(len(NAMES) - 1))) for i, v in rows], "vec_id long, embedding array<float>, label int, " + ", ".join(f"`{n}` string" for n in NAMES if n != "label"))
    assert sorted((r.vec_id is not None, r.vec_id or 0) for r in compressed(table).collect()) == [(False, 0), (True, LEAST), (True, 0), (True, 0), (True, GREATEST)]


def test_stages_keep_the_columns(spark, docs, labels, tmp_path):
    labels.filter("toxic = 0").write.parquet(f"{tmp_path}/labels.parquet")  # one class alone calls nothing toxic
    spark.createDataFrame(BENCHMARK, "item_id long, text string, doc_id string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and 0 < got.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
