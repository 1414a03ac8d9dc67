"""The ten operators and the pipeline against brute force, on small tables with nulls, empties, ties, repeats and clashing names."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skeinworks.llm import near_dedup, packing, queries
from skeinworks.llm import toxicity as toxicity_module
from skeinworks.llm.chat import escape, formatted, parse, read_back, turns_as_events, unescape
from skeinworks.llm.decontaminate import contamination, drop_contaminated, items_sha256
from skeinworks.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from skeinworks.llm.near_dedup import drop_near_duplicates, idf_table, near_duplicates, shingles, similarity
from skeinworks.llm.packing import packed
from skeinworks.llm.repeats import repeated_passages
from skeinworks.llm.sharding import sharded
from skeinworks.llm.tokens import token_counts, tokenizer, tokenizer_path
from skeinworks.llm.toxicity import drop_toxic, held_out, toxicity
from skeinworks.llm.warc import archived
from skeinworks.llm.words import chunks

rng = random.Random(3)
VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mé", "nu", "Pi", "ra") for b in ("tor", "vex", "lin", "9", "dum", "sée", "fo")]
PROSE = [" ".join(rng.choice(VOCABULARY) for _ in range(n)) for n in (3, 40, 80, 120, 200, 12, 60)]
NEAR = " ".join((PROSE[4].split())[:198] + ["changed", "end"])
LONG = " ".join(rng.choice(VOCABULARY) for _ in range(6000))
DOCS = [
    (1, PROSE[1]), (2, PROSE[1].replace(" ", "\t\n ")), (3, PROSE[1].replace(" ", "")), (4, None), (5, ""), (6, " \n\x0b"), (7, PROSE[4]), (8, NEAR), (9, LONG),
    (10, PROSE[2] + ". " + PROSE[3]), (11, "x! " + PROSE[3] + " <|endoftext|> y"), (12, PROSE[0]), (12, PROSE[0]), (None, PROSE[5]), (14, "!!! ..."), (15, PROSE[6] + "   " + PROSE[6].upper()),
]
SCHEMA = "doc_id long, text string, n_tokens string, keep_id string, class_id string, shard string, id string"
EMPTY = [(None,) * 7][:0]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in DOCS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame(EMPTY, SCHEMA)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_exact_dedup(docs, none):
    got = exact_duplicates(docs, support=0.3).collect()
    groups = defaultdict(list)
    for i, t in DOCS:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((i, len(t or "")))
    assert len(got) == len(DOCS) and sum(r.kept for r in got) == len(groups)
    for r in got:
        group = groups[r.text_sha256]
        assert r.group_size == len(group)
        assert r.keep_id == max(group, key=lambda x: (x[1], x[0] is not None, -(x[0] or 0)))[0]
    kept = drop_exact_duplicates(docs, support=0.3)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_duplicates(none).count() == 0


ITEMS = [(1, PROSE[3]), (2, PROSE[0]), (3, None), (None, " ".join(PROSE[3].split()[50:])), (5, "?"), (6, PROSE[3])]


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_contamination_by_brute_force(spark, docs, bound):
    got = contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), broadcast_bytes=bound).collect()
    want = []
    for i, t in DOCS:
        own, hit, items = words(t), set(), set()
        for name, text in ITEMS:
            w = words(text)
            n = min(13, len(w))
            runs = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
            for j in range(len(own) - n + 1 if w else 0):
                if tuple(own[j : j + n]) in runs:
                    hit |= set(range(j, j + n))
                    items.add("null" if name is None else str(name))
        want.append((str(i), len(own), len(hit), items_sha256(list(items))))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, items_sha256(r["items"])) for r in got) == sorted(want)
    assert any(x[2] for x in want)


def hits(text, items):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        n = min(13, len(w))
        runs = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
        for j in range(len(own) - n + 1 if w else 0):
            if tuple(own[j : j + n]) in runs:
                hit |= set(range(j, j + n))
                found.add(str(name))
    return len(hit), sorted(found)


def test_contamination_of_texts_that_repeat_themselves(spark):
    items = [(1, "a " * 400), (2, "a b " * 150 + "end"), (3, "a " * 20 + "b " * 20), (4, "x " + "a " * 11 + "y"), (5, "a b c " * 90)]
    texts = ["a " * 3000, "a " * 12 + "b", "a b " * 40 + "end", "b a " * 300, "q " * 500 + "a " * 13 + "b " * 12 + "q", "a b c " * 500 + "a " * 14, "y " + "a " * 11 + "x"]
    got = contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_hit, r["items"]) for r in got} == {i: hits(t, items) for i, t in enumerate(texts)}
    begin = time.perf_counter()  # places times places would be 10 ** 11
    got = contamination(spark.createDataFrame([(1, "a b " * 400000)], "doc_id long, text string"), spark.createDataFrame([(1, "a b " * 100000)], "item_id long, text string")).first()
    assert got.n_hit == 800000 and time.perf_counter() - begin < 60


def test_sharding(docs, none):
    got = sharded(docs, shards=4).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in DOCS)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len({r.shard for r in got if r.doc_id == 12}) == 1
    assert sharded(none).count() == 0


def test_sharding_deals_a_hot_group_and_balances(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "if(id % 3 = 0, repeat('hot ', 30), repeat(concat('w', id, ' '), CAST(10 + id % 40 AS INT))) AS text")
    load = Counter()
    for r in sharded(rows, shards=16).collect():
        load[r.shard] += r["size"]
    assert len(load) == 16 and max(load.values()) < 1.02 * min(load.values())


def test_sharding_deals_a_hot_group_of_null_ids(spark):
    rows = spark.range(4000).selectExpr("CAST(NULL AS LONG) AS doc_id", "if(id % 2 = 0, repeat('hot ', 3), concat('w', id, ' x y')) AS text")
    got = sharded(rows, shards=16).collect()
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    assert len(got) == 4000 and len(load) == 16 and max(load.values()) < 1.05 * min(load.values())
    for shard in load:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_token_counts(docs, none):
    path = tokenizer_path("word_bpe_49k.json")
    got = token_counts(docs, path, limit=100).collect()
    want = [(str(i), len((t or "").encode()), len(tokenizer(path).encode(t or "", add_special_tokens=False).ids)) for i, t in DOCS]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted(want)
    assert all(r.over_limit == (r.n_tokens > 100) for r in got) and token_counts(none, path).count() == 0


def test_packing(docs, none):
    path = tokenizer_path("byte_bpe_50k.json")
    got = packed(docs, path, capacity=256).collect()
    want = []
    for i, t in DOCS:
        ids = np.array([*tokenizer(path).encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        n = len(ids)
        cuts = [0, *range(n % 256 or 256, n, 256), n] if n > 256 else [0, n]
        want += [(str(i), p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packed(none, path).count() == 0


def test_a_plan_is_near_the_volume_bound():
    draw = np.random.default_rng(1)
    counts = Counter(int(x) for x in np.clip(draw.lognormal(5.5, 0.9, 20000), 1, 2048))
    places = packing.plan(dict(counts), 2048)
    assert Counter({int(k): int(places[places[:, 0] == k, 2].sum()) for k in counts}) == counts
    bins = int((places[:, 3] + places[:, 2]).max())
    assert bins <= 1.01 * sum(k * n for k, n in counts.items()) / 2048 + 2


@pytest.mark.parametrize("mean", [4.5, 5.5, 6.5, 7.2])
def test_a_plan_is_the_programs(mean):
    """Nearly all large pieces lie in the program's configurations, and these cost no bins: best fit of everything needs as many."""
    draw = np.random.default_rng(2)
    counts = Counter(int(x) for x in np.clip(draw.lognormal(mean, 0.9, 30000), 1, 2048))
    runs = packing.configured(dict(counts), 2048)
    inside = sum(number * len(lengths) for number, lengths in runs)
    large = sum(n for x, n in counts.items() if 2048 // packing.SMALL < x < 2048)
    assert all(sum(lengths) <= 2048 for _, lengths in runs) and inside >= (0.9 if large > 3000 else 0.6) * large
    places = packing.plan(dict(counts), 2048)
    plain = packing.Bins(2048)
    for length in sorted(counts, reverse=True):
        plain.best_fit(length, counts[length])
    assert int((places[:, 3] + places[:, 2]).max()) <= 1.002 * plain.number() + 1


def test_near_duplicates(docs, none):
    got = {r.doc_id: r for r in near_duplicates(docs).collect() if r.doc_id}
    assert got[7].class_id == got[8].class_id == 7 and got[7].class_size == 2
    assert got[1].class_id == got[2].class_id == 1  # equal words
    assert all(got[i].class_id == i for i in (3, 4, 5, 6, 9, 10, 11, 14))
    assert near_duplicates(docs).count() == len(DOCS) and near_duplicates(none).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    pick = random.Random(5)
    base = [[pick.choice(VOCABULARY) + str(pick.randrange(90)) for _ in range(150)] for _ in range(12)]
    rows = []
    for i in range(240):
        own = list(base[0 if i % 3 == 0 else i % 12])
        own[pick.randrange(150)] = f"new{i}"
        rows.append((i, " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(table).collect()}
    want = {i: min(j for j, _ in rows if (0 if j % 3 == 0 else j % 12) == (0 if i % 3 == 0 else i % 12)) for i, _ in rows}
    assert got == want


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rows = [(None, PROSE[4]), (None, NEAR), (5, NEAR), (5, PROSE[3]), (5, PROSE[3]), (None, PROSE[6]), (-(2**63), "one two"), (None, None), (None, "!!")]
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, row string, kept string")
    got = sorted(((r.doc_id, r.class_id, r.class_size, r.n_links, r.similarity and round(r.similarity, 1)) for r in near_duplicates(table).collect()), key=repr)
    assert got == sorted([(None, 5, 3, 1, 1.0), (None, 5, 3, 1, 1.0), (5, 5, 3, 1, 1.0), (5, 5, 2, 0, 1.0), (5, 5, 2, 0, 1.0), (None, None, 1, 0, None), (-(2**63), -(2**63), 1, 0, None), (None, None, 1, 0, None), (None, None, 1, 0, None)], key=repr)
    left = drop_near_duplicates(table)
    assert left.columns == table.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(5, NEAR), (5, PROSE[3]), (None, PROSE[6]), (-(2**63), "one two"), (None, None), (None, "!!")])


def test_near_duplicates_find_the_links_of_all_pairs(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    rows += [(10**6 + i, " ".join([*t.split()[:-3], "some", "thing", "else"])) for i, t in rows[:60]]  # near copies at all similarities
    rows += [(2 * 10**6 + i, " ".join(w for j, w in enumerate(t.split()) if j % 45)) for i, t in rows[:60]]
    want, got = near_classes(rows, spark), {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 50 and sum(got[i] == want[i] for i in linked) >= 0.9 * len(linked)
    assert all(want[i] == want[got[i]] for i in got)  # nothing is linked that isn't alike


def near_classes(rows, spark):
    """Classes of (id, text) by comparing every pair."""
    idf, sets = idf_table(spark.createDataFrame(rows, "id long, text string")), {}
    for i, t in rows:
        for _, _, found in chunks(pa.array([t])):
            sets[i] = shingles(found, idf)[1:]
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and root[i] != root[j] and similarity(sets[i], sets[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_near_duplicates_of_chains_by_brute_force(spark):
    pick, rows = random.Random(11), []
    for chain in range(60):  # a is like b, and b like the copies around l, but a is not like these
        l = [f"{pick.choice(VOCABULARY)}{pick.randrange(900)}" for _ in range(200)]
        b = [*l[:190], *(f"b{chain}x{j}" for j in range(10))]
        a = [*(f"a{chain}x{j}" for j in range(13)), *b[13:]]
        rows += [(chain * 10 + 9 - j, " ".join([*l[: 100 + j], f"l{chain}x{j}", *l[101 + j :]])) for j in range(6)]
        rows += [(chain * 10 + 1, " ".join(b)), (chain * 10, " ".join(a))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_classes(rows, spark)
    assert len(set(want.values())) == 60
    assert {r.doc_id: r.class_id for r in near_duplicates(table).collect()} == want


def test_near_duplicates_of_a_template_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    pick = random.Random(12)
    template, rows = [f"t{j}" for j in range(120)], []
    for i in range(80):  # letters of one template, each with a chain of two more
        own = [*template[: 110], *(f"{pick.choice(VOCABULARY)}{i}x{j}" for j in range(60))]
        two = [*own[:-12], *(f"u{i}x{j}" for j in range(12))]
        rows += [(3 * i, " ".join(own)), (3 * i + 1, " ".join(two)), (3 * i + 2, " ".join([*(f"v{i}x{j}" for j in range(14)), *two[14:]]))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(table).collect()} == near_classes(rows, spark)


def test_repeated_passages(spark, docs, none):
    got = {(r.doc_id, r.other_doc_id, r.n_words) for r in repeated_passages(docs).collect()}
    assert any(a == 10 and b == 11 and n >= 120 for a, b, n in got) and any(a == 11 and b == 10 for a, b, _ in got)
    assert any(a == 7 and b == 8 and n >= 198 for a, b, n in got)
    assert not {a for a, _, _ in got} & {1, 4, 5, 6, 9, 12, 14}
    assert repeated_passages(none).count() == 0


def test_repeated_passages_keep_each_link_true(spark):
    pick = random.Random(17)
    new = lambda n: [f"{pick.choice(VOCABULARY)}{pick.randrange(10**6)}" for _ in range(n)]
    one, two, core = new(70), new(80), new(36)
    rows = {1: one + two, 2: new(20) + one + new(20), 3: new(30) + two, 4: new(10) + one[:60] + new(10)}
    pairs = [(10 + 2 * i, 11 + 2 * i) for i in range(12)]
    for a, b in pairs:  # 36 words that all share, after 19 that two share
        own = new(19)
        rows |= {a: new(25) + own + core + new(25), b: new(33) + own + core + new(12)}
    rows |= {100 + i: new(20) + core + new(20) for i in range(120)}
    found = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")).collect()
    has = {i: {tuple(w[j : j + 50]) for j in range(len(w) - 49)} for i, w in rows.items()}
    for r in found:
        assert r.n_words == r.end_word - r.start_word >= 50 and r.other_doc_id != r.doc_id
        assert all(tuple(rows[r.doc_id][j : j + 50]) in has[r.other_doc_id] for j in range(r.start_word, r.end_word - 49))
    links = {(r.doc_id, r.other_doc_id) for r in found}
    assert {(1, 3), (3, 1), (2, 1), (4, 1)} <= links and {(a, b) for p in pairs for a, b in (p, p[::-1])} <= links
    assert {r.doc_id for r in found} == {1, 2, 3, 4} | {i for p in pairs for i in p}


def test_repeated_passages_by_brute_force(spark):
    pick = random.Random(13)
    new = lambda n: [f"{pick.choice(VOCABULARY)}{pick.randrange(10**6)}" for _ in range(n)]
    tail, rows = new(40), []
    for i in range(60):  # copies that end in a common tail, which stands in many other contexts
        passage = new(14) + tail
        rows += [new(30) + passage + new(20), new(9) + passage + new(40), new(25) + tail + new(25)]
    often = new(55)
    rows += [[w for _ in range(10) for w in often + new(3)], new(5) + often + new(70)]
    places = defaultdict(set)
    for i, w in enumerate(rows):
        for at in range(len(w) - 49):
            places[tuple(w[at : at + 50])].add((i, at))
    want = defaultdict(set)
    for found in places.values():
        for i, at in found if len(found) > 1 else ():
            want[i] |= set(range(at, at + 50))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = defaultdict(set)
    for r in repeated_passages(table).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
        assert r.other_doc_id != r.doc_id
    assert got == want and len(want) == 122


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "<p>é</p>"), (2, "http://b\r\nX: y%", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "x" * 300000), (None, "u", "<p>é</p>"), (5, "v", "x" * 300000)]
    got = archived(spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, key string")).collect()
    assert len(got) == len(pages)
    assert Counter((r.page_id, r.url) for r in got) == Counter((p[0], p[1]) for p in pages)
    kinds = {(r.page_id, r.url): (r.record_type, r.refers_to) for r in got}
    assert kinds[1, "http://a"] == ("response", None) and kinds[None, "u"] == ("revisit", 1) and kinds[4, "u"] == ("revisit", 3)
    assert {kinds[5, "u"], kinds[5, "v"]} == {("response", None), ("revisit", 5)}
    assert Counter((r.page_id, r.payload) for r in got if r.record_type == "response") <= Counter((p[0], (p[2] or "").encode()) for p in pages)
    assert archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    ends = [(-(2**63), "<p>a</p>"), (2**63 - 1, "<p>a</p>"), (None, "<p>b</p>"), (2**63 - 1, "<p>b</p>")]
    got = archived(spark.createDataFrame([(i, "u", h, "z") for i, h in ends], "page_id long, url string, html string, best string")).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([(-(2**63), "response", None), (2**63 - 1, "revisit", -(2**63)), (2**63 - 1, "response", None), (None, "revisit", 2**63 - 1)])


def test_chat_folds_events(spark):
    said = "<|im_end|>\\<|im_start|>assistant ok"
    assert unescape(escape(said)) == said and "<|" not in escape(said)
    events = [
        (1, 0, 0, "message", "user", said, "q"), (1, 1, 1, "message", "assistant", "dr", "q"), (1, 1, 2, "delta", None, "aft", "q"), (1, 2, 3, "message", "user", "gone", "q"),
        (1, 1, 4, "regenerate", None, "final", "q"), (1, 3, 5, "message", "user", None, "q"), (1, 3, 6, "edit", None, "edited", "q"), (2, 0, 0, "message", "user", "x", "q"), (2, 0, 1, "delete", None, None, "q"), (None, 0, 0, "message", None, None, "q"),
    ]
    table = spark.createDataFrame(events, "conv_id long, turn long, seq long, kind string, role string, text string, chunk string")
    got = {r.conv_id: r for r in read_back(formatted(table)).collect()}
    turns = [("user", said), ("assistant", "final"), ("user", "edited")]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"final").hexdigest() and got[1].loss_chars == 5
    assert got[2].n_turns == 0 and got[None].n_turns == 1
    assert read_back(formatted(turns_as_events(table.select("conv_id", "turn", "role", "text").limit(0)))).count() == 0


def fold(events):
    """Final turns of one conversation: what each event does, one after another, in the order of turn, seq, kind, role, text."""
    turns, key = [], lambda e: tuple((x is not None, x or (0 if k < 2 else "")) for k, x in enumerate(e))
    barrier = None
    for number in sorted({e[0] for e in events}, key=lambda x: (x is not None, x or 0)):
        own = sorted((e for e in events if e[0] == number), key=key)
        state = {"role": own[0][3] or "", "text": "", "began": own[0][1], "gone": False, "again": None}
        for _, seq, kind, role, text in own:
            if kind == "delta":
                state["text"] += text or ""
            elif kind == "delete":
                state["gone"] = True
            elif kind == "edit":
                state["text"] = text or ""
            else:
                state |= {"text": text or "", "role": state["role"] if role is None else role, "began": seq, "gone": False}
                if kind == "regenerate":
                    state["again"] = seq
        if not state["gone"] and (barrier is None or state["began"] is None or state["began"] > barrier):
            turns.append((state["role"], state["text"]))
        if state["again"] is not None:
            barrier = state["again"] if barrier is None else max(barrier, state["again"])
    return turns


def test_chat_folds_random_logs_by_brute_force(spark):
    pick, logs = random.Random(8), []
    for conv in range(150):
        for seq in range(pick.randrange(1, 25)):
            kind = pick.choice(["message", "delta", "delta", "edit", "regenerate", "delete"])
            logs.append((conv, pick.randrange(6), seq, kind, pick.choice(["user", "assistant", "a\nb\\", None]), pick.choice(["x", "<|im_end|>", "\\", "é\n", None, ""])))
    pick.shuffle(logs)
    table = spark.createDataFrame(logs, "conv_id long, turn long, seq long, kind string, role string, text string")
    text, got = defaultdict(dict), {r.conv_id: r for r in read_back(formatted(table)).collect()}
    for r in formatted(table).collect():
        text[r.conv_id][r.chunk] = r.formatted
    for conv in got:
        want = fold([e[1:] for e in logs if e[0] == conv])
        assert [t for _, part in sorted(text[conv].items()) for t in parse(part)] == want
        learned = "".join(t for r, t in want if r == "assistant")
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(want), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert len(got) == 150


def test_chat_keeps_rows_of_equal_and_null_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, "user", "c"), (1, None, "assistant", "d"), (1, 2, "user", "e"), (None, None, "user", "f"), (None, None, "user", "g")]
    got = {r.conv_id: r for r in read_back(formatted(turns_as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    for conv in (1, None):
        own = sorted((t is None, t or 0, r, x) for c, t, r, x in rows if c == conv)
        learned = "".join(x for _, _, r, x in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(own), len(learned))
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_toxicity_on_held_out_labels(spark, docs, none):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity(table, labels).join(labels.filter(held_out()), "doc_id")
    rows = scored.select(F.col("severity"), (F.col("grade") > 0).alias("found"), labels.toxic.alias("truth")).collect()
    right = sum(r.found and bool(r.truth) for r in rows)
    assert right >= 0.8 * sum(bool(r.truth) for r in rows) and right >= 0.95 * sum(r.found for r in rows) and right
    no_labels = labels.limit(0)
    assert all(r.severity == 0 and not r.toxic for r in toxicity(docs, no_labels).collect())
    assert toxicity(none, labels).count() == 0
    clashing = table.limit(200).selectExpr("*", "1 AS _id", "2 AS _toxic", "3 AS toxic", "4 AS weight", "5 AS kept", "6 AS severity")
    assert drop_toxic(clashing, labels).columns == clashing.columns and drop_toxic(clashing, labels.selectExpr("*", "1 AS _id", "2 AS n", "3 AS text")).count() <= 200


def test_pipeline_stage_by_stage(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf)
        assert after.columns == table.columns, name
        kept = spark.createDataFrame(after.toPandas(), table.schema)
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) and 0 < len(texts) < table.count()
    pieces = corpus_pipeline.run(spark, sf).select("doc_id").distinct()
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in kept.collect()}


def test_pipeline_by_brute_force(spark, tmp_path):
    """Null, repeated and clashing ids: what every stage leaves, from plain definitions."""
    pick = random.Random(23)
    text = lambda n: " ".join(f"{pick.choice(VOCABULARY)}{pick.randrange(500)}" for _ in range(n))
    bad = lambda n: " ".join(pick.choice(["vileword", "hatespeak", "scumtalk"]) if pick.random() < 0.3 else f"w{pick.randrange(500)}" for _ in range(n))
    train = [(10**6 + i, bad(60) if i % 3 == 0 else text(60)) for i in range(300)]
    test = [text(80) for _ in range(3)]
    base = [text(120) for _ in range(40)]
    rows = [(None, t) for t in base] + [(7, t) for t in base[:5]] + [(None, t + " ") for t in base[5:9]] + [(7, bad(80)) for _ in range(4)] + [(None, bad(80)) for _ in range(4)]
    rows += [(None, test[i % 3][: -5 * i or None] + " tail") for i in range(3)] + [(7, text(400) + " " + " ".join(test[0].split()[:13])), (None, None), (None, ""), (3, "!!"), (None, "!! ??")]
    rows += [(i, " ".join([*t.split()[:-1], f"other{i}"])) for i, t in enumerate(base[10:20])] + train
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10**6 + i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(test)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    blank = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    kept = [(i, t) for i, t in rows if "vileword" not in (t or "") and "hatespeak" not in (t or "") and "scumtalk" not in (t or "")]
    groups = defaultdict(list)
    for i, t in kept:
        groups[blank(t)].append((i, t))
    kept = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    classes = near_classes(list(enumerate(t or "" for _, t in kept)), spark)
    groups = defaultdict(list)
    for n, (i, t) in enumerate(kept):
        groups[classes[n] if words(t) else ("none", n)].append((i, t))
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    kept = [(i, t) for i, t in kept if not (h := hits(t, enumerate(test))[0]) or 20 * h < len(words(t))]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert Counter((r.doc_id, blank(r.text)) for r in docs.collect()) == Counter((i, blank(t)) for i, t in kept)
    pieces = corpus_pipeline.pack(spark, docs, str(tmp_path)).filter("piece = 0")
    assert Counter(r.doc_id for r in pieces.collect()) == Counter(i for i, _ in kept)


def test_null_ids_lose_no_clean_documents(spark):
    folder = "/root/testdata/sf0.01"
    copied = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").filter("length(text) > 200").limit(3).collect()]
    rows = [(None, f"{PROSE[i % 7]} {i} and so on") for i in range(197)] + [(None, t) for t in copied]
    left = drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert left.count() == 197
    assert drop_toxic(left, spark.read.parquet(f"{folder}/labels.parquet"), known=spark.read.parquet(f"{folder}/documents.parquet")).columns == ["doc_id", "text"]


def test_very_long_texts(spark):
    """A text of over a megabyte of one word, one of as many different words."""
    many = " ".join(f"w{i}" for i in range(180000))
    table = spark.createDataFrame([(1, "z" * (1 << 20)), (2, many), (3, many + " more")], "doc_id long, text string")
    near = {r.doc_id: r.class_id for r in near_duplicates(table).collect()}
    assert near == {1: 1, 2: 2, 3: 2}
    assert {(r.doc_id, r.n_words) for r in repeated_passages(table).collect()} == {(2, 180000), (3, 180000)}
    assert {r.doc_id: r.n_words for r in contamination(table, table.limit(0).withColumnRenamed("doc_id", "item_id")).collect()} == {1: 1, 2: 180000, 3: 180001}
    assert exact_duplicates(table).filter("kept").count() == sharded(table).count() == 3


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_ordinal_regression_by_brute_force():
    """The fit's optimum by numeric gradients, and expected severity from the definition."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3)).astype(np.float32)
    grade = np.digitize(x @ [1.5, -0.7, 0.0] + rng.logistic(size=120) * 0.7, [0.0, 1.2])
    worth = rng.uniform(0.2, 2, 120)
    weight, thresholds = toxicity_module.ordinal(x, grade, worth)
    assert thresholds[0] < thresholds[1]

    def loss(p):
        up = 1 / (1 + np.exp(p[None, 3:] - (x @ p[:3])[:, None]))
        edge = np.concatenate([np.ones((120, 1)), up, np.zeros((120, 1))], axis=1)
        chance = edge[np.arange(120), grade] - edge[np.arange(120), grade + 1]
        return -(worth / worth.sum()) @ np.log(chance) + toxicity_module.DECAY / 2 * (p[:3] ** 2).sum()

    best = np.concatenate([weight, thresholds])
    for k in range(5):
        step = 1e-4 * (np.arange(5) == k)
        assert abs((loss(best + step) - loss(best - step)) / 2e-4) < 2e-3
    for _ in range(50):
        assert loss(best) <= loss(best + rng.normal(size=5) * 0.05) + 1e-5
    model = toxicity_module.Model(np.array([]), np.array([]), weight, thresholds)
    up = model.severity(x)
    for row, own in zip(x[:20], up[:20], strict=True):
        chance = [1 / (1 + np.exp(t - row @ weight)) for t in thresholds]
        assert np.allclose(own, chance, atol=1e-5) and np.isclose(own.sum(), (chance[0] - chance[1]) + 2 * chance[1], atol=1e-5)
