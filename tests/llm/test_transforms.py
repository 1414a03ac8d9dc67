"""Operators 11 to 13 against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinworks.llm import pii
from skeinworks.llm.fim import SENTINELS, automaton, fill_in_middle, restored
from skeinworks.llm.vectors import compressed, nearest

EXTRA = "doc_id long, text string, n string, row string, chunk string, h1 string, output string"
BITS = ["a", "é", "\n", "<", "P", "<P", ">", "<S>", "M", " line\n", "\n\n", "漢字", "<M"]


def fim(doc_id, text, seed=7, rate=100, spm=50, marks=SENTINELS):
    """One document, by the definition."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    p, s, m = marks
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return doc_id, n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("chunk", [1 << 20, 7, 300])
@pytest.mark.parametrize("marks", [SENTINELS, ("<|pre|>", "<|suf|>", "<|mid|>")])
def test_fill_in_middle_by_brute_force(spark, chunk, marks):
    rng = random.Random(11)
    texts = [None, "", "\n", "x", "one line", "<P>", "a\n<", "P>\n", "no end\nhere", "\n" * 700, "<" * 500, "".join(rng.choice(BITS) for _ in range(3000))]
    texts += ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    texts += ["".join(rng.choice("ab\n<P é") for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc\n"), (5, "a\nb"), (5, "a\nb"), (5, "other\ntext"), (-(2**63), "x\ny"), (2**63 - 1, "x\ny")]
    rows = spark.createDataFrame([(i, t, "n", "row", "c", "h", "o") for i, t in docs], EXTRA)
    got = fill_in_middle(rows, seed=3, rate=80, spm=40, sentinels=marks, chunk_bytes=chunk).withColumn("text", restored(F.col("output"), F.col("form"), marks)).collect()
    want = [fim(*d, seed=3, rate=80, spm=40, marks=marks) for d in docs]
    assert order([tuple(r)[:6] for r in got]) == order(want)
    assert order([(r["doc_id"], r["text"]) for r in got]) == order([(i, t or "") for i, t in docs])
    assert fill_in_middle(rows.limit(0), chunk_bytes=chunk).collect() == []


def test_sentinels_that_overlap_are_no_sentinels():
    for marks in (("", "b", "c"), ("ab", "bc", "x"), ("aba", "x", "y"), ("ab", "abc", "x")):
        with pytest.raises(ValueError):
            automaton(marks)


def vector_codes(rows, entries=16, rounds=6):
    """All codes by the definition, in integers without bounds."""
    usable = [r for r in rows if r[1] is not None and len(r[1]) and len(r[1]) % 8 == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    usable = [r for r in usable if len(r[1]) == len(usable[0][1])]
    width = len(usable[0][1]) // 8 if usable else 0
    whole = [[math.floor(4096 * int(x)) if abs(x) > 2**60 else math.floor(4096 * x) for x in r[1]] for r in usable]
    parts = [[v[p * width : (p + 1) * width] for p in range(8)] for v in whole]
    books = [[parts[i][p] for i in range(min(entries, len(parts)))] for p in range(8)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            members = defaultdict(list)
            for v in parts:
                members[best(v[p], books[p])[1]].append(v[p])
            for k, own in members.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, by = [], defaultdict(int)
    for r, v in zip(usable, parts, strict=True):
        found = [best(v[p], books[p]) for p in range(8)]
        out.append((r[0], bytes(k for _, k in found).hex(), sum(d for d, _ in found), r[2]))
        by[r[2]] += out[-1][2]
    bound = lambda x: x if x < 2**63 else None
    return [(i, code, bound(e), bound(by[label]), digest) for i, code, e, label in out]


def test_vector_codes_by_brute_force(spark):
    rng = random.Random(13)
    vector = lambda n=16, size=1.0: [rng.choice([-1.0, -0.25, 0.0, 0.25, rng.random() * size]) for _ in range(n)]
    rows = [(i, vector(), rng.choice([1, 2, None])) for i in range(3, 120)] + [(None, vector(), 1), (None, vector(), None), (7, vector(), 2), (-(2**63), vector(), 2), (2**63 - 1, vector(), None)]
    rows += [(8, rows[5][1], 1), (8, rows[5][1], 1)]  # repeated rows
    bad = [(0, None, 1), (1, [], 1), (2, [0.5] * 15 + [None], 2), (1, [math.nan] * 16, 2), (1, [math.inf] + [0.0] * 15, 2), (500, vector(24), 1), (501, vector(15), 1)]
    schema = "vec_id long, embedding array<double>, label int, code string, error string, salt string"
    for kept in (rows, rows[:5], rows + [(600 + i, vector(16, 1e30), 2) for i in range(9)], rows + [(2, vector(24), 1)]):
        every = kept + bad
        rng.shuffle(every)
        table = spark.createDataFrame([(*r, "c", "e", "s") for r in every], schema).repartition(3)
        got = [tuple(r) for r in compressed(table).collect()]
        assert order(got) == order(vector_codes(every))
    assert compressed(table.limit(0)).collect() == [] and compressed(spark.createDataFrame([(*r, "", "", "") for r in bad[:5]], schema)).collect() == []


@pytest.mark.parametrize("kind", [np.int64, object])
def test_the_annulus_holds_the_nearest_entry(kind):
    rng = np.random.default_rng(13)
    for _ in range(60):
        span = int(rng.choice([2, 20, 4000, 1 << 23]))
        x, entries = rng.integers(-span, span + 1, (80, 4)).astype(kind), rng.integers(-span, span + 1, (rng.integers(1, 17), 4)).astype(kind)
        every = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        index, best = nearest(x, entries)
        assert (best == every.min(axis=1)).all() and (index == np.array([list(r).index(min(r)) for r in every])).all()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def check_digit(digits):
    twice = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def patterns(text):
    """(start, place of the kind, end) of all that the patterns find."""
    out = []
    for place, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and check_digit(digits), "phone": 9 <= len(digits) <= 15}
            if fits[kind]:
                out.append((m.start(), place, m.end()))
    return sorted(out)


def shown(spans):
    return ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in spans)


def test_the_patterns_by_brute_force(spark):
    rng = random.Random(12)
    pieces = ["a.b-c", "@", "x@y.zz", "@mail.example.com", "1.2.3.4", "255.256.1.1", ".", "-", " ", "  ", "+", "+1 (269) 555-3296", "4524132264652876", "4111-1111 1111 1111", "0", "12", "٣", "é", "\n", "(", ")", "00255", "%", "😀", "9" * 13, "+44.20.7946-0958"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    for text in texts:
        assert sorted((a, k, b) for k, a, b, fits in pii.matches(text) if fits) == patterns(text)
    docs = [(i, t) for i, t in enumerate(texts[:600])] + [(None, "x@y.zz"), (3, None), (3, ""), (3, "1.2.3.4"), (3, "1.2.3.4"), (-(2**63), "no data"), (9, "x" * 3000 + " a@b.co " + "1 2." * 5000 + "(" * 6000 + "+1 " + "a" * 3000 + "@")]
    rows = spark.createDataFrame([(i, t, "n", "row", "c", "h", "o") for i, t in docs], EXTRA)
    got = pii.personal_data(rows.repartition(3)).collect()
    count = lambda t: [sum(k == kind for _, k, _ in patterns(t)) for kind in range(4)]
    assert order([(r["doc_id"], r["base"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got]) == order([(i, shown(patterns(t)), *count(t)) for i, t in docs])
    for r in got:
        base, every = set(r["base"].split(",")) - {""}, set(r["spans"].split(",")) - {""}
        assert base <= every and len(every) == len(base) + r["n_added"]
    assert pii.personal_data(rows.limit(0)).collect() == []


def test_the_field_finds_what_the_patterns_miss(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 8)))
    say = lambda *x: " ".join([word() for _ in range(9)] + list(x) + [word() for _ in range(9)])

    def card():
        head = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
        return next(head + str(d) for d in range(10) if check_digit(head + str(d)))

    phone = lambda: f"+1 ({rng.randrange(200, 900)}) 555-{rng.randrange(10**4):04}"
    ip = lambda: ".".join(str(rng.randrange(1, 256)) for _ in range(4))
    mail = lambda: f"{word()}.{rng.randrange(99)}@mail.example.com"
    plain = [say(rng.choice(["on 2024-05-17", "version 3.1.4", "from 1990-2005", "at 10:20:30", 'token = "9f3a77c1"', "for 1 250 000", "in 12 15 19 22", "pages 10-20"])) for _ in range(150)]
    docs = [say(f()) for f in (card, phone, ip, mail) for _ in range(60)] + plain
    hard = [(say(p + " " + c), [("phone", p), ("card", c)]) for p, c in ((phone(), card()) for _ in range(30))] + [(say(c + " " + d), [("card", c), ("card", d)]) for c, d in ((card(), card()) for _ in range(30))]
    hard += [(say(p + " " + a), [("phone", p), ("ip", a)]) for p, a in ((phone(), ip()) for _ in range(20))] + [(say(p[3:]), [("phone", p[3:])]) for p in (phone() for _ in range(20))]
    texts = docs + [t for t, _ in hard]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = [[(k, text[int(a) : int(b)]) for k, a, b in (x.split(":") for x in got[i]["spans"].split(",") if x)] for i, text in enumerate(texts)]
    assert sum(f == want for f, (_, want) in zip(found[len(docs) :], hard, strict=True)) >= 0.95 * len(hard)
    assert all(not f for f in found[len(docs) - len(plain) : len(docs)]) and all(got[i]["n_added"] == 0 for i in range(len(docs)))


def ways(arcs, step):
    """(spans, score) of each way through a lattice."""

    def go(i, was, score, spans):
        if i == len(arcs):
            yield tuple(spans), score
        for j, kind, s in arcs[i] if i < len(arcs) else ():
            yield from go(j, kind, score + step[was][kind] + s, spans + [(i, j, kind)] * (kind != pii.NONE))

    return list(go(0, pii.NONE, 0.0, []))


def test_the_field_by_brute_force():
    rng = random.Random(8)
    for _ in range(40):
        n = rng.randrange(1, 6)
        step = [[rng.uniform(-1, 1) for _ in range(pii.NONE + 1)] for _ in range(pii.NONE + 1)]
        arcs = [[(i + 1, pii.NONE, 0.0)] for i in range(n)]
        for i, j, kind in {tuple(x) for x in [(rng.randrange(n), rng.randrange(1, n + 1), rng.randrange(4)) for _ in range(8)] if x[0] < x[1]}:
            arcs[i].append((j, kind, rng.uniform(-2, 2)))
        every = ways(arcs, step)
        most = max(s for _, s in every)
        assert math.isclose(dict(every)[tuple(pii.best_path(arcs, step))], most)
        total, spans, changes = pii.expected(arcs, step)
        weight = sum(math.exp(s) for _, s in every)
        assert math.isclose(math.exp(total), weight)
        chance = defaultdict(float)
        for way, s in every:
            for arc in way:
                chance[arc] += math.exp(s) / weight
        assert all(math.isclose(chance[a], spans.get(a, 0.0), abs_tol=1e-9) for a in chance | spans)
        for was, kind in itertools.product(range(pii.NONE + 1), repeat=2):  # the slope of the total, by differences
            near = [[x + 1e-5 * ((was, kind) == (a, b)) for b, x in enumerate(row)] for a, row in enumerate(step)]
            assert math.isclose((pii.expected(arcs, near)[0] - total) / 1e-5, changes.get((was, kind), 0.0), abs_tol=1e-3)
