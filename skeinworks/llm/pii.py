"""Personal data in texts: patterns, and a semi-Markov conditional random field that finds what they miss.

The field labels whole spans, not single tokens. A candidate span of at most ``MOST_TOKENS`` tokens is scored by
features of all of it (form, number of digits, check digits, neighbours), and dynamic programming over the tokens picks
boundaries and kinds together. So a phone number and a card number with a blank between them, in which a pattern sees
one number that is too long, become two spans. Spans that the patterns have found are fixed beforehand.

Only stretches around digits and ``@`` can hold candidates, and nothing reaches from one stretch to the next, so each
is decided by itself. The field is trained on a bounded sample of stretches, labelled by the patterns, on variants of
these (joined spans, other spellings of phone numbers), and on generated numbers that are no personal data.
"""

from __future__ import annotations

import heapq
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.store import stable
from skeinworks.llm.words import buffers

KINDS = ("email", "ip", "card", "phone")
#: The longest candidate in tokens, and the characters around a stretch that features may look at.
MOST_TOKENS, AROUND = 24, 40
#: The field is trained on at most this many stretches of each kind, and of none, of at most so many tokens: the first in the order of a hash.
TRAIN_STRETCHES, TRAIN_TOKENS = 150, 80
ROUNDS, RATE, DECAY = 8, 0.4, 1e-4
#: A feature is used if so many training stretches have it.
LEAST = 3

Span = tuple[int, int, int]  # kind, start and end in code points
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBERS = re.compile(r"(?<![+(). -])[+(). -]*+[0-9][0-9+(). -]*")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _before(text: str, at: int, least: int) -> int:
    """Where the characters of an address in front of ``at`` begin, not before ``least``."""
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """All matches of the patterns with whether they count, in time proportional to the text."""
    at, done = text.find("@"), 0
    while at >= 0:  # an address begins as far before its @ as it can
        start = _before(text, at, done)
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield 0, start, done, True
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        yield 1, m.start(), m.end(), all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split("."))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        yield 2, m.start(), m.end(), 12 <= len(digits) <= 19 and luhn(digits)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield 3, m.start(), m.end(), 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15


def by_start(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], s[0], s[2]))


def stretches(text: str) -> list[tuple[int, int]]:
    """Where candidates can be: runs of digits, blanks and signs, and what may belong to an address around an @."""
    found = [m.span() for m in _NUMBERS.finditer(text)]
    at = text.find("@")
    while at >= 0:
        end = at + 1
        while end < len(text) and (text[end].isascii() and text[end].isalnum() or text[end] in ".-"):
            end += 1
        found.append((_before(text, at, 0), end))
        at = text.find("@", at + 1)
    out: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


Token = tuple[int, int]
Arc = tuple[int, int, int]  # first token, token after the last, kind


def candidates(text: str, tokens: list[Token], fixed: list[bool]) -> Iterator[Arc]:
    """Spans of free tokens that could be of a kind."""
    address = any(text[a] == "@" for a, _ in tokens)
    for i, (a, _) in enumerate(tokens):
        first = text[a]
        last = min(i + MOST_TOKENS, len(tokens))
        if first in "0123456789+(":
            digits = groups = gap = 0
            signs = set()
            for j in range(i, last):
                c = text[tokens[j][0]]
                if fixed[j]:
                    break
                if c in "0123456789":
                    digits += tokens[j][1] - tokens[j][0]
                    groups, gap = groups + 1, 0
                    if digits > 19:
                        break
                    if 7 <= digits <= 15 and (first == "+" or groups > 1):
                        yield i, j + 1, 3
                    if 12 <= digits and first in "0123456789" and signs <= {" ", "-"}:
                        yield i, j + 1, 2
                    if groups == 4 and signs == {"."} and j == i + 6:
                        yield i, j + 1, 1
                else:
                    gap += 1
                    if gap > 2 or c not in " ().-" and (j > i or c != "+"):
                        break
                    signs.add(c)
        if address and first.isascii() and first.isalnum():
            sign, dot = -1, False
            for j in range(i, last):
                c = text[tokens[j][0]]
                if fixed[j] or c not in _LOCAL and (c != "@" or sign >= 0) or sign >= 0 and c in "_%+":
                    break
                sign = j if c == "@" else sign
                dot = dot or c == "." and sign >= 0
                if dot and c.isalnum() and text[tokens[j - 1][0]] in ".-":
                    yield i, j + 1, 0


def _class(c: str) -> str:
    return "edge" if not c else "digit" if c in "0123456789" else "letter" if c.isalpha() else "blank" if c.isspace() else c if c in ".-+()@_/:,\"'" else "other"


_WORD = re.compile(r"([^\W\d_]{2,24})[\s:.#=(]*$")


def features(text: str, start: int, end: int, kind: int) -> list[str]:
    """What a whole span says for and against a kind."""
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    sized = re.sub(r"[0-9]+|[A-Za-z]+", lambda m: f"d{len(m[0])}" if m[0][0] in "0123456789" else "a", span)
    left, right = text[max(0, start - 2) : start], text[end : end + 2]
    told = ["any", f"digits {len(digits)}", f"form {re.sub(r'd[0-9]+', 'd', sized)}", f"left {_class(left[-1:])}", f"right {_class(right[:1])}", f"left {_class(left[-1:])} {_class(left[-2:-1])}", f"right {_class(right[:1])} {_class(right[1:])}"]
    if kind > 1:
        told.append(f"sizes {sized}")
    if kind == 2:
        told.append(f"check {luhn(digits)}")
    if kind == 1:
        told.append(f"octets {all(len(x) < 4 and int(x) < 256 for x in span.split('.'))}")
    if kind == 0:
        told.append(f"letters last {span[-1].isalpha()}")
    if word := _WORD.search(text[max(0, start - 30) : start]):
        told.append(f"word {word[1].lower()}")
    return [f"{KINDS[kind]} {x}" for x in told]


NONE = len(KINDS)


@dataclass
class Model:
    weight: dict[str, float]
    step: list[list[float]]  # from a kind, or none, to the next

    def score(self, told: list[str]) -> float:
        return sum(self.weight.get(x, 0.0) for x in told)


Scored = list[list[tuple[int, int, float]]]  # of each token: the arcs that begin there, as (token after the last, kind or NONE, score)


def best_path(arcs: Scored, step: list[list[float]]) -> list[Arc]:
    """The spans of the best way from the first token to the end."""
    n = len(arcs)
    best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(n + 1)]
    best[0][NONE] = (0.0, -1, -1)
    for i in range(n):
        for was, (value, _, _) in best[i].items():
            for j, kind, score in arcs[i]:
                new = value + step[was][kind] + score
                if kind not in best[j] or new > best[j][kind][0]:
                    best[j][kind] = (new, i, was)
    out, at = [], n
    kind = max(best[n], key=lambda k: best[n][k][0])
    while at > 0:
        _, i, was = best[at][kind]
        if kind != NONE:
            out.append((i, at, kind))
        at, kind = i, was
    return out[::-1]


def expected(arcs: Scored, step: list[list[float]]) -> tuple[float, dict[Arc, float], dict[tuple[int, int], float]]:
    """The logarithm of all ways' sum, and how often each arc and each change of kind is expected."""
    n, kinds = len(arcs), range(NONE + 1)

    def total(values: list[float]) -> float:
        top = max(values, default=-math.inf)
        return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))

    into: list[list[list[float]]] = [[[] for _ in kinds] for _ in range(n + 1)]
    into[0][NONE] = [0.0]
    ahead = []
    for i in range(n + 1):
        ahead.append([total(v) for v in into[i]])
        for j, kind, score in arcs[i] if i < n else ():
            into[j][kind].append(score + total([ahead[i][was] + step[was][kind] for was in kinds]))
    every = total(ahead[n])
    back = [[-math.inf] * (NONE + 1) for _ in range(n)] + [[0.0] * (NONE + 1)]
    spans: dict[Arc, float] = {}
    changes: dict[tuple[int, int], float] = {}
    for i in range(n - 1, -1, -1):
        for was in kinds:
            if ahead[i][was] == -math.inf:
                continue
            ways = [(j, kind, step[was][kind] + score + back[j][kind]) for j, kind, score in arcs[i]]
            back[i][was] = total([w for _, _, w in ways])
            for j, kind, w in ways:
                chance = math.exp(ahead[i][was] + w - every)
                changes[was, kind] = changes.get((was, kind), 0.0) + chance
                if kind != NONE:
                    spans[i, j, kind] = spans.get((i, j, kind), 0.0) + chance
    return every, spans, changes


def tokens_of(text: str, start: int, end: int) -> list[Token]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


def added(model: Model, text: str, base: list[Span]) -> list[Span]:
    """The spans that the field adds to those of ``base``, which it leaves as they are."""
    out, at = [], 0
    base = by_start(base)
    for start, end in stretches(text):
        while at < len(base) and base[at][2] <= start:
            at += 1
        tokens, known = tokens_of(text, start, end), []
        while at + len(known) < len(base) and base[at + len(known)][1] < end:
            known.append(base[at + len(known)])
        arcs: Scored = [[(i + 1, NONE, 0.0)] for i in range(len(tokens))]
        fixed, near = [False] * len(tokens), 0
        for i, (a, b) in enumerate(tokens):
            while near < len(known) and known[near][2] <= a:
                near += 1
            if near < len(known) and known[near][1] < b:
                fixed[i] = True
                arcs[i] = [(i + 1, known[near][0], 0.0)]
        found = list(candidates(text, tokens, fixed)) if not all(fixed) else []
        if not found:
            continue
        for i, j, kind in found:
            arcs[i].append((j, kind, model.score(features(text, tokens[i][0], tokens[j - 1][1], kind))))
        out += [(kind, tokens[i][0], tokens[j - 1][1]) for i, j, kind in best_path(arcs, model.step) if not fixed[i]]
    return out


@dataclass
class Example:
    """A stretch ``start`` to ``end`` of a text, and the spans in it."""

    text: str
    start: int
    end: int
    spans: list[Span]


def example(before: str, parts: list[tuple[int, str]], after: str, between: str = " ") -> Example:
    """``parts`` (kind, or ``NONE``, and text) in a row."""
    text, spans = before, []
    for i, (kind, part) in enumerate(parts):
        text += between * (i > 0)
        if kind != NONE:
            spans.append((kind, len(text), len(text) + len(part)))
        text += part
    return Example(text + after, len(before), len(text), spans)


def variants(gold: list[Example], rng: random.Random) -> Iterator[Example]:
    """More examples: two spans in a row, and phone numbers without a country or in other spellings."""
    ones = [(e.text[: e.spans[0][1]], e.spans[0][0], e.text[e.spans[0][1] : e.spans[0][2]], e.text[e.spans[0][2] :]) for e in gold if len(e.spans) == 1]
    for before, kind, part, after in ones:
        _, other, more, _ = rng.choice(ones)
        yield example(before, [(kind, part), (other, more)], after)
        if kind == 3:
            local = re.sub(r"^\+[0-9]{1,3}[ .-]?(?=.{8})", "", part)
            groups = re.findall("[0-9]+", local)
            if len(groups) > 1 and 9 < sum(map(len, groups)) < 12:
                yield example(before, [(3, local)], after)
                yield example(before, [(3, "-".join(groups))], after)
                yield example(before, [(3, local), (other, more)], after)


def numbers(rng: random.Random, times: int) -> Iterator[str]:
    """Numbers that are no personal data: dates, times, versions, amounts, ranges, lists, and card-like ones with a false check digit."""
    n = rng.randrange
    for _ in range(times):
        date = f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}"
        false = f"{n(10**15, 10**16)}"
        yield from (date, f"{n(1, 29):02}.{n(1, 13):02}.{n(1900, 2100)}", f"{date} {n(24):02}:{n(60):02}:{n(60):02}", f"{n(20)}.{n(20)}.{n(99)}", f"{n(9)}.{n(10**7)}", f"{n(1, 999)} {n(1000):03} {n(1000):03}")
        yield from (f"{n(1500, 2100)}-{n(1500, 2100)}", f"{n(10**4, 10**5)}-{n(1000, 9999)}", " ".join(str(n(200)) for _ in range(n(2, 9))), f"{n(100)} - {n(100)}", f"{n(10**9, 10**11)}", f"{n(256)}.{n(256, 999)}.{n(256)}.{n(256)}", f"+{n(99)}", f"{date} - {date}")
        if not luhn(false):
            yield false
            yield " ".join(false[i : i + 4] for i in range(0, 16, 4))


def trained(examples: list[Example]) -> Model:
    """The field that makes the examples likeliest, by steps along each one's gradient."""
    built = []
    for e in examples:
        tokens = tokens_of(e.text, e.start, e.end)
        at = {a: i for i, (a, _) in enumerate(tokens)} | {tokens[-1][1]: len(tokens)} if tokens else {}
        told = {(i, j, k): features(e.text, tokens[i][0], tokens[j - 1][1], k) for i, j, k in candidates(e.text, tokens, [False] * len(tokens))}
        gold = {(at.get(a), at.get(b), k) for k, a, b in e.spans}
        if told and len(tokens) <= TRAIN_TOKENS and gold <= told.keys() and len(gold) == len(e.spans):
            built.append((len(tokens), told, gold))
    seen = Counter(x for _, told, _ in built for x in {x for names in told.values() for x in names})
    model = Model({x: 0.0 for x, n in sorted(seen.items()) if n >= LEAST}, [[0.0] * (NONE + 1) for _ in range(NONE + 1)])
    squares, step_squares = dict.fromkeys(model.weight, 1e-3), [[1e-3] * (NONE + 1) for _ in range(NONE + 1)]
    rng = random.Random(7)
    for _ in range(ROUNDS):
        rng.shuffle(built)
        for n, told, gold in built:
            arcs: Scored = [[(i + 1, NONE, 0.0)] for i in range(n)]
            for (i, j, k), names in told.items():
                arcs[i].append((j, k, model.score(names)))
            _, spans, changes = expected(arcs, model.step)
            slope: dict[str, float] = {}
            for arc, names in told.items():
                more = (arc in gold) - spans.get(arc, 0.0)
                for x in names if abs(more) > 1e-6 else ():
                    slope[x] = slope.get(x, 0.0) + more
            for x, g in slope.items():
                if x in squares:
                    g -= DECAY * model.weight[x]
                    squares[x] += g * g
                    model.weight[x] += RATE * g / math.sqrt(squares[x])
            was, at = NONE, 0
            ways = []
            for i, j, k in sorted(gold):
                ways += [(was, NONE)] * (i > at) + [(was if i == at else NONE, k)]
                was, at = k, j
            ways += [(was, NONE)] * (n > at)
            for k, counted in Counter(x for x in ways if x != (NONE, NONE)).items():
                changes[k] = changes.get(k, 0.0) - counted
            for (a, b), more in changes.items():
                if (a, b) != (NONE, NONE) and more:
                    step_squares[a][b] += more * more
                    model.step[a][b] -= RATE * more / math.sqrt(step_squares[a][b])
    return model


def _has_data(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts with a digit or an @; no other can hold anything."""
    seen = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57) | (raw == 64))])
    return seen[at[1:]] > seen[at[:-1]]


def _texts(column: pa.Array) -> Iterator[str | None]:
    """Texts of a column, None for those that can hold nothing."""
    raw, at = buffers(column)
    for a, b, some in zip(at[:-1].tolist(), at[1:].tolist(), _has_data(raw, at).tolist(), strict=True):
        yield raw[a:b].tobytes().decode(errors="surrogateescape") if some else None


def sample(docs: DataFrame, most: int = TRAIN_STRETCHES) -> list[Example]:
    """At most ``most`` stretches of each kind, and of none, with the spans of the patterns; different ones, so that copies don't count more.

    A stretch with a match that is too long is left out: it may be several numbers.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[tuple[int, str, int], tuple]] = [{} for _ in range(NONE + 1)]
        for batch in batches:
            for text in _texts(batch.column(0)):
                if text is None:
                    continue
                found = sorted(matches(text), key=lambda m: (m[1], m[0]))
                at = 0
                for start, end in stretches(text):
                    while at < len(found) and found[at][2] <= start:
                        at += 1
                    own = []
                    while at + len(own) < len(found) and found[at + len(own)][1] < end:
                        own.append(found[at + len(own)])
                    if end - start > 20 * TRAIN_TOKENS or any(not ok and k > 1 and sum(c in "0123456789" for c in text[a:b]) > (19, 15)[k - 2] for k, a, b, ok in own):
                        continue
                    low = max(0, start - AROUND)
                    spans = [(k, a - low, b - low) for k, a, b, ok in own if ok]
                    window = text[low : end + AROUND].encode(errors="replace").decode()
                    one = kept[spans[0][0] if spans else NONE]
                    one[zlib.crc32(window.encode()), window, start - low] = (end - low, spans)
                    if len(one) > 4 * most:
                        for key in heapq.nlargest(len(one) - most, one):
                            del one[key]
        rows = []
        for kind, one in enumerate(kept):
            for key in heapq.nsmallest(most, one):
                end, spans = one[key]
                rows.append({"kind": kind, "order": key[0], "text": key[1], "start": key[2], "end": end, "spans": [x for s in spans for x in s]})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("kind", pa.int32()), ("order", pa.int64()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("spans", pa.list_(pa.int32()))]))

    rows = stable(docs.select("text").mapInArrow(take, "kind int, order long, text string, start int, end int, spans array<int>"))
    out = []
    for kind in range(NONE + 1):
        for r in rows.filter(F.col("kind") == kind).drop("kind").distinct().orderBy("order", "text", "start", "end").limit(most).collect():
            out.append(Example(r["text"], r["start"], r["end"], [tuple(r["spans"][i : i + 3]) for i in range(0, len(r["spans"]), 3)]))
    return out


def fitted(docs: DataFrame, most: int = TRAIN_STRETCHES) -> Model:
    """A field trained on stretches of ``docs``, their variants, and generated numbers in the place of those without personal data.

    A stretch in which the patterns find nothing may still hold something. So those count as empty in which a field
    that was trained without them finds nothing either.
    """
    real = sample(docs, most)
    rng = random.Random(12)
    plain = [e for e in real if not e.spans] or [Example("see no. 7 there", 8, 9, [])]
    made = []
    for x in numbers(rng, 12):
        e = rng.choice(plain)
        made.append(example(e.text[: e.start].rstrip() + " ", [(NONE, x)], " " + e.text[e.end :].lstrip()))
    sure = [e for e in real if e.spans]
    sure += list(variants(sure, rng)) + made
    first = trained(sure)
    return trained(sure + [e for e in real if not e.spans and not added(first, e.text, [])])


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in by_start(spans))


def personal_data(docs: DataFrame, most: int = TRAIN_STRETCHES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, counts of the patterns' spans by kind, base (these), spans (all) and n_added.

    Spans are ``kind:start:end`` in code points, by start, then kind. A null text is empty, and so are the spans of an
    empty one. Rows that repeat a doc_id, or have none, are rows like others. Without any personal data in ``docs`` the
    field knows none and adds none. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fitted(rows, most))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            counts, base, every, more = [], [], [], []
            for text in _texts(batch.column(1)):
                known = [m[:3] for m in matches(text) if m[3]] if text else []
                new = added(own, text, known) if text else []
                counts.append([sum(k == kind for k, _, _ in known) for kind in range(len(KINDS))])
                base.append(written_spans(known))
                every.append(written_spans(known + new))
                more.append(len(new))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(base, pa.string()), pa.array(every, pa.string()), pa.array(more, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added"])

    return rows.mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long")
