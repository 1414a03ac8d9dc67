"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its runs of five words. A run weighs its count in the text times the mean idf of its
words. (By the runs' own document frequency, the very runs that copies share would count least, the more so the more
copies there are.) Document frequencies are of all texts, in a table of fixed size. ICWS samples are banded; texts
with a band in common first meet its most central text, which connects most of them. Where a band's texts stay in
different classes, all pairs of the band are compared in blocks inside tasks, which return the links that connect
classes. Pairs are verified by their weighted Jaccard similarity, and classes are the connected components of verified
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.exact_dedup import HOTTEST, grouped, looked_up
from skeinworks.llm.store import numbered, stable
from skeinworks.llm.words import Words, chunks, mix

SHINGLE, THRESHOLD = 5, 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.998 at 0.8.
BANDS, ROWS = 12, 4
#: Slots of the document frequency table, sent to every worker.
DF_SLOTS = 1 << 18
#: Texts, and bytes, of one band that a task compares with as many; more are spread over several tasks.
BLOCK, BLOCK_BYTES = 512, 1 << 23
#: Pairs that are added up at a time.
CELLS = 1 << 20
#: A text of more than BLOCK pairs, and among the HOTTEST of these, is verified in so many tasks.
SPREAD = 64
#: Links of which all rounds of ``components`` are small jobs, and how many of them a task of these has.
FEW, FEW_EACH = 400_000, 50_000
_TABLE = 16


def _quantiles(size: int = 1 << _TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at evenly spaced probabilities, and its logarithm, by Newton's method on 1 - (1 + x) exp(-x)."""
    p = (np.arange(size) + 0.5) / size
    x = np.where(p < 0.5, np.sqrt(2 * p), 1.0 - np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x.astype(np.float32), np.log(x).astype(np.float32)


_GAMMA, _LOG_GAMMA = _quantiles()


def document_frequency(texts: DataFrame) -> DataFrame:
    """(slot, n): in how many texts words of the slot are; each task sums into a table of its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DF_SLOTS, np.int64)
        for batch in batches:
            for _, _, words in chunks(batch.column(0)):
                seen = np.unique(words.owner * DF_SLOTS + (words.hash % np.uint64(DF_SLOTS)).astype(np.int64))
                total += np.bincount(seen % DF_SLOTS, minlength=DF_SLOTS)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["slot", "n"])

    return texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def idf_table(texts: DataFrame) -> np.ndarray:
    """Damped idf of each slot, from 1 (in every text) to 2 (in none)."""
    rows = document_frequency(texts).toArrow()  # at most DF_SLOTS rows
    total = texts.count()
    df = np.zeros(DF_SLOTS)
    df[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return (1 + np.log((1 + total) / (1 + np.minimum(df, total))) / np.log(2 + total)).astype(np.float32)


def shingles(words: Words, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the distinct shingles, by text; a text of fewer than five words is one shingle."""
    grams, inside = words.grams(SHINGLE)
    at = np.flatnonzero(inside)
    own = idf[(words.hash % np.uint64(DF_SLOTS)).astype(np.int64)].astype(np.float64)
    sums = np.concatenate([[0], np.cumsum(own)])
    hashes, weight, text = grams[at], (sums[at + SHINGLE] - sums[at]) / SHINGLE, words.owner[at]
    length = np.diff(words.first)
    for t in np.flatnonzero((length > 0) & (length < SHINGLE)):
        a, b = int(words.first[t]), int(words.first[t + 1])
        seed = np.uint64(b - a)
        for x in words.hash[a:b]:
            seed = mix(np.array([seed ^ x]))[0]
        hashes, weight, text = np.append(hashes, seed), np.append(weight, (sums[b] - sums[a]) / (b - a)), np.append(text, t)
    order = np.lexsort((hashes, text))
    hashes, weight, text = hashes[order], weight[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    times = np.diff(np.append(heads, len(hashes)))
    return text[heads], hashes[heads], (weight[heads] * times).astype(np.float32)


def samples(text: np.ndarray, hashes: np.ndarray, weight: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and ``number`` ICWS samples of each as 32-bit fingerprints of (shingle, level).

    The random variables of a shingle and a sample come from one hash, by tables of 2 ** 16 quantiles.
    """
    heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.empty(0, np.int64)
    out = np.empty((len(heads), number), np.uint32)
    log_weight = np.log(weight)
    mask = np.uint64((1 << _TABLE) - 1)
    for j in range(number if len(heads) else 0):
        bits = mix(hashes + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        r = _GAMMA[bits & mask]
        log_c = _LOG_GAMMA[(bits >> np.uint64(16)) & mask]
        beta = ((bits >> np.uint64(32)) & mask).astype(np.float32) * np.float32(1 / (1 << _TABLE))
        level = np.floor(log_weight / r + beta)
        rank = np.exp(log_c - r * (level - beta + 1))  # positive, so its bits are in its order
        print_ = (bits >> np.uint64(32)) ^ (level.astype(np.int64).astype(np.uint64) * np.uint64(0x85EBCA6B))
        packed = (rank.view(np.uint32).astype(np.uint64) << np.uint64(32)) | (print_ & np.uint64(0xFFFFFFFF))
        out[:, j] = np.minimum.reduceat(packed, heads).astype(np.uint32)
    return text[heads], out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two sets of (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64)
    return float(shared / max(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - shared, 1e-12))


def _sketched(rows: DataFrame, idf) -> DataFrame:
    """(row, id, print, bands, size) of rows (row, id, text): 128 bits of the word sequence, null for no words, the band keys, and bytes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in chunks(batch.column(2)):
                text, found = samples(*shingles(words, idf.value), BANDS * ROWS)
                keys = np.zeros((len(text), BANDS), np.uint64)
                for j in range(BANDS):
                    for r in range(ROWS):
                        keys[:, j] = mix(keys[:, j] * np.uint64(3) + found[:, j * ROWS + r] + np.uint64(j))
                bands: list = [None] * words.texts
                for t, key in zip(text, keys.view(np.int64).tolist(), strict=True):
                    bands[t] = key
                own = [batch.column(i).slice(a, b - a) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(words.prints(), pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(words.sizes)], names=["row", "id", "print", "bands", "size"])

    return rows.select("row", "id", "text").mapInArrow(sketch, "row long, id long, print binary, bands array<long>, size long")


def _with_leader(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b, text_a) with text_b, of the leader. A leader of very many pairs is dealt over SPREAD tasks by the other text."""
    often = stable(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).orderBy(F.desc("n"), "b").limit(HOTTEST))
    part = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), F.lit(SPREAD))).cast("int").alias("part")
    dealt = pairs.join(F.broadcast(often), "b", "left").select("a", "b", "text_a", part)
    parts = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    copies = texts.withColumnsRenamed({"id": "b", "text": "text_b"}).join(F.broadcast(often), "b", "left").select("b", "text_b", F.explode(parts).alias("part"))
    return dealt.join(copies, ["b", "part"]).select("a", "b", "text_a", "text_b")


def verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The ``pairs`` (a, and its leader b) of ids whose texts (id, text) have a weighted Jaccard similarity of ``threshold``."""
    both = _with_leader(pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a"), texts)

    def sets(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for _, _, words in chunks(column):
            text, hashes, weight = shingles(words, idf.value)
            cuts = np.searchsorted(text, np.arange(words.texts + 1))
            out += [(hashes[cuts[t] : cuts[t + 1]], weight[cuts[t] : cuts[t + 1]]) for t in range(words.texts)]
        return out

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                score = np.array([similarity(x, y) for x, y in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True)])
                alike = pa.array(score >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(alike), batch.column(1).filter(alike), pa.array(score).filter(alike)], names=["a", "b", "similarity"])

    return both.mapInArrow(judge, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(id, root): the least id that each end of ``links`` (a, b) is connected to, by alternating large and small stars.

    Every round joins on ids alone, so a text with very many links is spread by skew splitting, and aggregates
    combine before they shuffle. Up to FEW links are instead dealt by their first end once for each step of a round,
    into as many tasks as they are worth: so many rounds would otherwise leave a file for each of all partitions.
    """
    digest = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    edges = stable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = digest(edges)
    dealt = (lambda df: df.repartition(2 + before["n"] // FEW_EACH, "u")) if before["n"] <= FEW else (lambda df: df)
    while before["n"]:
        both = dealt(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = dealt(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = dealt(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))).distinct()
        edges = stable(small)
        after = digest(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _leaders(banded: DataFrame) -> DataFrame:
    """(id, leader): each text's most central companion in each band: the one whose bands are the most popular."""
    size = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = banded.join(size, ["band", "key"])
    central = shared.groupBy("id").agg(F.sum("n").alias("popular"))
    leader = shared.join(central, "id").groupBy("band", "key").agg(F.max(F.struct("popular", (-F.col("id")).alias("id"))).alias("best"))
    return banded.join(leader.select("band", "key", (-F.col("best.id")).alias("leader")), ["band", "key"]).filter("id != leader")


def _similarities(text: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Weighted Jaccard of all pairs of ``n`` texts, by adding up what each shingle contributes to the texts that have it."""
    order = np.argsort(hashes, kind="stable")
    text, hashes, weight = text[order], hashes[order], weight[order].astype(np.float64)
    head = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
    times = np.diff(np.append(head, len(hashes)))
    shared = np.zeros((n, n))
    for size in np.unique(times[times > 1]):
        at = head[times == size]
        step = max(1, CELLS // int(size) ** 2)
        for k in range(0, len(at), step):
            place = at[k : k + step, None] + np.arange(size)
            who, how = text[place], weight[place]
            np.add.at(shared, (who[:, :, None], who[:, None, :]), np.minimum(how[:, :, None], how[:, None, :]))
    total = np.bincount(text, weights=weight, minlength=n)
    return shared / np.maximum(total[:, None] + total[None, :] - shared, 1e-12)


def _joins(alike: np.ndarray, root: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """The most similar pairs that connect texts of different roots; one more would connect what is connected already."""
    i, j = np.nonzero(np.triu((alike >= threshold) & (root[:, None] != root[None, :]), 1))
    parent, out = {}, []

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in np.argsort(-alike[i, j], kind="stable"):
        a, b = top(int(root[i[k]])), top(int(root[j[k]]))
        if a != b:
            parent[a] = b
            out.append((int(i[k]), int(j[k])))
    return out


def _unmet(led: DataFrame, roots: DataFrame, sizes: DataFrame, rows: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b, similarity) that connect the classes ``roots`` of texts that share a band and have met only its leader.

    Texts of a band's largest class are connected already, so each of the others is compared with all of the band, and
    they with nothing else. That is done inside tasks: a pair is never a row. Both sides are cut into blocks of bounded
    number and bytes that meet two by two, so no band is one task's alone, and of its pairs a task only returns those
    that connect classes. A text of the largest class is copied once for each block of the others, of which there are
    few where most of a band is connected.
    """
    rooted = led.join(roots, "id", "left").join(sizes, "id").select("band", "key", "id", F.coalesce("root", "id").alias("root"), "size")
    met = stable(rooted)
    classes = met.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    largest = F.max(F.struct("n", F.bitwise_not("root").alias("root"), "bytes"))
    in_band = classes.groupBy("band", "key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), largest.alias("best"), F.count(F.lit(1)).alias("classes"))
    blocks = lambda n, bytes_: F.ceil(F.greatest(n / BLOCK, bytes_ / BLOCK_BYTES)).cast("int")
    sides = {"main": F.bitwise_not("best.root"), "mains": blocks(F.col("best.n"), F.col("best.bytes")), "rests": blocks(F.col("n") - F.col("best.n"), F.col("bytes") - F.col("best.bytes"))}
    apart = stable(in_band.filter("classes > 1").select("band", "key", "n", *(c.alias(k) for k, c in sides.items())))
    is_main = F.col("root") == F.col("main")
    own = F.pmod(F.xxhash64("id"), F.when(is_main, F.col("mains")).otherwise(F.col("rests"))).cast("int")
    told = looked_up(met, apart, "band", "key").select("band", "key", "id", "root", is_main.alias("is_main"), own.alias("own"), "mains", "rests")
    to = lambda end: F.sequence(F.lit(0), F.col(end) - 1)
    cell = lambda x, y: F.struct(x.alias("x"), y.alias("y"))  # noqa: E731  others' blocks are from 0, those of the largest class -1 and below
    among = F.transform(to("rests"), lambda k: cell(F.least("own", k), F.greatest("own", k)))
    against = F.transform(to("mains"), lambda k: cell(F.col("own"), -1 - k))
    cells_of = F.when(F.col("is_main"), F.transform(to("rests"), lambda k: cell(k, -1 - F.col("own")))).otherwise(F.concat(among, against))
    placed = stable(told.select("band", "key", F.explode(cells_of).alias("cell"), "id", "root").select("band", "key", "cell.x", "cell.y", "id", "root"))
    texts = rows.select(F.col("row").alias("id"), "text").join(placed.select("id").distinct(), "id")
    cells = placed.join(texts, "id")

    def compare(cell: pa.Table) -> pa.Table:
        ids, root = (cell[c].to_numpy() for c in ("id", "root"))
        parts = []
        for a, _, words in chunks(cell["text"]):
            text, hashes, weight = shingles(words, idf.value)
            parts.append((text + a, hashes, weight))
        alike = _similarities(*(np.concatenate(x) for x in zip(*parts, strict=True)), len(ids))
        found = [(*sorted((int(ids[i]), int(ids[j]))), float(alike[i, j])) for i, j in _joins(alike, root, threshold)]
        low, high, score = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(score, pa.float64())], names=["a", "b", "similarity"])

    return cells.groupBy("band", "key", "x", "y").applyInArrow(compare, "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _links(sketched: DataFrame, nodes: DataFrame, rows: DataFrame, idf, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links: a, b, similarity; classes: id, root) of the different texts ``nodes`` (id), by their rows' numbers."""
    bands = sketched.select(F.col("row").alias("id"), "bands").join(nodes, "id", "left_semi")
    banded = stable(bands.select("id", F.posexplode("bands").alias("band", "key")))
    led = stable(_leaders(banded))
    needed = led.select("id").union(led.select("leader")).distinct()
    texts = rows.select(F.col("row").alias("id"), "text").join(needed, "id", "left_semi")
    pair = stable(led.select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct())  # a leader is never led by one that it leads
    links = stable(verified(pair, texts, idf, threshold))
    roots = components(links)
    more = stable(_unmet(led, roots, sketched.select(F.col("row").alias("id"), "size"), rows, idf, threshold))
    every = links.unionByName(more)
    # classes so far are stars, which new links only have to connect
    stars = roots if more.isEmpty() else components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more.select("a", "b")))
    return every, stars.unionByName(stars.select(F.col("root").alias("id"), "root").distinct())


def _resolved(rows: DataFrame, threshold: float) -> DataFrame:
    """Each of rows (row, id, text) with ``best``, complements of the least id of its class and that row's number, group_size, n_links, similarity.

    Rows of equal words are one text, whose first row stands for it: the one of the least id, null last.
    """
    idf = rows.sparkSession.sparkContext.broadcast(idf_table(rows))
    sketched = stable(_sketched(rows, idf))
    best = F.struct(F.bitwise_not("id").alias("id"), F.bitwise_not("row").alias("row"))
    known = sketched.filter("print IS NOT NULL").select("row", "id", "print")
    member = stable(grouped(known, "print", best).select("row", "id", F.bitwise_not("best.row").alias("node"), "best", "group_size"))
    nodes = member.filter("row = node").select(F.col("node").alias("id"), "best", F.col("group_size").alias("copies"))
    links, classes = _links(sketched, nodes.select("id"), rows, idf, threshold)
    rooted = stable(nodes.join(classes, "id").select("id", "root", F.col("best").alias("own"), "copies"))
    placed = grouped(rooted, "root", F.col("own"), size=F.sum("copies"), alone=F.col("copies")).select("id", F.col("best").alias("_best"), F.col("group_size").alias("_size"))
    ends = links.select(F.col("a").alias("id"), "similarity").unionByName(links.select(F.col("b").alias("id"), "similarity"))
    near = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_links"), F.max("similarity").alias("similarity"))
    filled = {"group_size": F.coalesce("_size", "copies"), "n_links": F.coalesce("n_links", F.lit(0).cast("long")), "similarity": F.coalesce("similarity", F.when(F.col("copies") > 1, 1.0))}
    every = nodes.join(placed, "id", "left").join(near, "id", "left").withColumns(filled)
    judged = stable(every.select(F.col("id").alias("node"), F.col("best").alias("_own"), F.coalesce("_best", "best").alias("best"), "group_size", "n_links", "similarity", "copies"))
    out = ["row", "id", "best", "group_size", "n_links", "similarity"]
    single = judged.filter("copies = 1").withColumns({"row": F.col("node"), "id": F.bitwise_not("_own.id")}).select(*out)
    copied = looked_up(member.filter("group_size > 1").select("row", "id", "node"), judged.filter("copies > 1"), "node", n="copies").select(*out)
    own = {"best": best, "group_size": F.lit(1).cast("long"), "n_links": F.lit(0).cast("long"), "similarity": F.lit(None).cast("double")}
    bare = sketched.filter("print IS NULL").withColumns(own).select(*out)
    return single.unionByName(copied).unionByName(bare)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): class_id (the least doc_id of its class), class_size, n_links, similarity.

    Rows are told apart by numbers of their own, so null and repeated doc_ids are rows as any others; class_id is null
    for a class of null doc_ids alone. Rows of equal words are one text from the start. n_links counts the other texts
    that its text was verified to be similar to, and similarity is the highest of these (1 for a text with copies but
    no other links, null for none). Texts without words are classes of their own. Texts of one to four words have one
    shingle, all of their words. Other columns are not read.
    """
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))).select("row", F.col("kept.doc_id").alias("id"), "kept.text")
    return _resolved(rows, threshold).select(
        F.col("id").alias("doc_id"), F.bitwise_not("best.id").alias("class_id"), F.col("group_size").cast("long").alias("class_size"), F.col("n_links").cast("long").alias("n_links"), "similarity"
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The first row of every class, by doc_id, null last, with all its columns; texts without words all stay."""
    rows = numbered(docs)
    slim = rows.select("row", F.col("kept.doc_id").cast("long").alias("id"), F.coalesce("kept.text", F.lit("")).alias("text"))
    keep = _resolved(slim, threshold).filter(F.col("row") == F.bitwise_not("best.row")).select("row")
    return rows.join(keep, "row", "left_semi").select("kept.*")
