"""Token counts and ids of whole texts, exactly as a public tokenizer gives them, from cached pieces.

A text is cut only where the tokenizer itself always cuts, so the pieces' tokens are the text's tokens. The lengths
of frequent pieces are broadcast (the first tier); each Python worker encodes the others and caches them (the second
tier). Nothing is counted or shuffled for that: the tokenizer's own vocabulary says which pieces are frequent, as its
merges were learned in that order. Which pieces are in the table only matters to speed.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the vocabulary in the broadcast table, and entries of a worker's cache.
FREQUENT, CACHE = 1 << 15, 1 << 20
#: Longer pieces are encoded each time, so entries stay small.
LONGEST = 64
#: White space that every tokenizer here takes as a cut.
_ASCII_PIECE = re.compile(r"[^ \t\n\r\f\v]+")
_SEPARATORS = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_SPACED_PIECE = re.compile(r"\s*\S+|\s+\Z")
_BLANK_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\f", "\v")
_ENDING = ".,;:!?"
_SLICE = 256
_tokenizers: dict[str, object] = {}
_caches: dict[tuple, dict] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """The tokenizer, loaded once in each process."""
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].no_truncation()
        _tokenizers[path].no_padding()
    return _tokenizers[path]


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    for at in range(0, len(column), _SLICE):
        yield at, [x or "" for x in column.slice(at, _SLICE).to_pylist()]


def frequent_pieces(path: str, size: int = FREQUENT) -> list[str]:
    """The first ``size`` whole words of a tokenizer's vocabulary, in the order in which they were learned, each also with a capital."""
    from tokenizers import decoders

    ending = "</w>"
    entries = (k for k, _ in sorted(tokenizer(path).get_vocab(with_added_tokens=False).items(), key=lambda x: x[1]) if k.endswith(ending))
    decoder = decoders.ByteLevel()
    words = [decoder.decode([k.removesuffix(ending)]) for k, _ in zip(entries, range(size))]
    plain = [w for w in words if len(w) <= LONGEST and _ASCII_PIECE.fullmatch(w)]
    return list(dict.fromkeys([*plain, *(w.capitalize() for w in plain)]))


class Lengths(dict):
    """Token counts of pieces without white space. Misses are encoded, and kept while there is room."""

    def __init__(self, path: str, known: dict[str, int], room: int = CACHE):
        super().__init__(known)
        self.encode, self.known, self.room = tokenizer(path).encode, known, room

    def __missing__(self, piece: str) -> int:
        if len(piece) > LONGEST:
            return self._count(piece)
        if len(self) >= self.room:
            self.clear()
            self.update(self.known)
        stem = piece.rstrip(_ENDING)
        if stem != piece and stem and stem[-1].isalpha() and stem[-1] < "\u0130":
            n = self[stem] + self[piece[len(stem) :]]  # a letter and a mark that follows it are always cut
        else:
            n = self._count(piece)
        self[piece] = n
        return n

    def _count(self, piece: str) -> int:
        return len(self.encode(piece, add_special_tokens=False).ids)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_bytes (UTF-8), n_tokens of the whole text, over_limit.

    ``path``: a tokenizer of ``tokenizers`` that drops white space. Null and empty texts have no tokens; strings of
    special tokens inside texts are tokenized as the library does by default. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sc = docs.sparkSession.sparkContext
    pieces = frequent_pieces(path, frequent)  # at most 2 * ``frequent``
    table = dict(zip(pieces, (len(x.ids) for x in tokenizer(path).encode_batch(pieces, add_special_tokens=False)), strict=True))
    shared, key = sc.broadcast(table), (path, id(table))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _caches.get(key)
        if lengths is None:
            _caches.clear()
            lengths = _caches[key] = Lengths(path, shared.value)
        for batch in batches:
            n = np.empty(batch.num_rows, np.int64)
            size = np.empty(batch.num_rows, np.int64)
            for at, part in _texts(batch.column(1)):
                for i, text in enumerate(part, at):
                    n[i] = sum(map(lengths.__getitem__, _ASCII_PIECE.findall(text)))
                    size[i] = len(text) if text.isascii() else len(text.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


class Ids(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of pieces after a space (or, from a line feed on, as they are)."""

    def __init__(self, path: str, spaced: bool, room: int = CACHE):
        super().__init__()
        self.encode, self.spaced, self.room = tokenizer(path).encode, spaced, room
        self.bare = Ids(path, False, room >> 3) if spaced else self

    def __missing__(self, piece: str) -> bytes:
        stem = piece.rstrip(_ENDING)
        if stem != piece and stem and stem[-1].isalpha() and stem[-1] < "\u0130":
            ids = self[stem] + self.bare[piece[len(stem) :]]  # a letter and a mark that follows it are always cut
        else:
            text = " " + piece if self.spaced and piece[0] != "\n" else piece
            ids = np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= self.room:
                self.clear()
            self[piece] = ids
        return ids


def whole_ids(text: str, path: str) -> bytes:
    """Ids of a text by a byte-level tokenizer that joins a space to the word after it, without special tokens."""
    if not text:
        return b""
    if (path, True) not in _caches:
        _caches.clear()
        spaced = Ids(path, True)
        _caches.update({(path, True): spaced, (path, False): spaced.bare})
    plain = "<|" not in text and not _SEPARATORS.search(text)
    if plain and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in _BLANK_RUNS):
        # single spaces and line feeds only: each begins a piece
        first, *rest = text.replace("\n", " \n").split(" ")
        return _caches[path, False][first] + b"".join(map(_caches[path, True].__getitem__, rest))
    if plain:
        return b"".join(map(_caches[path, False].__getitem__, _SPACED_PIECE.findall(text)))
    return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
