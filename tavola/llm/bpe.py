"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue (operator 5).

The queue holds a bucket for every merge rank that has candidates; a bucket is
the positions of pairs, in a linked list of parts, that this rank would merge.
A two-level bitmap marks the buckets in use, and find-first-set gives the lowest
rank in two steps however many there are.  Merging unlinks a part and queues the
two pairs it makes; entries whose parts have changed meanwhile are skipped when
their turn comes.  A pre-token of n bytes takes O(n) queue steps, so one of
megabytes does no harm.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import batches_from, id_and_text, rows_of
from .encoders import PLAIN, WHITE, ChunkCache, spaced

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                    ("decoded_sha256", pa.string())])
DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
WORD = 256  # ranks a bitmap word


class RankQueue:
    """Buckets of positions by rank; ``pop`` gives the leftmost position of the lowest rank."""

    def __init__(self, n_ranks: int):
        self.words = [0] * (n_ranks // WORD + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, pos: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, pos)
            return
        self.buckets[rank] = [pos]
        w = rank // WORD
        self.words[w] |= 1 << rank % WORD
        self.top |= 1 << w

    def pop(self) -> tuple[int, int]:
        w = (self.top & -self.top).bit_length() - 1
        word = self.words[w]
        rank = w * WORD + (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        pos = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.words[w] = word = word & (word - 1)
            if not word:
                self.top &= self.top - 1
        return rank, pos


class _Masks(dict):
    """character -> what stands for it while splitting, None for itself.

    The two libraries' Unicode tables differ in age: a letter or digit that is
    unassigned in the tokenizer library's table splits as a symbol.
    """

    def __init__(self):
        super().__init__()
        self.new = regex.compile(r"[\p{L}\p{N}]").match
        self.known = tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}]", special_tokens={},
                                       mergeable_ranks={bytes([b]): b for b in range(256)}).encode_ordinary

    def __missing__(self, c: str):
        self[c] = 0xE000 if self.new(c) and not self.known(c) else None  # 0xE000: private use, a symbol
        return self[c]


class Bpe:
    """Ranks of a .tiktoken file with the pattern that splits a text into pre-tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.masks = _Masks()
        self.queue = RankQueue(max(self.tokens))
        self.pre_tokens = ChunkCache(lambda t: array("I", self.merge(t.encode())).tobytes(), 2_000_000)
        self.marks = {"": b"", ".": self.pre_tokens["."], ",": self.pre_tokens[","]}
        self.later = ChunkCache(self.spaced_chunk)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest-ranked pair merges first, the leftmost of equals."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        rank_of, tokens, push, pop = self.ranks.get, self.tokens, self.queue.push, self.queue.pop
        parts: list[bytes | None] = [piece[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n  # rank of the pair that begins at a part
        for i in range(n - 1):
            rank = rank_of(piece[i:i + 2])
            if rank is not None:
                pair[i] = rank
                push(rank, i)
        queue = self.queue
        while queue.top:
            rank, i = pop()
            if pair[i] != rank:
                continue  # one of its parts has merged meanwhile
            j = after[i]
            k = after[i] = after[j]
            made = parts[i] = tokens[rank]
            parts[j], pair[i], pair[j] = None, -1, -1
            if k < n:
                before[k] = i
                rank = rank_of(made + parts[k])
                if rank is not None:
                    pair[i] = rank
                    push(rank, i)
            h = before[i]
            if h >= 0:
                rank = rank_of(parts[h] + made)
                if rank is None:
                    pair[h] = -1
                elif rank != pair[h]:
                    pair[h] = rank
                    push(rank, h)
        return [self.ranks[p] for p in parts if p is not None]

    def split(self, text: str) -> list[str]:
        """The pattern's matches, as the library finds them."""
        if text.isascii() or not (masks := {ord(c): m for c in set(text) if (m := self.masks[c])}):
            return self.pattern.findall(text)
        return [text[m.start():m.end()] for m in self.pattern.finditer(text.translate(masks))]

    def chunk(self, text: str) -> bytes:
        return b"".join(map(self.pre_tokens.__getitem__, self.split(text)))

    def spaced_chunk(self, chunk: str) -> bytes:
        """A chunk as ``spaced`` gives those after the first."""
        plain = PLAIN.fullmatch(chunk)
        if plain is not None:  # a word and a closing mark: one pre-token each
            return self.pre_tokens[" " + plain[1]] + self.marks[plain[2]]
        return self.chunk(chunk if chunk[0] in WHITE else " " + chunk)

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids of a whole text."""
        chunks = spaced(text)
        if not chunks:
            return b""
        return self.chunk(chunks[0]) + b"".join(map(self.later.__getitem__, chunks[1:]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def load_bpe(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def digests(rows, bpe: Bpe) -> Iterator[tuple]:
    for doc_id, text in rows:
        ids = bpe.encode(text)
        yield doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian uint32 bytes) of every row.

    A null text has no ids; a null id stays null; repeated rows give repeated
    results; an empty table gives no rows; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        bpe = load_bpe(ranks_path, pattern)
        return batches_from(((d, bpe.encode(t)) for d, t in rows_of(batches, "doc_id", "text")), schema, 256)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``text`` from ``encode_documents``' rows (bytes that are no UTF-8 become U+FFFD)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        bpe = load_bpe(ranks_path, pattern)
        return batches_from(((d, bpe.decode(x).decode("utf-8", "replace")) for d, x in rows_of(batches, "doc_id", "ids")),
                            schema, 256)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Encode and decode every row in one pass; token count and digests of both. Cases as ``encode_documents``."""
    def run(batches):
        return batches_from(digests(rows_of(batches, "doc_id", "text"), load_bpe(ranks_path, pattern)), SCHEMA)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, DDL)
