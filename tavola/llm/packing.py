"""Cost-balanced packing of token ids into fixed-length sequences (operator 9).

A sequence costs the sum over its pieces of ``linear * n + quadratic * n * n``:
attention inside a piece grows with the square of its length.  Each task packs
its documents block by block; in a block the pieces, longest first, go to the
cheapest sequence that still has room for them, found among all, and only when
none has room is a piece cut.  Every sequence of a block is full: tokens that do not fill one
more are held for the next block, and what a task holds at its end becomes
sequences of the power-of-two lengths that add up to it, which need no padding.

Documents never move between tasks, so there is no shuffle and a hot source or
a very long text cannot gather in one task; sequence ids carry the partition
number in their high bits, so a retried task names its sequences alike.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_from, id_and_text, partition_id, rows_of
from .encoders import word_encoder

WIDTH = 4  # bytes of an id
FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
          ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
       "`offset` long")


NOWHERE = (math.inf, -1, 0)


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    ids: memoryview
    doc_tokens: int

    @property
    def size(self) -> int:
        return len(self.ids) // WIDTH

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (self._replace(ids=self.ids[:at * WIDTH]),
                self._replace(start=self.start + at, ids=self.ids[at * WIDTH:]))


class Cheapest:
    """Sequences with room left: a heap by cost for each room, and a tree of minima over the rooms."""

    def __init__(self, n: int, capacity: int) -> None:
        self.heaps: dict[int, list[tuple[float, int]]] = {}
        self.leaves = 1 << capacity.bit_length()
        self.tree: list[tuple[float, int, int]] = [NOWHERE] * (2 * self.leaves)  # cost, sequence, room
        if n:
            self.heaps[capacity] = [(0.0, k) for k in range(n)]
            self._mend(capacity)

    def _mend(self, room: int) -> None:
        heap, at = self.heaps[room], self.leaves + room
        self.tree[at] = (*heap[0], room) if heap else NOWHERE
        while at > 1:
            at >>= 1
            self.tree[at] = min(self.tree[2 * at], self.tree[2 * at + 1])

    def take(self, size: int) -> tuple[float, int, int]:
        """The cheapest with room for ``size``, or if none has, the cheapest; out of the tree."""
        at = self.leaves + size
        best = self.tree[at]
        while at > 1:
            if not at & 1:
                best = min(best, self.tree[at + 1])
            at >>= 1
        best = best if best is not NOWHERE else self.tree[1]
        heapq.heappop(self.heaps[best[2]])
        self._mend(best[2])
        return best

    def put(self, c: float, k: int, room: int) -> None:
        heapq.heappush(self.heaps.setdefault(room, []), (c, k))
        self._mend(room)


def balance(pieces: list[Piece], capacity: int, linear: float, quadratic: float) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences, and the held pieces that would not fill one more."""
    total = sum(p.size for p in pieces)
    waiting = sorted(pieces, key=lambda p: (-p.size, p.doc_id is not None, p.doc_id or 0, p.start))
    held: list[Piece] = []
    spare = total % capacity
    while spare:  # the shortest pieces wait
        p = waiting.pop()
        if p.size > spare:
            p, kept = p.cut(p.size - spare)
            waiting.append(p)
            p = kept
        held.append(p)
        spare -= p.size
    n = total // capacity
    cost = lambda size: linear * size + quadratic * size * size
    out: list[list[Piece]] = [[] for _ in range(n)]
    cheapest = Cheapest(n, capacity)
    queue = deque(waiting)
    while queue:
        p = queue.popleft()
        c, k, room = cheapest.take(p.size)
        if room < p.size:  # no room for all of it anywhere: fill the cheapest and go on with the rest
            p, rest = p.cut(room)
            queue.appendleft(rest)
        out[k].append(p)
        if room > p.size:
            cheapest.put(c + cost(p.size), k, room - p.size)
    return out, held


def powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Sequences of falling power-of-two lengths that hold the pieces exactly."""
    queue = deque(pieces)
    total = sum(p.size for p in pieces)
    while total:
        room, sequence = 1 << (total.bit_length() - 1), []
        total -= room
        while room:
            p = queue.popleft()
            if p.size > room:
                p, rest = p.cut(room)
                queue.appendleft(rest)
            sequence.append(p)
            room -= p.size
        yield sequence


def pack_rows(docs: Iterable[tuple[int | None, bytes]], capacity: int, linear: float, quadratic: float,
              block_tokens: int, first_id: int, with_ids: bool = False) -> Iterator[tuple]:
    """Piece rows of documents given as (doc_id, id bytes)."""
    next_id = first_id

    def told(sequence):
        at = 0
        for p in sequence:
            row = (p.doc_id, p.start, p.size, zlib.crc32(p.ids), p.doc_tokens, next_id, at)
            yield row + ((bytes(p.ids),) if with_ids else ())
            at += p.size

    block: list[Piece] = []
    size = 0
    for doc_id, ids in docs:
        rest = Piece(doc_id, 0, memoryview(ids), len(ids) // WIDTH)
        while rest.size > capacity:
            p, rest = rest.cut(capacity)
            yield from told([p])  # a full sequence of its own
            next_id += 1
        if rest.size:
            block.append(rest)
            size += rest.size
        if size >= block_tokens:
            full, block = balance(block, capacity, linear, quadratic)
            size = sum(p.size for p in block)
            for sequence in full:
                yield from told(sequence)
                next_id += 1
    full, held = balance(block, capacity, linear, quadratic)
    for sequence in [*full, *powers(held)]:
        yield from told(sequence)
        next_id += 1


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, linear: float = 1.0,
         quadratic: float = 1 / 4096, block_tokens: int = 1 << 20, with_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where its tokens lie in the document and in its sequence.

    Each document is its ids and ``end_id``; every id lies in exactly one piece.
    Sequences hold ``capacity`` ids, or a smaller power of two.  ``with_ids``
    adds the piece's ids as little-endian uint32 bytes.  A null or empty text is
    its end id alone; a null id stays null; repeated rows are packed each; an
    empty table gives no rows; other columns are ignored.
    """
    end = end_id.to_bytes(WIDTH, "little")
    schema = pa.schema(FIELDS + ([("ids", pa.binary())] if with_ids else []))

    def run(batches):
        encode = word_encoder(tokenizer_path)
        coded = ((doc_id, encode(text) + end) for doc_id, text in rows_of(batches, "doc_id", "text"))
        return batches_from(pack_rows(coded, capacity, linear, quadratic, block_tokens,
                                      partition_id() << 40, with_ids), schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, DDL + (", ids binary" if with_ids else ""))
