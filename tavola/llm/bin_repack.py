"""Best-fit packing with certified bin counts (operator 12).

Documents become pieces of at most ``capacity`` ids.  Rounds of packing follow,
each over blocks of a bounded number of pieces dealt out evenly:

* a block packs its pieces by best-fit decreasing: the longest first, each into
  the sequence with the least room that still holds it;
* dual feasible functions give a lower bound on the sequences that any packing
  of the block's pieces needs.  A block that meets its bound is certified: its
  sequences stay, all but its emptiest one;
* blocks with a gap, and the emptiest sequences of the others, give their
  pieces up.  The next round deals these out over fewer, other blocks, so that
  documents of different blocks meet, and packs them again.  Its result is taken
  only if it needs fewer sequences than the pieces had before.

Rounds end when all that was left fitted into one block, or after ``rounds``.
Only lengths and numbers travel; each round is a table in the shared folder, so
a retried task finds the same pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_from, id_and_text, partition_id, rows_of, written
from .encoders import word_encoder

WIDTH = 4  # bytes of an id
PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
         ("ids_crc32", pa.int64())]
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACE = [("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()), ("certified", pa.bool_())]
PLACE_DDL = "sequence_id long, `offset` long, open boolean, certified boolean"
ROUND_BITS, BLOCK_BITS = 58, 24  # a sequence's number: round, block, place in the block


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Sequence and offset of each length (in descending order), and the room left in each sequence.

    Sequences wait in a stack for each room; one integer has a bit for each
    room that occurs, so the tightest fit is its lowest set bit from the length up.
    """
    where, offset, room = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    waiting: dict[int, list[int]] = {}
    rooms = 0
    for k, n in enumerate(lengths.tolist()):
        fits = rooms >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            stack = waiting[left]
            at = stack.pop()
            if not stack:
                rooms ^= 1 << left
        else:
            at, left = len(room), capacity
            room.append(capacity)
        where[k], offset[k] = at, capacity - left
        left -= n
        room[at] = left
        if left:
            stack = waiting.setdefault(left, [])
            if not stack:
                rooms |= 1 << left
            stack.append(at)
    return where, offset, room


def bins_needed(lengths: np.ndarray, capacity: int, most: int = 64) -> int:
    """A lower bound on the sequences that any packing needs, by dual feasible functions.

    A function u with sum(u(x)) <= 1 for all lengths that fit one sequence turns
    every instance into the bound ceil(sum(u)).  Taken: u(x) = x / capacity; for
    each threshold t <= capacity / 2, lengths over capacity - t count as whole
    sequences and those under t as none; and the step functions with
    denominator k = 1 .. ``most``, alone and after each threshold.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    best = -(-int((count * sizes).sum()) // capacity)
    half = capacity // 2
    # thresholds: whole sequences above, nothing below, the plain share between
    number, total = np.cumsum(count), np.cumsum(count * sizes)
    t = np.arange(1, half + 1)
    whole = number[-1] - number[capacity - t]
    between = total[capacity - t] - total[t - 1]
    best = max(best, int((-(-(whole * capacity + between) // capacity)).max()))
    for k in range(1, most + 1):  # steps in units of 1 / k; exact multiples keep their share
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        # in units of 1 / (capacity * k): an exact multiple is sizes * k, another floor(scaled / capacity) * capacity
        u = np.where(exact, sizes * k, scaled // capacity * capacity)
        unit = capacity * k
        summed = np.cumsum(count * u)
        best = max(best, -(-int(summed[-1]) // unit))
        mixed = whole * unit + summed[capacity - t] - summed[t - 1]
        best = max(best, int((-(-mixed // unit)).max()))
    return best


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of every document, without a place yet."""
    end = end_id.to_bytes(WIDTH, "little")

    def run(batches):
        encode = word_encoder(tokenizer_path)

        def pieces():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                ids = memoryview(encode(text) + end)
                for number, at in enumerate(range(0, len(ids), capacity * WIDTH)):
                    part = ids[at:at + capacity * WIDTH]
                    yield doc_id, number, at // WIDTH, len(part) // WIDTH, zlib.crc32(part)
        return batches_from(pieces(), pa.schema(PIECE), 16384)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECE_DDL)


def _packed(batches, capacity: int, number: int, last: bool, most: int) -> Iterator[pa.RecordBatch]:
    """One block: its pieces with their places; ``open`` ones go into the next round."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).select([n for n, _ in PIECE])
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"),
                           ("ids_crc32", "ascending")]).combine_chunks()
    lengths = table.column("length").to_numpy()
    where, offset, room = best_fit(lengths, capacity)
    met = len(room) <= bins_needed(lengths, capacity, most)
    rooms = np.array(room)
    if last:
        left = np.zeros(len(room), bool)
    elif met:
        left = np.arange(len(room)) == rooms.argmax()
        left &= rooms > 0
    else:
        left = rooms > 0  # full sequences cannot be bettered
    first = number << ROUND_BITS | partition_id() << BLOCK_BITS
    columns = [*table.columns, pa.array(where + first), pa.array(offset), pa.array(left[where]),
               pa.array(np.full(len(lengths), met))]
    yield from pa.table(columns, names=[n for n, _ in PIECE + PLACE]).to_batches(16384)


def repack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, rounds: int = 6,
           block_pieces: int = 32768, steps: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its sequence and place; as few sequences of at most ``capacity`` ids as the rounds find.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is
    cut, into pieces of that length and a last shorter one.  ``certified`` tells
    that the block which placed the piece met its lower bound.  A null or empty
    text is its end id alone; a null id stays null; repeated rows are packed
    each; an empty table gives no rows; other columns are ignored.  A task holds
    one block of about ``block_pieces`` pieces, without ids or texts.
    """
    spark = docs.sparkSession
    names = [n for n, _ in PIECE]
    pool = written(pieces_of(docs, tokenizer_path, end_id, capacity, id_col, text_col))
    settled: DataFrame | None = None
    before = None  # sequences that the pool's pieces have now
    old_blocks = 0
    for number in range(rounds):
        size = pool.count()
        if not size:
            break
        blocks = max(1, math.ceil(size / block_pieces))
        if blocks == old_blocks:  # as many again would be dealt alike: one less mixes them anew
            blocks = max(1, blocks - 1)
        old_blocks = blocks
        last = blocks == 1 or number == rounds - 1

        def run(batches, number=number, last=last):
            return _packed(batches, capacity, number, last, steps)

        # dealt in turn, so that every block gets the same mixture (Spark sorts first: a retry deals alike)
        done = written(pool.select(*names).repartition(blocks).mapInArrow(run, f"{PIECE_DDL}, {PLACE_DDL}"))
        if before is not None:
            now = done.select("sequence_id").distinct().count()
            if now >= before:
                break
        settled = done.where("NOT open") if settled is None else settled.unionAll(done.where("NOT open"))
        pool = done.where("open")
        before = pool.select("sequence_id").distinct().count()
    # what no round bettered stays where the last round that was taken put it
    result = pool if settled is None else settled.unionAll(pool) if "open" in pool.columns else settled
    if settled is None:
        return spark.createDataFrame([], f"{PIECE_DDL}, sequence_id long, `offset` long, certified boolean")
    return result.select(*names, "sequence_id", "offset", "certified")
