"""Operator 12: exact pieces, valid sequences, and bounds against exhaustive packing."""

import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tavola.llm.bin_repack import best_fit, bins_needed, repack

from .fixtures import ROWS, frame, sample

WORD = P.path("word_bpe_49k.json")


def fewest(lengths, capacity):
    """The least number of sequences, by trying every assignment."""
    @lru_cache(None)
    def more(rest, rooms):
        if not rest:
            return 0
        n, rest = rest[0], rest[1:]
        best = 1 + more(rest, tuple(sorted([*rooms, capacity - n])))
        for k, room in enumerate(rooms):
            if room >= n and room not in rooms[:k]:
                best = min(best, more(rest, tuple(sorted([*rooms[:k], room - n, *rooms[k + 1:]]))))
        return best
    return more(tuple(sorted(lengths, reverse=True)), ())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_bound_and_best_fit_enclose_the_optimum(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    where, offset, room = best_fit(lengths, 20)
    best = fewest(lengths.tolist(), 20)
    assert bins_needed(lengths, 20) <= best <= len(room)
    used = defaultdict(int)
    for n, w, o in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        assert used[w] == o
        used[w] += n
    assert all(used[w] + room[w] == 20 and room[w] >= 0 for w in range(len(room)))


def test_bounds_beyond_the_plain_sum():
    assert bins_needed(np.full(10, 11), 20) == 10  # over half: one each
    assert bins_needed(np.full(10, 7), 20) == 5  # over a third: two each
    assert bins_needed(np.array([13, 13, 8, 8]), 20) == 3  # the plain sum says 3 too
    assert bins_needed(np.zeros(0, np.int64), 20) == 0


def test_best_fit_takes_the_tightest_room():
    where, offset, room = best_fit(np.array([15, 12, 8, 5]), 20)
    assert where.tolist() == [0, 1, 1, 0] and offset.tolist() == [0, 0, 12, 15] and room == [0, 0]


def check(rows, pieces, capacity, end):
    tok = Tokenizer.from_file(WORD)
    want = defaultdict(int)
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [end]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want[d, k, at, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    got, used = defaultdict(int), defaultdict(list)
    for r in pieces:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        used[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(used), -(-sum(r.length for r in pieces) // capacity)


def test_whole_documents_in_few_sequences(spark):
    rows = ROWS + sample()
    out = repack(frame(spark, rows), WORD, 0).collect()
    used, least = check(rows, out, 2048, 0)
    bound = bins_needed(np.array([r.length for r in out]), 2048)
    assert least <= bound <= used <= bound + 1  # one block: nothing to exchange with
    assert all(r.certified == (used == bound) for r in out)


def test_small_blocks_exchange_documents(spark):
    rows = sample()
    alone = repack(frame(spark, rows), WORD, 7, capacity=512, rounds=1, block_pieces=16).collect()
    one, least = check(rows, alone, 512, 7)
    met = repack(frame(spark, rows), WORD, 7, capacity=512, rounds=6, block_pieces=16).collect()
    used, _ = check(rows, met, 512, 7)
    assert least <= used < one


def test_awkward_tables(spark):
    assert repack(frame(spark, []), WORD, 0).count() == 0
    rows = [(1, None), (1, ""), (None, "a"), (2, " "), (3, "word " * 9000)] * 3
    assert check(rows, repack(frame(spark, rows), WORD, 0, block_pieces=4).collect(), 2048, 0)[0] <= 15
