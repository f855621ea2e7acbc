"""Operators 4, 5, 9 and 10 against the tokenizer libraries themselves."""

import base64
import hashlib
import io
import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tavola.llm import token_files as TF
from tavola.llm.bpe import Bpe, decode_documents, encode_documents, round_trip
from tavola.llm.packing import Piece, balance, pack
from tavola.llm.token_counts import count_rows, token_counts

from .fixtures import ROWS, frame, key, sample

WORD, BYTE, MULTI = (P.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))


def library_ids(path, text, end=None):
    ids = Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids
    return array("I", ids + ([end] if end is not None else [])).tobytes()


@pytest.fixture(scope="module")
def word_ids():
    tok = Tokenizer.from_file(WORD)
    return lambda text, end: array("I", tok.encode(text or "", add_special_tokens=False).ids + [end]).tobytes()


def test_token_counts(spark):
    rows = ROWS + sample()
    tok = Tokenizer.from_file(BYTE)
    want = []
    for d, t in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 512))
    assert key(token_counts(frame(spark, rows), BYTE).collect()) == key(want)
    assert list(count_rows(((d, t or "") for d, t in rows), BYTE, 512, 100)) == want  # long texts in small pieces
    assert token_counts(frame(spark, []), BYTE).count() == 0


def library_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark):
    rows, enc = ROWS + sample(), library_bpe()
    want = []
    for d, t in rows:
        ids = array("I", enc.encode_ordinary(t or "")).tobytes()
        want.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    df = frame(spark, rows)
    assert key(round_trip(df, MULTI, P.PATTERN).collect()) == key(want)
    back = decode_documents(encode_documents(df, MULTI, P.PATTERN), MULTI, P.PATTERN)
    assert key(back.collect()) == key((d, t or "") for d, t in rows)


def test_bpe_queue_on_long_and_odd_pre_tokens():
    enc, bpe, rng = library_bpe(), Bpe(MULTI, P.PATTERN), random.Random(5)
    for text in ["a" * 70001, "ab" * 20000, "".join(rng.choice("etaoin") for _ in range(60000)),
                 "".join(chr(rng.randrange(0x20, 0xD7FF)) for _ in range(3000)),
                 "".join(chr(rng.randrange(0x10000, 0x40000)) for _ in range(3000))]:
        assert bpe.encode(text) == array("I", enc.encode_ordinary(text)).tobytes()
    assert bpe.queue.top == 0 and not bpe.queue.buckets


def test_packing(spark, word_ids):
    rows = [(k, t) for k, (d, t) in enumerate(ROWS + sample())]
    pieces = pack(frame(spark, rows), WORD, end_id=2, with_ids=True, block_tokens=20000).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32 and p.length > 0
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for d, t in rows:
        parts = sorted(docs[d], key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in parts) == word_ids(t, 2)
        assert [p.start for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist()
        assert {p.doc_tokens for p in parts} == {sum(p.length for p in parts)}
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist()
        n = sum(p.length for p in parts)
        assert n <= 4096 and n & (n - 1) == 0  # a power of two: no padding
    assert pack(frame(spark, []), WORD, end_id=2).count() == 0
    repeated = pack(frame(spark, [(None, None), (None, None), (3, "a")]), WORD, end_id=2).collect()
    assert sum(p.length for p in repeated) == 4 and sum(p.doc_id is None for p in repeated) == 2


def test_token_files(spark, word_ids, tmp_path):
    rows = ROWS + [(d + 100, t) for d, t in sample()]
    manifest = TF.write_token_files(frame(spark, rows), f"file://{tmp_path}/ids", WORD, end_id=1, chunk_ids=1000)
    got = sorted(TF.read_token_files(spark, manifest).collect(), key=lambda r: r.start)
    want = sorted(((d, word_ids(t, 1)) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert key((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == key((d, len(x) // 4, zlib.crc32(x)) for d, x in want)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    empty = TF.write_token_files(frame(spark, []), f"file://{tmp_path}/none", WORD, end_id=1)
    assert empty == [] and TF.read_token_files(spark, empty).count() == 0


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes(kind):
    rng = np.random.default_rng(1)
    for ids in [np.zeros(0), np.zeros(5), rng.integers(0, 49408, 1001), rng.integers(0, 2**32, 77)]:
        ids = ids.astype("<u4")
        assert (TF.from_planes(TF.to_planes(ids, kind), len(ids), kind) == ids).all()
    docs = [(None, b""), (3, rng.integers(0, 50000, 2500).astype("<u4").tobytes()), (4, b""), (5, b"\x01\0\0\0")]
    out = io.BytesIO()
    TF.write_shard(out, docs, 1000, kind, 3)
    back = list(TF.read_shard(io.BytesIO(out.getvalue()), len(out.getvalue())))
    assert back == [(d, len(x) // 4, zlib.crc32(x)) for d, x in docs]
    with pytest.raises(ValueError):
        list(TF.read_shard(io.BytesIO(out.getvalue()[:-1]), len(out.getvalue()) - 1))


def test_packing_looks_at_every_sequence():
    cost = lambda n: n + n * n / 1024
    rng = random.Random(8)
    for _ in range(5):
        sizes = [1 + int(min(1000, rng.expovariate(1 / 200))) for _ in range(500)]
        pieces = [Piece(d, 0, memoryview(bytes(4 * n)), n) for d, n in enumerate(sizes + [1024 - sum(sizes) % 1024])]
        got, held = balance(pieces, 1024, 1.0, 1 / 1024)
        n = len(got)
        want, room, dear = [[] for _ in range(n)], [1024] * n, [0.0] * n
        waiting = sorted(pieces, key=lambda p: (-p.size, p.doc_id))
        while waiting:  # the cheapest of all with room, by looking at each
            p = waiting.pop(0)
            fits = [(dear[k], k) for k in range(n) if room[k] >= p.size]
            k = min(fits or [(dear[k], k) for k in range(n) if room[k]])[1]
            if not fits:
                p, rest = p.cut(room[k])
                waiting.insert(0, rest)
            want[k].append(p)
            room[k] -= p.size
            dear[k] += cost(p.size)
        told = lambda out: [[(p.doc_id, p.start, p.size) for p in s] for s in out]
        assert told(got) == told(want) and not held
