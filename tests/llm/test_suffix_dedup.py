"""Operator 6 against a dictionary of all 400-byte strings."""

import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest

from tavola.llm import passages
from tavola.llm.suffix_dedup import Parse, merged, repeated_substrings

from .fixtures import ROWS, frame, key, sample

LOWER = {k: k + 32 for k in range(65, 91)}


def brute(rows, length):
    count = {}
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        for i in range(len(raw) - length + 1):
            s = hash(raw[i:i + length])
            count[s] = count.get(s, 0) + 1
    out = []
    for (d, _), raw in zip(rows, raws):
        gone, spans = bytearray(len(raw)), []
        for i in range(len(raw) - length + 1):
            if count[hash(raw[i:i + length])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        for a, z in spans:
            gone[a:z] = b"\1" * (z - a)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), sum(gone), len(spans), hashlib.sha256(kept).hexdigest(),
                    b"".join(struct.pack("<qq", a, z) for a, z in spans)))
    return out


def planted(length):
    """Passages of all lengths around the limit, at all alignments, whole and with one byte changed."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randrange(60, 240)) for _ in range(12)]
    rows = []
    for k in range(150):
        p = rng.choice(passages)
        a, z = sorted(rng.randrange(len(p)) for _ in range(2))
        if k % 3 == 0:
            a, z = 0, len(p)
        if k % 5 == 0:
            z = min(len(p), a + length + rng.randrange(-2, 3))
        q = p[a:z]
        if k % 7 == 0 and q:
            i = rng.randrange(len(q))
            q = q[:i] + "#" + q[i + 1:]
        rows.append((1000 + k, prose(rng.randrange(30)) + q + prose(rng.randrange(30))))
    rows += [(2000, "ab" * 700), (2001, "x" * (length - 1)), (2002, "x" * length), (2003, "y" * (length + 1)),
             (2004, prose(30) + "ab" * 260), (2005, "0123456789" * 90 + "!" + "0123456789" * 45), (2006, "z" * 399 + "q" + "z" * 399)]
    return rows


@pytest.mark.parametrize("length", [400, 100])
def test_against_all_strings(spark, length):
    rows = ROWS + planted(length) + (sample()[:60] if length == 400 else [])
    got = repeated_substrings(frame(spark, rows), length).drop("repeats_passage").collect()
    assert key(got) == key((d, n, r, s, h, bytearray(x)) for d, n, r, s, h, x in brute(rows, length))


def test_empty_table(spark):
    assert repeated_substrings(frame(spark, [])).count() == 0
    got = repeated_substrings(frame(spark, [(1, None), (None, "a" * 500), (None, "a" * 500)])).collect()
    assert key((r.doc_id, r.n_removed) for r in got) == key([(1, 0), (None, 500), (None, 500)])


def test_equal_strings_have_equal_phrases():
    rng = np.random.default_rng(4)
    core = rng.integers(97, 105, 400).astype(np.uint8)
    ends = []
    for pad in range(40):
        text = np.concatenate([rng.integers(97, 105, pad), core, rng.integers(97, 105, 60)]).astype(np.uint8).tobytes().decode()
        p = Parse(text, 400)
        assert np.diff(p.ends).max() <= p.span
        inside = p.ends[(p.ends >= pad + p.span + 7) & (p.ends <= pad + 400 - p.span + 1)] - pad
        ends.append(inside.tolist())
    assert all(e == ends[0] for e in ends) and len(ends[0]) > 5


def test_merged():
    assert merged(np.array([[5, 9], [0, 3], [3, 4], [8, 20], [30, 31]])).tolist() == [[0, 4], [5, 20], [30, 31]]


def windows(text, size):
    w = [x.translate(LOWER) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def test_passages_of_other_rows(spark, monkeypatch):
    rows = ROWS + sample() + [(5000, "u " * 30 + "same words " * 40), (5001, "Same WORDS\n" * 40 + "v " * 9)]
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    for k, n in enumerate((39, 40, 50, 51, 52, 70, 51)):
        p = prose(n)
        rows += [(6000 + 2 * k, prose(20) + " " + p + " " + prose(k)), (6001 + 2 * k, prose(k) + "\n" + p + " " + prose(90))]
    hot = prose(51)
    rows += [(7000 + k, prose(rng.randrange(9)) + " " + hot + " " + prose(5)) for k in range(200)]  # a third of all rows
    rows += [(8000, "only a b c " * 60), (8001, prose(300))]
    for batch in (1 << 19, 40):  # compared in one task, and mostly after the shuffle
        monkeypatch.setattr(passages, "BATCH", batch)
        got = {(r.doc_id, r.n_bytes): r.repeats_passage for r in repeated_substrings(frame(spark, rows)).collect()}
        for size, sure in ((51, 1), (40, 0)):
            own = [windows(t, size) for _, t in rows]
            count = Counter(w for s in own for w in s)
            for (d, t), s in zip(rows, own):
                if (max(map(count.__getitem__, s), default=0) > 1) == bool(sure):
                    assert got[d, len((t or "").encode())] == sure, (d, size)


def test_sampled_windows():
    words = [f"w{k * k % 101}" for k in range(200)]
    every = passages.sampled(" ".join(words), 40, 1)
    assert len(every) == len({tuple(words[i:i + 40]) for i in range(161)})
    some = passages.sampled(" ".join(words), 40, 12)
    assert set(some) <= set(every) and 161 // 12 <= len(some) <= 60
    for at in range(200 - 51):  # each run of 51 words holds one of them
        assert set(passages.sampled(" ".join(words[at:at + 51]), 40, 12)) <= set(some)
    assert len(passages.sampled("a b", 40, 12)) == 0 and len(passages.sampled("", 40, 12)) == 0
