"""Operator 2 against all pairs."""

import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest

from tavola.llm import components, near_dup
from tavola.llm.common import written
from tavola.llm.components import connected_components
from tavola.llm.near_dup import PrefixTree, jaccard_components, one_of_each, prefix_length
from tavola.llm.words import shingles, word_hashes

from .fixtures import ROWS, frame, key, sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def set_of(text):
    w = words_of(text)
    k = min(5, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows):
    """(doc_id, set size, component id) by testing all pairs that share a shingle."""
    sets = [set_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for k, s in enumerate(sets):
        if rows[k][0] is not None:
            for x in s:
                by.setdefault(x, []).append(k)
    for a, b in {(a, b) for g in by.values() for i, a in enumerate(g) for b in g[:i]}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            parent[root(a)] = root(b)
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None and sets[k]:
            low[root(k)] = min(low.get(root(k), d), d)
    return [(d, len(sets[k]), d if d is None or not sets[k] else low[root(k)]) for k, (d, _) in enumerate(rows)], \
        [root(k) for k in range(len(rows))]


def family(rng, first, size, n_words, most_edits):
    """A text and variants that differ from it, and more from one another, in some words."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
    rows = [(first, " ".join(base))]
    for k in range(1, size):
        w = list(base)
        for _ in range(rng.randrange(most_edits + 1)):
            w[rng.randrange(n_words)] = f"e{rng.randrange(10**6)}"
        rows.append((first + k, " ".join(w)))
    return rows


def families():
    rng = random.Random(7)
    rows = []
    for k in range(12):
        rows += family(rng, 10_000 + 1000 * k, rng.choice([2, 3, 8, 20]), rng.choice([6, 40, 120]), 6)
    rows += family(rng, 50_000, 150, 100, 6)
    rows += family(rng, 60_000, 90, 60, 9)[1:]  # its source is missing
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(70_000 + k, passage + " " + " ".join(f"t{rng.randrange(10**6)}" for _ in range(rng.choice([3, 9, 14, 16, 40, 90]))))
             for k in range(120)]
    return rows


def test_words_and_shingles():
    for text in ["", " \n", "A b", "a B c d E\t", "é\xa0É  Z x\x1cy", "x " * 9 + "y"] + [t for _, t in sample()[:40]]:
        words = words_of(text)
        hashes = word_hashes(text).tolist()
        assert len(hashes) == len(words) and len(set(hashes)) == len(set(words))
        assert len(shingles(text)) == len(set_of(text))
    assert (shingles("One two\nTHREE four five six") == shingles("one  two three FOUR five\tsix")).all()
    assert not set(shingles("a b c").tolist()) & set(shingles("a b c a b c").tolist())


def test_prefix_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
        sets += [np.unique(np.concatenate([s[:-1], [np.uint64(rng.integers(0, 60))]])) for s in sets]
        tree = PrefixTree(np.zeros(0, np.uint64))
        for k, s in enumerate(sets):
            tree.add(s, k)
        for q in sets:
            want = [k for k, s in enumerate(sets)
                    if 180 * len(np.intersect1d(q, s)) >= 80 * (len(q) + len(s))]
            assert sorted(tree.search(q, 80)) == want


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(500, 501), (7, 7), (900, 900)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    parent = {x: x for e in links for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in linked)


def chains(rng, first, n_chains, size, n_words):
    """Texts that differ from the one before in a word: only near ones of a chain link."""
    rows = []
    for c in range(n_chains):
        w = [f"c{rng.randrange(10**6)}" for _ in range(n_words)]
        for k in range(size):
            w[rng.randrange(n_words)] = f"e{rng.randrange(10**6)}"
            rows.append((first + 100 * c + k, " ".join(w)))
    return rows


def test_components_of_stars_take_no_round(spark, monkeypatch):
    links = [(100 * c, 100 * c + k) for c in range(1, 5) for k in range(1, 9)]
    tables = []
    monkeypatch.setattr(components, "written", lambda df: tables.append(df) or written(df))
    got = connected_components(spark.createDataFrame(links * 2, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted({(x, a) for a, b in links for x in (a, b)})
    assert len(tables) == 2  # the links, the smallest neighbours


def test_later_components_start_from_stars(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 4)
    rows = chains(random.Random(3), 60_000, 3, 30, 80)
    calls = []

    def counted(links, a, b):
        found = connected_components(links, a, b)
        calls.append((links.where("a <> b").count(), found.count()))
        return found

    tested = []
    monkeypatch.setattr(near_dup, "connected_components", counted)
    monkeypatch.setattr(near_dup, "_tested", lambda *a, f=near_dup._tested: tested.append(a) or f(*a))
    got = jaccard_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert key(got) == key(brute(rows)[0])
    assert len(calls) == len(tested) > 1  # once after each round of tests, not again at the end


def test_no_likely_pairs_leave_the_others(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 4)
    cell = near_dup._group_cell
    none = lambda table: table.select(["sid", "n"]).slice(0, 0).rename_columns(["a", "b"]).cast(pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    monkeypatch.setattr(near_dup, "_group_cell", lambda percent, best: none if best else cell(percent, best))
    monkeypatch.setattr(near_dup, "_small_pairs", lambda rest, sets, percent: rest.selectExpr("sid AS a", "sid AS b").limit(0))
    rows = chains(random.Random(3), 60_000, 3, 30, 80)
    got = jaccard_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert key(got) == key(brute(rows)[0])


@pytest.mark.parametrize("setting", ["production", "hot cells", "small blocks"])
def test_components_of_documents(spark, monkeypatch, setting):
    rows = ROWS + [(None, ROWS[7][1])] + families() + sample()
    if setting == "small blocks":
        monkeypatch.setattr(near_dup, "BLOCK", 32)
        monkeypatch.setattr(near_dup, "SMALL", 4)
    hot = 40 if setting == "hot cells" else 1 << 16
    want, _ = brute(rows)
    got = jaccard_components(frame(spark, rows), hot=hot).select("doc_id", "n_shingles", "component_id").collect()
    assert key(got) == key(want)


def test_group_cell_takes_group_lists_whole():
    """Pairs of a cell against a plain rule; the calls made do not grow with the groups that its sets share."""
    rng, here, gids = np.random.default_rng(5), 902, np.arange(900, 1300)
    n, counts = rng.integers(90, 180, 200), rng.integers(0, 3, (200, 256)).astype(np.uint8)
    groups = [np.unique(np.append(rng.choice(gids[k % 2 * 100:], 200, replace=False), here)) for k in range(200)]
    base = [{"gid": here, "sid": k, "n": int(n[k]), "component": k % 7, "other": 1, "counts": counts[k].tobytes(),
             "groups": [{"gid": int(g), "shared": 1} for g in groups[k]]} for k in range(200)]
    rows = [{**r, "outside": False} for r in base] + [{**r, "outside": True} for r in base[:4]]
    cell = pa.Table.from_pylist(rows)
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    got = near_dup._group_cell(80, None)(cell)
    sys.setprofile(None)
    assert len(calls) < sum(map(len, groups)) / 10
    want = set()
    for k in range(4):
        for m in range(200):
            both = np.intersect1d(groups[k], groups[m])
            most = min(len(both) + 1 + max(n[x] - prefix_length(int(n[x]), 80) for x in (k, m)), int(np.minimum(counts[k], counts[m]).sum()))
            size = 100 * min(n[k], n[m]) >= 80 * max(n[k], n[m])
            if both[0] == here and k % 7 != m % 7 and size and 180 * most >= 80 * (n[k] + n[m]):
                want.add((k, m))
    assert set(zip(*(c.to_pylist() for c in got.columns))) == want and want
    assert near_dup._group_cell(80, None)(cell.slice(0, 200)).num_rows == 0  # none outside the main component


def test_empty_table(spark):
    assert jaccard_components(frame(spark, [])).count() == 0
    assert jaccard_components(frame(spark, [(1, None), (None, "a")])).count() == 2


def test_one_of_each(spark):
    rows = ROWS + families()[:80]
    df = frame(spark, rows)
    out = one_of_each(df)
    assert out.columns == df.columns
    want, root = brute(rows)
    chosen = {}
    stay = []
    for k, (d, t) in enumerate(rows):
        if d is None:
            stay.append(d)
        elif not want[k][1]:
            stay.append(d)
        else:
            chosen.setdefault(root[k], []).append(d)
    assert key([r.doc_id] for r in out.collect()) == key([[x] for x in stay + [min(v) for v in chosen.values()]])
