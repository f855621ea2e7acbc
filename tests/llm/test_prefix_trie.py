"""Operator 11 against the trie built in plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tavola.llm.prefix_trie import TernaryTree, medians, merged, prefix_trie, shard_rows

SCHEMA = "conv_id long, turn long, role string, text string, giver int, path string, words int, shard int, id int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        giver = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(giver, [])[:h] + turns[h:]
    return out


def brute(rows):
    paths = rebuilt(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
        ends[tuple(paths[c])].append(c)
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, who in members.items():
        own = (len(who) - 1) * len(WORDS.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += own
    return sorted((who[0], len(k), members[k[:-1]][0] if k else None, len(who), children[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, who in members.items())


def told(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "p", 2, 3, 4) for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, prefix_trie(df).collect()), key=lambda r: (r[0], r[1]))


def made(n, rng, texts):
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(1, 6)):
            rows.append((c, turn, "ua"[turn % 2], rng.choice(texts)))
    return rows


@pytest.fixture
def many_shards(spark):
    """As many shards as there are shuffle partitions, down to a few rows each."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_random_conversations(spark, many_shards):
    rng = random.Random(3)
    rows = made(300, rng, ["a", "b b", "c  c\tc", "", "d " * 50])
    rows += [(c, None, "u", "hot start") for c in range(300, 500)]  # a third of all ids hold one conversation
    rows += [(c, 1, "a", "hot answer") for c in range(300, 500)]
    rng.shuffle(rows)
    assert told(spark, rows) == brute(rows)


def test_awkward_rows(spark, many_shards):
    rows = [(1, None, None, None), (1, 0, "u", "x y"), (1, 0, "u", "x y"), (1, 0, "a", "z"), (2, 5, "", ""), (3, -1, "u", None),
            (None, 0, "u", "no id"), (21, 0, "u", "one"), (22, 0, "u", "one"), (23, 0, "u", "one"), (24, 0, "u", "one"),
            (-7, 0, "u", "minus"), (-20, 0, "u", "giver of -25"), (-25, 0, "u", "q"), (-25, 1, "u", "é  w"),
            (40, 0, "u", "long " * 100000), (41, 0, "u", "long " * 100000), (41, 1, "u", "r"), (41, 2, "u", "r"), (41, 3, "u", "r")]
    want = brute(rows)
    assert any(not p for p in rebuilt(rows).values())  # a conversation that loses all its turns
    assert told(spark, rows) == want
    assert told(spark, []) == [] and told(spark, [(None, 1, "u", "x")]) == []


def test_deep_conversation(spark, many_shards):
    rows = [(c, k, "u", f"turn {k}") for c in (20, 40, 45) for k in range(150)] + [(45, 150, "u", "one more")]
    assert told(spark, rows) == brute(rows)


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_shards_and_merge(shards):
    """Border rows merge to the same trie however the sorted conversations are cut."""
    rng = random.Random(shards)
    alphabet = [hashlib.sha256(bytes([k])).digest()[:16] for k in range(3)]
    items = sorted((b"".join(rng.choice(alphabet) for _ in range(rng.randrange(5))), c) for c in range(120))
    cuts = sorted(rng.randrange(121) for _ in range(shards - 1))
    parts = [items[a:b] for a, b in zip([0, *cuts], [*cuts, 120])]
    nodes = [r for k, part in enumerate(parts) for r in shard_rows(k, iter([(c, p, [2] * (len(p) // 16)) for p, c in part]))]
    border = [r for r in nodes if r[2] is not None]
    whole = list(merged((r[2], r[4], 0, 0, *r[7:11], r[11], r[12]) for r in border))
    inner = [(0, r[4], 0, *r[7:11], r[13]) for r in nodes if r[2] is None]
    trie = defaultdict(list)
    for p, c in items:
        for d in range(0, len(p) + 1, 16):
            trie[p[:d]].append((c, d == len(p)))
    want = []
    for k, who in trie.items():
        under = {q: len(v) for q, v in trie.items() if q.startswith(k)}
        want.append((len(k) // 16, len(who), sum(len(q) == len(k) + 16 for q in under),
                     sum(not any(x != q and x.startswith(q) for x in under) for q in under),
                     sum((n - 1) * 2 for q, n in under.items() if q),
                     hashlib.sha256(",".join(str(c) for c, e in who if e).encode()).hexdigest()))
    assert sorted((r[1], *r[3:]) for r in whole + inner) == sorted(want)


def test_median_insertion_balances_siblings():
    assert sorted(medians(100)) == list(range(100))
    tree = TernaryTree()
    for k in medians(1000):
        tree.insert([k])
    at, deepest = [(tree.child[0], 1)], 0
    while at:
        node, level = at.pop()
        if node:
            deepest = max(deepest, level)
            at += [(tree.less[node], level + 1), (tree.more[node], level + 1)]
    assert deepest == 10
