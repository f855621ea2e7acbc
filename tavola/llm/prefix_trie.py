"""Prefix trie of conversations (operator 11).

A turn becomes a 128-bit key, so that texts are read once and never travel; a
conversation becomes the string of its keys.  Conversations are range-partitioned
by (keys, id), which leaves each trie node's members next to one another and
spreads a conversation that many ids share over several shards.  A shard
numbers its distinct keys (its dictionary), inserts its distinct sequences into
a ternary search tree, always the median of what is left first, and accumulates
members, leaves and savings from the deepest nodes up.

Only nodes on a shard's first and last sequence can have members in other
shards.  They leave the shard as partial rows: own members and the sums over
the subtrees that lie wholly inside.  One ordered pass over these (at most two
sequences a shard) merges equal neighbours and carries the sums up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_from, partition_id, rows_of, written

KEY = 16  # bytes of a turn's key
ROOT = b"\0" * KEY
SHARD = [("shard", pa.int32()), ("place", pa.int64()), ("id", pa.binary()), ("parent", pa.binary()),
         ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
         ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
         ("words", pa.int64()), ("ends", pa.binary()), ("ends_sha256", pa.string())]
SHARD_DDL = ("shard int, place long, id binary, parent binary, depth long, conv_id long, parent_conv_id long, "
             "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends binary, ends_sha256 string")
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class TernaryTree:
    """Trie nodes whose children hang in a binary search tree: links to smaller and larger siblings and to the first child met."""

    def __init__(self) -> None:
        self.symbol, self.less, self.more, self.child = [-1], [0], [0], [0]
        self.parent, self.depth = [-1], [0]

    def _new(self, symbol: int, parent: int) -> int:
        self.symbol.append(symbol)
        self.less.append(0)
        self.more.append(0)
        self.child.append(0)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.symbol) - 1

    def insert(self, symbols: list[int]) -> int:
        """The node that ends the sequence; nodes it lacks are made, parents before children."""
        at = 0
        for s in symbols:
            node, link = self.child[at], self.child
            before = at
            while node and self.symbol[node] != s:
                link = self.less if s < self.symbol[node] else self.more
                before, node = node, link[node]
            if not node:
                node = link[before] = self._new(s, at)
            at = node
        return at

    def path(self, node: int) -> list[int]:
        """The nodes from the root to this one."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]


def medians(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle of every range before its halves."""
    ranges = [(0, n)]
    while ranges:
        low, high = ranges.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            ranges += [(middle + 1, high), (low, middle)]


def shard_rows(shard: int, rows: Iterator[tuple[int, bytes, list[int]]]) -> Iterator[tuple]:
    """Node rows (``SHARD``) of one shard's (id, keys, words a turn), in the order of (keys, id)."""
    ids: list[int] = []
    paths, starts, counts = [], [], []  # distinct sequences, their first row, words of their turns
    for conv_id, keys, words in rows:
        if not paths or keys != paths[-1]:
            paths.append(keys)
            starts.append(len(ids))
            counts.append(words)
        ids.append(conv_id)
    if not ids:
        return
    starts.append(len(ids))
    keys, codes = np.unique(np.frombuffer(b"".join(paths), f"S{KEY}"), return_inverse=True)
    names = [k.ljust(KEY, b"\0") for k in keys.tolist()]
    cuts = np.cumsum([0, *(len(p) // KEY for p in paths)])
    tree = TernaryTree()
    words = [0]
    last = {}  # node -> sequence that ends in it
    for k in medians(len(paths)):
        node = tree.insert(codes[cuts[k]:cuts[k + 1]].tolist())
        last[node] = k
        made = len(tree.symbol) - len(words)  # new nodes are the deepest of the sequence
        if made:
            words += counts[k][len(counts[k]) - made:]
    size = len(words)
    border = [False] * size
    found = {k: node for node, k in last.items()}
    spine = []
    for node in tree.path(found[0]) + tree.path(found[len(paths) - 1]):
        if not border[node]:
            border[node] = True
            spine.append(node)

    members, least, children, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    for node in range(size - 1, -1, -1):  # children were made after their parents
        k = last.get(node)
        if k is not None:
            members[node] += starts[k + 1] - starts[k]
            least[node] = ids[starts[k]] if least[node] is None else min(least[node], ids[starts[k]])
        up = tree.parent[node]
        if not border[node]:
            leaves[node] += not children[node]
            saved[node] += (members[node] - 1) * words[node]
            if up >= 0:
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
        if up >= 0:
            members[up] += members[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])

    def ends(node: int) -> bytes:
        k = last.get(node)
        return b"" if k is None else ",".join(map(str, ids[starts[k]:starts[k + 1]])).encode()

    name = {0: ROOT}
    for place, node in enumerate(spine):
        up = tree.parent[node]
        if up >= 0:
            name[node] = hashlib.blake2b(name[up] + names[tree.symbol[node]], digest_size=KEY).digest()
        yield (shard, place, name[node], name.get(up), tree.depth[node], least[node], None, members[node],
               children[node], leaves[node], saved[node], words[node], ends(node), None)
    nothing = hashlib.sha256(b"").hexdigest()
    for node in range(size):
        if not border[node]:
            up = tree.parent[node]
            yield (shard, None, None, name.get(up), tree.depth[node], least[node], least[up], members[node],
                   children[node], leaves[node], saved[node], None, None,
                   hashlib.sha256(ends(node)).hexdigest() if node in last else nothing)


class Open:
    """A border node whose subtree is still being read."""

    def __init__(self, row: tuple) -> None:
        self.id, self.depth, self.conv_id, self.parent_conv_id, self.words = row[0], row[1], row[2], row[3], row[8]
        self.members = self.children = self.leaves = self.saved = 0
        self.ends, self.any = hashlib.sha256(), False

    def add(self, row: tuple) -> None:
        self.members += row[4]
        self.children += row[5]
        self.leaves += row[6]
        self.saved += row[7]
        if row[9]:
            self.ends.update(b"," * self.any + row[9])
            self.any = True

    def closed(self) -> tuple:
        self.leaves += not self.children
        self.saved += (self.members - 1) * self.words
        return (self.conv_id, self.depth, self.parent_conv_id, self.members, self.children, self.leaves, self.saved,
                self.ends.hexdigest())


def merged(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Finished nodes of border rows (id, depth, conv_id, parent_conv_id, members, children, leaves, saved, words, ends) in trie order."""
    stack: list[Open] = []

    def close(depth: int) -> Iterator[tuple]:
        while len(stack) > depth:
            node = stack.pop()
            yield node.closed()
            if stack:
                stack[-1].children += 1
                stack[-1].leaves += node.leaves
                stack[-1].saved += node.saved
    for row in rows:
        depth = row[1]
        if len(stack) > depth and stack[depth].id == row[0]:
            stack[depth].add(row)  # the same node, seen from the next shard; deeper ones may go on too
            continue
        yield from close(depth)
        stack.append(Open(row))
        stack[-1].add(row)
    yield from close(0)


def turn_key(role: Column, text: Column) -> Column:
    """128 bits of a turn's role and text, as 32 hexadecimal digits (their order is that of the bytes)."""
    return F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256), 1, 2 * KEY)


def rebuilt(conversations: DataFrame, every: int = 20, shared: int = 4) -> DataFrame:
    """``conv_id``, ``path`` (keys of the rebuilt turns, joined) and ``words`` (a turn) of every conversation.

    The first h = crc32(id) % ``shared`` turns come from conversation id - id % ``every``
    (``%`` with the sign of the id), the others from behind the conversation's own first h.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), turn_key(role, text).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    turns = turns.withColumn("giver", F.col("conv_id") - F.col("conv_id") % every)
    # one shuffle: the conversations that share a giver (at most `every` ids) meet where their turns are gathered
    own = turns.repartition("giver").groupBy("giver", "conv_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "key", "words"))),
                    lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("own"))
    head = F.max(F.when(F.col("giver") == F.col("conv_id"), F.slice("own", 1, shared - 1))).over(Window.partitionBy("giver"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    none = F.slice("own", 1, 0)
    full = F.concat(F.slice(F.coalesce(head, none), F.lit(1), h), F.slice("own", h + 1, F.size("own")))
    return own.select("conv_id", full.alias("turns")).select(
        "conv_id", F.unhex(F.array_join("turns.key", "")).alias("path"), F.col("turns.words").alias("words"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations (``NODE``).

    Turns are ordered by ``turn``, null first; equal ones by role and then by
    the SHA-256 of role and text.  A null role or text is an empty one; repeated
    rows are turns of their own; rows without ``conv_id`` take no part; other
    columns are ignored.  A conversation whose rebuilt form has no turn is a
    member of the root alone.  An empty table gives no rows, not even a root.
    A task holds its shard and, for one conversation, 20 bytes a turn; the ids
    that end in one node are hashed in order, so a hot node's are streamed.
    """
    ordered = rebuilt(conversations).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def shard(batches):
        return batches_from(shard_rows(partition_id(), rows_of(batches, "conv_id", "path", "words")), pa.schema(SHARD))

    nodes = written(ordered.mapInArrow(shard, SHARD_DDL))  # once: another sampling would cut other shards
    border, inner = nodes.where("id IS NOT NULL"), nodes.where("id IS NULL")
    least = border.groupBy("id").agg(F.min("conv_id").alias("least"))
    seen = border.select("shard", "id").join(least, "id").select(
        "shard", F.col("id").alias("parent"), F.col("least").alias("parent_least"))
    under = inner.where("parent IS NOT NULL").join(seen, ["shard", "parent"]).withColumn("parent_conv_id", F.col("parent_least"))

    partial = (border.join(least, "id").join(seen, ["shard", "parent"], "left")
               .select("shard", "place", "id", "depth", F.col("least").alias("conv_id"),
                       F.col("parent_least").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                       "saved_tokens", "words", "ends")
               .repartition(1).sortWithinPartitions("shard", "place"))
    columns = ["id", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words", "ends"]
    fields = dict(SHARD)

    def merge(batches):
        return batches_from(merged(rows_of(batches, *columns)), pa.schema([(n, fields[n]) for n in NODE]))

    whole = partial.mapInArrow(merge, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                      "n_leaves long, saved_tokens long, ends_sha256 string")
    return inner.where("parent IS NULL").select(*NODE).unionAll(under.select(*NODE)).unionAll(whole.select(*NODE))
