"""Exact n-gram Jaccard join by prefix filtering and prefix trees (operator 2).

A document is the set of its distinct word shingles; two documents link when
``100 * |A & B| >= percent * |A | B|``.  Every set is written in one global order
of shingles, those met often last.  Sets that link share a shingle among the
first ``n - ceil(t n) + 1`` of each, so only those prefixes are shuffled, as
packed arrays, and grouped by shingle.  Equal sets are one set from the start.

The groups name candidates; no group is ever expanded into all its pairs:

1. Each set is tested against one hub, the member that shares most of its prefix.
   In a family of near copies that is the text they stem from.
2. Only groups whose members are still in different components go on.  Two exact
   bounds remove most pairs before any text is read: the prefix tokens they share
   plus all that can follow, and the smaller of 256 counts of either set, summed.
   Small groups give their pairs between components.
3. In large ones, cut into blocks, the sets outside the group's main component
   are held against all members by the same bounds: first the likeliest of each
   are tested, then, of those still apart, all.

Tests read whole texts: the sets on one side are stored, in global order, in a
prefix tree whose branches share partial overlaps, and a branch is left as soon
as the tokens remaining on either side cannot reach the threshold.  A pair that
could link is skipped only when its members are already connected, which does
not change a component.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, rows_of, unused, written
from .components import connected_components
from .packed import DDL, gathered, packing, part_names, parts_of
from .words import mix, shingles

CELLS = 1 << 22       # counters that find the frequent shingles
FLOOR = 32            # a counter at or under this says nothing
GROUPS = 256          # counts of a set's overlap bound
FULL = 255            # a count that says: this many or more
SMALL = 32            # largest group whose pairs are listed
BLOCK = 1024          # sets of a large group, or of a prefix tree, in one place
LIKELY = 4            # pairs of a set and a block that are tested first
ENTRY = np.dtype([("token", "<u8"), ("sid", "<i8"), ("n", "<i4")])
FACT_DDL = "kind int, doc_id long, text_key long, n long, sid long, counts binary"
FACT = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()),
                  ("sid", pa.int64()), ("counts", pa.binary())])
MEMBER = pa.schema([("gid", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("shared", pa.int64())])
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _facts(size: int):
    """Per document: set size, set id and bound counts; per task: the counters that stand out."""
    def run(batches):
        counters, seen = np.zeros(CELLS, np.int32), 0
        pending: list[np.ndarray] = []
        held = []

        def count(cells: list[np.ndarray]) -> None:
            met, n = np.unique(np.concatenate(cells), return_counts=True)
            counters[met] += n.astype(np.int32)

        for doc_id, key, text in rows_of(batches, "doc_id", "text_key", "text"):
            s = shingles(text, size)
            counts = np.minimum(np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), FULL)
            held.append((0, doc_id, key, len(s), _set_id(s), counts.astype(np.uint8).tobytes()))
            pending.append((s >> np.uint64(42)).astype(np.int64))
            seen += len(s)
            if len(held) >= 1024:
                yield pa.RecordBatch.from_pylist([dict(zip(FACT.names, x)) for x in held], schema=FACT)
                count(pending)
                held, pending = [], []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(FACT.names, x)) for x in held], schema=FACT)
            count(pending)
        high = np.flatnonzero(counters >= 4 + 4 * (seen // CELLS))
        for at in range(0, len(high), 1 << 16):
            part = high[at:at + (1 << 16)]
            none = pa.nulls(len(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(part), np.int32)), pa.array(part), none.cast(pa.int64()),
                 pa.array(counters[part].astype(np.int64)), none.cast(pa.int64()), none.cast(pa.binary())], schema=FACT)
    return run


def _levels(facts: DataFrame) -> np.ndarray:
    """Frequency level of every counter (at most ``CELLS`` rows reach the driver)."""
    high = (facts.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).where(F.col("n") >= 2 * FLOOR)
            .selectExpr("doc_id AS cell", "least(15, int(floor(log2(n / 32)))) AS level").toPandas())
    levels = np.zeros(CELLS, np.uint8)  # 4 MB for every worker
    levels[high["cell"].to_numpy(np.int64)] = high["level"].to_numpy(np.uint8)
    return levels


def _set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def _ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in global order: the frequency level in the top four bits, the hash below."""
    return np.sort((s & np.uint64((1 << 60) - 1)) | (levels[(s >> np.uint64(42)).astype(np.int64)].astype(np.uint64) << np.uint64(60)))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefixes(levels, size: int, percent: int, parts, hot: int):
    """Packed (token, set, size) entries by token; a very frequent token's sets meet in a grid of cells."""
    def placed(tokens: np.ndarray, sid: int, n: int):
        often = np.uint64(FLOOR) << (tokens >> np.uint64(60))
        grid = (often // np.uint64(hot)).astype(np.int64) * (tokens >> np.uint64(60) > 0) + 1
        places = [mix(tokens[grid == 1])]
        for s in np.unique(grid[grid > 1]).tolist():
            row = int(mix(np.array([sid], np.int64).view(np.uint64))[0] % np.uint64(s))
            for other in range(s):
                cell = np.uint64(min(row, other) * s + max(row, other) + 1)
                places.append(mix(tokens[grid == s] + mix(np.array([cell]))))
        places = np.concatenate(places)
        e = np.zeros(len(places), ENTRY)
        e["token"], e["sid"], e["n"] = places, sid, n  # tokens of one cell meet under one name
        return e, places

    def run(batches):
        order = levels.value

        def arrays():
            met = set()
            for (text,) in rows_of(batches, "text"):
                s = shingles(text, size)
                sid = _set_id(s)
                if not len(s) or sid in met:  # an equal set of this task
                    continue
                if len(met) < 1 << 20:
                    met.add(sid)
                yield placed(_ordered(s, order)[:prefix_length(len(s), percent)], sid, len(s))
        return packing(arrays(), parts)
    return run


def _groups(batches) -> Iterator[pa.RecordBatch]:
    """Distinct member lists of the tokens that two sets or more share, part by part."""
    for e in parts_of(batches, ENTRY):
        yield from _lists(e)


def _lists(e: np.ndarray) -> Iterator[pa.RecordBatch]:
    e = e[np.lexsort((e["sid"], e["token"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["token"][1:] != e["token"][:-1]) | (e["sid"][1:] != e["sid"][:-1])
    e = e[new]  # equal sets of other tasks
    starts = np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(e)]]))
    names = mix(np.add.reduceat(mix(e["sid"].view(np.uint64)), starts) + sizes.astype(np.uint64)).view(np.int64)
    shared = sizes > 1
    if not shared.any():
        return
    gid, first, times = np.unique(names[shared], return_index=True, return_counts=True)
    start, size = starts[shared][first], sizes[shared][first]
    at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    for k in range(0, len(at), 1 << 16):
        s = slice(k, k + (1 << 16))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(gid, size)[s]), pa.array(e["sid"][at[s]]), pa.array(e["n"][at[s]]),
             pa.array(np.repeat(times, size)[s])], schema=MEMBER)


class PrefixTree:
    """Ordered sets under shared, path-compressed prefixes."""

    __slots__ = ("edge", "children", "names", "least", "most")

    def __init__(self, edge: np.ndarray):
        self.edge, self.children, self.names = edge, {}, []
        self.least, self.most = 1 << 62, 0  # sizes of the sets below

    def add(self, tokens: np.ndarray, name) -> None:
        node, n, at = self, len(tokens), 0
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if at == n:
                node.names.append(name)
                return
            child = node.children.get(int(tokens[at]))
            if child is None:
                child = node.children[int(tokens[at])] = PrefixTree(tokens[at:])
                child.least = child.most = n
                child.names.append(name)
                return
            width = min(len(child.edge), n - at)
            differ = np.flatnonzero(child.edge[:width] != tokens[at:at + width])
            same = int(differ[0]) if len(differ) else width
            if same < len(child.edge):  # split the edge
                upper = PrefixTree(child.edge[:same])
                upper.least, upper.most = child.least, child.most
                child.edge = child.edge[same:]
                upper.children[int(child.edge[0])] = child
                node.children[int(tokens[at])] = upper
                child = upper
            node, at = child, at + same

    def search(self, query: np.ndarray, percent: int) -> Iterator:
        """Names of the sets that reach the threshold with the query."""
        total, weight = len(query), 100 + percent
        stack = [(self, 0, 0, 0)]  # node, tokens above, overlap so far, query tokens passed
        while stack:
            node, depth, overlap, passed = stack.pop()
            if len(node.edge):
                at = np.searchsorted(query, node.edge)
                hit = query[np.minimum(at, total - 1)] == node.edge
                overlap += int(hit.sum())
                passed = int(at[-1]) + int(hit[-1])
                depth += len(node.edge)
            best = min(max(depth + total - passed, node.least), node.most)  # the size that could reach furthest
            if weight * (overlap + min(total - passed, best - depth)) < percent * (total + best):
                continue
            if node.names and weight * overlap >= percent * (total + depth):
                yield from node.names
            stack.extend((child, depth, overlap, passed) for child in node.children.values())


def _tested(levels, size: int, percent: int):
    """Pairs that link, of rows (a, a_text, b, b_text); rows of one a come in a stretch."""
    def run(batches):
        order = levels.value
        now, query, tree, held = None, None, None, 0

        def found():
            got = [(now, b) for b in tree.search(query, percent)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], schema=LINK)

        for a, a_text, b, b_text in rows_of(batches, "a", "a_text", "b", "b_text"):
            if a != now or held >= BLOCK:
                if held:
                    yield found()
                if a != now:
                    now, query = a, _ordered(shingles(a_text, size), order)
                tree, held = PrefixTree(np.zeros(0, np.uint64)), 0
            tree.add(_ordered(shingles(b_text, size), order), b)
            held += 1
        if held:
            yield found()
    return run


def _overlap_bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At most so many shingles are in both sets."""
    both = np.minimum(x, y)
    return np.where(both.max(axis=1, initial=0) == FULL, 1 << 40, both.sum(axis=1, dtype=np.uint16).astype(np.int64))


def _counts_of(column: pa.Array) -> np.ndarray:
    """The counts of every row, as they lie in the column's buffer."""
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * GROUPS, int(first)).reshape(-1, GROUPS)


def _may_link(percent: int):
    """Pairs whose bound of the overlap, from the counts of both sets, reaches the threshold."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (_counts_of(batch.column(k)) for k in ("a_counts", "b_counts"))
            bound = _overlap_bound(x, y)
            n = batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy()
            keep = pa.array((100 + percent) * bound >= percent * n)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], schema=LINK)
    return run


def _group_cell(percent: int, best: int | None):
    """Pairs of a large group that may link: sets outside its main component against its members.

    Two sets of several large groups are held against each other in the first
    of them only.  With ``best`` just that many of the likeliest for each set.
    """
    def run(table: pa.Table) -> pa.Table:
        outside = table.column("outside").to_numpy(zero_copy_only=False).astype(bool)
        member = np.flatnonzero(~outside)
        if not outside.any() or not len(member):
            return LINK.empty_table()
        here = table.column("gid")[0].as_py()
        sid, n, component, other = (table.column(c).to_numpy() for c in ("sid", "n", "component", "other"))
        counts = _counts_of(table.column("counts").combine_chunks())
        lists = table.column("groups").combine_chunks()
        gid, weight = (x.to_numpy() for x in lists.flatten().flatten())
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        row = np.repeat(np.arange(len(n)), np.diff(ends, prepend=0))
        # members by group: ``holder[first[c]:first[c] + size[c]]`` are those of groups[c]
        inside = np.flatnonzero(~outside[row])
        inside = inside[np.argsort(gid[inside], kind="stable")]
        holder = (np.cumsum(~outside) - 1)[row[inside]]
        groups, first, size = np.unique(gid[inside], return_index=True, return_counts=True)
        column = np.minimum(np.searchsorted(groups, gid), len(groups) - 1)
        known = groups[column] == gid

        def holders(entries: np.ndarray) -> np.ndarray:
            c = column[entries]
            at = np.repeat(first[c] - np.cumsum(size[c]) + size[c], size[c])
            return holder[at + np.arange(len(at))]

        m_n, m_other, m_component = n[member], other[member], component[member]
        rest = -(-percent * n // 100) - 1  # tokens beyond the prefix
        m_rest = rest[member]
        pairs = [np.zeros((2, 0), np.int64)]
        for k in np.flatnonzero(outside).tolist():
            able = (m_component != component[k]) & (100 * np.minimum(m_n, n[k]) >= percent * np.maximum(m_n, n[k]))
            if not able.any():
                continue
            entries = np.arange(ends[k - 1] if k else 0, ends[k])
            entries = entries[known[entries]]
            earlier = gid[entries] < here
            able[holders(entries[earlier])] = False
            able = np.flatnonzero(able)
            if not len(able):
                continue
            entries = entries[~earlier]
            shared = np.bincount(holders(entries), np.repeat(weight[entries], size[column[entries]]), len(member))[able].astype(np.int64)
            most = shared + np.minimum(m_other[able], other[k]) + np.maximum(m_rest[able], rest[k])
            able = able[(100 + percent) * most >= percent * (m_n[able] + n[k])]
            reach = (100 + percent) * _overlap_bound(counts[member[able]], counts[k:k + 1]) - percent * (m_n[able] + n[k])
            able, reach = able[reach >= 0], reach[reach >= 0]
            if best:
                able = able[np.argsort(-reach / (m_n[able] + n[k]), kind="stable")[:best]]
            pairs.append(np.stack([np.full(len(able), sid[k]), sid[member[able]]]))
        a, b = np.concatenate(pairs, axis=1)
        return pa.table([a, b], schema=LINK)
    return run


def _small_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs between components of groups of at most ``SMALL`` sets that may link.

    Beyond the prefix tokens that two sets share, those of the set whose prefix
    ends first can all be in the other: ``ceil(t n) - 1`` of them.
    """
    side = lambda x: (rest.where(F.col("members") <= SMALL)
                      .select("gid", "shared", *(F.col(c).alias(f"{x}_{c}") for c in ("sid", "n", "component", "large"))))
    left, right = side("a"), side("b").drop("shared")
    beyond = lambda x: F.ceil(percent * F.col(x) / 100) - 1
    most = F.col("shared") + F.least("a_large", "b_large") + F.greatest(beyond("a_n"), beyond("b_n"))
    count = lambda x: sets.select(F.col("sid").alias(x), F.col("counts").alias(f"{x}_counts"))
    return (left.join(right, "gid").where((F.col("a_component") != F.col("b_component")) & (F.col("a_sid") < F.col("b_sid")))
            .where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
            .groupBy(F.col("a_sid").alias("a"), F.col("b_sid").alias("b"), "a_n", "b_n", "a_large", "b_large")
            .agg(F.sum("shared").alias("shared")).where((100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n")))
            .join(count("a"), "a").join(count("b"), "b").select("a", "a_n", "a_counts", "b", "b_n", "b_counts")
            .mapInArrow(_may_link(percent), "a long, b long"))


def _large_pairs(rest: DataFrame, sets: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Pairs of groups of more than ``SMALL`` sets that may link, block against block."""
    large = rest.where(F.col("members") > SMALL).select("gid", "sid", "n", "component", "shared", "small", "members")
    main = (large.groupBy("gid", "component").agg(F.count("*").alias("n")).groupBy("gid")
            .agg(F.max_by("component", F.struct("n", "component")).alias("main")).transform(written))
    groups = large.groupBy("sid").agg(F.collect_list(F.struct("gid", "shared")).alias("groups"))  # part of a prefix each
    rows = (large.withColumnRenamed("small", "other").join(groups, "sid").join(sets.select("sid", "counts"), "sid")
            .join(main, "gid").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
            .withColumn("block", F.expr("int(pmod(xxhash64(sid), blocks))")))
    every = "transform(sequence(0, blocks - 1), k -> struct({} AS i, {} AS j, {} AS outside))".format
    places = F.expr(f"concat({every('k', 'block', 'false')}, if(component <> main, {every('block', 'k', 'true')}, array()))")
    cells = (rows.withColumn("place", F.explode(places))
             .select("gid", "place.i", "place.j", "sid", "n", "component", "other", "groups", "counts", "place.outside"))
    return cells.groupBy("gid", "i", "j").applyInArrow(_group_cell(percent, best), "a long, b long")


def jaccard_components(docs: DataFrame, percent: int = 80, size: int = 5, hot: int = 1 << 16, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``text_key``, ``n_shingles``, ``component_id`` (smallest id reachable by links), ``group``.

    A text without words has no shingles and links with nothing; rows without
    an id take no part and have a null component; rows of equal id are documents
    of their own that share a name, so ``group`` tells components apart where
    ids do not (null: in none).  Other columns are ignored; an empty table gives
    no rows.  ``hot``: sets of a frequent token that meet
    in one place at most, about; beyond it they meet in a grid of places.
    """
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    facts = texts.mapInArrow(_facts(size), FACT_DDL).transform(written)
    documents = facts.where("kind = 0").select("doc_id", "text_key", "n", "sid")
    sets = (facts.where("kind = 0 AND n > 0 AND doc_id IS NOT NULL").groupBy("sid")
            .agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("n").alias("n"), F.min("counts").alias("counts"))
            .select("sid", "rep.doc_id", "rep.text_key", "n", "counts").transform(written))
    levels = spark.sparkContext.broadcast(_levels(facts))
    parts = part_names(spark)
    prefixes = (texts.where("doc_id IS NOT NULL").select("text")
                .mapInArrow(_prefixes(levels, size, percent, parts, hot), DDL))
    members = (gathered(prefixes, parts).mapInArrow(_groups, "gid long, sid long, n int, shared long")
               .groupBy("gid", "sid", "n").agg(F.sum("shared").alias("shared")).transform(written))

    release(spark)
    weight = members.groupBy("sid", "n").agg((F.sum("shared") / (F.col("n") + 5)).alias("weight")).drop("n").transform(written)
    wanted = weight.select("sid").join(sets.select("sid", "doc_id", "text_key"), "sid")
    body = (texts.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["sid", "doc_id", "text_key"]).select("sid", "text")
            .transform(written))
    release(spark)

    def tested(pairs: DataFrame) -> DataFrame:
        rows = (pairs.join(body.select(F.col("sid").alias("b"), F.col("text").alias("b_text")), "b")
                .join(body.select(F.col("sid").alias("a"), F.col("text").alias("a_text")), "a")
                .select("a", "a_text", "b", "b_text"))
        found = rows.mapInArrow(_tested(levels, size, percent), "a long, b long").transform(written)
        release(spark)
        return found

    # 1. one hub for each set
    span = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).alias("span")
    weighed = members.join(weight, "sid").withColumn("span", span).transform(written)
    hubs = weighed.groupBy("gid", "span").agg(F.max_by("sid", F.struct("weight", "sid")).alias("hub")).transform(written)
    first = (weighed.join(hubs, ["gid", "span"]).where("hub <> sid").groupBy("hub", "sid")
             .agg(F.sum("shared").alias("shared")).groupBy("sid")
             .agg(F.max_by("hub", F.struct("shared", "hub")).alias("a")).select("a", F.col("sid").alias("b")).transform(written))
    component = connected_components(tested(first), "a", "b")

    # 2. groups that still lie in several components: first the likeliest pairs, then all that remain
    rest = members
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for best in (LIKELY, None):
        placed = (rest.select("gid", "sid", "n", "shared").join(component.withColumnRenamed("node", "sid"), "sid", "left")
                  .select("gid", "sid", "n", "shared", F.coalesce("component", "sid").alias("component")).transform(written))
        mixed = (placed.groupBy("gid").agg(F.count("*").alias("members"), F.min("component").alias("low"),
                                           F.max("component").alias("high")).where("low <> high")
                 .select("gid", "members").transform(written))
        rest = placed.join(mixed, "gid")
        often = F.col("members") > SMALL
        held = rest.groupBy("sid").agg(F.sum(F.when(often, F.col("shared")).otherwise(0)).alias("large"),
                                       F.sum(F.when(often, 0).otherwise(F.col("shared"))).alias("small"))
        rest = rest.join(held, "sid").transform(written)
        wide, found = not rest.where(often).isEmpty(), []
        if best:  # all pairs of the small groups, once: those still apart in the second round were among them
            found.append(_small_pairs(rest, sets, percent))
        if wide:
            found.append(_large_pairs(rest, sets, percent, best))
        if not found:
            break
        pairs = (functools.reduce(DataFrame.unionAll, found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
                 .join(done, ["a", "b"], "left_anti").transform(written))
        if not pairs.isEmpty():  # else the likeliest were tested as hubs; the others may still link
            done = done.unionAll(pairs)
            stars = component.select(F.col("node").alias("a"), F.col("component").alias("b"))
            component = connected_components(stars.unionAll(tested(pairs)), "a", "b")
        if not wide:
            break

    grouped = (sets.select("sid", "doc_id").join(component.withColumnRenamed("node", "sid"), "sid", "left")
               .select("sid", "doc_id", F.coalesce("component", "sid").alias("group")).transform(written))
    low = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id")).transform(written)
    names = grouped.join(low, "group").select("sid", "group", "component_id").transform(written)
    named = documents.where("n > 0 AND doc_id IS NOT NULL").join(names, "sid").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", "group")
    alone = documents.where("n = 0 OR doc_id IS NULL").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
        F.lit(None).cast("long").alias("group"))
    return named.unionAll(alone)


def one_of_each(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with one row of each component, the one of the smallest id; all columns, whatever their names.

    Rows of equal id and text count as one row.  Rows without an id, and texts
    without words (null, empty), stay; an empty table gives no rows.
    """
    doc, key = unused(docs, "_doc", "_key")
    found = jaccard_components(docs, percent, size, id_col=id_col, text_col=text_col).where("doc_id IS NOT NULL")
    keep = (found.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("row"))
            .select(F.col("row.doc_id").alias(doc), F.col("row.text_key").alias(key))
            .unionAll(found.where("group IS NULL").select("doc_id", "text_key").distinct()).transform(written))
    row_id = F.col(id_col).cast("long")
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    chosen = (docs.where(row_id.isNotNull()).join(keep, (row_id == F.col(doc)) & (text == F.col(key)))
              .dropDuplicates([doc, key]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return chosen.select(*columns).unionAll(docs.where(row_id.isNull()).select(*columns))
