"""Repeated substrings by distributed difference-cover suffix sorting (operator 6).

Removes every byte covered by a ``length``-byte string that also starts anywhere
else.  Only prefixes of that length matter, so suffixes are compared no further,
and the names that the algorithm gives to equal prefixes are hashes of them.

The alphabet is a parse of the bytes into phrases: a position ends one when the
hash of the eight bytes before it is least within some window of ``SPAN``
positions.  That depends on near bytes only, so equal strings have equal phrases
but for their ends, and no phrase is longer than ``SPAN``.

1. Sort sampled triples: the phrases at positions 1 and 2 modulo 3, a difference
   cover, are named by the triple that begins there; names are sorted and
   neighbours compared.  Any two equal strings of ``length`` have, at an equal
   offset, a triple sampled in both, so a string whose sampled triples are
   unique in both classes cannot repeat and is discarded.
2. Recurse on names: suffixes of the phrases that are left are named by a run of
   phrases that every string about them contains, sorted and compared, and among
   equal ones by the whole stretch that all those strings cover.  A unique run
   ends the matter; a stretch met twice settles all of them at once.
3. Merge the remaining suffixes, those that begin inside phrases whose run is
   shared and whose stretch is not: they are sorted among themselves by their
   ``length``-byte prefixes and adjacent ones compared.

Names travel as packed arrays with the place they come from.  Equal texts are
one text; when there are two of at least ``length`` bytes, all of them goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_from, rows_of, written
from .packed import DDL, gathered, packing, part_names, parts_of, stretches
from .passages import texts_with_shared_passages
from .words import mix

CONTEXT = 8
_RNG = np.random.default_rng(20240703)
_BYTES = _RNG.integers(1, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have if len(have) <= 1 << 22 else have[:1 << 22]
    return have[:n]


class Hashes:
    """Hashes of substrings of one text, from running sums; ``which`` selects one of two independent ones."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.sums = raw, {}

    def __call__(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        n, base = len(self.raw), _BASES[which]
        if which not in self.sums:
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[which][self.raw] * _power(base, n), out=total[1:])
            self.sums[which] = total
        total = self.sums[which]
        return mix((total[end] - total[start]) * _power(pow(base, -1, 1 << 64), n + 1)[start]
                   + (end - start).astype(np.uint64))


def _extreme(x: np.ndarray, width: int, take, fill) -> np.ndarray:
    """``take`` (np.minimum or np.maximum) over each run of ``width`` values."""
    n = len(x) - width + 1
    size = -(-len(x) // width) * width
    padded = np.full(size, fill, x.dtype)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = take.accumulate(blocks, axis=1).ravel()
    behind = take.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return take(behind[:n], ahead[width - 1:width - 1 + n])


class Parse:
    """A text's phrase ends, and the strings of ``length`` bytes that belong to each."""

    def __init__(self, text: str, length: int):
        self.raw = np.frombuffer(text.encode(), np.uint8)
        self.hash = Hashes(self.raw)
        n = len(self.raw)
        span = self.span = (length - CONTEXT) // 10 + 1
        at = np.arange(CONTEXT, n + 1)
        h = self.hash(at - CONTEXT, at)
        least = _extreme(h, span, np.minimum, np.uint64(2**64 - 1))  # of the window that begins at each
        around = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
        self.ends = np.flatnonzero(h == _extreme(around, span, np.maximum, np.uint64(0))) + CONTEXT
        # the strings of phrase end b begin at low .. high: b is the first end at least ``lead`` bytes into them
        lead = span + CONTEXT - 1
        before = np.concatenate([[-(1 << 40)], self.ends[:-1]])
        self.low = np.maximum(before - lead + 1, 0)
        self.high = np.minimum(self.ends - lead, n - length)
        # all of them contain the phrases from b up to the last end within reach
        reach = length - span - (lead + span)
        self.last = np.searchsorted(self.ends, self.ends + reach, "right") - 1
        self.length = length

    def triples(self) -> tuple[np.ndarray, np.ndarray]:
        """(phrase numbers, names) of the difference-cover sample."""
        k = np.arange(len(self.ends) - 3)
        k = k[k % 3 != 0]
        return k, self.hash(self.ends[k], self.ends[k + 3])

    def open(self, shared: np.ndarray) -> np.ndarray:
        """Phrase ends with strings that may repeat, given the sampled positions whose names are shared."""
        m = len(self.ends)
        able = self.high >= self.low
        keep = np.zeros(m, bool)
        flag = np.zeros(m, bool)
        flag[shared[shared < m]] = True
        for residue in (1, 2):
            lonely = np.zeros(m + 1, np.int64)
            sampled = np.arange(m) % 3 == residue
            lonely[1:] = np.cumsum(sampled & ~flag)
            stop = np.maximum(self.last - 2, np.arange(m))  # triples that end within the run
            keep |= lonely[stop] == lonely[np.arange(m)]
        return np.flatnonzero(able & keep)


TRIPLE = np.dtype([("name", "<u8"), ("text", "<i8"), ("at", "<i4")])
RUN = np.dtype([("run", "<u8"), ("one", "<u8"), ("two", "<u8"), ("text", "<i8"), ("at", "<i4")])
PREFIX = np.dtype([("one", "<u8"), ("two", "<u8"), ("text", "<i8"), ("at", "<i4")])
PLACE = np.dtype([("text", "<i8"), ("at", "<i4"), ("end", "<i4")])
SETTLED, EXPAND = 1, 2


def _entries(kind: np.dtype, text: int, **columns) -> np.ndarray:
    e = np.zeros(len(columns["at"]), kind)
    e["text"] = text
    for name, values in columns.items():
        e[name] = values
    return e


def _places(text: int, n: int) -> np.ndarray:
    return np.full(n, mix(np.array([text], np.int64).view(np.uint64))[0])


def _sample(length: int, parts):
    """1. sampled triples by name."""
    def run(batches):
        def arrays():
            for key, text in rows_of(batches, "text_key", "text"):
                p = Parse(text, length)
                k, names = p.triples()
                yield _entries(TRIPLE, key, name=names, at=k), names
        return packing(arrays(), parts)
    return run


def _shared(e: np.ndarray) -> np.ndarray:
    e = e[np.lexsort((e["at"], e["text"], e["name"]))]
    group = stretches(e["name"], e["text"], e["at"])
    e = e[np.concatenate([[True], group[1:] != group[:-1]])]  # an equal text read twice
    name = stretches(e["name"])
    return e[np.bincount(name)[name] > 1]


def _shared_triples(parts):
    """Places of triples whose name occurs at another place too."""
    def run(batches):
        def arrays():
            for e in parts_of(batches, TRIPLE):
                e = _shared(e)
                out = np.zeros(len(e), PLACE)
                out["text"], out["at"] = e["text"], e["at"]
                yield out, mix(out["text"].view(np.uint64))
        return packing(arrays(), parts)
    return run


def _by_text(batches) -> Iterator[pa.RecordBatch]:
    """One row a text: its places, sorted, as int32 pairs (at, end)."""
    def rows():
        for e in parts_of(batches, PLACE):
            e = e[np.lexsort((e["end"], e["at"], e["text"]))]
            first = np.flatnonzero(np.concatenate([[True], e["text"][1:] != e["text"][:-1]]))
            pairs = np.stack([e["at"], e["end"]], axis=1)
            for a, z in zip(first.tolist(), [*first[1:].tolist(), len(e)]):
                yield int(e["text"][a]), pairs[a:z].tobytes()
    return batches_from(rows(), pa.schema([("text_key", pa.int64()), ("places", pa.binary())]), 512)


def _pairs(places: bytes) -> np.ndarray:
    return np.frombuffer(places, "<i4").reshape(-1, 2)


def _runs(length: int, parts):
    """2. for each open phrase: the name of its run, and of the whole stretch of its strings."""
    def run(batches):
        def arrays():
            for key, text, places in rows_of(batches, "text_key", "text", "places"):
                p = Parse(text, length)
                k = p.open(_pairs(places)[:, 0])
                names = p.hash(p.ends[k], p.ends[p.last[k]])
                stretch = [p.hash(p.low[k], p.high[k] + length, which) for which in (0, 1)]
                yield _entries(RUN, key, run=names, one=stretch[0], two=stretch[1], at=k), names
        return packing(arrays(), parts)
    return run


def _settle(parts):
    """Phrases whose stretch occurs again (settled), and those whose strings must be compared one by one."""
    def run(batches):
        def arrays():
            for e in parts_of(batches, RUN):
                e = e[np.lexsort((e["at"], e["text"], e["two"], e["one"], e["run"]))]
                name, stretch = stretches(e["run"]), stretches(e["run"], e["one"], e["two"])
                again = np.bincount(stretch)[stretch] > 1
                first = np.concatenate([[True], stretch[1:] != stretch[:-1]])
                several = np.bincount(name, first)[name] > 1  # unequal stretches about one run
                out = np.zeros(len(e), PLACE)
                out["text"], out["at"] = e["text"], e["at"]
                out["end"] = SETTLED * again + EXPAND * (several & first)  # one of equal stretches stands for all
                out = out[out["end"] > 0]
                yield out, mix(out["text"].view(np.uint64))
        return packing(arrays(), parts)
    return run


def _prefixes(length: int, parts):
    """3. prefixes of the remaining suffixes."""
    def run(batches):
        def arrays():
            for key, text, places in rows_of(batches, "text_key", "text", "places"):
                p, pairs = Parse(text, length), _pairs(places)
                k = pairs[pairs[:, 1] & EXPAND > 0, 0]
                size = p.high[k] - p.low[k] + 1
                at = np.repeat(p.low[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                one, two = (p.hash(at, at + length, which) for which in (0, 1))
                yield _entries(PREFIX, key, one=one, two=two, at=at), one
        return packing(arrays(), parts)
    return run


def _equal_prefixes(parts):
    def run(batches):
        def arrays():
            for e in parts_of(batches, PREFIX):
                e = e[np.lexsort((e["at"], e["text"], e["two"], e["one"]))]
                name = stretches(e["one"], e["two"])
                e = e[np.bincount(name)[name] > 1]
                out = np.zeros(len(e), PLACE)
                out["text"], out["at"] = e["text"], e["at"]
                yield out, mix(out["text"].view(np.uint64))
        return packing(arrays(), parts)
    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of (start, end) spans."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > top[:-1]])
    return np.stack([spans[new, 0], np.maximum.reduceat(top, np.flatnonzero(new))], axis=1)


def _covered(p: Parse, settled: bytes | None, equal: bytes | None) -> np.ndarray:
    spans = [np.zeros((0, 2), np.int64)]
    if settled is not None:
        k = (pairs := _pairs(settled))[pairs[:, 1] & SETTLED > 0, 0]
        spans.append(np.stack([p.low[k], p.high[k] + p.length], axis=1))
    if equal is not None:
        at = _pairs(equal)[:, 0].astype(np.int64)
        spans.append(np.stack([at, at + p.length], axis=1))
    spans = np.concatenate(spans)
    return merged(spans) if len(spans) else spans


def _cut(length: int):
    schema = pa.schema([("text_key", pa.int64()), ("sha", pa.string()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.binary())])

    def run(batches):
        def rows():
            for key, text, sha, settled, equal in rows_of(batches, "text_key", "text", "sha", "settled", "equal"):
                p = Parse(text, length)
                spans = _covered(p, settled, equal)
                keep = np.ones(len(p.raw) + 1, np.int8)
                edge = np.zeros(len(p.raw) + 1, np.int64)
                edge[spans[:, 0]] += 1
                edge[spans[:, 1]] -= 1
                keep = np.cumsum(edge)[:-1] == 0
                yield (key, sha, int((~keep).sum()), len(spans), hashlib.sha256(p.raw[keep].tobytes()).hexdigest(),
                       spans.astype("<i8").tobytes())
        return batches_from(rows(), schema, 256)
    return run


def repeated_substrings(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans``, ``repeats_passage``.

    ``repeats_passage`` is 1 where the row holds a passage of words that another
    row holds too (``passages.py``), however few its bytes; it removes nothing.

    ``spans`` are the maximal removed runs as little-endian int64 (start, end)
    pairs over the UTF-8 bytes.  Matches never cross rows and are judged on the
    input.  A null text is empty; texts shorter than ``length`` keep everything;
    repeated rows are each other's repeats; null ids take part like others; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = part_names(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"),
                       F.octet_length(text).cast("long").alias("n_bytes"))
    long = rows.where(F.col("n_bytes") >= length).select("text_key", "text")

    shared = gathered(long.mapInArrow(_sample(length, parts), DDL), parts).mapInArrow(_shared_triples(parts), DDL)
    shared = gathered(shared, parts).mapInArrow(_by_text, "text_key long, places binary")
    sha = F.sha2(F.col("text"), 256).alias("sha")
    texts = (long.join(shared, "text_key").select("text_key", sha, "text", "places")
             .dropDuplicates(["text_key", "sha"]).transform(written))

    runs = gathered(texts.mapInArrow(_runs(length, parts), DDL), parts).mapInArrow(_settle(parts), DDL)
    settled = gathered(runs, parts).mapInArrow(_by_text, "text_key long, places binary").transform(written)
    unsettled = texts.drop("places").join(settled, "text_key")
    equal = gathered(unsettled.mapInArrow(_prefixes(length, parts), DDL), parts).mapInArrow(_equal_prefixes(parts), DDL)
    equal = gathered(equal, parts).mapInArrow(_by_text, "text_key long, places binary")
    cuts = (texts.select("text_key", "sha", "text").join(settled.withColumnRenamed("places", "settled"), "text_key")
            .join(equal.withColumnRenamed("places", "equal"), "text_key", "left")
            .mapInArrow(_cut(length), "text_key long, sha string, n_removed long, n_spans long, kept_sha256 string, "
                                      "spans binary").transform(written))

    read = rows.select("doc_id", "text_key", F.sha2("text", 256).alias("sha"), "n_bytes").transform(written)
    distinct = read.groupBy("text_key", "sha", "n_bytes").agg(F.count("*").alias("copies")).transform(written)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    nothing = hashlib.sha256(b"").hexdigest()
    pair = F.expr("unhex(concat('0000000000000000', "
                  "array_join(transform(sequence(0, 7), k -> lpad(hex(shiftright(n_bytes, 8 * k) & 255L), 2, '0')), '')))")
    passages = texts_with_shared_passages(rows).withColumn("repeats_passage", F.lit(1).cast("long"))
    answer = distinct.join(cuts, ["text_key", "sha"], "left").join(passages, "text_key", "left").select(
        "text_key", "sha",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, pair).otherwise(F.coalesce("spans", F.lit(b""))).alias("spans"),
        F.coalesce("repeats_passage", F.lit(0).cast("long")).alias("repeats_passage")).transform(written)
    return read.join(answer, ["text_key", "sha"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans",
                                                         "repeats_passage")
