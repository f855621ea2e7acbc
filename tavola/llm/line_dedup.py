"""Line dedup across documents (operator 8).

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
Keys of at least ``min_chars`` code points that occur in two documents or more
lose all their lines but those of the smallest document that holds them.

Keys travel as 128-bit hashes with document and position, never as text.  They
are range-partitioned and sorted by (hash, document, position), so the lines of
one very frequent key spread over many tasks and no task sees more than its
range.  Each task then streams its range and tells first occurrences from later
ones; the one thing it cannot know, the first document of a key that began in an
earlier range, comes from one small row per range.  Later occurrences return as
one compressed bitmap of lines to keep per document, and the texts are cut by
joining those bitmaps.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import batches_from, partition_id, rows_of, unused

LINE_DDL = "h1 long, h2 long, doc_id long, text_key long, pos int"
LINE = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()),
                  ("pos", pa.int32())])
EDGE_DDL = "range int, first array<long>, last array<long>, last_doc long"
EDGE = pa.schema([("range", pa.int32()), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())),
                  ("last_doc", pa.int64())])
DROP_DDL = "doc_id long, text_key long, pos int"
DROP = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32())])
BITMAP = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("keep", pa.binary())])


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a UTF-8 line, or None if it has fewer than ``min_chars`` code points."""
    key = line.strip().lower()  # of bytes: ASCII white space and letters only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return key


def _lines(batches, min_chars: int) -> Iterator[tuple]:
    for doc_id, text_key, text in rows_of(batches, "doc_id", "text_key", "text"):
        for pos, line in enumerate(text.encode().split(b"\n")):
            key = line_key(line, min_chars)
            if key is not None:
                h = xxhash.xxh3_128_intdigest(key)
                yield (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), doc_id, text_key, pos


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(h1, h2, doc ids, text keys, positions) of stretches of one key within a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc, text, pos = (b.column(n).to_numpy() for n in ("h1", "h2", "doc_id", "text_key", "pos"))
        cuts = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
        for a, z in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(h1)].tolist()):
            yield (int(h1[a]), int(h2[a])), doc[a:z], text[a:z], pos[a:z]


def _edges(batches) -> Iterator[pa.RecordBatch]:
    first = last = last_doc = None
    for key, doc, _, _ in _runs(batches):
        if first is None:
            first = key
        if key != last:
            last, last_doc = key, int(doc[0])
    if first is not None:
        yield from batches_from([(partition_id(), list(first), list(last), last_doc)], EDGE)


def _later(carried: dict[int, tuple[tuple[int, int], int]]):
    """Lines whose key a smaller document holds; ``carried``: by range, its first key's first document."""
    def run(batches):
        key_now, first_doc = carried.get(partition_id(), (None, None))
        for b in batches:
            docs, texts, positions = [], [], []
            for key, doc, text, pos in _runs([b]):
                if key != key_now:
                    key_now, first_doc = key, int(doc[0])
                if doc[-1] != first_doc:
                    late = doc != first_doc
                    docs.append(doc[late])
                    texts.append(text[late])
                    positions.append(pos[late])
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (docs, texts, positions)],
                                                 schema=DROP)
    return run


def keep_bitmap(dropped: Iterable[int]) -> bytes:
    """Deflated bits, one a line up to the last dropped one; 0: dropped.  Lines beyond it stay."""
    at = np.fromiter(dropped, np.int64)
    keep = np.ones(int(at.max()) + 1, np.uint8)
    keep[at] = 0
    return zlib.compress(len(keep).to_bytes(8, "little") + np.packbits(keep, bitorder="little").tobytes(), 1)


def keep_flags(bitmap: bytes) -> np.ndarray:
    raw = zlib.decompress(bitmap)
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=int.from_bytes(raw[:8], "little"),
                         bitorder="little")


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       text.alias("text"), *more)


def line_bitmaps(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_key`` (hash of the text) and ``keep`` for the documents that lose lines.

    Rows of equal id count as one document.  Rows without an id hold no key and
    lose nothing.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    texts = keyed(docs, id_col, text_col).where("doc_id IS NOT NULL")
    lines = texts.mapInArrow(lambda b: batches_from(_lines(b, min_chars), LINE, 1 << 14), LINE_DDL)
    ranged = (lines.repartitionByRange("h1", "h2", "doc_id", "text_key", "pos")
              .sortWithinPartitions("h1", "h2", "doc_id", "text_key", "pos").checkpoint())
    carried, key, doc = {}, None, None
    for edge in sorted(ranged.mapInArrow(_edges, EDGE_DDL).collect()):  # one row per range
        if key is not None:
            carried[edge["range"]] = (key, doc)
        if tuple(edge.last) != key:
            key, doc = tuple(edge.last), edge.last_doc
    later = ranged.mapInArrow(_later(carried), DROP_DDL)

    def bitmaps(batches):
        return batches_from(((d, t, keep_bitmap(p)) for d, t, p in rows_of(batches, "doc_id", "text_key", "dropped")),
                            BITMAP, 256)

    return (later.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("dropped"))
            .mapInArrow(bitmaps, "doc_id long, text_key long, keep binary"))


def cut(text: str, bitmap: bytes | None) -> tuple[str, int, int]:
    """The text of the lines to keep, the lines before, the lines dropped."""
    lines = text.split("\n")
    if bitmap is None:
        return text, len(lines), 0
    flags = keep_flags(bitmap)
    kept = [x for x, f in zip(lines, flags) if f] + lines[len(flags):]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _with_bitmaps(docs: DataFrame, min_chars: int, id_col: str, text_col: str, *more) -> DataFrame:
    maps = line_bitmaps(docs, min_chars, id_col, text_col)
    return keyed(docs, id_col, text_col, *more).join(maps, ["doc_id", "text_key"], "left")


def line_report(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``n_lines`` before, ``n_dropped``, ``kept_sha256`` of what stays.

    A null or empty text is one empty line, which is never dropped; an empty
    table gives no rows; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()),
                        ("kept_sha256", pa.string())])

    def run(batches):
        def rows():
            for doc_id, text, keep in rows_of(batches, "doc_id", "text", "keep"):
                kept, n, dropped = cut(text, keep)
                yield doc_id, n, dropped, hashlib.sha256(kept.encode()).hexdigest()
        return batches_from(rows(), schema)

    return (_with_bitmaps(docs, min_chars, id_col, text_col).select("doc_id", "text", "keep")
            .mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string"))


def drop_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with its repeated lines dropped from ``text_col``; all columns, whatever their names.

    Null and empty texts stay as they are; rows without an id keep their lines
    and hold none for others; repeated rows of one id lose nothing to each
    other; an empty table gives no rows.
    """
    doc, key, keep = unused(docs, "_doc", "_key", "_keep")
    maps = line_bitmaps(docs, min_chars, id_col, text_col).withColumnsRenamed({"doc_id": doc, "text_key": key, "keep": keep})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    @F.pandas_udf("string")
    def kept(texts, keeps):
        return texts.combine(keeps, lambda t, k: t if k is None or t is None else cut(t, k)[0])

    joined = docs.join(maps, (F.col(id_col).cast("long") == F.col(doc)) & (F.xxhash64(text) == F.col(key)), "left")
    cuts = joined.withColumn(text_col, F.when(F.col(keep).isNull(), F.col(text_col))
                             .otherwise(kept(F.col(text_col).cast("string"), F.col(keep))))
    return cuts.select(*[F.col(f"`{c}`") for c in docs.columns])
