"""Token ids in bit-plane files (operator 4).

File of one shard, little-endian throughout::

    magic "BPLANES1"
    chunk*      each: its planes one after another, every plane zstandard-compressed
    doc index   zstandard of int64 arrays: doc_id, n_tokens; one byte each: id is null
    chunk index per chunk: file offset u64, ids u32, planes u32, bytes of each plane u32*
    footer      u64 offset and size of the doc index, of the chunk index, u32 ids a chunk,
                u8 plane kind (0 bits, 1 bytes), magic

A chunk is a block of up to ``chunk_ids`` ids.  Plane k of a bit-plane chunk
holds bit k of every id, eight ids to a byte; of a byte-plane chunk, byte k of
every id.  Planes above the highest one in use are not stored.

Documents are range-partitioned by id, each task writes one shard under a name
of its own attempt and reports it, and only reported shards are read back, so a
lost or repeated attempt leaves no trace in the result.  The driver sees one row
per shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_from, id_and_text, partition_id, rows_of
from .encoders import word_encoder

MAGIC = b"BPLANES1"
FOOTER = struct.Struct("<QQQQIB8s")
KINDS = ("bit", "byte")
SHARD_DDL = "shard int, path string, n_docs long, n_tokens long"
SHARD = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
DOC_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long"
DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of a block of uint32 ids, lowest first, without the empty ones on top."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(-(-top // 8))]
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little").tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    ids = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        part = np.frombuffer(plane, np.uint8)
        if kind == "bit":
            part = np.unpackbits(part, count=n, bitorder="little")
        ids |= part.astype("<u4") << np.uint32(k if kind == "bit" else 8 * k)
    return ids


def write_shard(out, docs: Iterable[tuple[int | None, bytes]], chunk_ids: int, kind: str, level: int) -> tuple[int, int]:
    """Write (doc_id, id bytes) documents to the open file; number of documents and ids."""
    z = zstandard.ZstdCompressor(level=level)
    at = out.write(MAGIC)
    index, names, sizes = [], [], []
    held = bytearray()

    def flush(n_bytes: int) -> int:
        ids = np.frombuffer(bytes(held[:n_bytes]), "<u4")
        del held[:n_bytes]
        planes = [z.compress(p) for p in to_planes(ids, kind)]
        index.append(struct.pack(f"<QII{len(planes)}I", at, len(ids), len(planes), *map(len, planes)))
        return out.write(b"".join(planes))

    for doc_id, ids in docs:
        names.append(doc_id)
        sizes.append(len(ids) // 4)
        view = memoryview(ids)
        while len(view):
            part = view[:chunk_ids * 4 - len(held)]
            held += part
            view = view[len(part):]
            if len(held) == chunk_ids * 4:
                at += flush(len(held))
    if held:
        at += flush(len(held))
    doc_index = z.compress(np.array([x or 0 for x in names], "<i8").tobytes() + np.array(sizes, "<i8").tobytes()
                           + bytes(x is None for x in names))
    chunk_index = b"".join(index)
    out.write(doc_index)
    out.write(chunk_index)
    out.write(FOOTER.pack(at, len(doc_index), at + len(doc_index), len(chunk_index), chunk_ids, KINDS.index(kind), MAGIC))
    return len(names), sum(sizes)


def read_shard(f, size: int) -> Iterator[tuple[int | None, int, int]]:
    """(doc_id, n_tokens, crc32 of its ids) of each document, one chunk in memory at a time."""
    z = zstandard.ZstdDecompressor()
    f.seek(size - FOOTER.size)
    doc_at, doc_size, chunk_at, chunk_size, _, kind, magic = FOOTER.unpack(f.read(FOOTER.size))
    f.seek(0)
    if magic != MAGIC or f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a bit-plane token file, or cut short")
    f.seek(doc_at)
    raw = z.decompress(f.read(doc_size))
    n = len(raw) // 17
    names, sizes, null = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), raw[16 * n:]
    f.seek(chunk_at)
    index = f.read(chunk_size)

    def chunks():
        pos = 0
        while pos < len(index):
            at, ids, planes = struct.unpack_from("<QII", index, pos)
            lengths = struct.unpack_from(f"<{planes}I", index, pos + 16)
            pos += 16 + 4 * planes
            f.seek(at)
            yield from_planes([z.decompress(f.read(x)) for x in lengths], ids, KINDS[kind]).tobytes()

    blocks, block, at = chunks(), b"", 0
    for k in range(n):
        need, crc = 4 * int(sizes[k]), 0
        while need:
            if at == len(block):
                block, at = next(blocks), 0
            part = memoryview(block)[at:at + need]
            crc = zlib.crc32(part, crc)
            at += len(part)
            need -= len(part)
        yield (None if null[k] else int(names[k])), int(sizes[k]), crc


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, chunk_ids: int = 1 << 16,
                      kind: str = "bit", level: int = 3, id_col: str = "doc_id",
                      text_col: str = "text") -> list[tuple[str, int, int]]:
    """Encode and write all documents in ascending id order; (path, first id's position, documents) per shard.

    Rows of equal id are ordered by their text.  Null ids come first; a null
    text is its end id alone.  An empty table writes no shard.
    """
    if kind not in KINDS:
        raise ValueError(f"plane kind must be one of {KINDS}")
    end = end_id.to_bytes(4, "little")
    ordered = (id_and_text(docs, id_col, text_col).withColumn("_tie", F.xxhash64("text"))
               .repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").drop("_tie"))

    def run(batches):
        rows = rows_of(batches, "doc_id", "text")
        first = next(rows, None)
        if first is None:
            return
        encode, shard = word_encoder(tokenizer_path), partition_id()

        def coded():
            yield first[0], encode(first[1]) + end
            for doc_id, text in rows:
                yield doc_id, encode(text) + end

        store, top = pafs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        with store.open_output_stream(f"{top}/{name}") as out:
            n_docs, n_tokens = write_shard(out, coded(), chunk_ids, kind, level)
        yield from batches_from([(shard, f"{folder.rstrip('/')}/{name}", n_docs, n_tokens)], SHARD)

    shards = sorted(ordered.mapInArrow(run, SHARD_DDL).collect())  # one row per shard
    manifest, start = [], 0
    for s in shards:
        manifest.append((s.path, start, s.n_docs))
        start += s.n_tokens
    return manifest


def read_token_files(spark: SparkSession, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    def run(batches):
        def rows():
            for path, start in rows_of(batches, "path", "start"):
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    for doc_id, n, crc in read_shard(f, f.size()):
                        yield doc_id, start, n, crc
                        start += n
        return batches_from(rows(), DOC)

    files = spark.createDataFrame(manifest, "path string, start long, n_docs long")
    return files.repartition(max(1, len(manifest)), "path").mapInArrow(run, DOC_DDL)
