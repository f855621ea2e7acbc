"""Token counts of whole texts (operator 10).

Each task regroups its documents into batches of about ``batch_bytes`` of text,
whatever the row sizes; a longer text is cut at safe boundaries (``encoders``)
and spread over batches.  The distinct chunks of a batch that the worker has
not met before are encoded in one library call that returns lengths only.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_from, id_and_text, rows_of
from .encoders import CACHE_LIMIT, LONG, PLAIN, WHITE, load_tokenizer, spaced

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                    ("over_limit", pa.bool_())])
DDL = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


#: A safe place to cut: after a visible character and before white space.
CUT = re.compile(f"[^{WHITE}](?=[{WHITE}])")


@functools.lru_cache(maxsize=4)
def _known(path: str) -> dict[str, int]:
    return {}


def _pieces(rows, piece_bytes: int) -> Iterator[tuple[int, str, list[str], int, bool]]:
    """(doc_id, first chunk, later chunks, bytes, last): long texts in pieces of about ``piece_bytes`` characters."""
    for doc_id, text in rows:
        last = False
        while not last:
            part, last = text, True
            if len(text) > piece_bytes:
                cut = CUT.search(text, piece_bytes)
                if cut:
                    part, text, last = text[:cut.start() + 1], text[cut.start() + 1:], False
            chunks = spaced(part)
            yield doc_id, (chunks or [""])[0], chunks[1:], len(part.encode()), last


def _lengths(tok, known: dict[str, int], batch: list[tuple]) -> Iterator[tuple[int, int, int, bool]]:
    """Counts of each piece of one batch; ``known`` holds chunks as they stand after another one."""
    fresh = [c for c in set().union(*(p[2] for p in batch)) if c not in known]
    cores, marked = set(), []
    for chunk in fresh:  # a mark at a word's end is always a token of its own
        plain = PLAIN.fullmatch(chunk)
        if plain is None or not plain[2]:
            cores.add(chunk)
        else:
            marked.append((chunk, plain[1]))
            if plain[1] not in known:
                cores.add(plain[1])
    words = list(cores)
    once = {}
    coded = tok.encode_batch_fast([c if c[0] in WHITE else " " + c for c in words] + [p[1] for p in batch],
                                  add_special_tokens=False)
    for chunk, n in zip(words, map(len, coded)):
        (known if len(chunk) <= LONG else once)[chunk] = n
    for chunk, core in marked:
        (known if len(chunk) <= LONG else once)[chunk] = (once[core] if core in once else known[core]) + 1
    for (doc_id, _, chunks, size, last), first in zip(batch, coded[len(words):]):
        if once:
            n = sum(once[c] if c in once else known[c] for c in chunks)
        else:
            n = sum(map(known.__getitem__, chunks))
        yield doc_id, size, n + len(first), last
    if len(known) > CACHE_LIMIT:
        known.clear()


def count_rows(rows, path: str, limit: int, batch_bytes: int) -> Iterator[tuple[int, int, int, bool]]:
    """(doc_id, n_bytes, n_tokens, over_limit) of (doc_id, text) rows."""
    tok, known = load_tokenizer(path), _known(path)

    def measured():
        batch, size = [], 0
        for piece in _pieces(rows, batch_bytes):
            batch.append(piece)
            size += piece[3]
            if size >= batch_bytes:
                yield from _lengths(tok, known, batch)
                batch, size = [], 0
        if batch:
            yield from _lengths(tok, known, batch)

    n_bytes = n_tokens = 0
    for doc_id, size, n, last in measured():
        n_bytes, n_tokens = n_bytes + size, n_tokens + n
        if last:
            yield doc_id, n_bytes, n_tokens, n_tokens > limit
            n_bytes = n_tokens = 0


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, batch_bytes: int = 1 << 20,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its UTF-8 bytes, tokens, and whether it has more than ``limit`` tokens.

    A null text counts as empty (0 bytes, 0 tokens); a null id is returned as
    null; repeated rows give repeated results; an empty table gives no rows;
    other columns are ignored.  Special strings in a text are handled as the
    library does by default.
    """
    def run(batches):
        return batches_from(count_rows(rows_of(batches, "doc_id", "text"), tokenizer_path, limit, batch_bytes), SCHEMA)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, DDL)
