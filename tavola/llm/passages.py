"""Passages of words that other documents hold too (a further column of operator 6).

The byte rule of operator 6 does not see a passage of few bytes.  Here a document
samples its windows of ``size`` words: of every ``span`` windows in a row the one
with the least hash (several windows share one, so about 2 in ``span`` + 1 are
kept).  Equal passages of ``size + span - 1`` words or more have a sampled window
in common, wherever they stand.

A task answers for the windows that it has met in two texts itself and sends one
entry on for each window, marked as shared; so a window that a third of all
documents hold costs one entry a batch, not one a document.  Words compare
with A-Z lower-cased, white space as one blank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of
from .packed import DDL, gathered, packing, part_names, parts_of
from .words import _BASE, _power, mix, word_hashes

ENTRY = np.dtype([("window", "<u8"), ("text", "<i8"), ("kind", "u1")])
ALONE, SHARED, ANSWER = 0, 1, 2  # met in one row, met in several, and: this text holds a shared one
BATCH = 1 << 19  # entries that a task compares at once
_STEP = pow(_BASE, -1, 1 << 64)


def sampled(text: str, size: int, span: int) -> np.ndarray:
    """Distinct hashes of the sampled windows of a text; none if it has fewer words than a window."""
    h = word_hashes(text)
    n = len(h) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(_BASE, len(h)), out=total[1:])
    w = mix((total[size:] - total[:-size]) * _power(_STEP, len(h))[:n])
    if n <= span:
        return np.array([w.min()])
    least = w
    width = 1
    while width < span:  # minimum of `span` windows in a row, by doubling
        step = min(width, span - width)
        least = np.minimum(least[:len(least) - step], least[step:])
        width += step
    return np.unique(least)


def _told(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries (one a row and window) to send on, one a window, and answers for the texts that share one here."""
    e = e[np.argsort(e["window"], kind="stable")]
    start = np.flatnonzero(np.concatenate([[True], e["window"][1:] != e["window"][:-1]]))
    size = np.diff(np.concatenate([start, [len(e)]]))
    several = (size > 1) | (e["kind"][start] == SHARED)
    on = e[start].copy()
    on["kind"] = np.where(several, SHARED, ALONE)
    texts = np.unique(e["text"][np.repeat(several, size)])
    answers = np.zeros(len(texts), ENTRY)
    answers["text"], answers["kind"] = texts, ANSWER
    return on, answers


def _sample(size: int, span: int, parts: np.ndarray):
    batch = BATCH

    def run(batches):
        def arrays():
            held, count = [], 0
            for key, text in rows_of(batches, "text_key", "text"):
                w = sampled(text, size, span)
                e = np.zeros(len(w), ENTRY)
                e["window"], e["text"] = w, key
                held.append(e)
                count += len(e)
                if count >= batch:
                    yield from resolved(np.concatenate(held))
                    held, count = [], 0
            if count:
                yield from resolved(np.concatenate(held))

        def resolved(e):
            on, answers = _told(e)
            yield on, mix(on["window"])
            yield answers, mix(answers["text"].view(np.uint64))
        return packing(arrays(), parts)
    return run


def _shared(batches):
    for e in parts_of(batches, ENTRY):
        answer = e["kind"] == ANSWER
        told = [e["text"][answer]]
        if not answer.all():
            told.append(_told(e[~answer])[1]["text"])
        told = np.unique(np.concatenate(told))
        if len(told):
            yield pa.RecordBatch.from_arrays([pa.array(told)], ["text_key"])


def texts_with_shared_passages(texts: DataFrame, size: int = 40, span: int = 12) -> DataFrame:
    """``text_key`` of the texts that have a sampled window in common with another row of ``texts`` (text_key, text).

    With the defaults that is every text with a passage of 51 words or more that
    another row holds (equal texts included), and some with 40 to 50."""
    parts = part_names(texts.sparkSession)
    entries = gathered(texts.select("text_key", "text").mapInArrow(_sample(size, span, parts), DDL), parts)
    return entries.mapInArrow(_shared, "text_key long").distinct()
