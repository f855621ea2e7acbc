"""Quality rules by line labelling with a linear-chain CRF (operator 3).

Every line of a document is a position of a sequence labelled content or
boilerplate.  A linear-chain conditional random field scores a labelling by a
weight per (label, feature) and per pair of neighbouring labels; Viterbi decoding
finds the best one.  The share of the document's words that lie in content lines
decides whether it is kept, after the base rules.

The field is trained here on a bounded sample of labelled documents: lines take
the label of their document, and neighbours smooth what single lines leave open.
All documents, whole, are then scored in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_from, id_and_text, rows_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
REPORT_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                 ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
                 ("n_lines", pa.int64()), ("content_share", pa.float64()), ("kept", pa.bool_())]
REPORT_DDL = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, n_lines long, content_share double, kept boolean")


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(members)] = 1
    return out


_IS_SYMBOL = _table(SYMBOLS)
_IS_UPPER = _table(bytes(range(65, 91)))
_IS_LETTER = _table(bytes([*range(65, 91), *range(97, 123)]))
_IS_DIGIT = _table(b"0123456789")
_IS_SHOUT = _table(b"!?")
_IS_LEAD = _table(bytes([*range(128), *range(192, 256)]))  # first byte of a code point
_MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of eight words that occur twice or more, each word once."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h ^= h >> np.uint64(29)
    windows = h[:n] * _MIX[0]
    for k in range(1, WINDOW):
        windows += h[k:n + k] * _MIX[k]
    ordered = np.sort(windows)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(hit), 1)
    np.add.at(edges, np.flatnonzero(hit) + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


@dataclass
class Reading:
    """One document: its base counts and the features of its lines."""
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    line_words: np.ndarray
    features: np.ndarray

    @property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


FEATURES = ["bias", "symbols a word", "shouts a word", "capitals", "digits", "word length", "few distinct words",
            "line length", "ends a sentence", "blank", "earlier line", "repeated in document"]


def read_document(text: str) -> Reading:
    data = text.encode()
    lines = data.split(b"\n")
    words = [x.split() for x in lines]
    n_line_words = np.fromiter(map(len, words), np.int64, len(lines))
    flat = [w for x in words for w in x]
    raw = np.frombuffer(data, np.uint8)
    starts = np.cumsum([0] + [len(x) + 1 for x in lines[:-1]])

    def count(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(table[raw], out=total[1:])
        ends = np.append(starts[1:] - 1, len(raw))
        return total[ends] - total[starts]

    symbols, shouts, upper, letters, digits = map(count, (_IS_SYMBOL, _IS_SHOUT, _IS_UPPER, _IS_LETTER, _IS_DIGIT))
    word_chars = sum(map(len, flat)) - (len(raw) - int(_IS_LEAD[raw].sum()))
    seen: set[bytes] = set()
    earlier = np.zeros(len(lines))
    for k, line in enumerate(lines):
        if words[k]:
            if line in seen:
                earlier[k] = 1
            else:
                seen.add(line)
    repeated = repeated_words(flat)
    n = np.maximum(n_line_words, 1)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    distinct = np.fromiter((len(set(x)) for x in words), np.int64, len(lines))
    closes = np.fromiter((x[-1][-1:] in (b".", b"!", b"?", b":", b'"') if x else False for x in words), bool, len(lines))
    share = lambda a, b: np.minimum(1.0, a / np.maximum(b, 1))
    features = np.stack([
        np.ones(len(lines)), share(symbols, n), share(shouts, n), share(upper, letters), share(digits, size),
        share(size, 12 * n), 1.0 - distinct / n, np.minimum(1.0, np.log1p(n_line_words) / 8), closes.astype(float),
        n_line_words == 0, earlier, np.full(len(lines), min(1.0, repeated / max(len(flat), 1)))], axis=1)
    return Reading(len(flat), word_chars, int(symbols.sum()), int(earlier.sum()), repeated, n_line_words, features)


@dataclass
class LineCrf:
    """Weights of the field; label 1 is content.  ``mean`` and ``scale`` standardise the features."""
    emit: np.ndarray       # features x 2
    move: np.ndarray       # from x to
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.emit

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The best labelling of one document's lines (Viterbi); equal scores go to content."""
        (a00, a01), (a10, a11) = self.move.tolist()
        back, best0, best1 = [], None, None
        for e0, e1 in self.scores(features).tolist():
            if best0 is None:
                best0, best1 = e0, e1
                continue
            from0 = best0 + a00 > best1 + a10
            from1 = best0 + a01 > best1 + a11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            best0, best1 = ((best0 + a00 if from0 else best1 + a10) + e0, (best0 + a01 if from1 else best1 + a11) + e1)
        label = 0 if best0 > best1 else 1
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return np.array(labels[::-1])


def fit_crf(sequences: list[tuple[np.ndarray, int]], rounds: int = 150, span: int = 32, ridge: float = 1e-3) -> LineCrf:
    """Maximum likelihood by forward-backward and Adam; sequences are (line features, document label).

    Long documents train as spans of ``span`` lines, every line in one of them.
    """
    pieces = [(f[at:at + span], y) for f, y in sequences for at in range(0, len(f), span)]
    rows = np.concatenate([f for f, _ in pieces])
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    mean[0], scale[scale < 1e-9] = 0.0, 1.0
    size, width = max(len(f) for f, _ in pieces), rows.shape[1]
    x = np.zeros((len(pieces), size, width))
    mask = np.zeros((len(pieces), size))
    y = np.array([v for _, v in pieces])
    for k, (f, _) in enumerate(pieces):
        x[k, :len(f)] = (f - mean) / scale
        mask[k, :len(f)] = 1
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))  # the classes weigh alike
    gold = np.eye(2)[y][:, None, :] * mask[..., None]
    pairs = mask[:, 1:] * mask[:, :-1]
    theta = np.zeros(2 * width + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    add = lambda a, axis: (top := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - top).sum(axis=axis))
    for step in range(1, rounds + 1):
        emit, move = theta[:2 * width].reshape(width, 2), theta[2 * width:].reshape(2, 2)
        e = x @ emit
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, size):
            on = add(forward[:, t - 1, :, None] + move, 1) + e[:, t]
            forward[:, t] = np.where(mask[:, t, None] > 0, on, forward[:, t - 1])
        for t in range(size - 2, -1, -1):
            on = add(move + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None] > 0, on, 0)
        total = add(forward[:, -1], 1)
        single = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        double = np.exp(forward[:, :-1, :, None] + move + (e[:, 1:] + backward[:, 1:])[:, :, None, :]
                        - total[:, None, None, None]) * pairs[..., None, None]
        slope_emit = np.einsum("n,nlf,nly->fy", weight, x, gold - single)
        slope_move = np.einsum("n,nlab->ab", weight, gold[:, :-1, :, None] * gold[:, 1:, None, :] - double)
        slope = np.concatenate([slope_emit.ravel(), slope_move.ravel()]) - ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        theta = theta + 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return LineCrf(theta[:2 * width].reshape(width, 2), theta[2 * width:].reshape(2, 2), mean, scale)


def train_line_crf(docs: DataFrame, labels: DataFrame, sample_docs: int = 1500, sample_lines: int = 256,
                   id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineCrf | None:
    """Fit on at most ``sample_docs`` labelled documents of each class, chosen by a hash of their id.

    Documents of more than ``sample_lines`` lines are not used for training.
    None if a class has no usable document: then only the base rules apply.
    """
    marked = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
              .where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y")))
    chosen = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = id_and_text(docs, id_col, text_col).where("doc_id IS NOT NULL")
    small = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))) < sample_lines
    sample = texts.where(small).join(F.broadcast(chosen), "doc_id")  # at most 2 * sample_docs rows

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("lines", pa.binary())])
        return batches_from(((d, y, read_document(t).features.astype("<f8").tobytes())
                             for d, y, t in rows_of(batches, "doc_id", "y", "text")), schema, 256)

    found = sample.mapInArrow(run, "doc_id long, y int, lines binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.lines))
    sequences = [(np.frombuffer(r.lines, "<f8").reshape(-1, len(FEATURES)), r.y) for r in found]
    if len({y for _, y in sequences}) < 2:
        return None
    return fit_crf(sequences)


def judge(text: str, model: LineCrf | None, min_share: float) -> tuple[Reading, float, bool]:
    """The document's reading, the share of its words in content lines, and whether it is kept."""
    r = read_document(text)
    if model is None or not r.n_words:
        return r, 1.0 if r.n_words else 0.0, not r.base_failed
    share = float((r.line_words * model.decode(r.features)).sum() / r.n_words)
    return r, share, not r.base_failed and share >= min_share


def quality_report(docs: DataFrame, model: LineCrf | None, min_share: float = 0.5, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Counts, content share and verdict of every row.

    A null or empty text has no words and fails the base rules; a null id stays
    null; repeated rows are judged alike; an empty table gives no rows; other
    columns are ignored.
    """
    schema = pa.schema(REPORT_FIELDS)

    def rows(batches) -> Iterator[tuple]:
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            r, share, kept = judge(text, model, min_share)
            yield (doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
                   len(r.line_words), share, kept)

    return id_and_text(docs, id_col, text_col).mapInArrow(lambda b: batches_from(rows(b), schema), REPORT_DDL)


def line_labels(docs: DataFrame, model: LineCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: ``doc_id``, ``line`` (from 0), ``content``; cases as ``quality_report``."""
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("content", pa.bool_())])

    def rows(batches):
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            for k, label in enumerate(model.decode(read_document(text).features).tolist()):
                yield doc_id, k, bool(label)

    return id_and_text(docs, id_col, text_col).mapInArrow(lambda b: batches_from(rows(b), schema),
                                                          "doc_id long, line int, content boolean")


def keep_good(docs: DataFrame, model: LineCrf | None, min_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that ``quality_report`` keeps, with all their columns, whatever their names.

    A null or empty text fails the base rules and goes; a null id does not
    matter; repeated rows are judged alike; an empty table gives no rows.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                kept = [judge(t or "", model, min_share)[2] for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
