"""Operator 3: base counts against plain Python, decoding against all labellings, held-out accuracy."""

import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np

from tavola.llm.quality import (LineCrf, fit_crf, keep_good, line_labels, quality_report, read_document,
                                train_line_crf)

from .fixtures import ROWS, frame, key, sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words))


def test_base_counts(spark):
    rows = ROWS + sample() + [(k, " ".join(f"w{(i * i) % k}" for i in range(60)) + "\n# a $b\n# a $b") for k in (3, 5, 17)]
    got = quality_report(frame(spark, rows), None).collect()
    fields = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert key(tuple(r[f] for f in fields) for r in got) == key((d, *base(t)) for d, t in rows)
    assert all(r.kept == (not r.base_failed) for r in got)  # without a model only the base rules decide
    assert quality_report(frame(spark, []), None).count() == 0


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(2)
    for _ in range(30):
        crf = LineCrf(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)), np.zeros(3), np.ones(3))
        x = rng.normal(size=(7, 3))
        e = crf.scores(x)
        worth = lambda y: sum(e[k, v] for k, v in enumerate(y)) + sum(crf.move[a, b] for a, b in zip(y, y[1:]))
        assert tuple(crf.decode(x)) == max(itertools.product((0, 1), repeat=7), key=worth)


def test_held_out_accuracy(spark):
    rows = duckdb.sql("""SELECT d.doc_id, text, quality FROM '/root/testdata/sf0.1/documents.parquet' d
                         JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) ORDER BY 1""").fetchall()
    read = [(read_document(t), y) for _, t, y in rows]
    crf = fit_crf([(r.features, y) for r, y in read[::3]], rounds=80)
    held = [(r, y) for k, (r, y) in enumerate(read) if k % 3 and not r.base_failed]
    share = [(r.line_words * crf.decode(r.features)).sum() / r.n_words >= 0.5 for r, _ in held]
    assert np.mean([a == bool(y) for a, (_, y) in zip(share, held)]) > 0.99
    assert np.mean([a for a, (_, y) in zip(share, held) if y]) > 0.99  # clean documents stay


def test_training_and_filter(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    good = lambda: f"This {' '.join(word() for _ in range(15))}, and it ends here."
    bad = lambda: " ".join(word() + rng.choice(["###", "$$$", "&&&", "!!"]) for _ in range(15))
    rows = [(k, "\n".join((good if k % 2 else bad)() for _ in range(3))) for k in range(60)]
    rows += [(100, None), (None, rows[1][1]), (101, "")]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (50, None, 0), (51, 7, 1)],
                                   "doc_id long, quality int, toxic int")
    df = frame(spark, rows)
    crf = train_line_crf(df, labels)
    kept = keep_good(df, crf)
    assert kept.columns == df.columns
    want = [r.doc_id for r in quality_report(df, crf).collect() if r.kept]
    assert key([x] for x in want) == key([r.doc_id] for r in kept.collect())
    assert key([x] for x in want) == key([[k] for k in range(1, 60, 2)] + [[None]])
    assert line_labels(df, crf).where("doc_id = 1 AND content").count() == 3
    assert train_line_crf(df, labels.where("quality = 1")) is None
    assert train_line_crf(df.limit(0), labels) is None
