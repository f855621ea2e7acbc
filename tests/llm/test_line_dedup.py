"""Operator 8 against a plain dictionary of lines."""

import hashlib

from tavola.llm.line_dedup import drop_lines, line_report

from .fixtures import ROWS, frame, key, sample

WHITE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def brute(rows):
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(WHITE).translate(LOWER)
            if len(k) >= 10 and d is not None:
                holders.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or (k := x.strip(WHITE).translate(LOWER)) not in holders
                or min(holders[k]) == d]
        out.append((d, t, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_report(spark):
    for rows in (ROWS, sample(), []):
        want = [(d, n, k, hashlib.sha256(x.encode()).hexdigest()) for d, _, n, k, x in brute(rows)]
        assert key(line_report(frame(spark, rows)).collect()) == key(want)


def test_drop_lines_keeps_columns(spark):
    df = frame(spark)
    out = drop_lines(df)
    assert out.columns == df.columns
    assert key((r.doc_id, r.text) for r in out.collect()) == key((d, t if t is None else x) for d, t, _, _, x in brute(ROWS))


def test_hot_line_spreads_over_ranges(spark):
    rows = [(k, f"a line that every document holds\nline {k} of its own document") for k in range(3000)]
    rows += [(k, "one more line that many documents hold") for k in range(5000, 6000)]
    want = [(d, n, k, hashlib.sha256(x.encode()).hexdigest()) for d, _, n, k, x in brute(rows)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert key(line_report(frame(spark, rows)).collect()) == key(want)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
