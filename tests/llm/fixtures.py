"""A small documents table with every awkward case, and its rows in plain Python."""

import duckdb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, keep string, text_key string"
LONG = "lorem ipsum dolor sit amet " * 8000 + "x" * 20000 + "\n" + "a b\n" * 500

ROWS = [
    (1, "A shared line of text\nown line number one\n  A SHARED line of text \n"),
    (2, "a shared line of text\nshort\n\nshort\nİstanbul çé own words here."),
    (3, "own line number one\n a shared line of text\t\n"),
    (4, None), (5, ""), (6, " "), (7, "\n\n\n"), (8, LONG), (9, LONG), (9, LONG), (9, "second text under id nine\nown line number one"),
    (None, "a shared line of text\nno id"), (None, None), (10, "x"), (11, "éééééééééé\nééééé"), (12, "ÉÉÉÉÉÉÉÉÉÉ\néééééééééé"),
    (13, "don't I'LL <|endoftext|> 3.14,15 日本語 テスト ǅ́ ﬁ   x\x1cy\r\n\ttabs  and   spaces "),
    (-5, "a shared line of text"), (14, "..." * 3000), (15, "7" * 3000),
]


def frame(spark, rows=None):
    """Rows as a table with extra columns whose names the operators use inside."""
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(d, t, None, "s", None, 1, "k", None) for d, t in rows], SCHEMA).repartition(3)


def sample(sf="sf0.001", table="documents"):
    return duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/{sf}/{table}.parquet' ORDER BY 1").fetchall()


def key(rows):
    return sorted(map(tuple, rows), key=repr)
