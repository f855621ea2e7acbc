"""The pipeline's rows against its stages in plain Python; the registry with and without this package."""

import subprocess
import sys
import zlib
from array import array
from collections import defaultdict
from pathlib import Path

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tavola.llm.pii import redact
from tavola.llm.quality import fit_crf, judge, read_document, train_line_crf

from .fixtures import ROWS
from .test_line_dedup import brute as line_brute
from .test_near_dup import brute as near_brute

SF = "/root/testdata/sf0.01"


def test_pipeline(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    crf = train_line_crf(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()
    rows = [(d, t) for d, t in rows if judge(t or "", crf, 0.5)[2]]
    assert 500 < len(rows) < 1000
    rows = [(d, x) for d, _, _, _, x in line_brute(rows)]
    rows = [(d, t) for (d, t), (_, _, c) in zip(rows, near_brute(rows)[0]) if d == c]
    want = {d: array("I", tok.encode(redact(t), add_special_tokens=False).ids + [2]).tobytes() for d, t in rows}
    got = defaultdict(list)
    for p in corpus_pipeline.run(spark, SF).collect():
        got[p.doc_id].append(p)
    assert got.keys() == want.keys()
    for d, pieces in got.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(want[d][4 * at:4 * (at + p.length)])
            at += p.length
        assert 4 * at == len(want[d])


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2] + corpus_pipeline.STAGES[3:4]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name


def test_stages_on_awkward_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, clashing column names, and no rows at all."""
    rows = [(d, t, "en", "s", 1, "x", "y", "z", "k") for d, t in ROWS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _key string, _Keep string, keep string"
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for name, given in (("some", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(given, schema).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns and out.count() <= len(given), stage_name
        packed = corpus_pipeline.run(spark, folder).collect()
        assert all(p.length > 0 for p in packed) and bool(packed) <= bool(given)


def test_fit_is_repeatable():
    rows = duckdb.sql(f"""SELECT text, quality FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id)
                          ORDER BY doc_id""").fetchall()
    read = [(read_document(t).features, y) for t, y in rows]
    assert (fit_crf(read, rounds=5).emit == fit_crf(read, rounds=5).emit).all()


PROBE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name in ("tavola.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
assert not any(n.startswith("op") or n == "pipeline" for n in e.queries()) and len(e.queries()) >= 160
"""


def test_registry():
    import __spark_entry__ as e
    names = {n.split("_")[0] for n in e.queries() if n.startswith("op")}
    assert names == {f"op{k}" for k in range(1, 14)} and "pipeline" in e.queries()
    run = subprocess.run([sys.executable, "-c", PROBE], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
