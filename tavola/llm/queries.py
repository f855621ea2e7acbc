"""The registered queries of this package: operator and production parameters over whole tables."""

from __future__ import annotations

import corpus_pipeline

from ..sources import driver as D
from .ann import nearest_neighbours
from .bin_repack import repack
from .bpe import round_trip
from .line_dedup import line_report
from .lookup_clusters import cluster_vectors
from .near_dup import jaccard_components
from .packing import pack
from .pii import pii_report
from .prefix_trie import prefix_trie
from .quality import quality_report, train_line_crf
from .suffix_dedup import repeated_substrings
from .token_counts import token_counts
from .token_files import read_token_files, write_token_files
from ..session import ensure_checkpoint_dir


def _tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_nearest_neighbours(spark, sf_dir):
    """The ten nearest of every hundredth vector of ``embeddings``, among all."""
    vectors = D.read(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op2_jaccard_join(spark, sf_dir):
    """Near duplicates among ``documents``: five-word shingles, similarity 0.8 or more."""
    return jaccard_components(D.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_quality_rules(spark, sf_dir):
    """Base counts and the line labelling's verdict on ``documents``; trained on ``labels``."""
    docs = D.read(spark, sf_dir, "documents")
    return quality_report(docs, train_line_crf(docs, D.read(spark, sf_dir, "labels")))


def op4_token_files(spark, sf_dir):
    """Token ids of ``documents`` written as bit-plane files and read back."""
    import uuid
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    manifest = write_token_files(D.read(spark, sf_dir, "documents"), folder,
                                 _tokenizer("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, manifest)


def op5_bpe_round_trip(spark, sf_dir):
    """Byte-level BPE ids of ``documents`` and their decoding."""
    import public_tokenizers
    return round_trip(D.read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN)


def op6_suffix_dedup(spark, sf_dir):
    """Bytes of ``documents`` covered by a 400-byte string that occurs elsewhere too."""
    return repeated_substrings(D.read(spark, sf_dir, "documents"), 400).drop("spans")


def op7_personal_data(spark, sf_dir):
    """Personal data in ``documents``."""
    return pii_report(D.read(spark, sf_dir, "documents"))


def op8_line_dedup(spark, sf_dir):
    """Lines of ``documents`` that an earlier document holds."""
    return line_report(D.read(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    """``documents`` packed into sequences of at most 4096 tokens."""
    return pack(D.read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)


def op10_token_counts(spark, sf_dir):
    """Token counts of ``documents``."""
    return token_counts(D.read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op11_conversation_trie(spark, sf_dir):
    """Every distinct prefix of the rebuilt ``conversations``."""
    return prefix_trie(D.read(spark, sf_dir, "conversations"))


def op12_best_fit_packing(spark, sf_dir):
    """``documents`` packed into few sequences of at most 2048 tokens, none cut but longer ones."""
    return repack(D.read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=0)


def op13_centroid_clustering(spark, sf_dir):
    """``embeddings`` in 16 clusters after three rounds, in whole numbers."""
    return cluster_vectors(D.read(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    """All stages of ``corpus_pipeline`` over ``documents``."""
    return corpus_pipeline.run(spark, sf_dir)


LINE_DEDUP_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10 GROUP BY key
           HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, coalesce(k.doc_id <> s.holder, false) AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

TRIE_SQL = r"""
WITH own AS (
  SELECT conv_id AS c, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, r, sha256(length(r) || ':' || r || x)) AS l
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY 1),
hashed AS (
  SELECT c, l, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT)),
    lambda crc, byte: list_reduce(CAST(range(8) AS BIGINT[]), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, byte)),
    CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 4 AS h FROM own),
built AS (
  SELECT o.c, list_concat(list_slice(coalesce(g.l, []), 1, o.h), list_slice(o.l, o.h + 1, len(o.l))) AS p
  FROM hashed o LEFT JOIN own g ON g.c = o.c - o.c % 20),
member AS (SELECT c, d, list_slice(p, 1, d) AS k, len(p) = d AS ends
           FROM (SELECT c, p, unnest(generate_series(0, len(p))) AS d FROM built)),
node AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS e,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].x, '[^\x20\x09-\x0D]+')) END AS w
  FROM member GROUP BY k, d),
child AS (SELECT list_slice(k, 1, d - 1) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT n.*, coalesce(child.n, 0) AS n_children FROM node n LEFT JOIN child ON child.k = n.k),
up AS (SELECT list_slice(k, 1, a) AS k, n_convs, w, n_children
       FROM (SELECT *, unnest(generate_series(0, d)) AS a FROM full_node)),
sub AS (SELECT k, CAST(sum(CAST(n_children = 0 AS INT)) AS BIGINT) AS n_leaves,
          CAST(sum((n_convs - 1) * w) AS BIGINT) AS saved_tokens FROM up GROUP BY k)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, sub.n_leaves, sub.saved_tokens,
  sha256(n.e) AS ends_sha256
FROM full_node n JOIN sub ON sub.k = n.k LEFT JOIN node p ON n.d > 0 AND p.k = list_slice(n.k, 1, n.d - 1)"""


def _clusters_sql(rounds: int = 3) -> str:
    """Each round: distances, the nearest centroid, then floor(sum / count) of each component."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS m FROM (
  SELECT rid, vec_id, v, c, list_sum(list_transform(list_zip(v, u), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM kept, centre{k}) GROUP BY rid)""")
        if k < rounds:
            steps.append(f"""
mean{k} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS u FROM (
    SELECT m.c AS c, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT m, v, unnest(range(1, 65)) AS j FROM near{k}) GROUP BY 1, 2) GROUP BY c),
centre{k + 1} AS (SELECT c, coalesce(mean{k}.u, centre{k}.u) AS u FROM centre{k} LEFT JOIN mean{k} USING (c))""")
    return """
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
centre0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INT) AS c, v AS u FROM (
  SELECT sha256('1:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 16)),""" + ",".join(steps) + f"""
SELECT vec_id, m.c AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(u, ',')) AS centroid_sha256
FROM near{rounds} JOIN centre{rounds} ON centre{rounds}.c = m.c"""


#: name -> (function of spark and table folder, DuckDB SQL or None)
QUERIES = {
    "op1_nearest_neighbours": (op1_nearest_neighbours, None),
    "op2_jaccard_join": (op2_jaccard_join, None),
    "op3_quality_rules": (op3_quality_rules, None),
    "op4_token_files": (op4_token_files, None),
    "op5_bpe_round_trip": (op5_bpe_round_trip, None),
    "op6_suffix_dedup": (op6_suffix_dedup, None),
    "op7_personal_data": (op7_personal_data, None),
    "op8_line_dedup": (op8_line_dedup, LINE_DEDUP_SQL),
    "op9_packing": (op9_packing, None),
    "op10_token_counts": (op10_token_counts, None),
    "op11_conversation_trie": (op11_conversation_trie, TRIE_SQL),
    "op12_best_fit_packing": (op12_best_fit_packing, None),
    "op13_centroid_clustering": (op13_centroid_clustering, _clusters_sql()),
    "pipeline": (pipeline, corpus_pipeline.ORACLE_SQL),
}
