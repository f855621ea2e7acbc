"""Document retrieval, vectors and text-processing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as X
from ..sources import driver as D
from .q_basket import _tfidf_sql
from .registry import register
from .sqlviews import with_views

_DOC_TFIDF = {"docs": "SELECT doc_id, text FROM documents", **_tfidf_sql("docs", "doc_id", "text", 512)}
def _doc_model(spark, sf):
    return X.tfidf(D.read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 512)


def _query_sql() -> dict[str, str]:
    from ..functions.text import sql_filtered_tokens, sql_terms_from
    return {
        "qtoks": f"SELECT item_id AS doc, {sql_filtered_tokens('text')} AS t FROM benchmark",
        "qpost": f"SELECT doc, term, COUNT(*) AS tf FROM (SELECT doc, unnest({sql_terms_from('t')}) AS term FROM qtoks) "
                 "GROUP BY 1, 2",
        "qw": """SELECT doc, term, w / sqrt(SUM(w * w) OVER (PARTITION BY doc)) AS w FROM (
  SELECT doc, qpost.term, tf * idf AS w FROM qpost JOIN vocab ON qpost.term = vocab.term)""",
        "ranked": """SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (
    SELECT q.doc AS query, d.doc, round_even(SUM(q.w * d.w), 6) AS score FROM qw q JOIN wts d ON q.term = d.term
    GROUP BY 1, 2) WHERE score > 0) WHERE rank <= 5""",
    }


def _ranked(spark, sf):
    model = _doc_model(spark, sf)
    qw = X.transform_texts(model, D.read(spark, sf, "benchmark"), "item_id", "text")
    return X.search_docs(qw, model.weights, 5)


@register("b14_search_docs", with_views("SELECT * FROM ranked", extra={**_DOC_TFIDF, **_query_sql()}))
def b14(spark, sf):
    """B14 top-5 documents for every benchmark passage by TF-IDF cosine (whole texts, 512 terms)."""
    return _ranked(spark, sf)


@register("b18_pack_context", with_views("""
SELECT w.query, w.rank, r.doc, r.tokens, t.total_tokens FROM walk w JOIN r ON w.query = r.query AND w.rank = r.rank
JOIN (SELECT query, max(used) AS total_tokens FROM walk GROUP BY 1) t ON w.query = t.query WHERE w.taken""",
                                         recursive=True, extra={**_DOC_TFIDF, **_query_sql(),
                                                "r": """SELECT ranked.query, ranked.rank, ranked.doc,
  CAST(floor(len(regexp_extract_all(COALESCE(d.text, ''), '\\S+')) * 1.3) AS BIGINT) AS tokens
  FROM ranked JOIN documents d ON ranked.doc = d.doc_id""",
                                                "walk(query, rank, used, taken)": """
  SELECT query, 0, CAST(0 AS BIGINT), false FROM (SELECT DISTINCT query FROM r)
  UNION ALL SELECT w.query, r.rank, CASE WHEN w.used + r.tokens <= 4000 THEN w.used + r.tokens ELSE w.used END,
    w.used + r.tokens <= 4000 FROM walk w JOIN r ON r.query = w.query AND r.rank = w.rank + 1"""}))
def b18(spark, sf):
    """B18 greedy 4000-token context packing of each query's ranked documents."""
    docs = D.read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    return X.pack_context(_ranked(spark, sf), docs, "query", "doc", 4000)


@register("b15_search_vectors", """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
c AS (SELECT label, list_transform(range(1, 1 + max(len(v))), lambda i: 0.0) AS z FROM e GROUP BY 1),
cen AS (SELECT label AS query, list(m ORDER BY pos) AS v FROM (
  SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM e) GROUP BY 1, 2)
  GROUP BY 1),
nq AS (SELECT query, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM cen),
nv AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e)
SELECT query, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT query, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT nq.query, nv.vec_id, round_even(list_sum(list_transform(range(1, len(nv.v) + 1), lambda i: nq.v[i] * nv.v[i])), 6)
      AS score FROM nq, nv)) WHERE rank <= 5""")
def b15(spark, sf):
    """B15 top-5 embeddings by cosine to each label centroid (queries derived from the data)."""
    e = D.read(spark, sf, "embeddings")
    cen = (e.select("label", F.posexplode("embedding").alias("pos", "x"))
           .groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
           .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_v"))
           .select(F.col("label").alias("query"), F.transform("_v", lambda s: s["m"]).alias("embedding")))
    return X.search_vectors(cen, e, 5)


@register("b16_build_documents", """
SELECT 'menu_item' AS type, CAST(p_partkey AS VARCHAR) AS ref,
  'Menu Item: ' || p_name || chr(10) || 'Category: ' || p_type || chr(10) || 'Subcategory: ' || p_brand || chr(10) ||
  'Description: ' || concat_ws(' ', p_name, lower(p_type), p_brand) || chr(10) || 'Price: $' || printf('%.2f', p_retailprice)
  || chr(10) || 'Dietary: ' || COALESCE(NULLIF(array_to_string(list_filter([CASE WHEN p_size <= 20 THEN 'vegetarian' END,
     CASE WHEN p_size <= 8 THEN 'vegan' END, CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN 'gluten-free' END],
     lambda x: x IS NOT NULL), ', '), ''), 'None') || chr(10) || 'Prep Time: ' || CAST(p_size AS VARCHAR) || ' minutes' || chr(10) || 'Calories: N/A' AS content
FROM part
UNION ALL
SELECT 'inventory', CAST(p_partkey AS VARCHAR),
  'Inventory Item: ' || p_name || chr(10) || 'Category: ' || p_type || chr(10) || 'Current Stock: ' || CAST(p_size AS VARCHAR)
  || ' units' || chr(10) || 'Reorder Level: 20' || chr(10) || 'Unit Cost: $' || printf('%.2f', p_retailprice) || chr(10) ||
  'Supplier: ' || COALESCE(CAST(s.supplier_id AS VARCHAR), 'N/A')
FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS supplier_id FROM lineitem GROUP BY 1) s ON p_partkey = s.l_partkey""")
def b16(spark, sf):
    """B16 knowledge-base documents for every menu row and stock row."""
    return X.build_documents(D.menu_items(spark, sf), D.inventory(spark, sf))


@register("b17_chunk_sentences", """
SELECT doc_id, CAST(pos AS INTEGER) AS pos, chunk FROM (
  SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos,
         regexp_replace(unnest(parts), '^\\s+|\\s+$', '', 'g') AS chunk
  FROM (SELECT doc_id, string_split(COALESCE(text, ''), '.') AS parts FROM documents))
WHERE length(chunk) > 0""")
def b17(spark, sf):
    """B17 sentence chunks of every document (split on '.', trimmed, non-empty)."""
    return X.chunk_sentences(D.read(spark, sf, "documents"), "doc_id", "text")


def _rules_sql(rules) -> str:
    parts = []
    for name, words in rules:
        cond = " OR ".join(f"contains(lower(COALESCE(text, '')), '{w.replace(chr(39), chr(39) * 2)}')" for w in words)
        parts.append((name, cond))
    return parts


@register("b19_tag_intents", "SELECT conv_id, turn, role, text, list_filter([" + ", ".join(
    f"CASE WHEN {c} THEN '{n}' END" for n, c in _rules_sql(X.INTENT_RULES)) + "], lambda x: x IS NOT NULL) AS intents "
    "FROM conversations")
def b19(spark, sf):
    """B19 intent tags of every conversation turn (several per text)."""
    return X.tag_intents(D.read(spark, sf, "conversations"), "text")


@register("b19_route_topic", "SELECT conv_id, turn, role, text, CASE " + " ".join(
    f"WHEN {c} THEN '{n}'" for n, c in _rules_sql(X.TOPIC_RULES)) + f" ELSE '{X.DEFAULT_TOPIC}' END AS topic "
    "FROM conversations")
def b19r(spark, sf):
    """B19 assistant topic of every conversation turn (first rule in priority order)."""
    return X.route_topic(D.read(spark, sf, "conversations"), "text")
