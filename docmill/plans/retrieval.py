"""Vector, hybrid and post-retrieval queries over documents, embeddings and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.operators import hybrid, lexical, vector
from docmill.plans.lexical import documents, questions, scores_sql, tokens_sql

K = 10


def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def vector_queries(spark, sf_dir):
    """Every vector whose id is divisible by 100."""
    return embeddings(spark, sf_dir).where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")


def vector_hits(spark, sf_dir, k):
    return vector.neighbours(embeddings(spark, sf_dir), vector_queries(spark, sf_dir), k)


def knn_cosine_topk(spark, sf_dir):
    return vector_hits(spark, sf_dir, K).select("query_id", "vec_id", "rank", "vector_score")


def knn_filtered(spark, sf_dir):
    rows = lexical.metadata_filter(embeddings(spark, sf_dir), {"label": 3})
    return vector.neighbours(rows, vector_queries(spark, sf_dir), K).select("query_id", "vec_id", "rank", "vector_score")


def vector_score_clamp(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    first = F.get("embedding", F.lit(0)).cast("double")
    return rows.select("vec_id", vector.score_of_distance(F.round(first * 10, 6)).alias("score"))


def l2_normalize(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    rows = embeddings(spark, sf_dir).select("vec_id", scaled.alias("v"))
    return rows.select("vec_id", F.round(vector.l2_norm(F.col("v")), 6).alias("norm"), F.round(F.get(vector.unit(F.col("v")), F.lit(0)), 6).alias("first"))


def semantic_cache_lookup(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    cache = rows.where("label % 2 = 0")
    return vector.cache_lookup(cache, vector_queries(spark, sf_dir))


def both_legs(spark, sf_dir, n):
    """Lexical hits of documents and vector hits, ids of vectors being those of documents."""
    lex = lexical.top_hits(lexical.scores(documents(spark, sf_dir), questions(spark, sf_dir)), n).select("query_id", "doc_id", "rank")
    rows = embeddings(spark, sf_dir)
    asked = questions(spark, sf_dir).select("query_id").join(rows, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    vec = vector.neighbours(rows, asked, n).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    return lex, vec


def rrf_fusion(spark, sf_dir):
    return hybrid.fused(*both_legs(spark, sf_dir, 15), 15).select("query_id", "doc_id", "bm25_rank", "vector_rank", "rrf_score", "rank")


def rrf_single_leg_fallback(spark, sf_dir):
    lex, vec = both_legs(spark, sf_dir, 15)
    rows = hybrid.fused_or_single(lex.where("query_id % 3 <> 1"), vec.where("query_id % 3 <> 2"), 15)
    return rows.select("query_id", "doc_id", "rrf_score", "rank")


def hybrid_topk(spark, sf_dir):
    return hybrid.fused(*both_legs(spark, sf_dir, 15), 5).select("query_id", "doc_id", "rrf_score", "rank")


def table_leg_union(spark, sf_dir):
    hits = hybrid.fused(*both_legs(spark, sf_dir, 15), K)
    rows = embeddings(spark, sf_dir)
    asked = questions(spark, sf_dir).select("query_id").join(rows, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    tables = vector.neighbours(rows.where("label = 1"), asked, K).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    return hybrid.with_table_leg(hits, tables, K)


def retriever_compare(spark, sf_dir):
    lex, vec = both_legs(spark, sf_dir, 5)
    both = hybrid.fused(lex, vec, 5).select("query_id", "doc_id", "rank")
    named = [d.withColumn("engine", F.lit(e)) for d, e in ((lex, "bm25"), (vec, "vector"), (both, "hybrid"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def doc_id_coalesce(spark, sf_dir):
    docs = documents(spark, sf_dir)
    chunk = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("c"), F.col("doc_id")))
    meta = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("m"), F.col("doc_id")))
    page = F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") % 7)
    return docs.select("doc_id", hybrid.document_key(chunk, meta, F.col("source"), page).alias("key"))


def children(spark, sf_dir):
    """Ranked hits by source: a document is a child, its parent is its source's documents of equal id modulo 4; query 0 asks."""
    docs = documents(spark, sf_dir)
    return docs.select(
        F.lit(0).alias("query_id"),
        "doc_id",
        F.col("source").alias("source_id"),
        F.when(F.col("doc_id") % 11 > 0, F.concat(F.col("lang"), F.lit("-"), (F.col("doc_id") % 4))).alias("parent_id"),
        F.col("text").alias("content"),
        (F.col("doc_id") % 9 == 0).alias("is_table"),
        F.col("doc_id").alias("rank"),
    )


def parents(spark, sf_dir):
    rows = children(spark, sf_dir).where("source_id <> 'src2' and parent_id is not null")
    return rows.groupBy("source_id", "parent_id").agg(F.min(F.md5("content")).alias("parent_text"))


def child_to_parent(spark, sf_dir):
    rows = hybrid.with_parents(children(spark, sf_dir), parents(spark, sf_dir))
    return rows.select("doc_id", F.md5("text").alias("text_md5"))


def parent_dedup(spark, sf_dir):
    return hybrid.first_by_parent(hybrid.with_parents(children(spark, sf_dir), parents(spark, sf_dir))).select("doc_id", "rank")


def text_dedup_first(spark, sf_dir):
    rows = children(spark, sf_dir).withColumn("text", F.col("content")).withColumn("query_id", F.xxhash64("source_id"))
    return hybrid.first_by_text(rows).select("doc_id", "source_id")


def text_dedup_last_wins(spark, sf_dir):
    return hybrid.last_by_text(documents(spark, sf_dir).withColumn("place", F.col("doc_id")), "source", "place")


def logits(spark, sf_dir):
    """Fused hits with a made-up but fixed logit."""
    hits = hybrid.fused(*both_legs(spark, sf_dir, 15), 15)
    return hits.withColumn("logit", ((F.col("doc_id") * 37 + F.col("query_id") * 11) % 100 - 40) / 20)


def sigmoid_threshold_topk(spark, sf_dir):
    rows = hybrid.reranked(logits(spark, sf_dir), 10)
    return rows.select("query_id", "doc_id", "new_rank", F.round("rerank_score", 6).alias("rerank_score"), "filtered_count")


def rerank_rank_changes(spark, sf_dir):
    before = logits(spark, sf_dir)
    return hybrid.rank_changes(before, hybrid.reranked(before, 10))


def fallback_filter(spark, sf_dir):
    hits = hybrid.fused(*both_legs(spark, sf_dir, 15), 15)
    asked = questions(spark, sf_dir).select("query_id", lexical.tokens(F.col("text")).alias("tokens"))
    rows = hits.join(asked, "query_id").join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    score = F.when(F.col("vector_rank") <= 5, F.col("vector_rank") / 10)
    kept = rows.where(hybrid.fallback_kept(score, F.col("tokens"), F.col("text")))
    return kept.select("query_id", "doc_id", "rank")


def hit_standardisation(spark, sf_dir):
    docs = documents(spark, sf_dir)
    score = F.when(F.col("doc_id") % 4 > 0, (F.col("doc_id") % 3) / 2)
    rrf = F.when(F.col("doc_id") % 2 > 0, F.col("doc_id") / 1000)
    return docs.select("doc_id", hybrid.standard_score(score, rrf).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        knn_cosine_topk, knn_filtered, vector_score_clamp, l2_normalize, semantic_cache_lookup, rrf_fusion,
        rrf_single_leg_fallback, hybrid_topk, table_leg_union, retriever_compare, doc_id_coalesce, child_to_parent,
        parent_dedup, text_dedup_first, text_dedup_last_wins, sigmoid_threshold_topk, rerank_rank_changes,
        fallback_filter, hit_standardisation,
    )
}


def knn_sql(name: str, rows: str, asked: str, k: int) -> str:
    return f"""{name}_all AS (SELECT q.query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS s
  FROM ({asked}) q, ({rows}) e),
{name} AS (SELECT query_id, vec_id, rank, round(greatest(0.0, s), 4) AS vector_score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id))::INT AS rank FROM {name}_all) WHERE rank <= {k})"""


ALL = "SELECT * FROM embeddings"
HUNDREDTHS = "SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0"
ITEMS = "SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id"


def legs_sql(n: int) -> str:
    return f"""{scores_sql()},
lex AS (SELECT query_id, doc_id, rank FROM ranked WHERE rank <= {n}),
{knn_sql('near', ALL, ITEMS, n)},
vec AS (SELECT query_id, vec_id AS doc_id, rank FROM near)"""


def fused_sql(lex: str = "lex", vec: str = "vec") -> str:
    return f"""merged AS (SELECT query_id, doc_id, min(b)::INT AS bm25_rank, min(v)::INT AS vector_rank FROM (
  SELECT query_id, doc_id, rank AS b, NULL AS v FROM {lex} UNION ALL SELECT query_id, doc_id, NULL, rank FROM {vec}) GROUP BY ALL),
rrf AS (SELECT *, round(coalesce(0.5::DOUBLE / (60 + bm25_rank), 0) + coalesce(0.5::DOUBLE / (60 + vector_rank), 0), 6) AS rrf_score FROM merged),
fused AS (SELECT *, (row_number() OVER (PARTITION BY query_id
  ORDER BY rrf_score DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST, doc_id))::INT AS rank FROM rrf)"""


CHILDREN = """kids AS (SELECT doc_id, source AS source_id, CASE WHEN doc_id % 11 > 0 THEN lang || '-' || (doc_id % 4) END AS parent_id,
  text AS content, doc_id % 9 = 0 AS is_table, doc_id AS rank FROM documents),
parents AS (SELECT source_id, parent_id, min(md5(content)) AS parent_text FROM kids
  WHERE source_id <> 'src2' AND parent_id IS NOT NULL GROUP BY ALL),
joined AS (SELECT kids.*, parent_text FROM kids LEFT JOIN parents USING (source_id, parent_id))"""

LOGITS = f"""{legs_sql(15)}, {fused_sql()},
logits AS (SELECT *, ((doc_id * 37 + query_id * 11) % 100 - 40)::DOUBLE / 20 AS logit FROM fused WHERE rank <= 15),
sig AS (SELECT *, 1 / (1 + exp(-logit)) AS rerank_score, count(*) OVER (PARTITION BY query_id) AS n_in FROM logits),
again AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank))::INT AS new_rank FROM sig),
kept AS (SELECT *, n_in - count(*) OVER (PARTITION BY query_id) AS filtered_count FROM again WHERE rerank_score >= 0.6 AND new_rank <= 5)"""

ORACLE = {
    "knn_cosine_topk": f"WITH {knn_sql('hits', ALL, HUNDREDTHS, K)} SELECT query_id, vec_id, rank, vector_score FROM hits",
    "knn_filtered": f"WITH {knn_sql('hits', ALL + ' WHERE label = 3', HUNDREDTHS, K)} SELECT query_id, vec_id, rank, vector_score FROM hits",
    "vector_score_clamp": "SELECT vec_id, round(greatest(0.0, 1 - round(embedding[1]::DOUBLE * 10, 6)), 4) AS score FROM embeddings",
    "l2_normalize": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM v)
SELECT vec_id, round(norm, 6) AS norm, round(CASE WHEN norm > 0 THEN v[1] / norm ELSE 0 END, 6) AS first FROM n""",
    "semantic_cache_lookup": f"""WITH {knn_sql('hits', ALL + ' WHERE label % 2 = 0', HUNDREDTHS, 1)}
SELECT query_id, vec_id, vector_score, vector_score >= 0.95 AS hit FROM hits""",
    "rrf_fusion": f"WITH {legs_sql(15)}, {fused_sql()} SELECT query_id, doc_id, bm25_rank, vector_rank, rrf_score, rank FROM fused WHERE rank <= 15",
    "rrf_single_leg_fallback": f"""WITH {legs_sql(15)}, some_lex AS (SELECT * FROM lex WHERE query_id % 3 <> 1), some_vec AS (SELECT * FROM vec WHERE query_id % 3 <> 2),
{fused_sql('some_lex', 'some_vec')}
SELECT query_id, doc_id, CASE WHEN sides = 2 THEN rrf_score END AS rrf_score, CASE WHEN sides = 2 THEN rank ELSE coalesce(bm25_rank, vector_rank) END AS rank
FROM fused JOIN (SELECT query_id, count(DISTINCT side) AS sides FROM (SELECT query_id, 1 AS side FROM some_lex UNION ALL SELECT query_id, 2 FROM some_vec) GROUP BY 1)
USING (query_id) WHERE rank <= 15""",
    "hybrid_topk": f"WITH {legs_sql(15)}, {fused_sql()} SELECT query_id, doc_id, rrf_score, rank FROM fused WHERE rank <= 5",
    "table_leg_union": f"""WITH {legs_sql(15)}, {fused_sql()}, {knn_sql('tab', ALL + ' WHERE label = 1', ITEMS, K)},
hits AS (SELECT query_id, doc_id, rrf_score, rank FROM fused WHERE rank <= 10),
fresh AS (SELECT query_id, vec_id AS doc_id, rank FROM tab WHERE rank <= 3 AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = tab.query_id AND h.doc_id = tab.vec_id))
SELECT * FROM hits UNION ALL
SELECT f.query_id, f.doc_id, NULL, (coalesce((SELECT max(rank) FROM hits h WHERE h.query_id = f.query_id), 0)
  + row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank, f.doc_id))::INT FROM fresh f""",
    "retriever_compare": f"""WITH {legs_sql(5)}, {fused_sql()}
SELECT query_id, doc_id, rank, 'bm25' AS engine FROM lex UNION ALL SELECT query_id, doc_id, rank, 'vector' FROM vec
UNION ALL SELECT query_id, doc_id, rank, 'hybrid' FROM fused WHERE rank <= 5""",
    "doc_id_coalesce": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'c' || doc_id WHEN 1 THEN 'm' || doc_id
ELSE coalesce(source, 'unknown') || '::p' || CASE WHEN doc_id % 5 > 0 THEN n_chars % 7 ELSE 0 END END AS key FROM documents""",
    "child_to_parent": f"WITH {CHILDREN} SELECT doc_id, md5(coalesce(parent_text, content)) AS text_md5 FROM joined",
    "parent_dedup": f"""WITH {CHILDREN}, marked AS (SELECT *, is_table OR parent_text IS NULL OR parent_id IS NULL AS exempt FROM joined)
SELECT doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id, parent_id, exempt ORDER BY rank) AS nth FROM marked) WHERE exempt OR nth = 1""",
    "text_dedup_first": r"""SELECT doc_id, source_id FROM (SELECT doc_id, source AS source_id,
row_number() OVER (PARTITION BY source, regexp_replace(text, '\s+', '', 'g') ORDER BY doc_id) AS nth FROM documents) WHERE nth = 1""",
    "text_dedup_last_wins": "SELECT arg_max(source, doc_id) AS source, min(doc_id) AS place FROM documents GROUP BY text",
    "sigmoid_threshold_topk": f"WITH {LOGITS} SELECT query_id, doc_id, new_rank, round(rerank_score, 6) AS rerank_score, filtered_count FROM kept",
    "rerank_rank_changes": f"WITH {LOGITS} SELECT query_id, doc_id, rank AS old_rank, new_rank, rank - new_rank AS moved FROM kept",
    "fallback_filter": f"""WITH {legs_sql(15)}, {fused_sql()},
hits AS (SELECT f.query_id, f.doc_id, f.rank, CASE WHEN vector_rank <= 5 THEN vector_rank::DOUBLE / 10 END AS v, {tokens_sql('b.text')} AS t, lower(d.text) AS c
  FROM fused f JOIN benchmark b ON f.query_id = b.item_id JOIN documents d ON f.doc_id = d.doc_id WHERE f.rank <= 15)
SELECT query_id, doc_id, rank FROM hits WHERE CASE WHEN v IS NOT NULL THEN v >= 0.53 WHEN len(t) = 0 THEN true
  ELSE len(list_filter(t, lambda x: contains(c, lower(x))))::DOUBLE / len(t) >= 0.5 END""",
    "hit_standardisation": """SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 4 > 0 THEN (doc_id % 3)::DOUBLE / 2 END, 0),
nullif(CASE WHEN doc_id % 2 > 0 THEN doc_id::DOUBLE / 1000 END, 0), 0) AS score FROM documents""",
}
