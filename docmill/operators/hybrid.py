"""Hybrid retrieval: rank fusion, table leg, parents, duplicates, rerank, thresholds.

Hit tables carry query_id and rank, so all operators work on many queries at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.settings import DEFAULTS, Settings


def fused(lexical: DataFrame, vector: DataFrame, n: int, settings: Settings = DEFAULTS) -> DataFrame:
    """query_id, doc_id, bm25_rank, vector_rank, rrf_score and rank: reciprocal ranks summed over two ranked lists.

    One union and one aggregation; equal scores keep the lexical list's order, then the vector list's.
    """
    both = lexical.select("query_id", "doc_id", F.col("rank").alias("bm25_rank"), F.lit(None).cast("int").alias("vector_rank")).unionByName(
        vector.select("query_id", "doc_id", F.lit(None).cast("int").alias("bm25_rank"), F.col("rank").alias("vector_rank"))
    )
    merged = both.groupBy("query_id", "doc_id").agg(F.min("bm25_rank").alias("bm25_rank"), F.min("vector_rank").alias("vector_rank"))

    def share(rank: str) -> Column:
        return F.coalesce(F.lit(settings.weight) / (settings.rrf_k + F.col(rank)), F.lit(0.0))

    scored = merged.withColumn("rrf_score", F.round(share("bm25_rank") + share("vector_rank"), 6))
    order = Window.partitionBy("query_id").orderBy(
        F.col("rrf_score").desc(), F.col("bm25_rank").asc_nulls_last(), F.col("vector_rank").asc_nulls_last(), "doc_id"
    )
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def fused_or_single(lexical: DataFrame, vector: DataFrame, n: int, settings: Settings = DEFAULTS) -> DataFrame:
    """fused(), but a query with hits in one list alone keeps that list, without fused scores."""
    sides = lexical.select("query_id", F.lit(1).alias("side")).unionByName(vector.select("query_id", F.lit(2).alias("side")))
    sides = sides.groupBy("query_id").agg(F.countDistinct("side").alias("sides"))
    rows = fused(lexical, vector, n, settings).join(sides, "query_id")
    alone = F.col("sides") == 1
    return rows.withColumn("rrf_score", F.when(~alone, F.col("rrf_score"))).withColumn(
        "rank", F.when(alone, F.coalesce("bm25_rank", "vector_rank")).otherwise(F.col("rank"))
    ).drop("sides")


def with_table_leg(hits: DataFrame, tables: DataFrame, n: int) -> DataFrame:
    """hits and up to max(2, n // 3) of each query's table hits (query_id, doc_id, rank) not among them, ranked after them."""
    fresh = tables.where(F.col("rank") <= max(2, n // 3)).join(hits, ["query_id", "doc_id"], "left_anti")
    lengths = hits.groupBy("query_id").agg(F.max("rank").alias("length"))
    order = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    placed = fresh.withColumn("place", F.row_number().over(order)).join(lengths, "query_id", "left")
    added = placed.select("query_id", "doc_id", F.lit(None).cast("double").alias("rrf_score"), (F.coalesce("length", F.lit(0)) + F.col("place")).alias("rank"))
    return hits.select("query_id", "doc_id", "rrf_score", "rank").unionByName(added)


def document_key(chunk_id: Column, meta_chunk_id: Column, source: Column, page: Column) -> Column:
    """A hit's identity: its chunk id, its metadata's, or source and page."""
    named = F.concat(F.coalesce(source, F.lit("unknown")), F.lit("::p"), F.coalesce(page.cast("string"), F.lit("0")))
    return F.coalesce(chunk_id, meta_chunk_id, named)


def standard_score(score: Column, rrf: Column) -> Column:
    """The first of score and fused score that is neither null nor zero, else zero."""
    return F.coalesce(F.nullif(score, F.lit(0.0)), F.nullif(rrf, F.lit(0.0)), F.lit(0.0))


def with_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """hits (source_id, parent_id, content) with `text`, the parent's text if there is one, else the hit's own."""
    joined = hits.join(parents.select("source_id", "parent_id", "parent_text"), ["source_id", "parent_id"], "left")
    return joined.withColumn("text", F.coalesce("parent_text", "content"))


def first_by_parent(hits: DataFrame) -> DataFrame:
    """Hits without later children of a parent that has been emitted; tables and hits without a found parent stay."""
    exempt = F.col("is_table") | F.col("parent_text").isNull() | F.col("parent_id").isNull() | F.col("source_id").isNull()
    order = Window.partitionBy("query_id", "source_id", "parent_id", exempt).orderBy("rank")
    return hits.withColumn("nth", F.row_number().over(order)).where(exempt | (F.col("nth") == 1)).drop("nth")


def first_by_text(hits: DataFrame, text_col: str = "text") -> DataFrame:
    """Hits without later ones of the same text but for white space."""
    stripped = F.md5(F.regexp_replace(text_col, r"(?U)\s+", ""))
    order = Window.partitionBy("query_id", stripped).orderBy("rank")
    return hits.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def last_by_text(rows: DataFrame, key: str, place: str) -> DataFrame:
    """One row a text: the last one's key, at the first one's place."""
    grouped = rows.groupBy(F.md5("text").alias("text_md5"))
    return grouped.agg(F.max_by(key, place).alias(key), F.min(place).alias(place)).drop("text_md5")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def reranked(hits: DataFrame, top_k: int, settings: Settings = DEFAULTS) -> DataFrame:
    """The best hits by sigmoid of logit, those of the threshold and more, with new rank and filtered_count."""
    k = min(settings.rerank_docs, top_k)
    scored = hits.withColumn("rerank_score", sigmoid(F.col("logit")))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    rows = scored.withColumn("new_rank", F.row_number().over(order)).withColumn("n_in", F.count("*").over(Window.partitionBy("query_id")))
    kept = rows.where((F.col("rerank_score") >= settings.rerank_threshold) & (F.col("new_rank") <= k))
    return kept.withColumn("filtered_count", F.col("n_in") - F.count("*").over(Window.partitionBy("query_id"))).drop("n_in")


def rank_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """query_id, doc_id, old_rank, new_rank and moved of every document that was reranked."""
    joined = before.select("query_id", "doc_id", F.col("rank").alias("old_rank")).join(after.select("query_id", "doc_id", "new_rank"), ["query_id", "doc_id"])
    return joined.withColumn("moved", F.col("old_rank") - F.col("new_rank"))


def fallback_kept(vector_score: Column, query_tokens: Column, content: Column, settings: Settings = DEFAULTS) -> Column:
    """Whether a hit stays without a reranker: by vector score, or by the share of query tokens its text holds."""
    text = F.lower(content)
    shared = F.size(F.filter(query_tokens, lambda t: F.contains(text, F.lower(t))))
    share = shared / F.size(query_tokens)
    return (
        F.when(vector_score.isNotNull(), vector_score >= settings.fallback_vector)
        .when(F.size(query_tokens) == 0, F.lit(True))
        .otherwise(share >= settings.fallback_overlap)
    )


def rerank_fallback(hits: DataFrame, top_k: int = DEFAULTS.rerank_docs) -> DataFrame:
    """What a reranker that is busy, late or broken gives: the first top_k hits (query_id, doc_id, rank) at score 0, marked as skipped."""
    count = F.count("*").over(Window.partitionBy("query_id"))
    rows = hits.withColumn("filtered", F.greatest(count - top_k, F.lit(0)))
    return rows.where(F.col("rank") <= top_k).select("query_id", "doc_id", "rank", F.lit(0.0).alias("rerank_score"), "filtered", F.lit(True).alias("skipped"))


def api_reranked(hits: DataFrame, responses: DataFrame, top_k: int = DEFAULTS.rerank_docs, threshold: float = DEFAULTS.rerank_threshold) -> DataFrame:
    """query_id, doc_id, rerank_score, place and filtered of a rerank service's responses (query_id, json) about hits (query_id, doc_id, rank).

    A result names a hit by its index from 0; results without one, below the
    threshold or beyond top_k of those left go, in the response's order.
    """
    kind = "struct<results: array<struct<index: int, relevance_score: double>>>"
    results = responses.select("query_id", F.posexplode(F.from_json("json", kind)["results"]).alias("nth", "r"))
    results = results.select("query_id", "nth", F.coalesce("r.index", F.lit(-1)).alias("index"), F.coalesce("r.relevance_score", F.lit(0.0)).alias("rerank_score"))
    count = F.count("*").over(Window.partitionBy("query_id"))
    known = hits.select("query_id", "doc_id", (F.col("rank") - 1).alias("index"), count.alias("hits"))
    passed = results.where((F.col("index") >= 0) & (F.col("rerank_score") >= threshold)).join(known, ["query_id", "index"])
    passed = passed.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("nth"))).where(F.col("place") <= top_k)
    kept = F.count("*").over(Window.partitionBy("query_id"))
    return passed.select("query_id", "doc_id", "rerank_score", "place", (F.col("hits") - kept).alias("filtered"))


def pool_size(n: int, least: int = DEFAULTS.pool_min) -> int:
    """Candidates that each leg fetches for n hits."""
    return max(least, n)
