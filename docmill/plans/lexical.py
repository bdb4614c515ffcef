"""Lexical queries: the corpus is documents, the query set all of benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import lexical
from docmill.session import Scratch
from docmill.settings import DEFAULTS, STOPWORDS


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def bm25_index_stats(spark, sf_dir):
    return lexical.corpus_stats(documents(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_postings(spark, sf_dir):
    return lexical.LexicalIndex(lexical.postings(documents(spark, sf_dir))).postings().select("doc_id", "term", "tf", "dl")


def bm25_idf(spark, sf_dir):
    index = lexical.LexicalIndex(Scratch(spark).table(lexical.postings(documents(spark, sf_dir)), "postings"))
    return lexical.document_frequencies(index.postings(), index.stats().first()["n"]).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_vocabulary(spark, sf_dir):
    return lexical.vocabulary(documents(spark, sf_dir))


def bm25_scores(spark, sf_dir):
    found = lexical.scores(documents(spark, sf_dir), questions(spark, sf_dir))
    return found.select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"))


def bm25_topn_normalized(spark, sf_dir):
    hits = lexical.top_hits(lexical.scores(documents(spark, sf_dir), questions(spark, sf_dir)), DEFAULTS.retrieval_k)
    return lexical.normalised(hits).select("query_id", "doc_id", "rank", "bm25_norm")


def bm25_filtered_topn(spark, sf_dir):
    """Scores of the whole corpus' statistics; the filter chooses among scored documents."""
    docs = documents(spark, sf_dir)
    among = lexical.metadata_filter(docs, {"source": "src1", "lang": "en"})
    hits = lexical.top_hits(lexical.scores(docs, questions(spark, sf_dir), among=among), DEFAULTS.pool_min)
    return lexical.normalised(hits).select("query_id", "doc_id", "rank", "bm25_norm")


def bm25_zero_padding(spark, sf_dir):
    docs = documents(spark, sf_dir)
    among = lexical.metadata_filter(docs, {"source": "src1"})
    scored = lexical.scores(docs, questions(spark, sf_dir), among=among)
    among = among.where(F.size(lexical.tokens(F.col("text"))) > 0)
    return lexical.padded_top_hits(scored, among, DEFAULTS.retrieval_k).select("query_id", "doc_id", "rank", "bm25")


def bm25_index_roundtrip(spark, sf_dir):
    """The ranked hits of an index that was saved, loaded, and brought up to date."""
    docs, root = documents(spark, sf_dir), Scratch(spark).root
    old = docs.where("doc_id % 5 > 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" old words"))).otherwise(F.col("text")))
    old = old.select("doc_id", "text").unionByName(docs.select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    lexical.save_index(old, f"{root}/first")
    gone = docs.select((-1 - F.col("doc_id")).alias("doc_id"))
    lexical.updated_index(lexical.load_index(spark, f"{root}/first"), gone, docs.where("doc_id % 5 = 0 or doc_id % 7 = 0").select("doc_id", "text"), f"{root}/second")
    hits = lexical.top_hits(lexical.load_index(spark, f"{root}/second").scores(questions(spark, sf_dir)), DEFAULTS.retrieval_k)
    return lexical.normalised(hits).select("query_id", "doc_id", "rank", "bm25_norm")


def tokenize_stopwords(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.array_join(lexical.tokens(F.col("text"), (*STOPWORDS, "the", "de")), " ").alias("tokens"))


SYNONYMS = {"the": "der", "de": "des", "que": "queue", "erth": "ethr"}


def synonyms_apply(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.md5(lexical.replaced_synonyms(F.col("text"), SYNONYMS)).alias("text_md5"))


def bm25_incremental_corpus(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.col("source").alias("source_id"), F.col("text").alias("content"))
    sources = docs.groupBy("source_id").agg(F.max("doc_id").alias("m")).where("source_id <> 'src3'")
    current = sources.select(
        "source_id",
        F.md5(F.col("source_id")).alias("hash"),
        F.when(F.col("source_id").isin("src1", "src2"), "stale").otherwise(F.md5("source_id")).alias("old_hash"),
    )
    fresh = docs.withColumn("content", F.concat("content", F.lit(" revised")))
    result = lexical.incremental_corpus(docs, current, fresh)
    return result.select("doc_id", "source_id", F.md5("content").alias("content_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_index_stats, bm25_postings, bm25_idf, bm25_vocabulary, bm25_scores, bm25_topn_normalized,
        bm25_filtered_topn, bm25_zero_padding, bm25_index_roundtrip, tokenize_stopwords, synonyms_apply, bm25_incremental_corpus,
    )
}

STOP_LIST = ", ".join(f"'{w}'" for w in STOPWORDS)


def tokens_sql(text: str, more: str = "") -> str:
    return rf"list_filter(regexp_extract_all(coalesce({text}, ''), '[\p{{L}}\p{{N}}]{{2,}}'), lambda t: t NOT IN ({STOP_LIST}{more}))"


def index_sql(corpus: str = "documents") -> str:
    return f"""toks AS (SELECT doc_id, {tokens_sql('text')} AS t FROM {corpus}),
stats AS (SELECT count(*) AS n, coalesce(avg(len(t)), 1.0) AS avgdl FROM toks WHERE len(t) > 0),
terms AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks),
posts AS (SELECT doc_id, term, dl, count(*) AS tf FROM terms GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df, ln((max(n) + 1.0) / count(*)) AS idf FROM posts, stats GROUP BY term)"""


def scores_sql(among: str = "documents") -> str:
    return index_sql() + f""",
asked AS (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark),
times AS (SELECT query_id, term, count(*) AS times FROM asked GROUP BY ALL),
scored AS (
  SELECT query_id, doc_id, round(sum(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) + 1)), 6) AS bm25
  FROM times JOIN posts USING (term) JOIN dfs USING (term), stats WHERE doc_id IN (SELECT doc_id FROM {among}) GROUP BY query_id, doc_id),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id))::INT AS rank FROM scored)"""


NORM_SQL = "SELECT query_id, doc_id, rank, round(bm25 / max(bm25) OVER (PARTITION BY query_id), 4) AS bm25_norm FROM ranked"
SRC1 = "(SELECT * FROM documents WHERE source = 'src1')"

ORACLE = {
    "bm25_index_stats": f"WITH {index_sql()} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_postings": f"WITH {index_sql()} SELECT doc_id, term, tf, dl FROM posts",
    "bm25_idf": f"WITH {index_sql()} SELECT term, df, round(idf, 6) AS idf FROM dfs",
    "bm25_vocabulary": f"""WITH toks AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents),
placed AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS place FROM toks)
SELECT term, first_doc, first_place FROM (SELECT term, doc_id AS first_doc, place AS first_place,
  row_number() OVER (PARTITION BY term ORDER BY doc_id, place) AS r FROM placed) WHERE r = 1""",
    "bm25_scores": f"WITH {scores_sql()} SELECT query_id, doc_id, bm25 FROM scored",
    "bm25_topn_normalized": f"WITH {scores_sql()} {NORM_SQL} WHERE rank <= 50",
    "bm25_index_roundtrip": f"WITH {scores_sql()} {NORM_SQL} WHERE rank <= 50",
    "bm25_filtered_topn": f"WITH {scores_sql('(SELECT * FROM documents WHERE source = $$src1$$ AND lang = $$en$$)')} {NORM_SQL} WHERE rank <= 15",
    "bm25_zero_padding": f"""WITH {scores_sql(SRC1)},
every AS (SELECT q.query_id, d.doc_id FROM (SELECT DISTINCT query_id FROM scored) q, (SELECT doc_id FROM toks WHERE len(t) > 0 AND doc_id IN (SELECT doc_id FROM {SRC1})) d),
filled AS (SELECT query_id, doc_id, coalesce(bm25, 0.0) AS bm25 FROM every LEFT JOIN scored USING (query_id, doc_id)),
filled_ranks AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id))::INT AS rank FROM filled)
SELECT query_id, doc_id, rank, bm25 FROM filled_ranks WHERE rank <= 50""",
    "tokenize_stopwords": f"SELECT doc_id, array_to_string({tokens_sql('text', ', $$the$$, $$de$$')}, ' ') AS tokens FROM documents",
    "synonyms_apply": "SELECT doc_id, md5(replace(replace(text, 'the', 'der'), 'erth', 'ethr')) AS text_md5 FROM documents",
    "bm25_incremental_corpus": """SELECT doc_id, source AS source_id,
md5(CASE WHEN source IN ('src1', 'src2') THEN text || ' revised' ELSE text END) AS content_md5 FROM documents WHERE source <> 'src3'""",
}
