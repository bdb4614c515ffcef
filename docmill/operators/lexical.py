"""Lexical index and search: tokens, postings, BM25+ scores and ranked hits for a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.session import Scratch, broadcast_if_small
from docmill.settings import DEFAULTS, STOPWORDS, Settings

#: The default tokeniser's words.
TOKEN = r"[\p{L}\p{N}]{2,}"


def tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Words of two letters or digits and more, repeats kept, without stopwords."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stopwords))


def replaced_synonyms(text: Column, synonyms: dict[str, str]) -> Column:
    """Each key replaced by its value in order; keys that are empty, unchanged or part of their value are skipped."""
    for key, value in synonyms.items():
        if key and key != value and key not in value:
            text = F.replace(text, F.lit(key), F.lit(value))
    return text


#: Stands in an index for a document itself; no token is empty.
DOCUMENT = ""


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """doc_id, term, tf and dl (tokens of the document) of docs (doc_id, text), with a row of term DOCUMENT for each document.

    One pass tokenises the texts; terms, if given, cut the rows before they are
    counted. Documents without tokens drop out.
    """
    tokenised = docs.select("doc_id", tokens(F.col("text")).alias("tokens"))
    marked = F.explode(F.array_append("tokens", F.lit(DOCUMENT))).alias("term")
    rows = tokenised.select("doc_id", F.size("tokens").cast("long").alias("dl"), marked).where("dl > 0")
    if terms is not None:
        wanted = terms.select("term").unionByName(terms.sparkSession.createDataFrame([(DOCUMENT,)], "term string"))
        rows = rows.join(broadcast_if_small(wanted, 64), "term", "left_semi")
    return rows.groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))


@dataclass
class LexicalIndex:
    """Postings in a table, sorted by term, so a few terms read few of its row groups."""

    table: DataFrame

    def postings(self) -> DataFrame:
        """doc_id, term, tf and dl without the documents' own rows."""
        return self.table.where(F.col("term") != DOCUMENT)

    def stats(self) -> DataFrame:
        """n documents and avgdl (1 for none), as one row."""
        return self.table.where(F.col("term") == DOCUMENT).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))

    def scores(self, queries: DataFrame, settings: Settings = DEFAULTS, among: DataFrame | None = None) -> DataFrame:
        """query_id, doc_id and bm25 of every document that shares a term with the query (query_id, text).

        A term counts once for each time it stands in the query. Statistics are
        those of the whole index, whichever documents (doc_id) are asked for.
        Query terms and their frequencies are one row a term and go to the
        postings, which stay where they are until their scores are summed.
        """
        asked = asked_terms(queries)
        known = self.stats().first()
        posts = self.postings().join(broadcast_if_small(asked.select("term").distinct(), 64), "term", "left_semi")
        frequencies = document_frequencies(posts, known["n"])
        weights = asked.join(frequencies, "term").select("query_id", "term", "idf", "times")
        if among is not None:
            posts = posts.join(broadcast_if_small(among.select("doc_id").distinct(), 16), "doc_id", "left_semi")
        matched = posts.join(broadcast_if_small(weights, 96), "term").withColumn("weight", term_weight(settings, known["avgdl"]))
        return matched.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("times")).alias("bm25"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, term and the times it stands in the query (query_id, text)."""
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term"))
    return asked.groupBy("query_id", "term").agg(F.count("*").alias("times"))


def save_index(docs: DataFrame, path: str) -> LexicalIndex:
    """The index of docs (doc_id, text), written to path; rows are dealt to files by ranges of term and document."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings(docs).repartitionByRange(parts, "term", "doc_id").sortWithinPartitions("term", "doc_id")
    dealt.write.mode("overwrite").parquet(path)
    return load_index(docs.sparkSession, path)


def load_index(spark: SparkSession, path: str) -> LexicalIndex:
    return LexicalIndex(spark.read.parquet(path))


def updated_index(index: LexicalIndex, gone: DataFrame, fresh: DataFrame, path: str) -> LexicalIndex:
    """The index, in a new folder, without the documents in gone (doc_id), with fresh (doc_id, text) ones; only those are tokenised."""
    added = postings(fresh)
    kept = index.table.join(gone.select("doc_id").union(fresh.select("doc_id")).distinct(), "doc_id", "left_anti")
    rows = kept.select("doc_id", "term", "dl", "tf").unionByName(added)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)
    return load_index(rows.sparkSession, path)


def corpus_stats(docs: DataFrame) -> DataFrame:
    """n documents with tokens, and avgdl (1 for none), as one row."""
    lengths = docs.select(F.size(tokens(F.col("text"))).alias("dl")).where("dl > 0")
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def document_frequencies(posts: DataFrame, n: int) -> DataFrame:
    """term, df and idf."""
    return posts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(n + 1.0) / F.col("df")))


def vocabulary(docs: DataFrame) -> DataFrame:
    """term and where it is first seen: document, then place in it."""
    placed = docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("place", "term"))
    first = placed.groupBy("term").agg(F.min(F.struct("doc_id", "place")).alias("first"))
    return first.select("term", F.col("first.doc_id").alias("first_doc"), F.col("first.place").cast("long").alias("first_place"))


def term_weight(settings: Settings = DEFAULTS, avgdl: float = 1.0) -> Column:
    """The share of one query term in a document's score."""
    norm = F.col("tf") + settings.k1 * (1 - settings.b + settings.b * F.col("dl") / F.lit(avgdl))
    return F.col("idf") * (F.col("tf") * (settings.k1 + 1) / norm + settings.delta)


def scores(docs: DataFrame, queries: DataFrame, settings: Settings = DEFAULTS, among: DataFrame | None = None) -> DataFrame:
    """LexicalIndex.scores() without a stored index: one pass keeps the postings of the queries' terms in a scratch table."""
    wanted = asked_terms(queries).select("term").distinct()
    table = Scratch(docs.sparkSession).table(postings(docs, wanted), "postings")
    return LexicalIndex(table).scores(queries, settings, among)


def top_hits(scored: DataFrame, n: int, score: str = "bm25", digits: int = 6) -> DataFrame:
    """The n best documents of each query by score, then by id, with rank from 1; scores are rounded before ranking."""
    best = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "doc_id")
    rounded = scored.withColumn(score, F.round(score, digits))
    return rounded.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def padded_top_hits(scored: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """top_hits; a query with some but fewer than n hits is filled up with zero scores in order of id.

    The fill of a query lies within the n smallest ids, as at most as many of those are hits as it needn't fill.
    """
    hits = top_hits(scored, n)
    first = [r["doc_id"] for r in docs.select("doc_id").orderBy("doc_id").limit(n).collect()]
    short = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.collect_set("doc_id").alias("own")).where(F.col("hits") < n)
    fill = short.select("query_id", "hits", F.posexplode(F.array_except(F.array(*map(F.lit, first)), "own")).alias("place", "doc_id"))
    fill = fill.select("query_id", "doc_id", F.lit(0.0).alias("bm25"), (F.col("hits") + F.col("place") + 1).cast("int").alias("rank"))
    return hits.select("query_id", "doc_id", "bm25", "rank").unionByName(fill.where(F.col("rank") <= n))


def normalised(hits: DataFrame, score: str = "bm25") -> DataFrame:
    """Adds bm25_norm: the score over the query's largest, to four digits."""
    most = F.max(score).over(Window.partitionBy("query_id"))
    return hits.withColumn("bm25_norm", F.round(F.when(most > 0, F.col(score) / most).otherwise(0.0), 4))


def metadata_filter(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows whose columns equal all wanted values; None equals null."""
    for column, value in wanted.items():
        df = df.where(F.col(column).eqNullSafe(F.lit(value)))
    return df


def incremental_corpus(corpus: DataFrame, current: DataFrame, fresh: DataFrame) -> DataFrame:
    """The corpus after a sync: rows of sources that are gone or changed leave, rows of new and changed ones enter.

    corpus and fresh: doc_id, source_id, content; current: source_id, hash, old_hash.
    """
    changed = current.where(~F.col("hash").eqNullSafe(F.col("old_hash"))).select("source_id")
    kept = corpus.join(current.select("source_id"), "source_id", "left_semi").join(changed, "source_id", "left_anti")
    return kept.unionByName(fresh.join(changed, "source_id", "left_semi"))
