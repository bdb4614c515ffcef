"""Queries of predicates, page blocks, tables and lookups; blocks are laid out from lineitem and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.operators import catalog
from docmill.plans.lexical import documents

WHERE = {"$and": [{"lang": {"$eq": "en"}}, {"source": {"$in": ["src1", "src2", "src3"]}}]}


def filtered_documents(spark, sf_dir):
    return documents(spark, sf_dir).where(catalog.predicate(WHERE)).select("doc_id", "source")


def source_location(spark, sf_dir):
    docs = documents(spark, sf_dir)
    suffix = F.get(F.array(*map(F.lit, ("pdf", "md", "hwp"))), (F.col("doc_id") % 3).cast("int"))
    title = F.when(F.col("doc_id") % 4 > 0, F.col("source"))
    page = F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") % 9)
    return docs.select("doc_id", catalog.source_location(suffix, title, page).alias("location"))


def blocks(spark, sf_dir):
    """Order lines as page blocks: size by quantity, every eleventh in a table, some of them article headings."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("제 "), F.col("l_partkey"), F.lit(" 조 목적"))).otherwise(F.concat(F.lit("line  of part "), "l_partkey"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("l_quantity")).select(
        F.col("l_orderkey").alias("doc_id"), F.floor(F.col("l_linenumber") / 4).alias("page"), F.col("l_linenumber").alias("block_no"), text.alias("text"),
        F.when(F.col("l_quantity") > 40, 14.0).when(F.col("l_quantity") < 5, 8.0).otherwise(11.0).alias("size"), (F.col("l_partkey") % 11 == 0).alias("in_table"),
    )


def pdf_sections(spark, sf_dir):
    bases = blocks(spark, sf_dir).groupBy("doc_id").agg(F.lit(11.0).alias("base_size"))
    return catalog.block_sections(blocks(spark, sf_dir), bases)


def page_context(spark, sf_dir):
    return catalog.page_context(blocks(spark, sf_dir))


def table_sections(spark, sf_dir):
    tables = blocks(spark, sf_dir).where("in_table").select("doc_id", "page", F.col("block_no").alias("table_index"), F.when(F.col("block_no") % 5 > 0, F.concat(F.lit("| "), "text", F.lit(" |"))).alias("markdown"))
    return catalog.table_sections(tables, catalog.page_context(blocks(spark, sf_dir)))


def golden_lookups(spark, sf_dir):
    docs = documents(spark, sf_dir)
    years = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("2023"), F.col("lang"), F.lit("2024"), F.col("source")))
    rows = docs.select(F.col("doc_id").alias("id"), F.array("source").alias("keys"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("value"), (F.col("doc_id") % 7 > 0).alias("cell_score"), years.alias("by_year"))
    return catalog.golden_lookups(rows).select("id", F.array_join("keys", "|").alias("keys"), "value")


def indexed_paths(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return catalog.indexed_paths(docs.select(F.col("source").alias("source_id"), F.concat("source", F.lit("/"), "lang").alias("relative_path"), F.col("doc_id").alias("place")))


QUERIES = {f.__name__: f for f in (filtered_documents, source_location, pdf_sections, page_context, table_sections, golden_lookups, indexed_paths)}

BLOCKS = """blocks AS (SELECT l_orderkey AS doc_id, l_linenumber // 4 AS page, l_linenumber AS block_no,
  CASE WHEN max(l_partkey) % 4 = 0 THEN '제 ' || max(l_partkey) || ' 조 목적' ELSE 'line  of part ' || max(l_partkey) END AS text,
  CASE WHEN max(l_quantity) > 40 THEN 14 WHEN max(l_quantity) < 5 THEN 8 ELSE 11 END AS size, max(l_partkey) % 11 = 0 AS in_table FROM lineitem GROUP BY l_orderkey, l_linenumber),
kinds AS (SELECT *, regexp_replace(text, '\\s+', ' ', 'g') AS clean, CASE WHEN size >= 12.5 THEN 1 WHEN size < 10.5 THEN -1 WHEN regexp_matches(text, '^제 \\d+ 조') THEN 2 ELSE 0 END AS kind FROM blocks WHERE NOT in_table),
marked AS (SELECT *, count(CASE WHEN kind > 0 THEN 1 END) OVER w AS section,
  coalesce(last_value(CASE WHEN kind = 1 THEN clean END IGNORE NULLS) OVER w, '기본 섹션') AS chapter,
  coalesce(last_value(CASE WHEN kind = 2 THEN clean WHEN kind = 1 THEN '기본 섹션' END IGNORE NULLS) OVER w, '기본 섹션') AS article
  FROM kinds WHERE kind >= 0 WINDOW w AS (PARTITION BY doc_id ORDER BY page, block_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_no) AS n FROM blocks WHERE NOT in_table),
contexts AS (SELECT doc_id, page, string_agg(trim(text), chr(10) ORDER BY n) AS context FROM lines WHERE n BETWEEN 2 AND 6 GROUP BY ALL)"""

ORACLE = {
    "filtered_documents": "SELECT doc_id, source FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3')",
    "source_location": """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN CASE WHEN doc_id % 4 > 0 THEN source ELSE '-' END
WHEN doc_id % 5 > 0 THEN 'p.' || (n_chars % 9) ELSE '-' END AS location FROM documents""",
    "pdf_sections": f"""WITH {BLOCKS} SELECT doc_id, section, chapter, article, string_agg(clean, ' ' ORDER BY page, block_no) FILTER (kind <> 1) AS content
FROM marked GROUP BY doc_id, section, chapter, article HAVING length(string_agg(clean, ' ' ORDER BY page, block_no) FILTER (kind <> 1)) >= 5""",
    "page_context": f"WITH {BLOCKS} SELECT * FROM contexts",
    "table_sections": f"""WITH {BLOCKS}, t AS (SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY block_no) - 1)::INT AS table_no,
  CASE WHEN block_no % 5 > 0 THEN '| ' || text || ' |' END AS markdown FROM blocks WHERE in_table)
SELECT doc_id, page, table_no, concat_ws(chr(10) || chr(10), nullif(context, ''), markdown) AS content, true AS is_table FROM t LEFT JOIN contexts USING (doc_id, page) WHERE markdown IS NOT NULL""",
    "golden_lookups": """SELECT doc_id AS id, source AS keys, lang AS value FROM documents WHERE doc_id % 7 > 0 AND doc_id % 3 > 0
UNION ALL SELECT doc_id, source || '|2023', lang FROM documents WHERE doc_id % 7 > 0 AND doc_id % 2 = 0
UNION ALL SELECT doc_id, source || '|2024', source FROM documents WHERE doc_id % 7 > 0 AND doc_id % 2 = 0""",
    "indexed_paths": "SELECT DISTINCT relative_path FROM (SELECT arg_min(source || '/' || lang, doc_id) AS relative_path FROM documents GROUP BY source)",
}
