"""Chunking, page and grid queries. Grids and boxes are laid out from orders and lineitem, pages from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions.splitting import PAGE_BREAK
from docmill.operators import chunking
from docmill.plans.lexical import documents

ROOT_HEADER = "# Guide\nintro text\n## "


def conversations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def marked_documents(spark, sf_dir):
    """Every document under markdown headers that name its source and language."""
    docs = documents(spark, sf_dir)
    text = F.concat(F.lit(ROOT_HEADER), F.col("source"), F.lit("\n"), F.col("text"), F.lit("\n# Annex\n### "), F.col("lang"), F.lit("\nshort note\n"))
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("source_id"), text.alias("text"))


def sectioned_markdown(spark, sf_dir):
    found = chunking.sections(marked_documents(spark, sf_dir))
    return found.select("doc_id", "section", "chapter", "article", F.md5("content").alias("content_md5"))


def recursive_chunks(spark, sf_dir):
    return chunking.recursive_chunks(documents(spark, sf_dir), 400, 50)


def hierarchical_chunks(spark, sf_dir):
    return chunking.flattened(chunking.hierarchical_chunks(marked_documents(spark, sf_dir)))


def chunk_quality_report(spark, sf_dir):
    parents = chunking.hierarchical_chunks(marked_documents(spark, sf_dir))
    kids = chunking.flattened(parents)
    return kids.groupBy("source_id").agg(
        F.countDistinct("parent_id").alias("parents"), F.count("*").alias("children"), F.min(F.length("text")).alias("shortest"),
        F.max(F.length("text")).alias("longest"), F.round(F.avg(F.length("text")), 2).alias("mean_chars"),
    )


def broken_pages(spark, sf_dir):
    """Conversation turns as parts, with page breaks at both ends of every other."""
    mark = F.when(F.col("turn") % 2 == 0, F.lit(PAGE_BREAK)).otherwise("")
    return conversations(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part_no"), F.concat(mark, "text", mark).alias("text"))


def net_page_breaks(spark, sf_dir):
    return chunking.net_page_breaks(broken_pages(spark, sf_dir), 50)


def repeated_line_removal(spark, sf_dir):
    rows = conversations(spark, sf_dir)
    head = F.when(F.col("turn") % 7 < 6, F.concat(F.lit("Company manual\n"))).otherwise("")
    text = F.concat(head, "text", F.lit("\n"), (F.col("turn") + 1).cast("string"), F.lit(" / 9"))
    pages = rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), text.alias("text"))
    return chunking.without_repeated_lines(pages).select("doc_id", "page", F.md5("text").alias("text_md5"))


def cells(spark, sf_dir):
    """Every order as a grid: its lines are rows, columns are flag (null if repeated), quantity and a blank."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    flag = F.when((F.col("l_linenumber") > 1) & (F.col("l_returnflag") == "N"), F.lit(None).cast("string")).otherwise(F.col("l_returnflag"))
    values = F.array(flag, F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_orderkey") % 3 == 0, F.col("l_linestatus")).otherwise(""))
    return rows.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), F.posexplode(values).alias("col", "cell"))


def rowspan_fill(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = rows.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("f"))
    grid = one.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), F.lit(0).alias("col"), F.when((F.col("l_linenumber") == 1) | (F.col("f") != "N"), F.col("f")).alias("cell"))
    return chunking.filled_rowspans(grid)


def drop_empty_columns(spark, sf_dir):
    return chunking.without_empty_columns(cells(spark, sf_dir)).select("table_id", "row", "col", "cell")


def grid_to_markdown(spark, sf_dir):
    rows = cells(spark, sf_dir).groupBy("table_id", "row", "col").agg(F.max("cell").alias("cell"))
    return chunking.grid_markdown(rows)


def markdown_tables(spark, sf_dir):
    """Every conversation as a markdown table of turn and role."""
    rows = conversations(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("| "), r["turn"].cast("string"), F.lit(" | "), r["role"], F.lit(" |"))), "\n")
    text = F.concat(F.lit("| turn | role |\n| --- | --- |\n"), body)
    return rows.select(F.col("conv_id").alias("table_id"), F.concat(F.lit("Talk "), "conv_id").alias("title"), text.alias("markdown"))


def table_row_chunks(spark, sf_dir):
    return chunking.table_row_chunks(markdown_tables(spark, sf_dir))


def boxes(spark, sf_dir, key):
    """Boxes of orders on pages of a few hundred, by key and price."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x, y = (F.col("o_orderkey") * 37) % 500, (F.col("o_custkey") * 53) % 700
    width = (F.floor("o_totalprice") % 60) + 10
    return rows.select(F.col("o_orderkey").alias(key), F.floor(F.col("o_orderkey") / 200).alias("page"), x.alias("x0"), y.alias("y0"), (x + width).alias("x1"), (y + 20).alias("y1"))


def bbox_overlap_join(spark, sf_dir):
    return chunking.overlapping_boxes(boxes(spark, sf_dir, "block_id"), boxes(spark, sf_dir, "table_id"))


def point_in_cell_join(spark, sf_dir):
    points = boxes(spark, sf_dir, "point_id").select("point_id", "page", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return chunking.in_cells(points, boxes(spark, sf_dir, "cell_id"))


def base_font_size(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    spans = rows.select((F.col("l_orderkey") % 100).alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_quantity") / 4).alias("size"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return chunking.base_font_size(spans)


QUERIES = {
    f.__name__: f
    for f in (
        sectioned_markdown, recursive_chunks, hierarchical_chunks, chunk_quality_report, net_page_breaks, repeated_line_removal,
        rowspan_fill, drop_empty_columns, grid_to_markdown, table_row_chunks, bbox_overlap_join, point_in_cell_join, base_font_size,
    )
}

CELLS = """cells AS (SELECT l_orderkey AS table_id, l_linenumber AS "row", unnest([0, 1, 2]) AS col, unnest([
  CASE WHEN l_linenumber > 1 AND l_returnflag = 'N' THEN NULL ELSE l_returnflag END, l_quantity::INT::VARCHAR,
  CASE WHEN l_orderkey % 3 = 0 THEN l_linestatus ELSE '' END]) AS cell FROM lineitem)"""
BOXES = """boxes AS (SELECT o_orderkey AS id, o_orderkey // 200 AS page, (o_orderkey * 37) % 500 AS x0, (o_custkey * 53) % 700 AS y0,
  (o_orderkey * 37) % 500 + floor(o_totalprice)::BIGINT % 60 + 10 AS x1, (o_custkey * 53) % 700 + 20 AS y1 FROM orders)"""

ORACLE = {
    "sectioned_markdown": r"""WITH body AS (SELECT doc_id, source, lang, trim(regexp_replace('intro text', '\s+', ' ', 'g')) AS i,
  regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' '), '\s+', ' ', 'g'), '\(\s+\)', '()', 'g') AS t FROM documents)
SELECT * FROM (
  SELECT doc_id, 1::BIGINT AS section, 'Guide' AS chapter, '기본 섹션' AS article, md5(i) AS content_md5 FROM body
  UNION ALL SELECT doc_id, 2, 'Guide', source, md5(trim(t)) FROM body WHERE length(trim(t)) >= 5
  UNION ALL SELECT doc_id, 4, 'Annex', lang, md5('short note') FROM body)""",
    "net_page_breaks": f"""WITH p AS (SELECT conv_id AS doc_id, turn AS part_no, CASE WHEN turn % 2 = 0 THEN '{PAGE_BREAK}' || text || '{PAGE_BREAK}' ELSE text END AS text FROM conversations),
n AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY part_no) AS prev FROM p)
SELECT doc_id, part_no, greatest(0, len(string_split(text, '{PAGE_BREAK}')) - 1 - coalesce(len(string_split(right(prev, 50), '{PAGE_BREAK}')) - 1, 0))::INT AS breaks FROM n""",
    "repeated_line_removal": """WITH p AS (SELECT conv_id AS doc_id, turn AS page, CASE WHEN turn % 7 < 6 THEN 'Company manual' || chr(10) ELSE '' END || text || chr(10) || (turn + 1) || ' / 9' AS text FROM conversations),
l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0) AS own FROM p),
e AS (SELECT doc_id, unnest(list_distinct(list_concat(own[1:2], own[greatest(len(own) - 1, 1):]))) AS line FROM l),
c AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY 1),
noise AS (SELECT doc_id, list(line) AS noise FROM (SELECT doc_id, line, count(*) AS n FROM e WHERE length(line) > 1 GROUP BY ALL) JOIN c USING (doc_id) WHERE pages > 1 AND n::DOUBLE / pages >= 0.8 GROUP BY 1)
SELECT p.doc_id, page, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(noise, []), trim(x))), chr(10))) AS text_md5
FROM p LEFT JOIN noise ON p.doc_id = noise.doc_id""",
    "rowspan_fill": """WITH one AS (SELECT l_orderkey AS table_id, l_linenumber AS "row", max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
g AS (SELECT table_id, "row", 0 AS col, CASE WHEN "row" = 1 OR f <> 'N' THEN f END AS cell FROM one)
SELECT table_id, "row", col, coalesce(last_value(cell IGNORE NULLS) OVER (PARTITION BY table_id, col ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS cell FROM g""",
    "drop_empty_columns": f"""WITH {CELLS}, u AS (SELECT *, bool_or(trim(coalesce(cell, '')) <> '') OVER (PARTITION BY table_id, col) AS used FROM cells),
a AS (SELECT *, bool_or(used) OVER (PARTITION BY table_id) AS any_used FROM u) SELECT table_id, "row", col, cell FROM a WHERE used OR NOT any_used""",
    "grid_to_markdown": f"""WITH {CELLS}, one AS (SELECT table_id, "row", col, max(cell) AS cell FROM cells GROUP BY ALL),
lines AS (SELECT table_id, "row", '| ' || string_agg(coalesce(cell, ''), ' | ' ORDER BY col) || ' |' AS line FROM one GROUP BY ALL)
SELECT table_id, string_agg(CASE WHEN "row" = m THEN line || chr(10) || '| --- | --- | --- |' ELSE line END, chr(10) ORDER BY "row") AS markdown
FROM (SELECT *, min("row") OVER (PARTITION BY table_id) AS m FROM lines) GROUP BY 1""",
    "table_row_chunks": """SELECT conv_id AS table_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS row_no,
'Talk ' || conv_id || chr(10) || '| turn | role |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || turn || ' | ' || role || ' |' AS chunk FROM conversations""",
    "bbox_overlap_join": f"""WITH {BOXES} SELECT a.id AS block_id, b.id AS table_id FROM boxes a JOIN boxes b ON a.page = b.page
AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""",
    "point_in_cell_join": f"""WITH {BOXES} SELECT a.id AS point_id, b.id AS cell_id FROM boxes a JOIN boxes b ON a.page = b.page
AND a.x0 BETWEEN b.x0 AND b.x1 AND a.y0 BETWEEN b.y0 AND b.y1""",
    "base_font_size": """WITH s AS (SELECT l_orderkey % 100 AS doc_id, round(l_quantity / 4, 1) AS size, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem WHERE l_linenumber <= 10 GROUP BY 1, 2)
SELECT doc_id, size AS base_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS r FROM s) WHERE r = 1""",
}
