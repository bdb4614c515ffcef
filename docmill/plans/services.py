"""Queries of layout, chunk choice, reranker services, parser switches and scoring, over tables laid out from the test data."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions.text import repaired_tables as repaired
from docmill.operators import chunking, evaluation, hybrid, incremental
from docmill.plans.chunks import conversations
from docmill.plans.lexical import documents


def orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def talk_tables(spark, sf_dir):
    """Each conversation as a markdown table of its turns."""
    line = F.concat(F.lit("| "), F.col("turn").cast("string"), F.lit(" | "), "role", F.lit(" |"))
    rows = conversations(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", line.alias("line")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return rows.select(F.col("conv_id").alias("table_id"), F.concat(F.lit("|turn|role|\n| --- | --- |\n"), body).alias("markdown"))


def markdown_cells(spark, sf_dir):
    return chunking.markdown_cells(talk_tables(spark, sf_dir))


def repaired_tables(spark, sf_dir):
    """Documents as one table line each, with gaps torn into numbers and words."""
    docs = documents(spark, sf_dir)
    text = F.concat(F.lit("| 1 2 "), F.regexp_replace("text", "[|\n]", " "), F.lit(" | 학 교 | 3학 년 |"))
    return docs.select("doc_id", F.md5(repaired(text)).alias("text_md5"))


def block_texts(spark, sf_dir):
    """Orders as blocks of two spans."""
    rows = orders(spark, sf_dir)
    spans = F.array(
        *(
            F.struct(F.lit(size).alias("size"), F.lit(0.0).alias("x"), F.lit(y).alias("y"), text.alias("text"))
            for size, y, text in ((10.0, 10.0, F.col("o_orderpriority")), (12.0, 30.0, F.col("o_clerk") if "o_clerk" in rows.columns else F.col("o_orderstatus")))
        )
    )
    box = [F.lit(float(x)).alias(n) for n, x in (("x0", 0), ("y0", 0), ("x1", 60), ("y1", 40))]
    blocks = rows.select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), F.col("o_orderkey").alias("block_no"), *box, spans.alias("spans"))
    return chunking.block_texts(blocks)


def section_chunks(spark, sf_dir):
    """Documents as three sections: a text, a table and a note; a third are raw, a third combined."""
    kind = F.element_at(F.array(F.lit("raw"), F.lit("combined"), F.lit("manual")), (F.col("doc_id") % 3 + 1).cast("int"))
    parts = F.array(
        F.struct(F.lit(0).alias("section"), F.concat(F.lit("# Head\n"), "text").alias("content"), F.lit(False).alias("is_table")),
        F.struct(F.lit(1).alias("section"), F.concat(F.lit("| a | b |\n|---|---|\n| 1 | "), "lang", F.lit(" |\n| 2 | |")).alias("content"), F.lit(True).alias("is_table")),
        F.struct(F.lit(2).alias("section"), F.lit("# Note\nshort note").alias("content"), F.lit(False).alias("is_table")),
    )
    sections = documents(spark, sf_dir).select("doc_id", kind.alias("kind"), F.col("source").alias("title"), F.inline(parts))
    return chunking.section_chunks(sections)


def ranked_orders(spark, sf_dir):
    """The orders of each customer as hits, the dearest first."""
    best = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return orders(spark, sf_dir).select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.row_number().over(best).alias("rank"))


def rerank_fallback(spark, sf_dir):
    return hybrid.rerank_fallback(ranked_orders(spark, sf_dir))


def api_rerank_mapping(spark, sf_dir):
    """Responses that name hits backwards, some below the threshold, without an index, or beyond the last hit."""
    hits = ranked_orders(spark, sf_dir)
    counts = hits.groupBy("query_id").agg(F.count("*").cast("int").alias("n"))
    results = F.transform(
        F.sequence(F.lit(0), F.col("n")),
        lambda i: F.struct(F.when((F.col("n") - i) % 5 != 3, F.col("n") - i).alias("index"), (F.lit(1.0) - (i % 3) * 0.25).alias("relevance_score")),
    )
    responses = counts.select("query_id", F.to_json(F.struct(results.alias("results"))).alias("json"))
    return hybrid.api_reranked(hits, responses)


def parser_switch(spark, sf_dir):
    rows = orders(spark, sf_dir)
    manifest = rows.select(
        F.concat(F.lit("d"), F.col("o_custkey") % 9, F.lit("\\o"), "o_orderkey", F.lit(".pdf")).alias("rel_path"),
        F.md5(F.col("o_orderkey").cast("string")).alias("hash"), F.when(F.col("o_orderkey") % 2 == 0, "docling").otherwise("manual").alias("parser_type"),
    )
    names = rows.where("o_orderkey % 3 = 0").select(F.concat(F.lit("o"), "o_orderkey", F.lit(".pdf")).alias("name"))
    return incremental.switched_parsers(manifest, names, "docling")


def cleanup_targets(spark, sf_dir):
    """Chunks whose names are in the decomposed form, names in the composed one."""
    docs = documents(spark, sf_dir)
    chunks = docs.select(F.concat(F.lit("s"), F.col("doc_id") % 40).alias("source_id"), F.concat(F.lit("café"), F.col("doc_id") % 40, F.lit(".md")).alias("src_name"))
    names = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("café"), F.col("doc_id") % 60, F.lit(".md")).alias("name"))
    ids = docs.where("doc_id % 17 = 0").select(F.concat(F.lit("x"), F.col("doc_id") % 34).alias("source_id"))
    return incremental.cleanup_targets(chunks, names, ids)


def source_chunk_count(spark, sf_dir):
    docs = documents(spark, sf_dir)
    chunks = docs.select("doc_id", F.concat(F.lit("café"), F.col("doc_id") % 4).alias("src_name"))
    return incremental.source_chunks(chunks, "café1").select("doc_id")


def valid_uploads(spark, sf_dir):
    rows = orders(spark, sf_dir)
    name = F.element_at(F.array(*map(F.lit, ("a/b/", "..\\", "", "c/.."))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    file = F.when(F.col("o_orderkey") % 4 != 3, F.concat(F.lit("f"), "o_orderkey", F.lit(".md"))).otherwise("")
    return incremental.valid_uploads(rows.select(F.concat(name, file).alias("name"), (F.col("o_custkey") % 3).alias("size")), "/store/")


def matrix_cell_accuracy(spark, sf_dir):
    """The status of every order in the grid of its customer, looked up by order and column."""
    rows = orders(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    placed = rows.select(F.col("o_custkey").alias("file"), place.alias("row"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    head = placed.select("file").distinct().select("file", F.lit(0).cast("long").alias("row"), F.inline(F.array(*(F.struct(F.lit(i).alias("col"), F.lit(n).alias("cell")) for i, n in enumerate(("order", "status", "priority"))))))
    columns = (F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderstatus")).otherwise("?"), F.col("o_orderpriority"))
    cells = head.unionByName(placed.select("file", "row", F.inline(F.array(*(F.struct(F.lit(i).alias("col"), c.alias("cell")) for i, c in enumerate(columns))))))
    truth = placed.select("file", F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("key"), F.lit("").alias("note"), F.lit("status").alias("column"), F.col("o_orderstatus").alias("value"))
    return evaluation.matrix_cells(truth, cells)


def answer_correctness(spark, sf_dir):
    rows = conversations(spark, sf_dir)
    answer = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("("), F.substring("text", 3, 12), F.lit(")"))).otherwise(F.concat("role", F.lit("?")))
    return rows.select("conv_id", "turn", "role", evaluation.answer_correct(answer, F.col("text")).alias("correct"))


def leg_reduction(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    timings = rows.select(F.when(F.col("user_id") % 2 == 0, "serial").otherwise("parallel").alias("mode"), (F.abs("value") / F.when(F.col("user_id") % 2 == 0, 1).otherwise(2)).alias("seconds"))
    return evaluation.leg_reduction(timings).select(*(F.round(c, 6).alias(c) for c in ("serial", "parallel", "reduction")))


QUERIES = {
    f.__name__: f
    for f in (
        markdown_cells, repaired_tables, block_texts, section_chunks, rerank_fallback, api_rerank_mapping, parser_switch,
        cleanup_targets, source_chunk_count, valid_uploads, matrix_cell_accuracy, answer_correctness, leg_reduction,
    )
}

RANKED = "hits AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"
NORM = r"'[\s()\-·‧,]', '', 'g'"

ORACLE = {
    "markdown_cells": """WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM conversations)
SELECT conv_id AS table_id, 0::BIGINT AS "row", unnest([0, 1])::INT AS col, unnest(['turn', 'role']) AS cell FROM (SELECT DISTINCT conv_id FROM t)
UNION ALL SELECT conv_id, n, unnest([0, 1])::INT, unnest([turn::VARCHAR, role]) FROM t""",
    "rerank_fallback": f"WITH {RANKED} SELECT query_id, doc_id, rank, 0.0::DOUBLE AS rerank_score, greatest(n - 5, 0) AS filtered, true AS skipped FROM hits WHERE rank <= 5",
    "api_rerank_mapping": f"""WITH {RANKED},
r AS (SELECT query_id, n, unnest(range(0, n + 1)) AS i FROM (SELECT DISTINCT query_id, n FROM hits)),
p AS (SELECT r.query_id, doc_id, 1.0::DOUBLE - (i % 3) * 0.25::DOUBLE AS rerank_score, r.n, row_number() OVER (PARTITION BY r.query_id ORDER BY i) AS place
  FROM r JOIN hits h ON h.query_id = r.query_id AND h.rank - 1 = r.n - i WHERE (r.n - i) % 5 <> 3 AND 1.0 - (i % 3) * 0.25 >= 0.6)
SELECT query_id, doc_id, rerank_score, place::INT AS place, n - count(*) OVER (PARTITION BY query_id) AS filtered FROM p WHERE place <= 5""",
    "parser_switch": r"""SELECT 'd' || (o_custkey % 9) || '\o' || o_orderkey || '.pdf' AS rel_path,
CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN '' ELSE md5(o_orderkey::VARCHAR) END AS hash,
CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 'docling' ELSE 'manual' END AS parser_type FROM orders""",
    "cleanup_targets": """SELECT DISTINCT 's' || (doc_id % 40) AS source_id FROM documents WHERE doc_id % 40 IN (SELECT doc_id % 60 FROM documents WHERE doc_id % 3 = 0)
UNION SELECT 'x' || (doc_id % 34) FROM documents WHERE doc_id % 17 = 0""",
    "source_chunk_count": "SELECT doc_id FROM documents WHERE doc_id % 4 = 1",
    "valid_uploads": "SELECT 'f' || o_orderkey || '.md' AS name, o_custkey % 3 AS size, '/store/f' || o_orderkey || '.md' AS path FROM orders WHERE o_custkey % 3 > 0 AND o_orderkey % 4 <> 3",
    "matrix_cell_accuracy": """SELECT o_custkey AS file, sum(CASE WHEN o_orderkey % 7 > 0 THEN 1 ELSE 0 END)::BIGINT AS hit, count(*) AS total FROM orders GROUP BY ROLLUP (o_custkey)""",
    "answer_correctness": rf"""SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN regexp_replace(substr(text, 3, 12), {NORM}) <> '' AND contains(regexp_replace(text, {NORM}), regexp_replace(substr(text, 3, 12), {NORM}))
  ELSE contains(regexp_replace(text, {NORM}), role || '?') END AS correct FROM conversations""",
    "leg_reduction": """WITH m AS (SELECT avg(CASE WHEN user_id % 2 = 0 THEN abs(value) END) AS s, avg(CASE WHEN user_id % 2 = 1 THEN abs(value) / 2 END) AS p FROM events WHERE value IS NOT NULL)
SELECT round(s, 6) AS serial, round(p, 6) AS parallel, round((1 - p / s) * 100, 6) AS reduction FROM m""",
}
