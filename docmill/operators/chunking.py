"""Chunking, page and table-grid operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions import layout, splitting
from docmill.functions.text import clean_text
from docmill.settings import DEFAULTS, Settings

PARENTS = (
    "source_id string, parent_id string, parent_no bigint, parent_text string, header_path string, sec_title string, pg_num int, "
    "children array<struct<chunk_id: string, text: string, pg_num: int, is_table: boolean>>"
)


def hierarchical_chunks(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Parents with their children of markdown texts (source_id, text)."""
    child = pa.struct([("chunk_id", pa.string()), ("text", pa.string()), ("pg_num", pa.int32()), ("is_table", pa.bool_())])
    names = ["source_id", "parent_id", "parent_no", "parent_text", "header_path", "sec_title", "pg_num", "children"]

    def run(batches):
        for batch in batches:
            rows = [
                (s, p.parent_id, i, p.text, p.header_path, p.sec_title, p.page,
                 [{"chunk_id": f"{p.parent_id}_c{c.number}", "text": c.text, "pg_num": c.page, "is_table": c.is_table} for c in p.children])
                for s, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for i, p in enumerate(splitting.hierarchy(text or "", s or "", settings))
            ]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(child)]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(F.col("source_id").cast("string"), "text").mapInArrow(run, PARENTS)


def recursive_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk_no and chunk of texts (doc_id, text)."""

    def run(batches):
        for batch in batches:
            rows = [
                (i, n, c)
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for n, c in enumerate(splitting.split_text(text or "", size, overlap))
            ]
            columns = list(zip(*rows)) if rows else [[], [], []]
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "chunk_no", "chunk"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, chunk_no bigint, chunk string")


def flattened(parents: DataFrame) -> DataFrame:
    """One row a child of parents."""
    return parents.select("source_id", "parent_id", "sec_title", "header_path", F.inline("children"))


def sections(docs: DataFrame, default: str = splitting.DEFAULT_SECTION, least: int = 5) -> DataFrame:
    """doc_id, section, chapter, article and content of markdown texts (doc_id, text).

    A chapter line resets the article if text has gathered since the last
    header; the text under a header is its non-blank lines, joined.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"[\t\r]+", " ")))
    level = F.when(F.col("line").rlike("^# "), 1).when(F.col("line").rlike("^#{2,3} "), 2)
    name = F.trim(F.regexp_replace("line", "^#+ ", ""))
    order = Window.partitionBy("doc_id").orderBy("pos")
    lines = lines.where("line <> ''").withColumn("level", level).withColumn("section", F.count("level").over(order))
    heads = lines.groupBy("doc_id", "section").agg(
        F.max("level").alias("level"),
        F.max(F.when(F.col("level").isNotNull(), name)).alias("name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), " ").alias("content"),
    )
    by = Window.partitionBy("doc_id").orderBy("section")
    flushed = F.length(F.lag("content").over(by)) > 0
    heads = heads.withColumn("chapter", F.last(F.when(F.col("level") == 1, F.col("name")), True).over(by))
    reset = (F.col("level") == 1) & F.coalesce(flushed, F.lit(False))
    article = F.when(F.col("level") == 2, F.col("name")).when(reset, F.lit(default))
    heads = heads.withColumn("article", F.last(article, True).over(by))
    found = heads.select(
        "doc_id", "section", F.coalesce("chapter", F.lit(default)).alias("chapter"), F.coalesce("article", F.lit(default)).alias("article"), clean_text(F.col("content"), "general").alias("content")
    )
    return found.where(F.length("content") >= least)


def net_page_breaks(parts: DataFrame, overlap: int) -> DataFrame:
    """doc_id, part_no and the page breaks of each part (doc_id, part_no, text) that its overlap doesn't repeat."""
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("part_no"))

    def breaks(text: Column) -> Column:
        return F.size(F.split(text, splitting.PAGE_BREAK)) - 1

    repeated = F.coalesce(breaks(F.right(before, F.lit(overlap))), F.lit(0))
    return parts.select("doc_id", "part_no", F.greatest(F.lit(0), breaks(F.col("text")) - repeated).alias("breaks"))


def table_row_chunks(tables: DataFrame) -> DataFrame:
    """table_id, row_no and chunk: each data row of markdown tables (table_id, title, markdown) with title, header and rule."""
    lines = tables.select("table_id", "title", F.filter(F.split("markdown", "\n"), lambda x: F.trim(x) != "").alias("lines")).where(F.size("lines") >= 3)
    head = F.concat_ws("\n", "title", F.get("lines", F.lit(0)), F.get("lines", F.lit(1)))
    rows = lines.select("table_id", head.alias("head"), F.posexplode(F.slice("lines", F.lit(3), F.size("lines"))).alias("row_no", "row"))
    data = rows.where(~F.regexp_replace("row", r"[\s|:\-]", "").eqNullSafe(""))
    return data.select("table_id", F.col("row_no").cast("long").alias("row_no"), F.concat_ws("\n", "head", "row").alias("chunk"))


def without_repeated_lines(pages: DataFrame, share: float = DEFAULTS.repeated_line_share, edge: int = DEFAULTS.edge_lines) -> DataFrame:
    """pages (doc_id, page, text) without lines that stand at the edge of at least a share of the document's pages.

    Edges are the first and last lines with text; one-letter lines never count; a single page stays.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    edges = F.array_distinct(F.concat(F.slice("own", F.lit(1), F.lit(edge)), F.reverse(F.slice(F.reverse("own"), F.lit(1), F.lit(edge)))))
    shown = pages.withColumn("own", lines).select("doc_id", F.explode(edges).alias("line")).where(F.length("line") > 1)
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    noise = shown.groupBy("doc_id", "line").agg(F.count("*").alias("n")).join(counts, "doc_id")
    noise = noise.where((F.col("pages") > 1) & (F.col("n") / F.col("pages") >= share)).groupBy("doc_id").agg(F.collect_set("line").alias("noise"))
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.coalesce("noise", F.array().cast("array<string>")), F.trim(x)))
    return pages.join(noise, "doc_id", "left").select("doc_id", "page", F.array_join(kept, "\n").alias("text"))


def filled_rowspans(cells: DataFrame) -> DataFrame:
    """cells (table_id, row, col, cell) with null as the value above it, empty at the top."""
    above = Window.partitionBy("table_id", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("cell", F.coalesce(F.last("cell", True).over(above), F.lit("")))


def without_empty_columns(cells: DataFrame) -> DataFrame:
    """cells without the columns that are blank in every row; a table blank all over stays."""
    blank = F.trim(F.coalesce("cell", F.lit(""))) == ""
    marked = cells.withColumn("used", F.bool_or(~blank).over(Window.partitionBy("table_id", "col")))
    marked = marked.withColumn("any", F.bool_or("used").over(Window.partitionBy("table_id")))
    return marked.where("used or not any").drop("used", "any")


def grid_markdown(cells: DataFrame) -> DataFrame:
    """table_id and markdown of cells, with a rule after the first row."""
    listed = F.array_sort(F.collect_list(F.struct("col", clean_text(F.coalesce("cell", F.lit("")), "general").alias("cell"))))
    rows = cells.groupBy("table_id", "row").agg(listed.alias("cells"))
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: c["cell"]), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("cells")))
    first = F.min("row").over(Window.partitionBy("table_id"))
    rows = rows.withColumn("line", F.when(F.col("row") == first, F.concat(line, F.lit("\n"), rule)).otherwise(line))
    ordered = F.array_sort(F.collect_list(F.struct("row", "line")))
    return rows.groupBy("table_id").agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("markdown"))


def markdown_cells(tables: DataFrame) -> DataFrame:
    """table_id, row, col and cell of markdown tables (table_id, markdown): lines that open with a pipe, without rules."""
    lines = F.filter(F.split("markdown", r"\r?\n"), lambda x: F.startswith(x, F.lit("|")) & ~F.contains(x, F.lit("---")))
    rows = tables.select("table_id", F.posexplode(lines).alias("row", "line"))
    cells = F.transform(F.split(F.btrim("line", F.lit("|")), r"\|"), lambda c: F.trim(c))
    return rows.select("table_id", F.col("row").cast("long").alias("row"), F.posexplode(cells).alias("col", "cell"))


def block_texts(blocks: DataFrame) -> DataFrame:
    """doc_id, page, block_no, text and size (the largest) of glyph spans (doc_id, page, block_no, x0, y0, x1, y1, spans).

    spans: size, x, y and text of each; a block goes by its own box.
    """

    def run(batches):
        for batch in batches:
            names = ("x0", "y0", "x1", "y1")
            boxes = zip(*(batch.column(n).to_pylist() for n in names))
            found = [
                layout.block_text({"bbox": box, "lines": [{"spans": [{"size": s["size"], "origin": (s["x"], s["y"]), "text": s["text"]} for s in spans or []]}]})
                for box, spans in zip(boxes, batch.column("spans").to_pylist())
            ]
            kept = [batch.column(n) for n in ("doc_id", "page", "block_no")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([t for t, _ in found], pa.string()), pa.array([z for _, z in found], pa.float64())], names=["doc_id", "page", "block_no", "text", "size"])

    kinds = ", ".join(f"{n} {blocks.schema[n].dataType.simpleString()}" for n in ("doc_id", "page", "block_no"))
    return blocks.mapInArrow(run, f"{kinds}, text string, size double")


def section_chunks(sections: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """doc_id, section, chunk_no, chunk and is_table of sections (doc_id, section, content, kind, is_table, title).

    The first section's kind decides for its document: raw documents are their
    first section alone, combined ones all of them, each split by headers; any
    other document's tables give a chunk a row and its texts are split as they
    are.
    """
    first = sections.groupBy("doc_id").agg(F.min_by("kind", "section").alias("how"), F.min("section").alias("first"))
    rows = sections.join(first, "doc_id")
    headed = F.coalesce(F.col("how").isin("raw", "combined"), F.lit(False))
    whole = rows.where(headed & ((F.col("how") == "combined") | (F.col("section") == F.col("first"))))
    plain = rows.where(~headed)

    def split(texts: DataFrame, parts) -> DataFrame:
        def run(batches):
            for batch in batches:
                out = [
                    (d, s, n, c.text, c.is_table)
                    for d, s, text in zip(*(batch.column(i).to_pylist() for i in range(3)))
                    for n, c in enumerate(parts(text or ""))
                ]
                columns = list(zip(*out)) or [()] * 5
                kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "section", "chunk_no", "chunk", "is_table"])

        kind = texts.schema["doc_id"].dataType.simpleString()
        return texts.select("doc_id", F.col("section").cast("long"), "content").mapInArrow(run, f"doc_id {kind}, section bigint, chunk_no bigint, chunk string, is_table boolean")

    by_header = split(whole, lambda text: [c for p in splitting.hierarchy(text, "", settings) for c in p.children])
    by_size = split(plain.where(~F.col("is_table")), lambda text: splitting.children(text, 1, settings))
    named = plain.where("is_table").select(F.struct("doc_id", F.col("section").cast("long").alias("section")).alias("table_id"), "title", F.col("content").alias("markdown"))
    table_rows = table_row_chunks(named).select("table_id.doc_id", "table_id.section", F.col("row_no").alias("chunk_no"), "chunk", F.lit(True).alias("is_table"))
    return by_header.unionByName(by_size).unionByName(table_rows)


def boxes_overlap(a: list[Column], b: list[Column]) -> Column:
    """Whether two boxes (x0, y0, x1, y1) share area."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def in_cells(points: DataFrame, cells: DataFrame, tile: float = 64.0) -> DataFrame:
    """point_id and cell_id of every point (page, x, y) in a closed cell (page, x0, y0, x1, y1).

    Cells are dealt to the tiles they touch, so points meet cells of their own tile by equality.
    """

    def tiles(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(low) / tile), F.floor(F.col(high) / tile))

    spread = cells.withColumn("tx", F.explode(tiles("x0", "x1"))).withColumn("ty", F.explode(tiles("y0", "y1")))
    placed = points.withColumn("tx", F.floor(F.col("x") / tile)).withColumn("ty", F.floor(F.col("y") / tile))
    met = placed.join(spread, ["page", "tx", "ty"])
    return met.where("x between x0 and x1 and y between y0 and y1").select("point_id", "cell_id")


def overlapping_boxes(blocks: DataFrame, tables: DataFrame, tile: float = 64.0) -> DataFrame:
    """block_id and table_id of boxes on the same page that share area; both sides are dealt to tiles."""

    def spread(df: DataFrame) -> DataFrame:
        for axis in ("x", "y"):
            df = df.withColumn(f"t{axis}", F.explode(F.sequence(F.floor(F.col(f"{axis}0") / tile), F.floor(F.col(f"{axis}1") / tile))))
        return df

    a, b = spread(blocks).alias("a"), spread(tables).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("page", "tx", "ty")]
    share = boxes_overlap(*([F.col(f"{s}.{c}") for c in ("x0", "y0", "x1", "y1")] for s in "ab"))
    return a.join(b, [*same, share]).select("a.block_id", "b.table_id").distinct()


def base_font_size(spans: DataFrame) -> DataFrame:
    """doc_id and its most common span size over ten pages, first seen on ties; 11.0 without spans is the caller's default."""
    sizes = spans.where("page <= 10").groupBy("doc_id", F.round("size", 1).alias("size")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("base_size"))
