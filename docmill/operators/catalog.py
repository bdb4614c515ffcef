"""Predicates, section building, lookups, retriever choice and job state around the core operators."""

from __future__ import annotations

import json
import os
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions.splitting import DEFAULT_SECTION
from docmill.functions.text import clean_text

#: File types without pages.
PAGELESS = ("md", "markdown", "hwp", "hwpx")
#: Fixed value: an article heading once its blanks are gone.
ARTICLE = r"^제(\d+조|조\d+)"


def predicate(where: dict | None) -> Column:
    """A filter like {"a": 1}, {"a": {"$in": [..]}} or {"$and": [..]} as a column; nothing keeps all rows."""
    out = F.lit(True)
    for key, value in (where or {}).items():
        if key == "$and":
            for part in value:
                out = out & predicate(part)
        elif isinstance(value, dict):
            for op, operand in value.items():
                if op not in ("$eq", "$in"):
                    raise ValueError(f"unknown operator {op}")
                out = out & (F.col(key).eqNullSafe(F.lit(operand)) if op == "$eq" else F.col(key).isin(list(operand)))
        else:
            out = out & F.col(key).eqNullSafe(F.lit(value))
    return out


def where_clause(wanted: dict) -> dict | None:
    """The filter of plain equalities: none, one, or an $and of $eq."""
    if len(wanted) < 2:
        return dict(wanted) or None
    return {"$and": [{k: {"$eq": v}} for k, v in wanted.items()]}


def source_location(suffix: Column, title: Column, page: Column) -> Column:
    """Where a chunk stands: its section for files without pages, else its page."""
    titled = F.when(title.isNotNull() & (title != DEFAULT_SECTION), title)
    paged = F.when(page.isNotNull(), F.concat(F.lit("p."), page.cast("string")))
    return F.when(suffix.isin(*PAGELESS), F.coalesce(titled, F.lit("-"))).otherwise(F.coalesce(paged, F.lit("-")))


def block_sections(blocks: DataFrame, bases: DataFrame, least: int = 5) -> DataFrame:
    """doc_id, section, chapter, article and content of page blocks (doc_id, page, block_no, text, size, in_table).

    A block that is larger than the base size opens a chapter, a smaller one is
    dropped, an article heading opens an article; all else is content. bases:
    doc_id, base_size.
    """
    rows = blocks.where(~F.col("in_table")).join(bases, "doc_id", "left").withColumn("base", F.coalesce("base_size", F.lit(11.0)))
    text = clean_text(F.col("text"), "general")
    bare = F.regexp_replace("text", r"(?U)\s+", "")
    kind = F.when(F.col("size") >= F.col("base") + 1.5, 1).when(F.col("size") < F.col("base") - 0.5, -1).when(bare.rlike(ARTICLE), 2).otherwise(0)
    order = Window.partitionBy("doc_id").orderBy("page", "block_no")
    rows = rows.withColumn("kind", kind).where("kind >= 0").withColumn("text", text)
    rows = rows.withColumn("section", F.count(F.when(F.col("kind") > 0, 1)).over(order))
    rows = rows.withColumn("chapter", F.coalesce(F.last(F.when(F.col("kind") == 1, F.col("text")), True).over(order), F.lit(DEFAULT_SECTION)))
    named = F.when(F.col("kind") == 2, F.col("text")).when(F.col("kind") == 1, F.lit(DEFAULT_SECTION))
    rows = rows.withColumn("article", F.coalesce(F.last(named, True).over(order), F.lit(DEFAULT_SECTION)))
    parts = F.array_sort(F.collect_list(F.when(F.col("kind") != 1, F.struct("page", "block_no", "text"))))
    found = rows.groupBy("doc_id", "section", "chapter", "article").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("content"))
    return found.where(F.length("content") >= least)


def page_context(blocks: DataFrame, skip: int = 1, take: int = 5) -> DataFrame:
    """doc_id, page and context: a page's lines of text outside tables, after the first skip, take of them."""
    noise = F.col("in_table") | F.contains("text", F.lit("|")) | F.col("text").rlike(r"^\s*-?\s*\d+\s*-?\s*$") | F.col("text").rlike("^<[^>]*(개정|신설|삭제)[^>]*>$")
    order = Window.partitionBy("doc_id", "page").orderBy("block_no")
    lines = blocks.where(~noise & (F.trim("text") != "")).withColumn("n", F.row_number().over(order))
    lines = lines.where((F.col("n") > skip) & (F.col("n") <= skip + take))
    listed = F.array_sort(F.collect_list(F.struct("n", F.trim("text").alias("text"))))
    return lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("context"))


def table_sections(tables: DataFrame, contexts: DataFrame) -> DataFrame:
    """doc_id, page, table_no (from 0 on each page) and content: each table that isn't blank, after its page's context."""
    order = Window.partitionBy("doc_id", "page").orderBy("table_index")
    shown = tables.withColumn("table_no", F.row_number().over(order) - 1).where(F.trim(F.coalesce("markdown", F.lit(""))) != "")
    joined = shown.join(contexts, ["doc_id", "page"], "left")
    return joined.select("doc_id", "page", "table_no", F.concat_ws("\n\n", F.nullif("context", F.lit("")), "markdown").alias("content"), F.lit(True).alias("is_table"))


def golden_lookups(rows: DataFrame) -> DataFrame:
    """id, keys and value of golden rows (id, keys, value, cell_score, by_year): one for the value, one for each year's."""
    scored = rows.where(F.coalesce("cell_score", F.lit(True)))
    plain = scored.where(F.col("value").isNotNull()).select("id", "keys", "value")
    yearly = scored.select("id", "keys", F.explode("by_year").alias("year", "value"))
    return plain.unionByName(yearly.select("id", F.concat("keys", F.array("year")).alias("keys"), "value"))


def indexed_paths(chunks: DataFrame) -> DataFrame:
    """The first path of each source, distinct."""
    first = chunks.groupBy("source_id").agg(F.min_by("relative_path", "place").alias("relative_path"))
    return first.select("relative_path").where("relative_path is not null").distinct()


def needs_reset(stored: dict, current: dict, keys: tuple[str, ...] = ("embedding_model", "child_size", "parent_size")) -> bool:
    """Whether a store was made with other settings."""
    return any(k in stored and stored[k] != current.get(k) for k in keys)


def retriever(kind: str, engines: dict[str, Callable]) -> Callable:
    """The engine of a kind: vector, bm25, hybrid or ensemble; unknown kinds get vector."""
    return engines.get({"ensemble": "hybrid"}.get(kind, kind), engines["vector"])


@dataclass
class JobState:
    """Progress of a sync job that other threads may read or cancel."""

    total: int = 0
    done: int = 0
    message: str = ""
    cancelled: bool = False
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    @property
    def percent(self) -> int:
        return int(self.done / self.total * 100) if self.total else 0

    def step(self, done: int, total: int, message: str = "") -> None:
        with self._lock:
            if self.cancelled:
                raise InterruptedError("the job was cancelled")
            self.done, self.total, self.message = done, total, message

    def cancel(self) -> None:
        with self._lock:
            self.cancelled = True


def reranker(kind: str, engines: dict[str, Callable], allow_external: bool = False) -> Callable:
    """The reranker of a kind; services outside (any kind but local) need leave, and without it or for unknown kinds the local one serves."""
    wanted = kind.lower()
    return engines[wanted] if wanted in engines and (wanted == "local" or allow_external) else engines["local"]


@dataclass
class Breaker:
    """Keeps away from an engine that failed, using another one until retry seconds have gone by."""

    engine: Callable
    other: Callable
    retry: float = 300.0
    clock: Callable[[], float] = time.monotonic
    failed_at: float | None = None
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def __call__(self, *args: object, **named: object) -> object:
        with self._lock:
            resting = self.failed_at is not None and self.clock() - self.failed_at < self.retry
        if not resting:
            try:
                found = self.engine(*args, **named)
            except Exception:  # whatever the engine raises, the other one answers
                with self._lock:
                    self.failed_at = self.clock()
            else:
                with self._lock:
                    self.failed_at = None
                return found
        return self.other(*args, **named)


class JsonFiles:
    """Parsed JSON files, the least recently used leave beyond most; a changed file is read anew."""

    def __init__(self, most: int = 128):
        self.most = most
        self.kept: OrderedDict[str, tuple[tuple, object]] = OrderedDict()

    def read(self, path: str) -> object:
        state = os.stat(path)
        stamp = state.st_mtime_ns, state.st_size
        if path not in self.kept or self.kept[path][0] != stamp:
            with open(path, encoding="utf-8") as file:
                self.kept[path] = stamp, json.load(file)
        self.kept.move_to_end(path)
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return self.kept[path][1]

    def forget(self, path: str | None = None) -> None:
        """One file, or all."""
        if path is None:
            self.kept.clear()
        else:
            self.kept.pop(path, None)


def hwp_guarded(texts: DataFrame, least: int = 5) -> DataFrame:
    """Parsed HWP files (path, text) that may become sections: of a HWP suffix, and with some text."""
    return texts.where(F.lower("path").rlike(r"\.hwpx?$") & (F.length(F.trim(F.coalesce("text", F.lit("")))) >= least))


def hybrid_sections(text: DataFrame, tables: DataFrame) -> DataFrame:
    """Sections of a file's text with those of its tables, the tables under the text's source id."""
    ids = text.groupBy("doc_id").agg(F.first("source_id").alias("source_id"))
    shared = tables.drop("source_id").join(ids, "doc_id")
    return text.withColumn("is_table", F.lit(False)).unionByName(shared, allowMissingColumns=True)
