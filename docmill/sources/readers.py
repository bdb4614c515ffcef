"""Readers: raw files, markdown, processed JSON, golden sets, lookups."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File types that are read, in order.
SUFFIXES = (".pdf", ".md", ".markdown", ".hwp", ".hwpx")
HIDDEN = r"(^|/)(\._[^/]*|\.DS_Store)$"

#: Keys that may hold a chunk's text, the first that does counts.
CONTENT = ("text", "content", "parent_text")


def scan_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, name, suffix, modificationTime, length and content of the files below root, without hidden ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = files.withColumn("suffix", suffix).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return rows.where(suffix.isin(*suffixes) & ~F.col("path").rlike(HIDDEN))


def category(path: Column, default: str = "일반") -> Column:
    """A file's parent folder."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(default)


def read_markdown(spark: SparkSession, path: str, least: int = 5) -> DataFrame:
    """path and text of whole markdown files with at least so many characters."""
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return texts.where(F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) >= least)


def flatten_chunks(items: DataFrame) -> DataFrame:
    """content, chunk_id and metadata of nested chunk JSON (json: one object a row), children of any depth included.

    Depth is unbounded, so a text is walked in Python, with a stack; what isn't an object is left out.
    """

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(0).to_pylist():
                waiting = [_parsed(text)]
                while waiting:
                    chunk = waiting.pop()
                    if not isinstance(chunk, dict):
                        continue
                    content = next((chunk[k] for k in CONTENT if isinstance(chunk.get(k), str) and chunk[k]), None)
                    if content is not None:
                        notes = chunk.get("metadata") if isinstance(chunk.get("metadata"), dict) else {}
                        out.append((content, chunk.get("chunk_id"), [(str(k), _shown(v)) for k, v in notes.items()]))
                    waiting += reversed(chunk.get("children") or [])
            columns = list(zip(*out)) or [(), (), ()]
            kinds = (pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["content", "chunk_id", "metadata"])

    return items.select("json").mapInArrow(run, "content string, chunk_id string, metadata map<string, string>")


def _parsed(text: str | None) -> object:
    try:
        return json.loads(text or "null")
    except (ValueError, RecursionError):
        return None


def _shown(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """Flattened chunks of processed JSON files (lists of parents), manifests and unreadable files left out."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(F.col("_metadata.file_name").alias("name"), "value")
    items = files.where("name <> 'manifest.json'").select(F.explode(F.from_json("value", "array<string>")).alias("json"))
    return flatten_chunks(items)


def read_golden(spark: SparkSession, path: str, most: int = 50) -> DataFrame:
    """The first rows of a golden set."""
    return spark.read.schema("question string, ground_truth string, context string, source string, source_id string").json(path, multiLine=True).orderBy(F.monotonically_increasing_id()).limit(most)


def lookup_file(path: str, default):
    """A small JSON lookup from the driver's disk, default if it isn't there or can't be read."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return default
