"""Writers: partitioned stores, append-only traces, table backups."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tarfile
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parents(parents: DataFrame, path: str) -> None:
    """Parents by source; only the sources that are written are replaced."""
    rows = parents.withColumn("source_id", F.coalesce("source_id", F.lit("unknown")))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(path)


def append_traces(traces: DataFrame, path: str) -> None:
    """Traces as JSON by day."""
    traces.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").json(path)


def write_evaluation(summary: DataFrame, details: DataFrame, path: str) -> None:
    """A summary as JSON and its details as CSV."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    details.write.mode("overwrite").option("header", True).csv(f"{path}/details")


def save_manifest(manifest: dict, path: str) -> None:
    """A manifest, whole or not at all."""
    draft = f"{path}.tmp"
    Path(draft).write_text(json.dumps(manifest, ensure_ascii=False, indent=1), encoding="utf-8")
    os.replace(draft, path)


def digest(path: str) -> str:
    found = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            found.update(block)
    return found.hexdigest()


def backup(table_dir: str, backup_dir: str, keep: int = 5) -> str:
    """An archive of a table's folder with its digest beside it, without locks; older archives beyond keep go."""
    os.makedirs(backup_dir, exist_ok=True)
    path = f"{backup_dir}/backup_{time.strftime('%Y%m%d_%H%M%S')}_{time.time_ns() % 10**9:09d}.tar.gz"
    with tarfile.open(path, "w:gz") as archive:
        archive.add(table_dir, "table", filter=lambda m: None if m.name.endswith((".lock", "-wal", "-shm")) else m)
    Path(f"{path}.sha256").write_text(digest(path))
    for old in sorted(Path(backup_dir).glob("backup_*.tar.gz"))[:-keep]:
        old.unlink()
        Path(f"{old}.sha256").unlink(missing_ok=True)
    return path


def verify(path: str) -> bool:
    """Whether an archive matches the digest beside it."""
    beside = Path(f"{path}.sha256")
    return beside.exists() and beside.read_text().strip() == digest(path)


def restore(path: str, table_dir: str) -> None:
    """The archive's table in place of the folder; the old one comes back if anything fails."""
    if not verify(path):
        raise ValueError(f"{path} doesn't match its digest")
    aside = f"{table_dir}.before-restore"
    if os.path.exists(table_dir):
        os.replace(table_dir, aside)
    try:
        with tarfile.open(path) as archive:
            archive.extractall(f"{table_dir}.restored", filter="data")
        os.replace(f"{table_dir}.restored/table", table_dir)
    except Exception:
        shutil.rmtree(table_dir, ignore_errors=True)
        if os.path.exists(aside):
            os.replace(aside, table_dir)
        raise
    finally:
        shutil.rmtree(f"{table_dir}.restored", ignore_errors=True)
    shutil.rmtree(aside, ignore_errors=True)


def diagnosis(table: DataFrame, key: str) -> DataFrame:
    """rows, missing keys, repeated keys and ok of a stored table, as one row."""
    counts = table.groupBy(key).agg(F.count("*").alias("n"))
    found = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated")
    )
    return found.withColumn("ok", (F.col("rows") > 0) & (F.col("missing") == 0) & (F.col("repeated") == 0))
