"""Incremental sync: content hashes, manifests, deltas, deletes, upserts, integrity."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions.text import nfc, nfc_path

MANIFEST = "struct<version: string, global_parser_type: string, files: map<string, struct<hash: string, parser_type: string>>>"
OLD_MANIFEST = "map<string, string>"


def source_hash(path: Column, content: Column, parser: Column, doc_type: Column) -> Column:
    """The id of a source: twelve digits over its path, content, parser and document type."""
    return F.substring(F.md5(F.concat_ws("_", path, F.sha2(content, 256), parser, doc_type)), 1, 12)


def file_hash(content: Column) -> Column:
    return F.md5(content)


def upgraded_manifest(manifests: DataFrame, default_parser: str = "manual") -> DataFrame:
    """rel_path, hash and parser_type of manifests (json) of either version; what can't be read gives no row."""
    rows = manifests.select(
        F.from_json("json", MANIFEST).alias("new"), F.from_json("json", OLD_MANIFEST).alias("old"), F.get_json_object("json", "$.version").alias("version")
    )
    new = rows.where("version is not null").select(F.explode(F.map_entries("new.files")).alias("e"))
    old = rows.where("version is null").select(F.explode(F.map_entries("old")).alias("e"))
    return new.select(F.col("e.key").alias("rel_path"), F.col("e.value.hash").alias("hash"), F.col("e.value.parser_type").alias("parser_type")).unionByName(
        old.select(F.col("e.key").alias("rel_path"), F.col("e.value").alias("hash"), F.lit(default_parser).alias("parser_type"))
    )


def manifest_delta(old: DataFrame, current: DataFrame, stored: DataFrame) -> DataFrame:
    """rel_path, hash, old_hash, process and delete: what a sync has to do.

    old and current: rel_path, hash; stored: rel_path, has_json, chunks. A file
    is processed if it is new, has changed, or lacks its JSON or its chunks; an
    old hash is deleted if its file is gone or has changed.
    """
    both = current.select("rel_path", "hash").join(old.select("rel_path", F.col("hash").alias("old_hash")), "rel_path", "full")
    state = both.join(stored, "rel_path", "left")
    present, changed = F.col("hash").isNotNull(), ~F.col("hash").eqNullSafe(F.col("old_hash"))
    lacking = ~F.coalesce("has_json", F.lit(False)) | (F.coalesce("chunks", F.lit(0)) == 0)
    return state.select(
        "rel_path", "hash", "old_hash", (present & (changed | lacking)).alias("process"), (F.col("old_hash").isNotNull() & changed).alias("delete")
    )


def sync_plan(delta: DataFrame, force: bool = False) -> DataFrame:
    """rel_path and action (process, delete, both or keep); force processes every current file and deletes every old one."""
    process = F.col("hash").isNotNull() if force else F.col("process")
    delete = F.col("old_hash").isNotNull() if force else F.col("delete")
    action = F.when(process & delete, "replace").when(process, "process").when(delete, "delete").otherwise("keep")
    return delta.select("rel_path", action.alias("action"))


def target_filtered(delta: DataFrame, targets: DataFrame) -> DataFrame:
    """The delta for target files alone; other files keep their old manifest entry and nothing of theirs is deleted."""
    wanted = delta.join(targets.select("rel_path", F.lit(True).alias("wanted")).distinct(), "rel_path", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    return wanted.select(
        "rel_path",
        F.when(F.col("wanted"), F.col("hash")).otherwise(F.col("old_hash")).alias("hash"),
        (F.col("wanted") & F.col("process")).alias("process"),
        (F.col("wanted") & F.col("delete")).alias("delete"),
    )


def resolved_paths(names: DataFrame, manifest: DataFrame, scanned: DataFrame) -> DataFrame:
    """name and rel_path: names by path or base name, in the manifest first, then in the scan."""

    def keyed(df: DataFrame, order: int) -> DataFrame:
        base = F.element_at(F.split("rel_path", "/"), -1)
        return df.select("rel_path", F.lit(order).alias("tier"), F.explode(F.array_distinct(F.array("rel_path", base))).alias("name"))

    found = names.join(keyed(manifest, 0).unionByName(keyed(scanned, 1)), "name")
    best = Window.partitionBy("name").orderBy("tier", "rel_path")
    return found.withColumn("r", F.row_number().over(best)).where("r = 1").select("name", "rel_path")


def upserted(store: DataFrame, fresh: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The store with fresh rows in place of those of the same key; of fresh rows that share a key, the one of least hash."""
    one = Window.partitionBy(key).orderBy(F.xxhash64(*(F.to_json(F.struct(c)) for c in fresh.columns)))
    single = fresh.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").drop("_nth")
    return store.join(single.select(key), key, "left_anti").unionByName(single)


def cascaded(store: DataFrame, doomed: DataFrame) -> DataFrame:
    """The store without rows whose source id, path (either slash) or file name is doomed (kind, value)."""
    path = F.replace("relative_path", F.lit("\\"), F.lit("/"))
    keys = F.array(
        F.struct(F.lit("source_id").alias("kind"), F.col("source_id").alias("value")),
        F.struct(F.lit("path").alias("kind"), path.alias("value")),
        F.struct(F.lit("name").alias("kind"), F.element_at(F.split(path, "/"), -1).alias("value")),
    )
    doomed = doomed.select("kind", F.when(F.col("kind") == "path", F.replace("value", F.lit("\\"), F.lit("/"))).otherwise(F.col("value")).alias("value"))
    hit = store.select("chunk_id", F.inline(keys)).join(doomed, ["kind", "value"], "left_semi").select("chunk_id").distinct()
    return store.join(hit, "chunk_id", "left_anti")


def without_null_metadata(entries: Column) -> Column:
    """A map without null values; an empty one says so."""
    kept = F.map_filter(entries, lambda k, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(F.create_map(F.lit("_is_empty"), F.lit("true")))


def integrity(local: DataFrame, stored: DataFrame) -> DataFrame:
    """rel_path and anomaly: ghost (stored alone), missing (local alone), mismatch (hash not stored) or duplicate parsers.

    local: rel_path, hash; stored: relative_path, src_name, source_id, parser_type, parser, one row a chunk.
    """
    path = F.coalesce("relative_path", "src_name", F.lit("UNKNOWN"))
    seen = stored.groupBy(path.alias("rel_path")).agg(
        F.collect_set("source_id").alias("ids"), F.collect_set(F.coalesce("parser_type", "parser")).alias("parsers"), F.count("*").alias("chunks")
    )
    both = local.select("rel_path", "hash").join(seen, "rel_path", "full")
    anomaly = (
        F.when(F.col("hash").isNull(), "ghost").when(F.col("ids").isNull(), "missing")
        .when(F.size("parsers") > 1, "duplicate_parser").when(~F.array_contains("ids", F.col("hash")), "mismatch").otherwise("ok")
    )
    return both.select("rel_path", anomaly.alias("anomaly"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def evicted(files: DataFrame, keep: int, place: str = "mtime", name: str = "path", within: list[str] | None = None) -> DataFrame:
    """The files beyond the keep newest, by group if within names one; the newest of all are a top-k, so no task gets all files."""
    newest = [F.col(place).desc(), F.col(name)]
    if not within:
        return files.join(F.broadcast(files.orderBy(*newest).limit(keep).select(name)), name, "left_anti").select(*files.columns)
    return files.withColumn("r", F.row_number().over(Window.partitionBy(*within).orderBy(*newest))).where(F.col("r") > keep).drop("r")


def cleanup_targets(chunks: DataFrame, names: DataFrame, ids: DataFrame) -> DataFrame:
    """source_id to delete: those of chunks (source_id, src_name) whose file name is in names (name) in either normal form, and ids."""
    wanted = names.select(nfc(F.col("name")).alias("name")).distinct()
    found = chunks.withColumn("name", nfc(F.col("src_name"))).join(wanted, "name", "left_semi")
    return found.select("source_id").union(ids.select("source_id")).where("source_id is not null").distinct()


def source_chunks(chunks: DataFrame, name: str) -> DataFrame:
    """The chunks of a source by name, in whichever normal form either is."""
    return chunks.where(nfc(F.col("src_name")) == unicodedata.normalize("NFC", name))


def reset_collection(path: str, table: DataFrame) -> DataFrame:
    """The stored table at path emptied; its columns stay."""
    table.limit(0).write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def switched_parsers(manifest: DataFrame, names: DataFrame, parser: str) -> DataFrame:
    """The manifest (rel_path, hash, parser_type) with the parser of the named files (name: path or base name) changed.

    A changed file has an empty hash, so the next sync takes it as changed; one that has that parser already stays.
    """
    path = nfc_path(F.col("rel_path"))
    keyed = manifest.withColumn("_keys", F.array(path, F.element_at(F.split(path, "/"), -1)))
    wanted = names.select(nfc_path(F.col("name")).alias("_key")).distinct()
    hit = keyed.select("rel_path", F.explode("_keys").alias("_key")).join(wanted, "_key", "left_semi").select("rel_path").distinct().withColumn("_hit", F.lit(True))
    changed = F.coalesce("_hit", F.lit(False)) & ~F.col("parser_type").eqNullSafe(F.lit(parser))
    rows = manifest.join(hit, "rel_path", "left")
    return rows.select("rel_path", F.when(changed, "").otherwise(F.col("hash")).alias("hash"), F.when(changed, parser).otherwise(F.col("parser_type")).alias("parser_type"))


def apply_changes(steps: dict[str, Callable[[], object]]) -> list[str]:
    """Runs a sync's steps in their order: cache flush, cleanup, parse and upsert, index; an error leaves the later ones out."""
    done = []
    for name in ("flush", "cleanup", "upsert", "index"):
        if name in steps:
            steps[name]()
            done.append(name)
    return done


def valid_uploads(files: DataFrame, root: str) -> DataFrame:
    """name, size and path below root of uploads (name, size) that may be stored: a base name without any folder, and some bytes."""
    base = F.element_at(F.split(F.replace("name", F.lit("\\"), F.lit("/")), "/"), -1)
    rows = files.withColumn("base", base).where((F.col("size") > 0) & (F.col("base") != "") & ~F.col("base").isin(".", ".."))
    return rows.select(F.col("base").alias("name"), "size", F.concat(F.lit(root.rstrip("/") + "/"), "base").alias("path"))


def parser_of(path: Column, chosen: Column, docling: bool = True) -> Column:
    """The parser of a file: by suffix, PDFs as the manifest has it, manual where that isn't there."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    return (
        F.when(suffix.isin("hwp", "hwpx"), "hwp").when(suffix != "pdf", "markdown")
        .when(F.coalesce(chosen, F.lit("manual")) == "docling", "docling" if docling else "manual").otherwise("manual")
    )
