"""Readers, writers and streams on small files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docmill.operators import incremental, lexical, vector
from docmill.sources import readers, writers
from docmill.streaming import ingest


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nbody text")
    (tmp_path / "b.md").write_text(" x ")
    (tmp_path / "._c.md").write_text("hidden file")
    assert [r["name"] for r in readers.scan_files(spark, str(tmp_path)).orderBy("name").collect()] == ["a.md", "b.md"]
    assert readers.read_markdown(spark, str(tmp_path / "[ab].md")).count() == 1


def test_processed_json(spark, tmp_path):
    parent = {"parent_text": "P", "metadata": {"k": "v"}, "children": [{"text": "C", "chunk_id": "c1", "extra": 1}]}
    (tmp_path / "x.json").write_text(json.dumps([parent]))
    (tmp_path / "manifest.json").write_text("{}")
    (tmp_path / "bad.json").write_text("{")
    rows = readers.read_processed(spark, str(tmp_path)).orderBy("content").collect()
    assert [(r["content"], r["chunk_id"]) for r in rows] == [("C", "c1"), ("P", None)]


def test_chunks_of_any_depth(spark):
    nested = None
    for n in reversed(range(60)):
        nested = {"content": f"c{n}", "chunk_id": str(n), "metadata": {"n": n, "s": "x"}, "children": [nested, {"text": ""}, 7] if nested else []}
    rows = readers.flatten_chunks(spark.createDataFrame([(json.dumps(nested),), ("{",), (None,), ("[1]",)], "json string")).collect()
    assert [r["content"] for r in rows] == [f"c{n}" for n in range(60)] and rows[3]["metadata"] == {"n": "3", "s": "x"}


def test_index_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple red"), (2, "green apple"), (3, ""), (4, None), (5, "blue sky apple")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red apple"), (2, "nothing here")], "query_id long, text string")

    def found(index):
        return {(r["query_id"], r["doc_id"]): round(r["bm25"], 6) for r in index.scores(asked).collect()}

    index = lexical.save_index(docs, str(tmp_path / "a"))
    direct = {(r["query_id"], r["doc_id"]): round(r["bm25"], 6) for r in lexical.scores(docs, asked).collect()}
    assert found(lexical.load_index(spark, str(tmp_path / "a"))) == direct and index.stats().first()["n"] == 3
    fresh = spark.createDataFrame([(2, "red pear"), (6, "apple")], "doc_id long, text string")
    updated = lexical.updated_index(index, spark.createDataFrame([(5,)], "doc_id long"), fresh, str(tmp_path / "b"))
    now = docs.where("doc_id not in (2, 5)").unionByName(fresh)
    assert found(updated) == {(r["query_id"], r["doc_id"]): round(r["bm25"], 6) for r in lexical.scores(now, asked).collect()}
    assert lexical.scores(docs.limit(0), asked).count() == 0


def test_sync_stores(spark, tmp_path):
    store = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, n int")
    fresh = spark.createDataFrame([("b", 3), ("c", 4), ("c", 5), (None, 6)], "chunk_id string, n int")
    rows = incremental.upserted(store, fresh).collect()
    assert sorted(r["chunk_id"] or "" for r in rows) == ["", "a", "b", "c"] and {r["n"] for r in rows} >= {1, 3, 6}
    assert incremental.reset_collection(str(tmp_path / "t"), store).count() == 0
    files = spark.createDataFrame([(f"f{i}", i % 4) for i in range(9)], "path string, mtime int")
    assert {r["path"] for r in incremental.evicted(files, 3).collect()} == {f"f{i}" for i in (0, 1, 4, 5, 6, 8)}
    order = []
    steps = {n: (lambda n=n: order.append(n)) for n in ("index", "flush", "upsert", "cleanup")}
    assert incremental.apply_changes(steps) == order == ["flush", "cleanup", "upsert", "index"]


def test_neighbours_by_blocks(spark):
    rows = [(i, [float((i * 7 + k * 3) % 11 - 5) for k in range(6)]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", vector.unit(F.col("embedding")).alias("embedding"))
    queries = corpus.select(F.col("vec_id").alias("query_id"), "embedding")
    one, many = ({tuple(r) for r in vector.neighbours(corpus, queries, 5, size).collect()} for size in (1 << 20, 600))
    assert one == many and len(one) == 300
    cache = queries.select(F.col("query_id").alias("vec_id"), "embedding").limit(3)
    assert vector.cache_added(cache, cache.limit(1)).count() == 3 and vector.cache_flushed(cache).count() == 0


def test_evaluation_files_and_traces(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-02 03:04:05", "a")], "timestamp string, k string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    for _ in range(2):
        writers.append_traces(df, str(tmp_path / "traces"))
    assert spark.read.json(str(tmp_path / "traces")).where("date = '2026-01-02'").count() == 2
    writers.write_evaluation(df.select("k"), df.select("k"), str(tmp_path / "eval"))
    assert spark.read.json(str(tmp_path / "eval/summary")).first()["k"] == "a"
    assert spark.read.option("header", True).csv(str(tmp_path / "eval/details")).first()["k"] == "a"


def test_lookup_default(tmp_path):
    assert readers.lookup_file(str(tmp_path / "none.json"), {}) == {}


def test_backups(spark, tmp_path):
    table, kept = tmp_path / "t", tmp_path / "b"
    spark.range(3).withColumnRenamed("id", "chunk_id").write.parquet(str(table))
    paths = [writers.backup(str(table), str(kept), keep=2) for _ in range(3)]
    assert len(list(kept.glob("*.tar.gz"))) == 2 and writers.verify(paths[-1])
    spark.range(1).withColumnRenamed("id", "chunk_id").write.mode("overwrite").parquet(str(table))
    writers.restore(paths[-1], str(table))
    spark.catalog.refreshByPath(str(table))
    row = writers.diagnosis(spark.read.parquet(str(table)), "chunk_id").first()
    assert (row["rows"], row["ok"]) == (3, True)


def test_manifest_is_whole(tmp_path):
    writers.save_manifest({"version": "2.0"}, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"version": "2.0"} and not (tmp_path / "m.json.tmp").exists()


def test_parents_by_source(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), (None, "2")], "source_id string, parent_id string")
    writers.write_parents(df, str(tmp_path / "p"))
    writers.write_parents(df.where("source_id = 'a'").withColumn("parent_id", F.lit("9")), str(tmp_path / "p"))
    assert {(r["source_id"], r["parent_id"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("a", "9"), ("unknown", "2")}


def test_stream_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\n" + "some body text. " * 40)
    for _ in range(2):
        ingest.ingest(ingest.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    first = spark.read.parquet(str(tmp_path / "store")).count()
    (tmp_path / "in" / "b.md").write_text("# U\n" + "other body text. " * 40)
    ingest.ingest(ingest.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    assert 0 < first < spark.read.parquet(str(tmp_path / "store")).count()


def test_keep_alive():
    import time

    def slow():
        yield "a"
        time.sleep(0.3)
        yield "b"

    out = list(ingest.kept_alive(slow(), interval=0.1))
    assert [x for x in out if x] == ["a", "b"] and "" in out
