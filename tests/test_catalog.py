"""Predicates, retriever choice, settings and job state."""

from __future__ import annotations

import pytest

from docmill.operators import catalog


def test_where_clause():
    assert catalog.where_clause({}) is None and catalog.where_clause({"a": 1}) == {"a": 1}
    assert catalog.where_clause({"a": 1, "b": 2}) == {"$and": [{"a": {"$eq": 1}}, {"b": {"$eq": 2}}]}


def test_predicate(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert df.where(catalog.predicate(catalog.where_clause({"a": 1, "b": "x"}))).count() == 1
    assert df.where(catalog.predicate({"b": None})).count() == 1 and df.where(catalog.predicate(None)).count() == 2
    with pytest.raises(ValueError):
        catalog.predicate({"a": {"$gt": 1}})


def test_choices():
    engines = {"vector": len, "bm25": max, "hybrid": min}
    assert [catalog.retriever(k, engines) for k in ("bm25", "ensemble", "other")] == [max, min, len]
    assert catalog.needs_reset({"child_size": 400}, {"child_size": 500}) and not catalog.needs_reset({}, {"child_size": 500})


def test_job_state():
    job = catalog.JobState()
    job.step(1, 3, "parsing")
    assert job.percent == 33
    job.cancel()
    with pytest.raises(InterruptedError):
        job.step(2, 3)


def test_reranker_choice():
    engines = {"local": len, "cohere": max}
    assert [catalog.reranker(k, engines, leave) for k, leave in (("cohere", False), ("Cohere", True), ("jina", True), ("local", False))] == [len, max, len, len]


def test_breaker():
    now, calls = [0.0], []

    def engine(x):
        calls.append(x)
        if x < 0:
            raise RuntimeError("out of memory")
        return "fast"

    guarded = catalog.Breaker(engine, lambda x: "slow", 300.0, lambda: now[0])
    assert [guarded(1), guarded(-1), guarded(2)] == ["fast", "slow", "slow"] and calls == [1, -1]
    now[0] = 301.0
    assert guarded(3) == "fast" and guarded(4) == "fast" and guarded.failed_at is None


def test_json_files(tmp_path):
    files = catalog.JsonFiles(most=2)
    for n in range(3):
        (tmp_path / f"{n}.json").write_text(f"[{n}]")
        assert files.read(str(tmp_path / f"{n}.json")) == [n]
    assert list(files.kept) == [str(tmp_path / f"{n}.json") for n in (1, 2)]
    (tmp_path / "2.json").write_text("[22, 2]")
    assert files.read(str(tmp_path / "2.json")) == [22, 2]
    files.forget()
    assert not files.kept


def test_sections(spark):
    texts = spark.createDataFrame([("a.hwp", "long enough"), ("b.HWPX", " abc "), ("c.pdf", "long enough"), ("d.hwp", None)], "path string, text string")
    assert [r["path"] for r in catalog.hwp_guarded(texts).collect()] == ["a.hwp"]
    text = spark.createDataFrame([(1, "s1", "body")], "doc_id int, source_id string, content string")
    tables = spark.createDataFrame([(1, "old", "| a |", True), (2, "x", "| b |", True)], "doc_id int, source_id string, content string, is_table boolean")
    rows = {(r["source_id"], r["content"], r["is_table"]) for r in catalog.hybrid_sections(text, tables).collect()}
    assert rows == {("s1", "body", False), ("s1", "| a |", True)}
