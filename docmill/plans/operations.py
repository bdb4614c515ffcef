"""Sync, evaluation, cost, trace and streaming queries over documents, orders, events and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docmill.operators import evaluation, incremental, lexical
from docmill.plans.lexical import documents, questions, scores_sql
from docmill.session import broadcast_if_small, shared_dir
from docmill.streaming import ingest

NOW = "timestamp '2024-01-28 00:00:00'"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_hash(spark, sf_dir):
    key = incremental.source_hash(F.concat("source", F.lit("/"), "doc_id"), F.col("text"), F.lit("manual"), F.lit("legal"))
    return documents(spark, sf_dir).select("doc_id", key.alias("source_id"), incremental.file_hash(F.col("text")).alias("file_md5"))


def old_files(spark, sf_dir):
    """The orders that are not open stand for an older snapshot of a folder, all orders for the current one."""
    rows = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("d"), F.col("o_custkey") % 50, F.lit("/o"), "o_orderkey")
    return rows.where("o_orderkey % 7 > 0").select(path.alias("rel_path"), F.md5(F.concat(F.when(F.col("o_orderkey") % 5 == 0, "old").otherwise(F.col("o_orderstatus")), "o_orderkey")).alias("hash"))


def new_files(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 11 > 0")
    path = F.concat(F.lit("d"), F.col("o_custkey") % 50, F.lit("/o"), "o_orderkey")
    return rows.select(path.alias("rel_path"), F.md5(F.concat("o_orderstatus", "o_orderkey")).alias("hash"))


def delta(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("d"), F.col("o_custkey") % 50, F.lit("/o"), "o_orderkey")
    stored = rows.select(path.alias("rel_path"), (F.col("o_orderkey") % 13 > 0).alias("has_json"), (F.col("o_orderkey") % 17).alias("chunks"))
    return incremental.manifest_delta(old_files(spark, sf_dir), new_files(spark, sf_dir), stored)


def manifest_delta(spark, sf_dir):
    return delta(spark, sf_dir)


def sync_plan(spark, sf_dir):
    return incremental.sync_plan(delta(spark, sf_dir))


def sync_plan_force(spark, sf_dir):
    return incremental.sync_plan(delta(spark, sf_dir), force=True)


def target_filter(spark, sf_dir):
    found = delta(spark, sf_dir)
    return incremental.target_filtered(found, found.where("rel_path like 'd7/%'").select("rel_path"))


def manifest_upgrade(spark, sf_dir):
    rows = documents(spark, sf_dir).groupBy("source").agg(F.max("doc_id").alias("m"))
    old = F.concat(F.lit('{"'), "source", F.lit('.pdf":"h'), "m", F.lit('"}'))
    new = F.concat(F.lit('{"version":"2.0","global_parser_type":"docling","files":{"'), "source", F.lit('.pdf":{"hash":"h'), "m", F.lit('","parser_type":"docling"}}}'))
    return incremental.upgraded_manifest(rows.select(F.when(F.col("m") % 2 == 0, old).otherwise(new).alias("json")))


def path_resolution(spark, sf_dir):
    names = new_files(spark, sf_dir).select(F.element_at(F.split("rel_path", "/"), -1).alias("name"))
    return incremental.resolved_paths(names, old_files(spark, sf_dir), new_files(spark, sf_dir))


def upsert_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), "o_orderstatus", "o_totalprice")
    fresh = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select((F.col("o_orderkey") * 2).alias("chunk_id"), F.lit("X").alias("o_orderstatus"), "o_totalprice")
    return incremental.upserted(rows, fresh)


def delete_cascade(spark, sf_dir):
    docs = documents(spark, sf_dir)
    store = docs.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("source_id"), F.concat("source", F.lit("\\f"), F.col("doc_id") % 20).alias("relative_path"))
    doomed = spark.createDataFrame([("source_id", "es"), ("path", "src3/f5"), ("name", "f7")], "kind string, value string")
    return incremental.cascaded(store, doomed)


def integrity_anomalies(spark, sf_dir):
    docs = documents(spark, sf_dir)
    local = docs.where("doc_id % 10 <> 3").select(F.concat(F.lit("f"), F.floor(F.col("doc_id") / 2)).alias("rel_path"), F.concat(F.lit("h"), F.floor(F.col("doc_id") / 2) % 9).alias("hash")).distinct()
    stored = docs.where("doc_id % 14 > 1").select(
        F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("f"), F.floor(F.col("doc_id") / 2))).alias("relative_path"),
        F.concat(F.lit("f"), F.floor(F.col("doc_id") / 2)).alias("src_name"),
        F.concat(F.lit("h"), F.floor(F.col("doc_id") / 2) % 8).alias("source_id"),
        F.when(F.col("doc_id") % 2 == 0, "manual").alias("parser_type"),
        F.when(F.col("doc_id") % 26 == 1, "docling").otherwise("manual").alias("parser"),
    )
    return incremental.integrity(local, stored)


def health_verdict(spark, sf_dir):
    found = integrity_anomalies(spark, sf_dir).groupBy("anomaly").agg(F.count("*").alias("n"))
    return found.select("anomaly", "n", (F.col("anomaly") != "ghost").alias("healthy"))


def cache_eviction(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("folder"), F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"))
    return incremental.evicted(files, 50, within=["folder"]).select("folder", "path")


def parser_routing(spark, sf_dir):
    kinds = F.get(F.array(*(F.lit(x) for x in ("pdf", "md", "HWP", "hwpx", "pdf"))), (F.col("doc_id") % 5).cast("int"))
    chosen = F.when(F.col("doc_id") % 2 == 0, "docling")
    return documents(spark, sf_dir).select("doc_id", incremental.parser_of(F.concat("source", F.lit("."), kinds), chosen).alias("parser"))


def metric_means(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("faithfulness"), F.when(F.col("user_id") % 3 == 0, F.col("value") / 2).alias("answer_relevancy"), F.lit(None).cast("double").alias("context_recall"))
    found = evaluation.metric_means(rows, ["faithfulness", "answer_relevancy", "context_recall"])
    return found.select("metric", F.round("mean", 6).alias("mean"), "n")


def resource_means(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("event_type").agg(F.round(F.avg("value"), 1).alias("mean_value"), F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 1).alias("mean_k"))


def quality_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("metric")).agg(
        F.avg(F.when(F.dayofmonth("ts") <= 15, F.col("value"))).alias("baseline"), F.avg(F.when(F.dayofmonth("ts") > 15, F.col("value"))).alias("current")
    )
    rows = rows.select(F.col("user_id").alias("run"), "metric", F.coalesce("baseline", F.lit(0.0)).alias("baseline"), F.coalesce("current", F.lit(0.0)).alias("current"))
    return evaluation.quality_gate(rows).select("run", "metric", F.round("drop_pct", 4).alias("drop_pct"), "passed", "run_passed")


def llm_cost(spark, sf_dir):
    names = ("claude-haiku-4-5-2025", "gpt-4o-mini", "llama3", "gemini-2.0-flash", "click")
    rows = table(spark, sf_dir, "events")
    model = F.get(F.array(*map(F.lit, names)), (F.col("event_id") % 5).cast("int"))
    used_in = evaluation.first_true(F.col("event_id") % 4, F.col("user_id"))
    return rows.groupBy("user_id").agg(F.round(F.sum(evaluation.cost(model, used_in, F.col("user_id") + 1)), 6).alias("dollars"), F.sum(used_in).alias("tokens_in"))


def stage_latency_bottleneck(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 2 == 0, "start").otherwise("end")
    return evaluation.stage_durations(rows.select(F.col("user_id").alias("session"), F.col("event_type").alias("stage"), status.alias("status"), "ts"))


def ttft(spark, sf_dir):
    stage = F.when(F.col("event_type") == "purchase", "generation").otherwise(F.col("event_type"))
    return evaluation.first_token_time(table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), stage.alias("stage"), "ts"))


def trace_retention(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("ts") >= F.expr(f"{NOW} - interval 7 days")).select("event_id", "user_id")


def session_ttl(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("value"))
    return evaluation.session_latest(rows, F.expr(NOW)).select("key", "value")


def true_documents(spark, sf_dir):
    """Documents that hold a whole benchmark passage are its truth; the pairs meet by the passage's rarest words."""
    docs = documents(spark, sf_dir)
    items = questions(spark, sf_dir)
    words = items.select("query_id", F.col("text").alias("passage"), F.explode(F.array_distinct(lexical.tokens(F.col("text")))).alias("term"))
    posts = lexical.LexicalIndex(lexical.postings(docs)).postings().select("doc_id", "term")
    rarity = posts.join(broadcast_if_small(words.select("term").distinct(), 64), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rare = words.join(rarity, "term").groupBy("query_id", "passage").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    near = rare.join(posts, "term").join(docs.select("doc_id", "text"), "doc_id")
    return near.where(F.contains("text", F.col("passage"))).select("query_id", "doc_id")


def retrieval_quality(spark, sf_dir):
    hits = lexical.top_hits(lexical.scores(documents(spark, sf_dir), questions(spark, sf_dir)), 10).select("query_id", "doc_id", "rank")
    return evaluation.hit_at_k(hits, true_documents(spark, sf_dir), 10)


def hit_at_k(spark, sf_dir):
    return retrieval_quality(spark, sf_dir).agg(F.count("*").alias("queries"), F.sum(F.col("hit").cast("long")).alias("hits"))


def mrr(spark, sf_dir):
    return retrieval_quality(spark, sf_dir).agg(F.round(F.avg("rr"), 5).alias("mrr"))


def golden_filter(spark, sf_dir):
    docs = documents(spark, sf_dir)
    letters = F.regexp_count("text", F.lit("[a-z]")) / F.length("text")
    return docs.where((F.length("text") > 150) & (letters > 0.3)).select("doc_id", F.round(letters, 6).alias("share"))


def golden_sample(spark, sf_dir):
    docs = golden_filter(spark, sf_dir).withColumn("place", F.md5(F.concat(F.lit("golden|"), "doc_id")))
    return docs.orderBy("place", "doc_id").limit(50).select("doc_id")


def golden_cell_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    lines = rows.select(F.col("conv_id").alias("file"), F.col("turn").alias("pos"), F.concat("role", F.lit("|"), "text").alias("row"))
    lookups = rows.select(F.col("conv_id").alias("file"), F.col("turn").alias("id"), F.array(F.concat(F.lit(" ("), "role", F.lit(")"))).alias("keys"), F.concat(F.lit("- "), "text").alias("value"))
    return evaluation.golden_cells(lookups, lines)


def cer_levenshtein(spark, sf_dir):
    rows = questions(spark, sf_dir)
    return rows.select("query_id", F.round(evaluation.error_rate(F.replace("text", F.lit("th"), F.lit("h")), F.col("text")), 6).alias("cer"))


def document_status(spark, sf_dir):
    return documents(spark, sf_dir).agg(F.countDistinct("source").alias("files"), F.count("*").alias("chunks"))


def pagination(spark, sf_dir):
    docs = documents(spark, sf_dir)
    page = F.floor((F.row_number().over(lexical.Window.partitionBy("source").orderBy("doc_id")) - 1) / 5) + 1
    return docs.select("source", "doc_id", page.cast("long").alias("page"))


def event_stream(spark, sf_dir):
    """All events as a stream; the pattern matches the one file or folder, as streams read no single file."""
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_windowed_counts(spark, sf_dir):
    events = event_stream(spark, sf_dir)
    found = ingest.drained(ingest.windowed_counts(events), f"{shared_dir(spark)}/docmill/streams/{uuid.uuid4().hex}")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_sessions(spark, sf_dir):
    events = event_stream(spark, sf_dir)
    found = ingest.drained(ingest.sessions(events), f"{shared_dir(spark)}/docmill/streams/{uuid.uuid4().hex}")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "finish")})


QUERIES = {
    f.__name__: f
    for f in (
        source_hash, manifest_delta, sync_plan, sync_plan_force, target_filter, manifest_upgrade, path_resolution, upsert_chunks,
        delete_cascade, integrity_anomalies, health_verdict, cache_eviction, parser_routing, metric_means, resource_means, quality_gate,
        llm_cost, stage_latency_bottleneck, ttft, trace_retention, session_ttl, hit_at_k, mrr, golden_filter, golden_sample,
        golden_cell_accuracy, cer_levenshtein, document_status, pagination, stream_windowed_counts, stream_sessions,
    )
}

FILES = """paths AS (SELECT *, 'd' || (o_custkey % 50) || '/o' || o_orderkey AS rel_path FROM orders),
old AS (SELECT rel_path, md5(CASE WHEN o_orderkey % 5 = 0 THEN 'old' ELSE o_orderstatus END || o_orderkey) AS hash FROM paths WHERE o_orderkey % 7 > 0),
cur AS (SELECT rel_path, md5(o_orderstatus || o_orderkey) AS hash FROM paths WHERE o_orderkey % 11 > 0),
sto AS (SELECT rel_path, o_orderkey % 13 > 0 AS has_json, o_orderkey % 17 AS chunks FROM paths),
delta AS (SELECT rel_path, c.hash, o.hash AS old_hash,
  c.hash IS NOT NULL AND (c.hash IS DISTINCT FROM o.hash OR NOT coalesce(has_json, false) OR coalesce(chunks, 0) = 0) AS process,
  o.hash IS NOT NULL AND c.hash IS DISTINCT FROM o.hash AS "delete"
  FROM cur c FULL JOIN old o USING (rel_path) LEFT JOIN sto USING (rel_path))"""

STATUS = """local AS (SELECT DISTINCT 'f' || (doc_id // 2) AS rel_path, 'h' || ((doc_id // 2) % 9) AS hash FROM documents WHERE doc_id % 10 <> 3),
chunks AS (SELECT 'f' || (doc_id // 2) AS rel_path, 'h' || ((doc_id // 2) % 8) AS sid,
  CASE WHEN doc_id % 2 = 0 THEN 'manual' WHEN doc_id % 26 = 1 THEN 'docling' ELSE 'manual' END AS parser FROM documents WHERE doc_id % 14 > 1),
seen AS (SELECT rel_path, list(DISTINCT sid) AS ids, count(DISTINCT parser) AS parsers, count(*) AS chunks FROM chunks GROUP BY 1),
found AS (SELECT rel_path, CASE WHEN hash IS NULL THEN 'ghost' WHEN ids IS NULL THEN 'missing' WHEN parsers > 1 THEN 'duplicate_parser'
  WHEN NOT list_contains(ids, hash) THEN 'mismatch' ELSE 'ok' END AS anomaly, coalesce(chunks, 0) AS chunks FROM local FULL JOIN seen USING (rel_path))"""

TRUTH = f"""{scores_sql()},
truth AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
best AS (SELECT t.query_id, min(r.rank) AS best FROM truth t LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r USING (query_id, doc_id) GROUP BY 1)"""

ORACLE = {
    "source_hash": "SELECT doc_id, substr(md5(concat_ws('_', source || '/' || doc_id, sha256(text), 'manual', 'legal')), 1, 12) AS source_id, md5(text) AS file_md5 FROM documents",
    "manifest_delta": f"WITH {FILES} SELECT * FROM delta",
    "sync_plan": f"""WITH {FILES} SELECT rel_path, CASE WHEN process AND "delete" THEN 'replace' WHEN process THEN 'process' WHEN "delete" THEN 'delete' ELSE 'keep' END AS action FROM delta""",
    "sync_plan_force": f"""WITH {FILES} SELECT rel_path, CASE WHEN hash IS NOT NULL AND old_hash IS NOT NULL THEN 'replace' WHEN hash IS NOT NULL THEN 'process' ELSE 'delete' END AS action FROM delta""",
    "target_filter": f"""WITH {FILES} SELECT rel_path, CASE WHEN rel_path LIKE 'd7/%' THEN hash ELSE old_hash END AS hash, rel_path LIKE 'd7/%' AND process AS process, rel_path LIKE 'd7/%' AND "delete" AS "delete" FROM delta""",
    "manifest_upgrade": """SELECT source || '.pdf' AS rel_path, 'h' || max(doc_id) AS hash, CASE WHEN max(doc_id) % 2 = 0 THEN 'manual' ELSE 'docling' END AS parser_type FROM documents GROUP BY source""",
    "path_resolution": f"""WITH {FILES}, keyed AS (SELECT rel_path, 0 AS tier, split_part(rel_path, '/', -1) AS name FROM old UNION ALL SELECT rel_path, 1, split_part(rel_path, '/', -1) FROM cur)
SELECT name, rel_path FROM (SELECT name, rel_path, row_number() OVER (PARTITION BY name ORDER BY tier, rel_path) AS r FROM keyed
WHERE name IN (SELECT split_part(rel_path, '/', -1) FROM cur)) WHERE r = 1""",
    "upsert_chunks": """WITH fresh AS (SELECT o_orderkey * 2 AS chunk_id, 'X' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_orderkey AS chunk_id, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT chunk_id FROM fresh) UNION ALL SELECT * FROM fresh""",
    "delete_cascade": r"""SELECT doc_id AS chunk_id, lang AS source_id, source || '\f' || (doc_id % 20) AS relative_path FROM documents
WHERE lang <> 'es' AND NOT (source = 'src3' AND doc_id % 20 = 5) AND doc_id % 20 <> 7""",
    "integrity_anomalies": f"WITH {STATUS} SELECT * FROM found",
    "health_verdict": f"WITH {STATUS} SELECT anomaly, count(*) AS n, anomaly <> 'ghost' AS healthy FROM found GROUP BY 1",
    "cache_eviction": "SELECT folder, path FROM (SELECT o_custkey % 40 AS folder, o_orderkey AS path, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r > 50",
    "parser_routing": "SELECT doc_id, CASE WHEN doc_id % 5 IN (2, 3) THEN 'hwp' WHEN doc_id % 5 = 1 THEN 'markdown' WHEN doc_id % 2 = 0 THEN 'docling' ELSE 'manual' END AS parser FROM documents",
    "metric_means": """SELECT 'faithfulness' AS metric, round(avg(value), 6) AS mean, count(value) AS n FROM events WHERE user_id % 5 <> 0
UNION ALL SELECT 'answer_relevancy', round(avg(value / 2), 6), count(value) FROM events WHERE user_id % 3 = 0""",
    "resource_means": "SELECT event_type, round(avg(value), 1) AS mean_value, round(avg(json_extract_string(props, '$.k')::DOUBLE), 1) AS mean_k FROM events GROUP BY 1",
    "quality_gate": """WITH m AS (SELECT user_id AS run, event_type AS metric, coalesce(avg(value) FILTER (dayofmonth(ts) <= 15), 0) AS b, coalesce(avg(value) FILTER (dayofmonth(ts) > 15), 0) AS c FROM events GROUP BY 1, 2),
d AS (SELECT *, CASE WHEN b > 0 THEN (c - b) / b * 100 ELSE 0 END AS drop_pct FROM m)
SELECT run, metric, round(drop_pct, 4) AS drop_pct, drop_pct >= -5 AS passed, bool_and(drop_pct >= -5) OVER (PARTITION BY run) AS run_passed FROM d""",
    "llm_cost": """WITH e AS (SELECT user_id, event_id % 5 AS m, coalesce(nullif(event_id % 4, 0), nullif(user_id, 0), 0) AS i, user_id + 1 AS o FROM events)
SELECT user_id, round(sum(CASE m WHEN 0 THEN i * 1.0::DOUBLE / 1e6 + o * 5.0::DOUBLE / 1e6 WHEN 1 THEN i * 2.5::DOUBLE / 1e6 + o * 10.0::DOUBLE / 1e6 WHEN 3 THEN i * 0.1::DOUBLE / 1e6 + o * 0.4::DOUBLE / 1e6 ELSE 0 END), 6) AS dollars,
sum(i)::BIGINT AS tokens_in FROM e GROUP BY 1""",
    "stage_latency_bottleneck": """WITH e AS (SELECT user_id AS session, event_type AS stage, event_id % 2 = 0 AS st, epoch_us(ts) / 1e6 AS t FROM events),
s AS (SELECT session, stage, min(t) FILTER (st) AS a, max(t) FILTER (NOT st) AS b FROM e GROUP BY 1, 2),
d AS (SELECT session, stage, round(b - a, 3) AS seconds FROM s WHERE a IS NOT NULL AND b >= a)
SELECT session, stage, seconds, CASE WHEN sum(seconds) OVER w > 5 THEN first_value(stage) OVER (PARTITION BY session ORDER BY seconds DESC, stage DESC) END AS bottleneck FROM d WINDOW w AS (PARTITION BY session)""",
    "ttft": """SELECT session, round(b - a, 3) AS ttft FROM (SELECT user_id AS session, min(epoch_us(ts) / 1e6) AS a, min(epoch_us(ts) / 1e6) FILTER (event_type = 'purchase') AS b FROM events GROUP BY 1) WHERE b IS NOT NULL""",
    "trace_retention": f"SELECT event_id, user_id FROM events WHERE ts >= {NOW} - INTERVAL 7 DAY",
    "session_ttl": f"SELECT user_id AS key, arg_max(event_id, (ts, event_id)) AS value FROM events WHERE ts > {NOW} - INTERVAL 24 HOUR GROUP BY 1",
    "hit_at_k": f"WITH {TRUTH} SELECT count(*) AS queries, sum((best IS NOT NULL)::INT)::BIGINT AS hits FROM best",
    "mrr": f"WITH {TRUTH} SELECT round(avg(round(coalesce(1.0::DOUBLE / best, 0), 6)), 5) AS mrr FROM best",
    "golden_filter": "SELECT doc_id, round(len(regexp_extract_all(text, '[a-z]'))::DOUBLE / length(text), 6) AS share FROM documents WHERE length(text) > 150 AND len(regexp_extract_all(text, '[a-z]'))::DOUBLE / length(text) > 0.3",
    "golden_sample": "SELECT doc_id FROM documents WHERE length(text) > 150 AND len(regexp_extract_all(text, '[a-z]'))::DOUBLE / length(text) > 0.3 ORDER BY md5('golden|' || doc_id), doc_id LIMIT 50",
    "golden_cell_accuracy": r"""WITH l AS (SELECT conv_id AS file, turn AS id, role, regexp_replace(text, '[\s()\-·‧,]', '', 'g') AS value FROM conversations),
t AS (SELECT conv_id AS file, turn, regexp_replace(role || '|' || text, '[\s()\-·‧,]', '', 'g') AS r FROM conversations),
m AS (SELECT l.file, l.id, l.value, t.r, row_number() OVER (PARTITION BY l.file, l.id ORDER BY t.turn) AS n FROM l JOIN t ON t.file = l.file AND contains(t.r, l.role)),
s AS (SELECT l.file, coalesce(l.value <> '' AND contains(m.r, l.value), false)::INT AS hit FROM l LEFT JOIN m ON l.file = m.file AND l.id = m.id AND m.n = 1)
SELECT file, sum(hit)::BIGINT AS hit, count(*) AS total FROM s GROUP BY ROLLUP (file)""",
    "cer_levenshtein": "SELECT item_id AS query_id, round(levenshtein(replace(text, 'th', 'h'), text)::DOUBLE / greatest(length(text), 1), 6) AS cer FROM benchmark",
    "document_status": "SELECT count(DISTINCT source) AS files, count(*) AS chunks FROM documents",
    "pagination": "SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 + 1 AS page FROM documents",
    "stream_windowed_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 24 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 24 HOUR AS finish, count(*) AS n FROM s GROUP BY user_id, k""",
}
