"""Structured Streaming: file ingest into a store, stage latencies, session state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from docmill.operators import chunking
from docmill.operators.incremental import source_hash

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """New files below root as a stream."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def ingest(files: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Chunks of streamed markdown files in a store partitioned by source; ids are deterministic, so a replayed batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        text = F.decode("content", "UTF-8")
        named = batch.withColumn("source_id", source_hash(F.col("path"), F.col("content"), F.lit("markdown"), F.lit("general")))
        chunks = chunking.flattened(chunking.hierarchical_chunks(named.select("source_id", text.alias("text"))))
        chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(store)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window start, event_type, n and total of events (ts, event_type, value) by tumbling window."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def sessions(events: DataFrame, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """user_id, start, finish and n of sessions that end after a gap."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("finish"), "n")


def drained(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """All that a stream gives for what is there now, written below path and read back."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def kept_alive(tokens, interval: float = 20.0, empty: str = ""):
    """tokens of a generator, with an empty one whenever none comes for an interval; its errors come through."""
    import queue
    import threading

    waiting: queue.Queue = queue.Queue()
    end = object()

    def produce() -> None:
        try:
            for token in tokens:
                waiting.put((token, None))
            waiting.put((end, None))
        except BaseException as error:  # handed to the consumer
            waiting.put((end, error))

    threading.Thread(target=produce, daemon=True).start()
    while True:
        try:
            token, error = waiting.get(timeout=interval)
        except queue.Empty:
            yield empty
            continue
        if error is not None:
            raise error
        if token is end:
            return
        yield token


def answered(batch_of: Callable[[DataFrame], DataFrame], questions: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Answers to streamed questions, one micro-batch at a time, appended to a sink."""
    return (
        questions.writeStream.foreachBatch(lambda batch, _: batch_of(batch).write.mode("append").parquet(sink))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
