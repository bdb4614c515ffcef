"""From ranked hits to a prompt: history, token budget, rendered context, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions.text import sanitised, token_estimate
from docmill.settings import DEFAULTS, Settings

UNKNOWN_FILE = "알 수 없는 파일"
REFUSAL = "제공된 문서에서 관련 정보를 찾을 수 없습니다."


def history_tail(chat: DataFrame, messages: int = DEFAULTS.history_messages) -> DataFrame:
    """The last messages of each conversation (conv_id, turn)."""
    last = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return chat.withColumn("back", F.row_number().over(last)).where(F.col("back") <= messages).drop("back")


def trimmed(hits: DataFrame, budget: int, ratio: float = DEFAULTS.chars_per_token) -> DataFrame:
    """query_id and doc_ids of the hits (score, text) that fit in budget tokens.

    By falling score, each that still fits is taken and each that doesn't is
    passed over; a fold over a query's own hits, of which there are few.
    """
    cost = token_estimate(F.col("text"), ratio)
    row = F.struct((-F.col("score")).alias("order"), F.col("doc_id").alias("doc_id"), cost.alias("cost"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<bigint>").alias("taken"))

    def step(state: Column, hit: Column) -> Column:
        fits = state["used"] + hit["cost"] <= budget
        return F.struct(
            F.when(fits, state["used"] + hit["cost"]).otherwise(state["used"]).alias("used"),
            F.when(fits, F.concat(state["taken"], F.array(hit["doc_id"]))).otherwise(state["taken"]).alias("taken"),
        )

    grouped = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("hits"))
    folded = grouped.select("query_id", F.aggregate("hits", start, step).alias("f"))
    return folded.select("query_id", F.col("f.used").alias("used"), F.col("f.taken").alias("taken"))


def context_budget(settings: Settings = DEFAULTS) -> int:
    return int(settings.context_tokens * settings.context_share)


def rendered(hits: DataFrame) -> DataFrame:
    """query_id and context: its hits (rank, text, source, page) as numbered documents, unsafe marks escaped."""
    order = Window.partitionBy("query_id").orderBy("rank")
    entry = F.concat(
        F.lit('<document index="'), F.col("i").cast("string"), F.lit('">\n내용: '), sanitised(F.col("text")),
        F.lit("\n출처: ["), F.coalesce("source", F.lit(UNKNOWN_FILE)), F.lit(", p."), F.coalesce(F.col("page").cast("string"), F.lit("-")), F.lit("]\n</document>"),
    )
    numbered = hits.withColumn("i", F.row_number().over(order)).select("query_id", "i", entry.alias("entry"))
    listed = F.array_sort(F.collect_list(F.struct("i", "entry")))
    return numbered.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda e: e["entry"]), "\n\n").alias("context"))


def citations(hits: DataFrame) -> DataFrame:
    """query_id and citations: each distinct source and page of its hits once, in order of first rank."""
    place = F.when(F.col("page").isNotNull() & (F.col("page") != 0), F.concat(F.lit("p."), F.col("page"))).otherwise("-")
    named = hits.select("query_id", "rank", F.concat(F.coalesce("source", F.lit(UNKNOWN_FILE)), F.lit(" ("), place, F.lit(")")).alias("line"))
    first = named.groupBy("query_id", "line").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("query_id").orderBy("rank", "line")
    lines = first.withColumn("i", F.row_number().over(order)).select("query_id", "i", F.concat(F.lit("- **["), F.col("i"), F.lit("]** "), "line").alias("line"))
    listed = F.array_sort(F.collect_list(F.struct("i", "line")))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda e: e["line"]), "\n").alias("citations"))


def guarded(queries: DataFrame, contexts: DataFrame, refusal: str = REFUSAL) -> DataFrame:
    """Every query with its context, or the refusal if nothing was found for it."""
    joined = queries.join(contexts, "query_id", "left")
    return joined.select("query_id", F.coalesce("context", F.lit("")).alias("context"), F.when(F.col("context").isNull(), refusal).alias("refusal"))


def prompts(system: str, contexts: DataFrame, chat: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id and prompt: system text, context, the conversation's tail (users' words escaped) and the question."""
    said = F.when(F.col("role") == "user", sanitised(F.col("text"))).otherwise(F.col("text"))
    tail = history_tail(chat).select(F.col("conv_id").alias("query_id"), "turn", F.concat("role", F.lit(": "), said).alias("line"))
    listed = F.array_sort(F.collect_list(F.struct("turn", "line")))
    history = tail.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda e: e["line"]), "\n").alias("history"))
    rows = questions.join(contexts, "query_id", "left").join(history, "query_id", "left")
    parts = F.concat_ws("\n\n", F.lit(system), "context", "history", sanitised(F.col("text")))
    return rows.select("query_id", parts.alias("prompt"))
