"""Weighted fair queueing of documents to target source weights, in DataFrame operations only.

Every source gets a target by water filling. Its documents, in hash order,
queue for up to three rounds; a document's virtual finish time is the source's
words up to its end over the source's target. One global order by finish time,
cut at the total budget, is the mix. Running totals over all documents come
from range partitions and one offset a partition, so no source and no order
meets in one task.

Defined cases: a null or empty text has size 0 and takes 0; null is a source of
its own, the last; repeated rows each take their share; equal finish times go
by source, round and hash; an empty table gives an empty result; other columns
are ignored by weighted_fair_mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.session import Scratch, broadcast_if_small

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Times a document may be taken.
ROUNDS = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def running_total(rows: DataFrame, order: list[Column], value: str, scratch: Scratch, name: str) -> DataFrame:
    """rows with `before`, the sum of value over all rows earlier in the order, and the row's `part` and `place` in it.

    rows should come from a table, as its keys are sampled for the ranges.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    dealt = scratch.table(dealt, name)
    offsets = dealt.groupBy("part").agg(F.sum(value).alias("own"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = offsets.select("part", F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part").orderBy(*order)
    inside = within.rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(broadcast_if_small(offsets, 16), "part")
        .withColumn("before", F.col("ahead") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .withColumn("place", F.row_number().over(within))
        .drop("ahead")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """source, source_size, source_start (words of the sources before it), weight and target, one row a source.

    Water filling: sources are capped in rising order of cap over weight, and
    the level is the largest of what each prefix of capped sources leaves.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    sources = sources.select(
        "source",
        "source_size",
        F.coalesce(F.sum("source_size").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("source_start"),
        F.get(F.array(*(F.lit(w).cast("long") for w in weights)), (F.row_number().over(by_name) - 1) % len(weights)).alias("weight"),
        (F.col("source_size") * rounds).alias("cap"),
    )
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything)
    capped = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    levels = sources.withColumn("budget", budget).withColumn("left", (F.col("budget") - capped).cast("double") / open_weight.cast("double"))
    level = F.max("left").over(everything)
    return levels.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select(
        "source", "source_size", "source_start", "weight", "target", F.floor(F.col("target") + 0.5).cast("long").alias("quota"), "budget"
    )


def weighted_fair_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    rounds: int = ROUNDS,
    seed: str = "mix",
    row_col: str | None = None,
) -> DataFrame:
    """One row a document and round: doc_id, text_hash, row, source, size, source_size, target, round, taken, position.

    position is where the row starts in the mix, in words. A document that the
    mix doesn't take has one row with taken 0; rows that are taken in part end
    their source's share. row is row_col, null without one; queue_part and
    queue_place tell repeated documents apart as well.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.table(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            n_words(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(text_col)).alias("text_hash"),
            (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"),
            F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("shuffled"),
        ),
        "sized",
    )
    targets = scratch.table(source_targets(sized, weights, rounds), "targets")
    queue = [F.col("source").asc_nulls_last(), F.col("shuffled"), F.col("doc_id"), F.col("size"), F.col("text_hash"), F.col("row")]
    queued = running_total(sized, queue, "size", scratch, "queued").alias("q")
    known = broadcast_if_small(targets, 200).alias("t")
    joined = queued.join(known, F.col("q.source").eqNullSafe(F.col("t.source"))).drop(F.col("t.source"))
    ahead = F.col("before") - F.col("source_start")

    def taken(r: int) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least("size", F.col("quota") - (r * F.col("source_size") + ahead)))

    turns = F.array(
        *(
            F.struct(
                F.lit(r).alias("round"),
                taken(r).alias("served"),
                ((r * F.col("source_size") + ahead + taken(r)).cast("double") / F.greatest("target", F.lit(1e-9))).alias("finish"),
            )
            for r in range(rounds)
        )
    )
    rows = joined.select(
        "doc_id", "text_hash", "row", "source", "size", "source_size", "target", "budget", "shuffled",
        F.col("part").alias("queue_part"), F.col("place").alias("queue_place"),
        F.inline(F.filter(turns, lambda t: (t["served"] > 0) | (t["round"] == 0))),
    )
    rows = scratch.table(rows, "turns")
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("round"), F.col("shuffled"), F.col("doc_id"), F.col("size"), F.col("text_hash"), F.col("row")]
    mixed = running_total(rows, order, "served", scratch, "mixed")
    cut = F.greatest(F.lit(0).cast("long"), F.least("served", F.col("budget") - F.col("before")))
    return mixed.select(
        "doc_id", "text_hash", "row", "source", "size", "source_size", "target", "round",
        cut.alias("taken"), F.col("before").alias("position"), "queue_part", "queue_place",
    )


def taken_by_document(mix: DataFrame) -> DataFrame:
    """The mix summed up, one row a document."""
    return mix.groupBy("queue_part", "queue_place").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "text_hash", "row", "source", "size", "source_size", "target")),
        F.sum("taken").alias("taken"),
        F.min(F.when(F.col("taken") > 0, F.col("position"))).alias("position"),
    )


def op7_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    mix = weighted_fair_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken_by_document(mix).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_weighted_mix": op7_weighted_mix}

MIX_SQL = r"""
sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS shuffled
  FROM {documents}
), named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT source, source_size, weight, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS budget,
         ((sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
            ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
          / sum(weight) OVER (
            ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE) AS lft
  FROM named
), targets AS (
  SELECT source, source_size, budget, least(cap::DOUBLE, max(lft) OVER () * weight) AS target,
         floor(least(cap::DOUBLE, max(lft) OVER () * weight) + 0.5)::BIGINT AS quota
  FROM levels
), queued AS (
  SELECT s.*, t.source_size, t.target, t.quota, t.budget,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY shuffled, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), turns AS (
  SELECT *, greatest(0, least(size, quota - (r * source_size + ahead))) AS served,
         (r * source_size + ahead + greatest(0, least(size, quota - (r * source_size + ahead))))::DOUBLE / greatest(target, 1e-9) AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS r)
), mixed AS (
  SELECT *, coalesce(sum(served) OVER (ORDER BY finish, source NULLS LAST, r, shuffled, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM turns WHERE served > 0 OR r = 0
)
"""

ORACLE = {
    "op7_weighted_mix": "WITH "
    + MIX_SQL.replace("{documents}", "documents")
    + """SELECT doc_id, size, source_size, target,
  sum(greatest(0, least(served, budget - before)))::BIGINT AS taken
FROM mixed GROUP BY doc_id, size, source_size, target"""
}
