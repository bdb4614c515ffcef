"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Items are partitioned by their number of shingles, in powers of two. Within a
partition each item keeps its bottom-k MinHash sketch, with k one more than the
shingles that a match may lack at the partition's upper size, so that a text
which contains enough of the item holds some of the sketch for certain. One
pass over the texts looks their shingles up in the sketches; each item needs as
many hits as its own size implies. Candidates are verified by the exact share
of the item's shingles, as strings, in the text.

Defined cases: words are split at ASCII white space and lowered; a text of
fewer words than a shingle is one shingle of its whole sequence; a null or
empty text or item has no shingles and matches nothing; rows that repeat an id
are searched each on their own text; repeated items each match; empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.session import Scratch, broadcast_if_small

SHINGLE = 5
#: Percent of an item's shingles that a text must contain.
CONTAINED = 80
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Lower-cased words; none for null or blank text."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, evaluated once; a plain reference inside a lambda would be evaluated at each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_starts(count: Column, n: int) -> Column:
    """Where shingles start; one for a sequence of fewer than n words, none for no words."""
    return F.when(count == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(count - n, F.lit(0))))


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """The distinct 64-bit hashes of a text's shingles."""

    def of(hashes: Column) -> Column:
        def at(i: Column) -> Column:
            return F.xxhash64(*(F.coalesce(F.get(hashes, i + k), F.lit(0).cast("long")) for k in range(n)))

        return F.array_distinct(F.transform(shingle_starts(F.size(hashes), n), at))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """The distinct shingles of a text, space-joined."""

    def of(own: Column) -> Column:
        starts = shingle_starts(F.size(own), n)
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(own, i + 1, F.lit(n)), " ")))

    return let(words(text), of)


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart by id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def item_sketches(items: DataFrame, n: int = SHINGLE, contained: int = CONTAINED) -> DataFrame:
    """item_id, n_shingles, item_shingles, need (sketch hits) and sketch, one row an item with shingles."""
    rows = items.select("item_id", shingles(F.col("text"), n).alias("item_shingles"), shingle_hashes(F.col("text"), n).alias("hashes"))
    rows = rows.where(F.size("hashes") > 0)
    size = F.size("item_shingles")

    def may_lack(count: Column) -> Column:
        return count - F.floor((count * contained + 99) / 100)

    upper = (F.pow(F.lit(2), F.floor(F.log2(size)) + 1) - 1).cast("int")
    k = F.least(F.size("hashes"), (may_lack(upper) + 1).cast("int"))
    return rows.select(
        "item_id",
        size.cast("long").alias("n_shingles"),
        "item_shingles",
        F.slice(F.array_sort("hashes"), F.lit(1), k).alias("sketch"),
        F.greatest(F.lit(1), k - may_lack(size)).alias("need"),
    )


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = SHINGLE,
    contained: int = CONTAINED,
) -> DataFrame:
    """doc_id, row_key, item_id, n_shingles, n_shared and containment of every text that contains enough of an item."""
    scratch = Scratch(docs.sparkSession)
    sketches = scratch.table(
        item_sketches(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), n, contained), "sketches"
    )
    postings = broadcast_if_small(sketches.select("item_id", "need", F.explode("sketch").alias("hash")), 40)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row_key"))
    # explode_outer, as explode brings a filter that would hash every text twice
    hashed = texts.select("row_key", F.explode_outer(shingle_hashes(F.col("text"), n)).alias("hash"))
    hits = hashed.join(postings, "hash")
    candidates = scratch.table(
        hits.groupBy("row_key", "item_id", "need").agg(F.count("*").alias("hits")).where(F.col("hits") >= F.col("need")).select("row_key", "item_id"),
        "candidates",
    )
    near = texts.join(broadcast_if_small(candidates, 48), "row_key")
    known = broadcast_if_small(
        sketches.select("item_id", "n_shingles", "item_shingles"), 64, more=F.aggregate("item_shingles", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 24)
    )
    shared = F.size(F.array_intersect(shingles(F.col("text"), n), F.col("item_shingles"))).cast("long")
    checked = near.join(known, "item_id").select("doc_id", "row_key", "item_id", "n_shingles", shared.alias("n_shared"))
    checked = scratch.table(checked, "checked")
    return checked.where(F.col("n_shared") * 100 >= F.col("n_shingles") * contained).withColumn(
        "containment", F.col("n_shared") / F.col("n_shingles")
    )


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.table(contaminated(docs, items, id_col, text_col).select("row_key").distinct(), "contaminated")
    keyed = docs.alias("d").join(
        broadcast_if_small(found, 24).alias("c"), row_key(f"d.{id_col}", f"d.{text_col}") == F.col("c.row_key"), "left_anti"
    )
    return keyed.select(*(F.col(f"d.`{c}`") for c in docs.columns))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


QUERIES = {"op5_decontamination": op5_decontamination}

LEAKS_SQL = r"""
doc_words AS (
  SELECT doc_id, text, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {documents}
), item_words AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), doc_shingles AS (
  SELECT DISTINCT doc_id, text, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM doc_words WHERE len(w) > 0
), item_shingles AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM item_words WHERE len(w) > 0
), item_sizes AS (
  SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id
), leaks AS (
  SELECT doc_id, text, item_id, n_shingles, count(*) AS n_shared
  FROM doc_shingles JOIN item_shingles USING (s) JOIN item_sizes USING (item_id)
  GROUP BY ALL HAVING count(*) * 100 >= n_shingles * 80
)
"""

ORACLE = {
    "op5_decontamination": "WITH "
    + LEAKS_SQL.replace("{documents}", "documents")
    + "SELECT doc_id, item_id, n_shingles, n_shared, n_shared::DOUBLE / n_shingles AS containment FROM leaks"
}
