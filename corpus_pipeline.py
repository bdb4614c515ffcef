"""Training-corpus pipeline: language, near duplicates, benchmark leaks, personal data, source mix.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; every stage
is written as a table and read again before the next. All but the last return
the columns of documents.

Defined cases, in every stage: rows with a null id or one that repeats are rows
of their own; a null or blank text goes at the language stage; rows that are
equal in id and text go with the copies at the near-duplicate stage, and are
kept, cut or mixed each by itself elsewhere; ties go as the operators say; an
empty table gives an empty table; further columns pass through, unless they have
the name of one that mixing adds (size, target, taken, position) or mix_row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.decontamination import without_contaminated
from docmill.llm.language import fitted_parser, identified_only
from docmill.llm.mixing import taken_by_document, weighted_fair_mix
from docmill.llm.pseudonyms import pseudonymised
from docmill.llm.simhash import first_of_groups
from docmill.session import Scratch, broadcast_if_small, ensure_importable

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; null texts and those without a letter go."""
    ensure_importable(spark)
    return identified_only(docs, fitted_parser(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    ensure_importable(spark)
    return first_of_groups(docs, SHINGLE)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by pseudonyms of its format."""
    ensure_importable(spark)
    return pseudonymised(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their size, target, words taken and place in the mix; repeated rows each have their share."""
    scratch = Scratch(spark)
    rows = scratch.table(docs.withColumn("mix_row", F.monotonically_increasing_id()), "rows")
    taken = taken_by_document(weighted_fair_mix(rows, row_col="mix_row")).where("taken > 0")
    taken = scratch.table(taken.select(F.col("row").alias("mix_row"), "size", "target", "taken", "position"), "taken")
    return rows.join(broadcast_if_small(taken, 48), "mix_row").drop("mix_row")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pseudonyms", pseudonym_stage),
    ("mixing", mixing_stage),
]

#: The language, near-duplicate and pseudonym stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
