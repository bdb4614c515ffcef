"""Host-level quality rules.

Each document is measured once. Rule failures are summed by host, each host's
failure rate is shrunk towards an empirical beta prior fitted to all hosts by
moments, and the host's verdict joins back to its documents.

Defined cases: a null or empty text has no words and fails; a null host has no
verdict, so its documents stand on their own rules; repeated rows are judged
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.columns import ASCII_SPACES, ROWS, giving_back, sliced, utf8_values
from docmill.session import BROADCAST_BYTES, Scratch, broadcast_if_small

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
WINDOW = 3

#: Further rules: symbols per word, share of repeated lines, share of capital letters among ASCII letters.
MAX_SYMBOLS_PER_WORD = 0.25
MAX_DUP_LINE_SHARE = 0.3
MIN_DUP_LINES = 3
MAX_CAPITAL_SHARE = 0.6

#: Hosts whose verdicts are broadcast at any size.
LARGE = 1024

#: A host is rejected when its shrunk failure rate passes this.
MAX_HOST_RATE = 0.6

CAPITALS, SMALLS = bytes(range(65, 91)), bytes(range(97, 123))
CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_window_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words inside n-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(n))))
    if len(set(windows)) == len(windows):
        return 0
    number: dict[tuple, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in windows), np.int64, len(windows))
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    covered = np.zeros(len(words), bool)
    for i in range(n):
        covered[starts + i] = True
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, capitals, small letters."""
    words = text.split()
    bare = text.translate(None, ASCII_SPACES)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(bare.translate(None, CONTINUATION)),
        len(bare) - len(bare.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
        len(lines),
        len(bare) - len(bare.translate(None, CAPITALS)),
        len(bare) - len(bare.translate(None, SMALLS)),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_smalls")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the measures of every whole text."""

    def run(batches):
        for batch in sliced(batches, ROWS):
            rows = [measure(x) for x in utf8_values(batch.column(2))]
            found = [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=["doc_id", "host", *MEASURES])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, host_col)}
    schema = f"doc_id {kinds[id_col]}, host {kinds[host_col]}, " + ", ".join(f"{m} bigint" for m in MEASURES)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(giving_back(run), schema)


def with_rule_failures(rows: DataFrame) -> DataFrame:
    """Adds base_failed and failed (any rule) to measured rows."""
    letters = F.col("n_capitals") + F.col("n_smalls")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    further = (
        (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words"))
        | ((F.col("n_dup_lines") >= MIN_DUP_LINES) & (F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines")))
        | (F.col("n_capitals") > MAX_CAPITAL_SHARE * letters)
    )
    return rows.withColumn("base_failed", base).withColumn("failed", F.col("base_failed") | further)


def host_verdicts(rows: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, host_docs, host_failures, host_rate (shrunk) and host_ok, one row a host.

    The prior is a beta distribution with the mean and, corrected for binomial
    noise, the variance of the hosts' rates; only its two numbers reach the driver.
    """
    hosts = rows.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failures")
    )
    rate = F.col("host_failures") / F.col("host_docs")
    seen = hosts.agg(
        F.count("*").alias("n"),
        F.sum("host_docs").alias("docs"),
        F.sum("host_failures").alias("failures"),
        F.avg(rate).alias("mean"),
        F.var_pop(rate).alias("variance"),
        F.avg(1 / F.col("host_docs")).alias("inverse"),
    ).first()
    alpha, beta = beta_prior(seen["n"], seen["mean"], seen["variance"], seen["inverse"])
    shrunk = (F.col("host_failures") + F.lit(alpha)) / (F.col("host_docs") + F.lit(alpha + beta))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_ok", F.col("host_rate") <= max_rate)


def beta_prior(hosts: int, mean: float | None, variance: float | None, inverse: float | None) -> tuple[float, float]:
    """Beta parameters by moments; hosts without spread beyond noise give a prior worth 1000 documents."""
    if not hosts or mean is None:
        return 1.0, 1.0
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    noise = mean * (1 - mean) * (inverse or 0.0)
    spread = max((variance or 0.0) - noise, 0.0)
    strength = min(mean * (1 - mean) / spread - 1, 1000.0) if spread > 0 else 1000.0
    strength = max(strength, 2.0)
    return mean * strength, (1 - mean) * strength


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """Every document's measures, rule failures, its host's shrunk rate and the verdict in kept."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(with_rule_failures(measured(docs, id_col, text_col, host_col)), "measured")
    verdicts = scratch.table(host_verdicts(rows, max_rate), "verdicts")
    kept = ~F.col("failed") & F.coalesce(F.col("host_ok"), F.lit(True))
    return with_verdicts(rows, verdicts).withColumn("kept", kept)


def with_verdicts(rows: DataFrame, verdicts: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """rows with the verdict on their host, null for a null host.

    Verdicts that don't fit a broadcast are dealt out by host, but for those of
    the largest hosts, LARGE at most, each with more than that share of all rows;
    these are broadcast, and their rows and those without a host stay in place.
    """
    known = broadcast_if_small(verdicts, 80, limit, more=F.octet_length(F.col("host").cast("string")))
    total = verdicts.agg(F.sum("host_docs")).first()[0] or 0
    if known is not verdicts:
        return rows.join(known, "host", "left")
    large = verdicts.where(F.col("host_docs") * LARGE > total)
    placed = rows.join(F.broadcast(large), "host", "left")
    here = F.col("host_docs").isNotNull() | F.col("host").isNull()
    dealt = placed.where(~here).select(*rows.columns).join(verdicts.hint("shuffle_hash"), "host", "left")
    return placed.where(here).unionByName(dealt)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality verdict on every document."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "host", F.round("host_rate", 6).alias("host_rate"),
    )


QUERIES = {"op4_quality_rules": op4_quality_rules}

ORACLE = {
    "op4_quality_rules": r"""WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), wins AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM docs)
), twice AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS n FROM wins) WHERE n > 1
), inside AS (
  SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY k
), measured AS (
  SELECT doc_id, host, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters
  FROM docs LEFT JOIN inside USING (k)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.25 * n_words
         OR (n_dup_lines >= 3 AND n_dup_lines > 0.3 * n_lines) OR capitals > 0.6 * letters AS failed
  FROM measured
), hosts AS (
  SELECT host, count(*) AS n, sum(failed::INT) AS f FROM judged WHERE host IS NOT NULL GROUP BY host
), seen AS (
  SELECT least(greatest(avg(f / n), 0.001), 0.999) AS m, var_pop(f / n) AS v, avg(1 / n) AS inverse FROM hosts
), prior AS (
  SELECT m, greatest(2.0, CASE WHEN v > m * (1 - m) * inverse THEN least(m * (1 - m) / (v - m * (1 - m) * inverse) - 1, 1000.0) ELSE 1000.0 END) AS strength FROM seen
), rates AS (
  SELECT host, (f + m * strength) / (n + strength) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT failed AND coalesce(rate <= 0.6, true) AS kept, j.host, round(rate, 6) AS host_rate
FROM judged j LEFT JOIN rates r ON j.host = r.host"""
}
