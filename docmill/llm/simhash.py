"""SimHash near-duplicate groups with pigeonring filtering.

The 64 bits are a ring of five segments. If two fingerprints differ in at most
four bits, some segment starts a chain in which the first l segments differ in
at most 4 l / 5 bits for every l: none in the first, one in the first two, and
so on. Pairs meet on that chain's first two segments (the second as four
blocks, of which three must agree), pass the budgets of the longer chains, and
last the full Hamming distance.

A meeting place with many fingerprints is not paired out but split by the
chain's third segment: at most two of its five blocks may differ, so three of
them must agree. A place that is crowded even then, as a large group of near
copies makes, goes by neighbours: two fingerprints are within four bits if and
only if some 64-bit value lies within two bits of both, so each emits the values
around it and those that share a value are linked to the least one. All ways
are exact, and the last is linear in the number of fingerprints.

Defined cases: a null, empty or blank text has no shingle and fingerprint zero,
which links like any other; a text of fewer words than a shingle has one
shingle, its whole sequence; repeated rows share a group; a null id stays and
gets its group's smallest id, null if it has none; first_of_groups() tells rows
apart by id and text, so groups that share an id, or have none, keep a row each;
an empty table gives an empty result; other columns are ignored by
near_duplicate_groups() and kept by first_of_groups().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.columns import giving_back, map_texts, sliced, utf8_values
from docmill.llm.components import connected_components
from docmill.llm.near_copies import arrays, digests, distinct, frequent_shingles, linked_near_copies, prefix, set_digest, sketch
from docmill.session import Scratch, broadcast_if_small

SHINGLE = 4
#: Bits that linked fingerprints may differ in.
DISTANCE = 4
#: Bits of the ring's segments, and of the four blocks of each.
SEGMENTS = (13, 13, 13, 13, 12)
BLOCKS = {13: (4, 3, 3, 3), 12: (3, 3, 3, 3)}
#: Bits of the five blocks of a chain's third segment, where crowded places are split.
THIRD_BLOCKS = {13: (3, 3, 3, 2, 2), 12: (3, 3, 2, 2, 2)}
#: Fingerprints at one meeting place that are paired; more are split, then go by their neighbours.
PAIRED = 64
#: Places whose sizes are broadcast at any size.
LARGE = 1 << 18
#: Sets that a task remembers to tell copies; beyond that it starts afresh.
REMEMBERED = 1 << 17


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text as an unsigned number; zero without words."""
    return folded(digests(text, n))


def folded(parts: Iterable[bytes]) -> int:
    """The SimHash of joined shingle hashes."""
    ones, count = np.zeros(64, np.int64), 0
    for some in parts:
        ones += np.unpackbits(np.frombuffer(some, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        count += len(some) // 8
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number, of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x, n) for x in utf8_values(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return map_texts(docs, run, f"doc_id {kind}, fp bigint", id_col, text_col)


def mask(low: int, width: int) -> int:
    return ((1 << width) - 1) << low


def segment_starts() -> list[int]:
    """The lowest bit of each segment."""
    return [sum(SEGMENTS[:i]) for i in range(len(SEGMENTS))]


def meeting_masks() -> list[tuple[int, int]]:
    """(first segment, kept bits) of each kind of meeting place."""
    lows, m = segment_starts(), len(SEGMENTS)
    places = []
    for i in range(m):
        j = (i + 1) % m
        at, parts = lows[j], []
        for width in BLOCKS[SEGMENTS[j]]:
            parts.append(mask(at, width))
            at += width
        places += [(i, mask(lows[i], SEGMENTS[i]) | sum(kept)) for kept in combinations(parts, len(parts) - 1)]
    return places


def chain_masks() -> list[list[tuple[int, int]]]:
    """By first segment: (bits, most that may differ) of its chains of three or more segments."""
    lows, m = segment_starts(), len(SEGMENTS)
    return [
        [(sum(mask(lows[(i + k) % m], SEGMENTS[(i + k) % m]) for k in range(n)), DISTANCE * n // m) for n in range(3, m)]
        for i in range(m)
    ]


def splitting_masks() -> list[list[int]]:
    """By first segment: bits of the chain's third segment that a crowded place is split by; three of five blocks, as two bits may differ."""
    lows, m = segment_starts(), len(SEGMENTS)
    out = []
    for i in range(m):
        k = (i + 2) % m
        at, parts = lows[k], []
        for width in THIRD_BLOCKS[SEGMENTS[k]]:
            parts.append(mask(at, width))
            at += width
        out.append([sum(kept) for kept in combinations(parts, len(parts) - 2)])
    return out


def neighbour_masks() -> list[int]:
    """All 64-bit values of at most half DISTANCE bits."""
    return [sum(1 << b for b in bits) for n in range(DISTANCE // 2 + 1) for bits in combinations(range(64), n)]


def met_at(rows: DataFrame, place: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows whose place others share, with n, the fingerprints there.

    Rows of large places, LARGE at most as each has more than that share of all
    rows, learn n by broadcast and stay where they are; the others are dealt out.
    """
    counts = scratch.table(rows.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1"), f"{name}-places")
    most = max(PAIRED, (counts.agg(F.sum("n")).first()[0] or 0) // LARGE)
    marked = rows.join(F.broadcast(counts.where(F.col("n") > most)), place, "left")
    dealt = marked.where("n is null").drop("n").join(counts.where(F.col("n") <= most), place)
    return scratch.table(marked.where("n is not null").unionByName(dealt), name)


def pairs_at(rows: DataFrame, place: list[str], places: list[tuple[int, int]]) -> DataFrame:
    """Edges (a, b) of the fingerprints at each place that pass the longer chains and the full distance."""
    x, y = rows.alias("x"), rows.alias("y")
    together = F.col("x.fp") < F.col("y.fp")
    for c in place:
        together = together & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    pairs = x.join(y, together & within_ring(F.col("x.kind"), differ, places) & (F.bit_count(differ) <= DISTANCE))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def links(distinct: DataFrame, scratch: Scratch, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) over the nodes of distinct (fp, node) whose components are those of all pairs within DISTANCE."""
    places = meeting_masks()
    keys = F.array(*(F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for k, (_, m) in enumerate(places)))
    met = met_at(distinct.select("fp", "node", F.inline(keys)), ["kind", "bits"], scratch, "met")
    edges = pairs_at(met.where(F.col("n") <= paired), ["kind", "bits"], places)
    splits = splitting_masks()
    by_kind = F.array(*(F.array(*(F.lit(signed(m)) for m in splits[i])) for i, _ in places))
    crowded = met.where(F.col("n") > paired).select("fp", "node", "kind", "bits", F.posexplode(F.get(by_kind, F.col("kind"))).alias("split", "mask"))
    crowded = crowded.select("fp", "node", "kind", "split", F.col("bits").bitwiseOR(F.col("fp").bitwiseAND(F.col("mask"))).alias("bits"))
    crowded = met_at(crowded, ["kind", "split", "bits"], scratch, "crowded")
    edges = edges.unionByName(pairs_at(crowded.where(F.col("n") <= paired), ["kind", "split", "bits"], places))
    many = crowded.where(F.col("n") > paired).select("fp", "node").distinct()
    around = many.select("node", F.explode(F.transform(F.array(*(F.lit(signed(m)) for m in neighbour_masks())), lambda m: m.bitwiseXOR(F.col("fp")))).alias("near"))
    least = around.groupBy("near").agg(F.min("node").alias("a"), F.collect_set("node").alias("all")).where(F.size("all") > 1)
    return edges.unionByName(least.select("a", F.explode("all").alias("b"))).distinct()


def within_ring(kind: Column, differ: Column, places: list[tuple[int, int]]) -> Column:
    """Whether every chain from the meeting place's first segment stays within its share of DISTANCE."""
    per_segment = len(places) // len(SEGMENTS)
    first = F.floor(kind / per_segment)
    chains = chain_masks()
    passed = F.lit(True)
    for n in range(len(chains[0])):
        bits = F.get(F.array(*(F.lit(signed(c[n][0])) for c in chains)), first.cast("int"))
        passed = passed & (F.bit_count(differ.bitwiseAND(bits)) <= chains[0][n][1])
    return passed


def near_duplicate_groups(
    docs: DataFrame, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", paired: int = PAIRED
) -> DataFrame:
    """doc_id, fp and component_id, the smallest id reachable over linked fingerprints, one row a document."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(fingerprints(docs, n, id_col, text_col), "fingerprints")
    distinct = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    nodes = distinct.select("fp", F.col("fp").alias("node"))
    groups = connected_components(links(nodes, scratch, paired), scratch)
    ids = groups.join(distinct.withColumnRenamed("fp", "node"), "node").groupBy("component").agg(F.min("least").alias("grouped"))
    labels = groups.join(ids, "component").select(F.col("node").alias("fp"), "grouped")
    labels = scratch.table(
        distinct.join(labels, "fp", "left").select("fp", F.coalesce("grouped", "least").alias("component_id")), "labels"
    )
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


def first_of_groups(docs: DataFrame, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each group, with all its columns; groups join SimHash links and near copies by Jaccard similarity.

    It is the row with the smallest id, nulls last, then of the least text hash;
    of rows that are equal in id and text any one.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tx"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in sliced(batches):
            parts = [list(digests(x, n)) for x in utf8_values(part.column(1))]
            found = np.array([folded(p) for p in parts], np.uint64).view(np.int64)
            sets = [distinct(p) for p in parts]
            names = [set_digest(x) for x in sets]
            if len(seen) > REMEMBERED:
                seen.clear()
            # a task sends the prefix and sketch of copies once
            first = [name not in seen and not seen.add(name) for name in names]
            prefixes = [prefix(x, *shared.value) if f else None for x, f in zip(sets, first)]
            columns = [arrays([p and p[k] for p in prefixes]) for k in range(2)]
            columns.append(arrays([sketch(x) if f else None for x, f in zip(sets, first)]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(found), pa.array(names, pa.int64()), pa.array([len(x) for x in sets], pa.int32()), *columns],
                names=["doc_id", "tx", "fp", "sd", "size", "rare", "common", "sketch"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, tx bigint, fp bigint, sd bigint, size int, rare array<bigint>, common array<bigint>, sketch array<bigint>"
    rows = scratch.table(texts.mapInArrow(giving_back(run), schema), "prefixes")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tx")).alias("least")
    sets = rows.groupBy("sd").agg(F.first("size").alias("size"), F.max("sketch").alias("sketch"), least)
    sets = scratch.table(sets, "sets")
    # a set of shingles is a node; one fingerprint's sets hang on the least of them
    prints = rows.select("fp", "sd").distinct()
    prints = scratch.table(prints.join(prints.groupBy("fp").agg(F.min("sd").alias("node")), "fp"), "prints")
    own = prints.where("sd <> node").select(F.col("sd").alias("a"), F.col("node").alias("b"))
    edges = links(prints.select("fp", "node").distinct(), scratch).unionByName(own)
    groups = linked_near_copies(rows, sets, texts, edges, n, scratch)
    grouped = sets.select("sd", "least").join(groups.select(F.col("node").alias("sd"), "component"), "sd", "left")
    keep = grouped.groupBy(F.coalesce("component", "sd").alias("component")).agg(F.min("least").alias("least"))
    keep = scratch.table(keep.select(F.col("least.doc_id").alias("kept_id"), F.col("least.tx").alias("kept_tx")), "kept")
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("kept_id")) & (F.xxhash64(f"d.`{text_col}`") == F.col("kept_tx"))
    kept = docs.alias("d").join(broadcast_if_small(keep, 32), same, "left_semi").select(*(F.col(f"d.`{c}`") for c in docs.columns))
    repeated = rows.groupBy("doc_id", "tx").agg(F.count("*").alias("rows")).where("rows > 1")
    return kept.dropDuplicates([id_col, text_col]) if repeated.limit(1).count() else kept


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and near-duplicate group of every document."""
    groups = near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash_groups": op1_simhash_groups}
