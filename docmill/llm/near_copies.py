"""Near copies by the Jaccard similarity of word shingles, found by prefix filtering and checked exactly.

All shingles have one global order. Two texts that share enough of their
shingles share one of each text's first ones, its prefix of about a fifth, so
every pair meets on a prefix shingle. The order puts shingles that are frequent
in a sample last, and is otherwise that of the hashes; the sample changes how
many pairs meet by chance and where they are dealt, never which pairs are found.

The texts at a meeting place first meet one of them, the one that has the place
earliest in its own order. What was edited is rare and so comes first, which
makes that one the least edited, and it joins most of a group of near copies.
Then only texts of one place that are still in different groups meet each other,
if their sizes and what they have left can make a near copy. Pairs pass a sketch
first: texts that differ in the parity of so many buckets of their shingles
differ in as many shingles at least. The groups are those of all pairs. Places of frequent shingles are summed up before they are
dealt out and join by broadcast (at most KEPT of them); the rest have few texts.

Defined cases: null, empty and blank texts have no shingle and meet nothing; a
text of fewer words than a shingle has one shingle, its whole sequence; texts
that differ only in case and white space have equal shingles. Sets of shingles go
by a 64-bit hash of theirs, shingles by their XXH64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.llm.columns import giving_back, sliced, utf8_values
from docmill.llm.components import connected_components
from docmill.session import Scratch, broadcast_if_small

SEED = 42
#: Hashes that are in memory together.
HASHES_AT_ONCE = 1 << 16
#: Percent of the shingles of two texts, taken together, that near copies share.
SIMILAR = 80
#: One text of so many is in the sample; shingles that so many of its texts hold are frequent; so many of them are kept.
SAMPLE, FREQUENT, KEPT = 16, 4, 1 << 19
#: Pairs of one text that are checked in one place.
PARTNERS = 1024
#: Bits of the smallest sketch; larger ones have half a bit for each shingle, or more.
SKETCH = 1024

def digests(text: bytes, n: int) -> Iterator[bytes]:
    """The joined 8-byte hashes of a UTF-8 text's shingles, in parts; none without words."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.append(gaps, len(joined))
    count = max(1, len(starts) - n + 1)
    starts, ends = starts[:count].tolist(), ends[min(n, len(ends)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    for at in range(0, count, HASHES_AT_ONCE):
        yield b"".join([digest(joined[i:j], SEED) for i, j in zip(starts[at : at + HASHES_AT_ONCE], ends[at : at + HASHES_AT_ONCE])])


def distinct(parts: list[bytes]) -> np.ndarray:
    """The distinct hashes, rising."""
    return np.unique(np.frombuffer(b"".join(parts), ">u8").astype(np.uint64))


def set_digest(hashes: np.ndarray) -> int:
    """A signed hash of a set of rising hashes."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity of the number of hashes in each bucket, as a power of two of bits packed in 64-bit numbers."""
    buckets = SKETCH
    while 2 * buckets < len(hashes):
        buckets *= 2
    odd = np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def prefix(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similar: int = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Those of the distinct rising hashes of which a near copy has at least one in its own prefix: the rare, then the frequent ones."""
    size = len(hashes)
    length = size - -(-size * similar // 100) + 1 if size else 0
    if not size or not len(frequent):
        return hashes[:length], hashes[:0]
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    known = frequent[at] == hashes
    common = hashes[known][np.argsort(counts[at[known]], kind="stable")]
    rare = hashes[~known]
    return rare[:length], common[: max(0, length - len(rare))]


def arrays(values: list[np.ndarray | None]) -> pa.Array:
    """A column of arrays of hashes as signed numbers."""
    sizes = [0 if v is None else len(v) for v in values]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([v is None for v in values] + [False], bool))
    flat = np.concatenate([np.empty(0, np.uint64), *(v for v in values if v is not None)]).view(np.int64)
    return pa.ListArray.from_arrays(offsets, pa.array(flat))


def frequent_shingles(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rising hashes of shingles that are frequent in a sample of texts (tx, text), and in how many of its texts each is."""

    def run(batches):
        for part in sliced(batches):
            found = [distinct(list(digests(x, n))) for x in utf8_values(part.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], names=["token"])

    some = texts.where(F.pmod("tx", F.lit(SAMPLE)) == 0).select("text").mapInArrow(giving_back(run), "token bigint")
    most = some.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(KEPT).toArrow()
    tokens, counts = most["token"].to_numpy().astype(np.int64).view(np.uint64), most["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def full_sets(texts: DataFrame, n: int) -> DataFrame:
    """sd and tokens, the hashes of all shingles, of texts (sd, text)."""

    def run(batches):
        for part in sliced(batches):
            found = [distinct(list(digests(x, n))) for x in utf8_values(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), arrays(found)], names=["sd", "tokens"])

    return texts.select("sd", "text").mapInArrow(giving_back(run), "sd bigint, tokens array<bigint>")


def may_be_alike(x: Column, y: Column, similar: int = SIMILAR) -> Column:
    """Whether two texts (size, at) whose first common shingle is the one at these places can share enough."""
    rest = F.least(x["size"] - x["at"], y["size"] - y["at"])
    return rest * (100 + similar) >= (x["size"] + y["size"]) * similar


def met_places(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """token, sd, size, at and the place's lead (at, sd, size), for prefix shingles that several sets have.

    A set that several rows have counts as one.
    """
    rare = rows.select(F.posexplode("rare").alias("at", "token"), "sd", "size")
    here = Window.partitionBy("token").orderBy("at", "sd")
    first = F.first(F.struct("at", "sd", "size")).over(here)
    last = F.last("sd").over(here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rare = rare.withColumn("lead", first).withColumn("last", last).where(F.col("last") != F.col("lead.sd"))
    common = rows.select(F.posexplode("common").alias("nth", "token"), "sd", "size", F.size("rare").alias("before"))
    common = common.select((F.col("nth") + F.col("before")).alias("at"), "token", "sd", "size")
    leads = common.groupBy("token").agg(F.min(F.struct("at", "sd", "size")).alias("lead"), F.max(F.struct("at", "sd")).alias("last"))
    leads = leads.where("last.sd <> lead.sd").select("token", "lead")
    common = common.join(F.broadcast(scratch.table(leads, "leads")), "token")  # KEPT rows at most
    columns = ["token", "sd", "size", "at", "lead"]
    return scratch.table(rare.select(*columns).unionByName(common.select(*columns)), "places")


def with_sides(pairs: DataFrame, values: DataFrame, column: str, hot: DataFrame) -> DataFrame:
    """pairs (a, b) with the column of both, from values (sd, column), as x and y; hot: a and the places (shares) it is dealt to, if several."""
    right = pairs.join(values.select(F.col("sd").alias("b"), F.col(column).alias("y")), "b").join(hot, "a", "left")
    right = right.withColumn("share", F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    left = values.select(F.col("sd").alias("a"), F.col(column).alias("x")).join(hot, "a", "left")
    left = left.withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    return right.join(left, ["a", "share"]).drop("share")


def may_match(x: Column, y: Column, similar: int = SIMILAR) -> Column:
    """Whether two sets (size, sketch) can share enough; the larger sketch is folded to the smaller one's buckets."""

    def folded(v: Column, n: Column) -> Column:
        half = F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, n + 1, n), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(v) == n, v).otherwise(half)

    n = F.least(F.size(x["sketch"]), F.size(y["sketch"]))
    differ = F.zip_with(folded(x["sketch"], n), folded(y["sketch"], n), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    total = F.aggregate(differ, F.lit(0), lambda s, d: s + d)
    return total * (100 + similar) <= (x["size"] + y["size"]) * (100 - similar)


def alike(pairs: DataFrame, sets: DataFrame, texts: DataFrame, n: int, scratch: Scratch, name: str, similar: int = SIMILAR) -> DataFrame:
    """Those of the pairs (a, b) of sets that are near copies."""
    pairs = scratch.table(pairs.distinct(), f"{name}-pairs")
    # a set with very many partners is dealt to several places
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("shares"))
    hot = broadcast_if_small(scratch.table(shares.where("shares > 1"), f"{name}-hot"), 24)
    near = with_sides(pairs, sets.select("sd", F.struct("size", "sketch").alias("own")), "own", hot).where(may_match(F.col("x"), F.col("y"), similar))
    near = scratch.table(near.select("a", "b"), f"{name}-near")
    scratch.drop(f"{name}-pairs")
    wanted = near.select(F.col("a").alias("sd")).union(near.select("b")).distinct().join(sets.select("sd", "least.doc_id", "least.tx"), "sd")
    wanted = scratch.table(wanted.withColumnRenamed("doc_id", "id"), f"{name}-wanted")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t.tx") == F.col("w.tx"))
    own = texts.alias("t").join(broadcast_if_small(wanted, 40).alias("w"), same).select("sd", "text")
    tokens = scratch.table(full_sets(own, n), f"{name}-sets")
    enough = F.size(F.array_intersect("x", "y")) * (100 + similar) >= (F.size("x") + F.size("y")) * similar
    found = scratch.table(with_sides(near, tokens, "tokens", hot).where(enough).select("a", "b"), f"{name}-found")
    for part in ("near", "wanted", "sets", "hot"):
        scratch.drop(f"{name}-{part}")
    return found


def still_apart(met: DataFrame, groups: DataFrame) -> DataFrame:
    """Those of met, with their component, whose place has sets of several components."""
    own = met.join(groups.select(F.col("node").alias("sd"), "component"), "sd", "left").withColumn("component", F.coalesce("component", "sd"))
    several = own.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    return own.join(broadcast_if_small(several, 16), "token", "left_semi")


def linked_near_copies(rows: DataFrame, sets: DataFrame, texts: DataFrame, edges: DataFrame, n: int, scratch: Scratch, similar: int = SIMILAR) -> DataFrame:
    """node and component of edges (a, b) over sets with those of all near copies added.

    rows has sd, size and the prefix (rare, common) of each set once or more;
    sets has sd, size, sketch and least (doc_id, tx), whose text stands for it;
    texts has doc_id, tx and text.
    """
    met = met_places(rows, scratch)
    stars = met.where((F.col("sd") != F.col("lead.sd")) & may_be_alike(F.struct("size", "at"), F.col("lead"), similar))
    stars = alike(stars.select(F.col("lead.sd").alias("a"), F.col("sd").alias("b")), sets, texts, n, scratch, "star", similar)
    edges = scratch.table(edges.unionByName(stars), "edges")
    groups = scratch.table(connected_components(edges, scratch, "components-0"), "groups")
    met = scratch.table(still_apart(met, groups), "apart")
    # sizes of near copies are within a quarter, so they lie in one of two neighbouring steps of a little more
    step = F.floor(F.log("size") / F.log(F.lit(100 / similar * 1.000001))).cast("int")
    low, high = met.withColumn("step", F.explode(F.array(step, step + 1))).alias("x"), met.withColumn("step", step).alias("y")
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.step") == F.col("y.step")) & (F.col("x.component") != F.col("y.component"))
    meet = meet & (F.struct("x.size", "x.sd") < F.struct("y.size", "y.sd")) & (F.col("x.sd") != F.col("y.lead.sd")) & (F.col("y.sd") != F.col("x.lead.sd"))
    pairs = low.join(high, meet & may_be_alike(F.struct("x.size", "x.at"), F.struct("y.size", "y.at"), similar))
    more = alike(pairs.select(F.col("x.sd").alias("a"), F.col("y.sd").alias("b")), sets, texts, n, scratch, "rest", similar)
    for name in ("places", "leads", "apart"):
        scratch.drop(name)
    if not more.limit(1).count():
        return groups
    hung = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
    return connected_components(hung.unionByName(more), scratch, "components-1")
