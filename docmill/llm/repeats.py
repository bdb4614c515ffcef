"""Removal of repeated byte strings over all documents.

Every byte covered by a min_length string that also starts earlier (in a
document of smaller id, or earlier in the same one) is removed.

1. Anchors. The anchor of a min_length string is the first of its k-grams with
   the least hash, so equal strings have equal anchors at equal places. The
   context of a place with an anchor is the strings that have it as theirs,
   which lie side by side.
2. Contexts meet by anchor, one entry for each distinct context and task. All
   but the first of equal contexts are covered whole. Anchors with one context
   are done; first contexts of the others go on. Beyond 16,384 ranges of anchors
   they meet in two steps, first with those of some tasks and then of all.
3. Those contexts' texts come together in blocks by anchor. A block's suffixes
   are sorted to min_length, and breadth-first backward extension on their
   Burrows-Wheeler transform derives common prefixes by increasing value and
   stops at min_length: what it leaves unset are borders between suffixes that
   share min_length bytes or more. All but the first of those are covered.
4. An anchor with very many distinct contexts doesn't make a block: its strings
   meet one by one by hash instead, summed up before they are dealt out.

Covered places go back to their documents. Matches never cross documents.

Contexts count as equal if the hash of their anchor and their own hash agree,
128 bits in all that aren't linear in the bytes; all else is compared.

Defined cases: a null or empty text has no bytes and nothing removed; rows that
repeat an id are ordered by a hash of their text, and rows equal in both count as one
place; a null id comes after all others; an empty table gives an empty result;
other columns are ignored. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.columns import fan_outs, give_back, sliced, utf8_values
from docmill.llm.kernels import mixed, packed, prefix_hashes, span_hashes, unpacked
from docmill.session import Scratch, broadcast_if_small

MIN_LENGTH = 100
KGRAM = 32
#: Anchors that a task holds before it sends them, and that one range of the hash space gets, about.
ANCHORS_AT_ONCE = 1 << 19
RANGE_TEXT = 12 << 20
#: Context bytes of a block, about.
BLOCK_BYTES = 1 << 18
#: Bytes of text that are hashed together.
TEXT_BYTES = 1 << 18
#: Distinct contexts of an anchor that go to a block; in one task's entries or in all.
HOT_LOCAL, HOT = 256, 1024

NO_ID = np.iinfo(np.int64).max


def windowed(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over values[i : i + width], for all whole windows."""
    out, reach = values, 1
    while reach * 2 <= width:
        out = pick(out[:-reach], out[reach:])
        reach *= 2
    return pick(out[: len(out) - (width - reach)], out[width - reach :]) if width > reach else out


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, k: int):
    """Anchors of the texts data[starts:ends]: place, hash, first and last string start of each, and all prefix hashes."""
    prefixes = prefix_hashes(data)
    if len(data) < length:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none, prefixes
    at = np.arange(len(data) - k + 1)
    hashes = span_hashes(prefixes, at, at + k)
    keyed = hashes >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64)  # the first of equal hashes is least
    least = (windowed(keyed, length - k + 1, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    room = np.zeros(len(data) + 1, np.int32)
    whole = np.maximum(ends - starts - length + 1, 0)
    some = whole > 0
    np.add.at(room, starts[some], 1)
    np.add.at(room, starts[some] + whole[some], -1)
    strings = np.flatnonzero(np.cumsum(room[: len(least)]))
    least = least[strings]
    new = np.append(True, least[1:] != least[:-1]) if len(least) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1 if len(least) else first
    place = least[first]
    # least hashes start with zeros, so they are mixed anew to fill the ranges evenly
    return place, mixed(hashes[place]), strings[first], strings[last], prefixes


def text_blocks(texts: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of texts of about TEXT_BYTES together."""
    out, first, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= TEXT_BYTES:
            out.append((first, i + 1))
            first, size = i + 1, 0
    if first < len(texts):
        out.append((first, len(texts)))
    return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(texts), np.uint8), ends - sizes, ends


def first_of_equal(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Of rows in sorted order: whether each differs in any key from the one before."""
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
    return new


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs; touching spans join."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]]) if len(starts) else np.empty(0, bool)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1) if len(starts) else np.empty(0, np.int64)
    return starts[new], ends[last]


def entries(ids: np.ndarray, ties: np.ndarray, texts: list[bytes], length: int, k: int) -> dict[str, np.ndarray]:
    """All anchors of the texts: hash, context's hash, id, tie, context's start, end, anchor's offset in it."""
    parts = []
    for a, b in text_blocks(texts):
        data, starts, ends = joined(texts[a:b])
        place, hashes, left, right, prefixes = anchors(data, starts, ends, length, k)
        if not len(place):
            continue
        owner = np.searchsorted(ends, place, "right")
        right = right + length
        context = span_hashes(prefixes, left, right) + (place - left).astype(np.uint64)
        base = starts[owner]
        parts.append((hashes, context, ids[a:b][owner], ties[a:b][owner], left - base, right - base))
    names = ("anchor", "context", "id", "tie", "start", "end")
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)
    return {n: np.concatenate([p[i] for p in parts]) if parts else np.empty(0, kind) for i, (n, kind) in enumerate(zip(names, kinds))}


def found_rows(ids, ties, starts, ends, codes, keys=None) -> pa.RecordBatch:
    keys = pa.array(keys.view(np.int64)) if keys is not None else pa.nulls(len(ids), pa.int64())
    return pa.RecordBatch.from_arrays(
        [*(pa.array(x, pa.int64()) for x in (ids, ties, starts, ends)), pa.array(codes, pa.int8()), keys],
        names=["id", "tie", "start", "end", "code", "anchor"],
    )


FOUND = "id bigint, tie bigint, start bigint, end bigint, code tinyint, anchor bigint"
#: What found rows say of their span: covered; its text goes to a block; its strings go one by one.
COVERED, BLOCKED, SINGLY = 0, 1, 2


ENTRY = ("id", "tie", "start", "end", "anchor", "context")
SENT = "range bigint, sender bigint, " + ", ".join(f"{n} binary" for n in ENTRY)


def dealt(held: list[dict[str, np.ndarray]], ranges: int, sender: int, most: int) -> pa.RecordBatch:
    """Entries packed by range; those known here to be covered go to range -1, and contexts of an anchor beyond most and one to -2."""
    e = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
    order = np.lexsort((e["start"], e["tie"], e["id"], e["context"], e["anchor"]))
    new = first_of_equal(order, e["anchor"], e["context"])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    same = (e["id"][first] == e["id"][order]) & (e["tie"][first] == e["tie"][order]) & (e["start"][first] == e["start"][order])
    later = order[~new & ~same]
    out = [(-1, [packed(e[n][later]) for n in ("id", "tie", "start", "end")] + [None] * 2)]
    kept = order[new]
    # of an anchor with very many contexts here, only as many are sent as tell the others so
    nth = np.arange(len(kept)) - np.maximum.accumulate(np.where(first_of_equal(kept, e["anchor"]), np.arange(len(kept)), 0))
    over = kept[nth > most]
    out.append((-2, [packed(e[n][over]) for n in ("id", "tie", "start", "end")] + [None] * 2))
    kept = kept[nth <= most]
    # ranges is a power of two, and an anchor's first bits name its range; only ranges with anchors get a row
    dealt_to = e["anchor"][kept] >> np.uint64(65 - ranges.bit_length()) if ranges > 1 else np.zeros(len(kept), np.uint64)
    cuts = np.append(np.flatnonzero(np.append(True, dealt_to[1:] != dealt_to[:-1])), len(kept)) if len(kept) else np.zeros(1, np.int64)
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        some = kept[a:b]
        out.append((int(dealt_to[a]), [packed(e[n][some], rising=n == "anchor") for n in ENTRY]))
    return pa.RecordBatch.from_arrays(
        [pa.array([r for r, _ in out], pa.int64()), pa.array([sender] * len(out), pa.int64()), *(pa.array([x[i] for _, x in out], pa.binary()) for i in range(6))],
        names=["range", "sender", *ENTRY],
    )


def unpacked_entries(table: pa.Table) -> list[dict[str, np.ndarray]]:
    """The entries of each packed row."""
    columns = {n: [unpacked(x, rising=n == "anchor") for x in table.column(n).to_pylist()] for n in ENTRY}
    return [{n: c[i] if n in ("anchor", "context") else c[i].view(np.int64) for n, c in columns.items()} for i in range(table.num_rows)]


def local_entries(rows: DataFrame, ranges: int, length: int, k: int) -> DataFrame:
    """Packed entries by range of the anchors' hash space; spans that a task knows to be covered (range -1) or hot (-2)."""

    def run(batches):
        held, size, sender = [], 0, TaskContext.get().partitionId() << 32
        for batch in sliced(batches):
            ids, ties = (np.array(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in (0, 1))
            held.append(entries(ids, ties, utf8_values(batch.column(2)), length, k))
            size += len(held[-1]["anchor"])
            if size >= ANCHORS_AT_ONCE:
                yield dealt(held, ranges, sender, HOT_LOCAL)
                held, size, sender = [], 0, sender + 1
        if size:
            yield dealt(held, ranges, sender, HOT_LOCAL)
        held = []
        give_back()

    return rows.mapInArrow(run, SENT)


def dealt_on(sent: DataFrame, ranges: int, groups: int) -> DataFrame:
    """What a group of senders sent to a range, merged and dealt to the smaller ranges in it, as one sender would."""

    def run(table: pa.Table) -> pa.Table:
        out = pa.Table.from_batches([dealt(unpacked_entries(table), ranges, 0, HOT_LOCAL)])
        give_back()
        return out

    own = sent.where("range >= 0").withColumn("sender", F.pmod(F.xxhash64("sender"), F.lit(groups)))
    return own.groupBy("range", "sender").applyInArrow(run, SENT)


def settled(packed_rows: DataFrame) -> DataFrame:
    """Spans that tasks have settled themselves."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                i, t, s, e = (unpacked(batch.column(c)[row].as_py()).view(np.int64) for c in ("id", "tie", "start", "end"))
                code = COVERED if batch.column("range")[row].as_py() == -1 else SINGLY
                yield found_rows(i, t, s, e, np.full(len(i), code, np.int8))

    return packed_rows.where("range < 0").select("range", "id", "tie", "start", "end").mapInArrow(run, FOUND)


def met_contexts(packed_rows: DataFrame) -> DataFrame:
    """Spans by what is to be done: later equal contexts are covered, first ones of shared anchors go on."""

    def run(table: pa.Table) -> pa.Table:
        parts, local = unpacked_entries(table), []
        e = {n: np.concatenate([p[n] for p in parts]) for n in ENTRY}
        for p in parts:
            distinct, times = np.unique(p["anchor"], return_counts=True)
            local.append(distinct[times > HOT_LOCAL])
        del parts
        order = np.lexsort((e["start"], e["tie"], e["id"], e["context"], e["anchor"]))
        new = first_of_equal(order, e["anchor"], e["context"])
        anchor = np.cumsum(first_of_equal(order, e["anchor"])) - 1
        contexts = np.bincount(anchor[new])
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        same = (e["id"][first] == e["id"][order]) & (e["tie"][first] == e["tie"][order]) & (e["start"][first] == e["start"][order])
        later = order[~new & ~same]
        many = contexts[anchor] > 1
        hot = (contexts[anchor] > HOT) | np.isin(e["anchor"][order], np.concatenate(local))
        on, single = order[new & many & ~hot], order[new & many & hot]
        whole = np.concatenate([later, on, single])
        codes = np.repeat(np.array([COVERED, BLOCKED, SINGLY], np.int8), [len(later), len(on), len(single)])
        give_back()
        return pa.Table.from_batches([found_rows(e["id"][whole], e["tie"][whole], e["start"][whole], e["end"][whole], codes, e["anchor"][whole])])

    return packed_rows.where("range >= 0").groupBy("range").applyInArrow(run, FOUND)


def by_document(found: DataFrame) -> DataFrame:
    """id, tie and the spans (start, end, code, anchor) of each document."""
    return found.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "end", "code", "anchor")).alias("spans"))


def span_arrays(cell) -> tuple[np.ndarray, ...]:
    spans = cell.values
    return tuple(spans.field(n).fill_null(0).to_numpy(zero_copy_only=False) for n in ("start", "end", "code", "anchor"))


def contexts_and_strings(near: DataFrame, length: int, blocks: int) -> DataFrame:
    """Texts of contexts for the blocks, and hashes of single strings, of documents with their spans."""

    def run(batches):
        for batch in sliced(batches):
            texts = utf8_values(batch.column(2))
            out: list[tuple] = []
            singles = []
            for row, text in enumerate(texts):
                who = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                starts, ends, codes, keys = span_arrays(batch.column(3)[row])
                for i in np.flatnonzero(codes == BLOCKED).tolist():
                    out.append((int(keys[i]) % blocks, *who, int(starts[i]), text[starts[i] : ends[i]]))
                want = codes == SINGLY
                if want.any():
                    a, b = merged(starts[want], ends[want])
                    at = np.concatenate([np.arange(x, y - length + 1) for x, y in zip(a, b)])
                    hashes = span_hashes(prefix_hashes(np.frombuffer(text, np.uint8)), at, at + length)
                    singles.append((hashes, np.full(len(at), who[0]), np.full(len(at), who[1]), at))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())],
                    names=["key", "id", "tie", "start", "text"],
                )
            if singles:
                h, i, t, s = (np.concatenate(x) for x in zip(*singles))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(i, pa.int64()), pa.array(t, pa.int64()), pa.array(s, pa.int64()), pa.nulls(len(h), pa.binary())],
                    names=["key", "id", "tie", "start", "text"],
                )

    return near.select("id", "tie", "text", "spans").mapInArrow(run, "key bigint, id bigint, tie bigint, start bigint, text binary")


def sorted_suffixes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Places of the suffixes in order of their first length symbols, or more: packed symbols, then doubling."""
    n = len(symbols)
    used = np.zeros(int(symbols.max()) + 1, np.int64)
    used[symbols] = 1
    dense = np.cumsum(used)[symbols].astype(np.uint64)  # from 1; 0 is past the end
    bits = int(used.sum()).bit_length()
    reach = max(1, min(64 // bits, length, n))
    key = np.zeros(n, np.uint64)
    for i in range(reach):
        key <<= np.uint64(bits)
        key[: n - i] |= dense[i:]
    shift = np.uint64((n + 1).bit_length())
    while True:
        order = np.argsort(key)
        ranked = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
        if reach >= length or ranked[-1] == n - 1:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = ranked
        key = rank << shift
        key[: n - reach] |= rank[reach:] + np.uint64(1)
        reach *= 2


def long_borders(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and at each border to the one before whether they share length symbols or more.

    Level by level, every interval of suffixes that start with one string of l
    symbols is extended backward by each symbol before them. The interval of the
    extended string ends at a border; if that is unset, its common prefix is l,
    and the interval is extended in its turn. Borders unset at the end share length.
    """
    n = len(symbols)
    order = sorted_suffixes(symbols, length)
    before = symbols[order - 1].astype(np.int64)  # the transform
    to = np.empty(n, np.int64)
    to[np.argsort(before, kind="stable")] = np.arange(n)  # backward steps keep the order of equal symbols
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(low):
            break
        sizes = high - low
        own = np.repeat(np.arange(len(low)), sizes)
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        landed = np.sort(own * (n + 1) + to[inside])
        symbol = symbols[order[landed % (n + 1)]].astype(np.int64)
        group = landed // (n + 1) * 512 + symbol
        last = np.append(group[1:] != group[:-1], True)
        start = np.concatenate([[True], last[:-1]])
        low, high = landed[start] % (n + 1), landed[last] % (n + 1) + 1
        fresh = unset[high]
        low, high = low[fresh], high[fresh]
        unset[high] = False
        if not unset.any():
            break
    return order, unset[:n]


def block_repeats(table: pa.Table, length: int) -> pa.Table:
    """Covered strings among a block's contexts."""
    texts = utf8_values(table.column("text"))
    ids, ties, starts = (table.column(c).to_numpy() for c in ("id", "tie", "start"))
    sizes = np.array([len(t) for t in texts]) + 1
    ends = np.cumsum(sizes) - 1
    data = np.frombuffer(b"\0".join([*texts, b"\0"]), np.uint8).astype(np.int64) + 2
    data[ends], data[-1] = 1, 0  # separators, then one end below all
    order, shared = long_borders(data, length)
    owner = np.minimum(np.searchsorted(ends, order, "left"), len(ends) - 1)
    whole = ends[owner] - order >= length
    # runs of suffixes with a common prefix of length; those too short share only what follows a separator
    run = np.cumsum(~shared)[whole]
    order, owner = order[whole], owner[whole]
    at = starts[owner] + order - (ends[owner] - sizes[owner] + 1)
    i, t = ids[owner], ties[owner]
    by = np.lexsort((at, t, i, run))
    new = first_of_equal(by, run)
    first = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else by
    later = by[(i[first] != i[by]) | (t[first] != t[by]) | (at[first] != at[by])]
    give_back()
    return pa.Table.from_batches([found_rows(i[later], t[later], at[later], at[later] + length, np.full(len(later), COVERED, np.int8))])


def single_repeats(singles: DataFrame, length: int) -> DataFrame:
    """Covered strings among those that meet by hash: all places but the least."""
    place = F.struct("id", "tie", "start")
    firsts = singles.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    later = singles.join(firsts.select("key", "first"), "key").where(place > F.col("first"))
    return later.select("id", "tie", "start", (F.col("start") + length).alias("end"), F.lit(COVERED).cast("tinyint").alias("code"), F.lit(None).cast("bigint").alias("anchor"))


def remaining(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """The text without the spans, the bytes removed and the maximal runs removed."""
    a, b = merged(starts, ends)
    kept, at = [], 0
    for x, y in zip(a.tolist(), b.tolist()):
        kept.append(text[at:x])
        at = y
    kept.append(text[at:])
    return b"".join(kept), int((b - a).sum()), len(a)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = MIN_LENGTH,
    k: int = KGRAM,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, kept (the bytes left), n_bytes, n_removed and n_spans of every document."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(int(NO_ID))))
    again = scratch.table(rows.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("again")), "again")
    if again.limit(1).count():
        rows = rows.join(broadcast_if_small(again, 16), "id", "left")
        rows = rows.withColumn("tie", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    else:
        rows = rows.withColumn("tie", F.lit(0).cast("long"))
    rows = rows.select("id", "tie", "text", "doc_id")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << (size // RANGE_TEXT).bit_length()
    first, groups = fan_outs(ranges)
    sent = scratch.table(local_entries(rows.select("id", "tie", "text"), first, length, k), "entries")
    known, last = settled(sent), sent
    if groups > 1:
        last = scratch.table(dealt_on(sent, ranges, groups), "entries-on")
        known = known.unionByName(settled(last))
    found = scratch.table(known.unionByName(met_contexts(last)), "found")
    open_spans = scratch.table(by_document(found.where(F.col("code") != COVERED)), "open")
    context_bytes = found.where(F.col("code") == BLOCKED).agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    blocks = max(1, context_bytes // block_bytes)
    joined_rows = rows.select("id", "tie", "text").join(open_spans, ["id", "tie"])
    pieces = scratch.table(contexts_and_strings(joined_rows, length, int(blocks)), "pieces")
    blocked = pieces.where(F.col("text").isNotNull()).groupBy("key").applyInArrow(lambda t: block_repeats(t, length), FOUND)
    blocked = scratch.table(blocked, "blocked")  # else two Python workers a task stand side by side
    singles = single_repeats(pieces.where(F.col("text").isNull()).drop("text"), length)
    covered = found.where(F.col("code") == COVERED).unionByName(blocked).unionByName(singles)
    covered = scratch.table(packed_spans(covered), "covered")
    whole = rows.join(broadcast_if_small(covered, 64, more=F.octet_length("spans")), ["id", "tie"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in sliced(batches, 200):
            texts = utf8_values(batch.column(1))
            spans = batch.column(2).to_pylist()
            out = []
            for text, own in zip(texts, spans):
                pair = unpacked(own).view(np.int64).reshape(2, -1) if own else np.empty((2, 0), np.int64)
                kept, removed, n = remaining(text, pair[0], pair[1])
                out.append((kept, len(text), removed, n))
            kept, *numbers = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in numbers)],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    return whole.mapInArrow(run, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


def packed_spans(covered: DataFrame) -> DataFrame:
    """id, tie and the document's covered runs, packed; runs are merged before and after they are dealt out."""
    schema = "id bigint, tie bigint, start bigint, end bigint"

    def merge(i: np.ndarray, t: np.ndarray, s: np.ndarray, e: np.ndarray):
        order = np.lexsort((s, t, i))
        i, t, s, e = i[order], t[order], s[order], e[order]
        bounds = np.flatnonzero(first_of_equal(np.arange(len(i)), i, t)).tolist() + [len(i)]
        for a, b in zip(bounds, bounds[1:]):
            yield i[a], t[a], *merged(s[a:b], e[a:b])

    def local(batches):
        for batch in batches:
            if batch.num_rows:
                parts = list(merge(*(batch.column(c).to_numpy() for c in ("id", "tie", "start", "end"))))
                n = [len(p[2]) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([p[0] for p in parts], n), pa.int64()), pa.array(np.repeat([p[1] for p in parts], n), pa.int64()), pa.array(np.concatenate([p[2] for p in parts]), pa.int64()), pa.array(np.concatenate([p[3] for p in parts]), pa.int64())],
                    names=["id", "tie", "start", "end"],
                )

    def whole(batches):
        held = [[np.empty(0, np.int64)] for _ in range(4)]
        for batch in batches:
            for h, c in zip(held, ("id", "tie", "start", "end")):
                h.append(batch.column(c).to_numpy())
        out = [(i, t, packed(np.concatenate([s, e]))) for i, t, s, e in merge(*(np.concatenate(h) for h in held))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())],
            names=["id", "tie", "spans"],
        )

    merged_rows = covered.select("id", "tie", "start", "end").mapInArrow(local, schema)
    parts = int(covered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return merged_rows.repartition(parts, "id", "tie").mapInArrow(whole, "id bigint, tie bigint, spans binary")


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings."""
    left = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op9_repeated_strings": op9_repeated_strings}
