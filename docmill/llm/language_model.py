"""Language-model scores by deleted interpolation.

A trigram model: maximum-likelihood estimates of the trigram, the bigram, the
word and the uniform distribution are mixed by weights that depend on how often
the context was seen, in powers of two: the context of two tokens if training
has it, else that of one. Expectation-maximisation learns the weights on the
training tokens, each held out of its own counts.

Counts never meet in one table of all words. Documents are put in chunks of
some megabytes; each chunk asks for its distinct n-grams, as sorted hashes cut
into ranges of the hash space; each range adds up what all chunks hold and
answers each in the order of its question; the answers come back to the chunk.
What moves is a few bytes a distinct n-gram and chunk, and a word in every
document is one entry a chunk; a chunk has a row for each range that it asks.
Beyond 16,384 ranges a chunk asks larger ones, a group of chunks adds up what it
asks of each, and the group asks the smaller ranges in it as one chunk would; so
rows grow with the power 1.5 of the input. Hashes of bigrams and trigrams are as wide as
the input's size asks for, so that a clash has a chance below 2**-20 for a bigram
and 2**-12 for a trigram; word hashes have 64 bits.

Defined cases: a null or empty text is its end token alone; a null id counts as
a training row; repeated rows are counted and scored each; no training rows
leave the uniform distribution; an empty table gives an empty result; other
columns are ignored; a text is never cut, so a very long one is a chunk of its own.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.columns import fan_outs, give_back, id_type, utf8_values
from docmill.llm.kernels import mixed, packed, unpacked, word_hashes
from docmill.session import Scratch

CHUNK_BYTES = 8 << 20
#: Text whose n-grams one range of the hash space answers, about.
RANGE_BYTES = 8 << 20
#: Bits of bigram and trigram hashes beyond those that number all bytes of the input, and the fewest in all.
SPARE_BITS, LEAST_BITS = (20, 12), 40

END = np.uint64(0x5E6D0C3A9B1F2487)
START = np.uint64(0x1C7A4E93D05B86F3)
ADDED = 0.1

#: Steps of the logarithm, a doubling, in which the ratios of estimates are counted for the weights.
STEPS = 2
#: Ratios that a code can name, and the code of none; buckets of contexts of two tokens, then those of one.
RATIOS, NONE = 4096, -1000
ONE_TOKEN = 64
ITERATIONS = 60
LEAST_WEIGHT = 1e-6


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def token_arrays(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words, then END), of their contexts, and tokens by text."""
    words, counts = word_hashes(texts)
    sizes = counts + 1
    tokens = np.full(int(sizes.sum()), END, np.uint64)
    ends = np.cumsum(sizes) - 1
    is_word = np.ones(len(tokens), bool)
    is_word[ends] = False
    tokens[is_word] = words
    contexts = np.empty_like(tokens)
    contexts[1:] = tokens[:-1]
    contexts[ends - sizes + 1] = START
    return tokens, contexts, sizes


def ngram_keys(tokens: np.ndarray, contexts: np.ndarray, sizes: np.ndarray, bits: tuple[int, int]) -> list[tuple[np.ndarray, int]]:
    """Hashes of the words, bigrams and trigrams that end at each token, and their bits; texts start with two START."""
    pairs = mixed(contexts * np.uint64(0xD6E8FEB86659FD93) + tokens)
    earlier = np.empty_like(contexts)
    earlier[1:] = contexts[:-1]
    earlier[np.cumsum(sizes) - sizes] = START
    triples = mixed(earlier * np.uint64(0xA0761D6478BD642F) + pairs)
    return [(tokens, 64), (pairs >> np.uint64(64 - bits[0]), bits[0]), (triples >> np.uint64(64 - bits[1]), bits[1])]


def distinct_counts(keys: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, how many are counted, and each key's place among them."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place[counted], minlength=len(distinct)).astype(np.uint64), place


def range_numbers(distinct: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """The range of each sorted hash; ranges is a power of two."""
    if ranges == 1:
        return np.zeros(len(distinct), np.int64)
    return (distinct >> np.uint64(bits + 1 - ranges.bit_length())).astype(np.int64)


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue()


def from_bytes(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (chunk, data): documents (doc_id, text, held_out) packed together up to about chunk_bytes of text."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        waiting, size = [], 0

        def flush():
            nonlocal waiting, size, number
            whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()
            for batch in whole:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task << 32 | number], pa.int64()), pa.array([to_bytes(batch)], pa.binary())], names=["chunk", "data"]
                )
                number += 1
            waiting, size = [], 0

        for batch in batches:
            lengths = np.array([len(x) for x in utf8_values(batch.column(1))])
            ends, at = np.cumsum(lengths), 0
            while at < len(lengths):
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + chunk_bytes - size, "right")))
                waiting.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at = to
                if size >= chunk_bytes or at < len(lengths):
                    yield from flush()
        if waiting:
            yield from flush()

    return docs.mapInArrow(run, "chunk bigint, data binary")


KINDS = ("words", "bigrams", "trigrams")


def counted_chunk(data: bytes):
    """A chunk's batch, its tokens, their contexts, tokens by text, and which tokens are for training."""
    batch = from_bytes(data)
    tokens, contexts, sizes = token_arrays(utf8_values(batch.column(1)))
    training = np.repeat(~np.array(batch.column(2).to_pylist(), bool), sizes)
    return batch, tokens, contexts, sizes, training


NAMES = [n for k in KINDS for n in (k, f"{k}_counts")]
QUESTION = "range bigint, chunk bigint, " + ", ".join(f"{n} binary" for n in NAMES)
ANSWER = "chunk bigint, range bigint, " + ", ".join(f"{k}_counts binary" for k in KINDS) + ", n_types bigint, n_tokens bigint"


def dealt(own: list[tuple[np.ndarray, np.ndarray]], ranges: int, widths: list[int], chunk: int) -> pa.RecordBatch:
    """One row for each range that the sorted n-grams of all kinds are in, with them and their counts."""
    numbers = [range_numbers(distinct, ranges, width) for (distinct, _), width in zip(own, widths)]
    asked = np.unique(np.concatenate([np.unique(r) for r in numbers]))
    out = []
    for (distinct, counts), r in zip(own, numbers):
        cuts = list(zip(np.searchsorted(r, asked, "left").tolist(), np.searchsorted(r, asked, "right").tolist()))
        out += [[packed(distinct[a:b], rising=True) for a, b in cuts], [packed(counts[a:b]) for a, b in cuts]]
    return pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array([chunk] * len(asked), pa.int64()), *(pa.array(x, pa.binary()) for x in out)], names=["range", "chunk", *NAMES])


def questions(chunks: DataFrame, ranges: int, bits: tuple[int, int]) -> DataFrame:
    """One row a chunk and range that it asks: its n-grams there, with their training counts."""

    def run(batches):
        for rows in batches:
            for chunk, data in zip(rows.column(0).to_pylist(), rows.column(1)):
                _, tokens, contexts, sizes, training = counted_chunk(data.as_py())
                keys = ngram_keys(tokens, contexts, sizes, bits)
                yield dealt([distinct_counts(k, training)[:2] for k, _ in keys], ranges, [w for _, w in keys], chunk)
        give_back()

    return chunks.mapInArrow(run, QUESTION)


def added_up(keys: pa.ChunkedArray, counts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of all rows in order, their summed counts, each n-gram's place among them, and where rows end."""
    parts = [unpacked(k.as_py(), rising=True) for k in keys]
    distinct, place = np.unique(np.concatenate(parts), return_inverse=True)
    sums = np.zeros(len(distinct), np.uint64)
    np.add.at(sums, place, np.concatenate([unpacked(c.as_py()) for c in counts]))
    return distinct, sums, place, np.cumsum([len(p) for p in parts])[:-1]


def answers(asked: DataFrame) -> DataFrame:
    """One row a chunk and range: the corpus counts, in the question's order; n_types and n_tokens once a range."""

    def total(keys: pa.ChunkedArray, counts: pa.ChunkedArray) -> tuple[list[bytes], int, int]:
        _, sums, place, cuts = added_up(keys, counts)
        return [packed(x) for x in np.split(sums[place], cuts)], int((sums > 0).sum()), int(sums.sum())

    def run(table: pa.Table) -> pa.Table:
        found = [total(table.column(k), table.column(f"{k}_counts")) for k in KINDS]
        once = [1] + [0] * (table.num_rows - 1)
        out = pa.table(
            {
                "chunk": table.column("chunk"),
                "range": table.column("range"),
                **{f"{k}_counts": pa.array(x[0], pa.binary()) for k, x in zip(KINDS, found)},
                "n_types": pa.array([found[0][1] * x for x in once], pa.int64()),
                "n_tokens": pa.array([found[0][2] * x for x in once], pa.int64()),
            }
        )
        del found
        give_back()
        return out

    return asked.groupBy("range").applyInArrow(run, ANSWER)


def asked_on(asked: DataFrame, ranges: int, bits: tuple[int, int]) -> DataFrame:
    """What a group of chunks asks of a range, added up and dealt to the smaller ranges in it, as one chunk (the group) would."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own = [added_up(table.column(k), table.column(f"{k}_counts"))[:2] for k in KINDS]
        out = pa.Table.from_batches([dealt(own, ranges, [64, *bits], key[1].as_py())])
        del own
        give_back()
        return out

    return asked.drop("chunk").groupBy("range", "group").applyInArrow(run, QUESTION)


def answered_back(asked: DataFrame, found: DataFrame) -> DataFrame:
    """The answers to a group (range, group; the smaller ranges as part), dealt back to its chunks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        out = {"chunk": left.column("chunk"), "range": left.column("range")}
        for k in KINDS:
            *_, place, cuts = added_up(left.column(k), left.column(f"{k}_counts"))
            total = np.concatenate([unpacked(x.as_py()) for x in right.column(f"{k}_counts")])
            out[f"{k}_counts"] = pa.array([packed(x) for x in np.split(total[place], cuts)], pa.binary())
        none = pa.array([0] * left.num_rows, pa.int64())
        give_back()
        return pa.table(out | {"n_types": none, "n_tokens": none})

    return asked.groupBy("range", "group").cogroup(found.groupBy("range", "group")).applyInArrow(run, ANSWER)


def exchanged(chunks: DataFrame, ranges: int, bits: tuple[int, int], scratch: Scratch) -> tuple[DataFrame, int, int]:
    """answers() to all chunks, the corpus' distinct words and its tokens; through groups of chunks if there are very many ranges."""
    first, groups = fan_outs(ranges)
    asked = questions(chunks, first, bits)
    if groups > 1:
        asked = scratch.table(asked.withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups))), "asked")
    answered = scratch.table(answers(asked_on(asked, ranges, bits) if groups > 1 else asked), "answers")
    totals = answered.agg(F.coalesce(F.sum("n_types"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    if groups > 1:
        shift = (ranges // first).bit_length() - 1
        named = answered.withColumnRenamed("chunk", "group").withColumnRenamed("range", "part").withColumn("range", F.shiftright("part", shift))
        answered = scratch.table(answered_back(asked, named), "answers-back")
    return answered, int(totals[0]), int(totals[1])


def counted(chunks: DataFrame, answered: DataFrame, bits: tuple[int, int], n_tokens: int, n_types: int, kind: str) -> DataFrame:
    """One row a document: its tokens' corpus counts, its base score and counts of tokens."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = right.sort_by("range")
        batch, tokens, contexts, sizes, _ = counted_chunk(left.column("data")[0].as_py())
        first = np.cumsum(sizes) - sizes
        own = []
        for k, (keys, _) in zip(KINDS, ngram_keys(tokens, contexts, sizes, bits)):
            total = np.concatenate([unpacked(x.as_py()) for x in found.column(f"{k}_counts")])
            distinct, place = np.unique(keys, return_inverse=True)
            own.append(total[place].astype(np.int64))
            if k == "words":
                starts = int(total[np.searchsorted(distinct, END)])  # texts start as often as they end
            del total, distinct, place
        words, pairs, triples = own
        base = np.log10((words + ADDED) / (n_tokens + ADDED * (n_types + 1)))
        once = np.array([starts])
        cuts = zip(first.tolist(), (first + sizes).tolist())
        out = pa.table(
            {
                "doc_id": batch.column(0),
                "held_out": batch.column(2),
                "n_tokens": pa.array(sizes, pa.int64()),
                "n_known": pa.array(np.add.reduceat((words > 0).astype(np.int64), first), pa.int64()),
                "base_score": pa.array(np.add.reduceat(base, first)),
                "counts": pa.array([packed(np.concatenate([words[a:b], pairs[a:b], triples[a:b], once])) for a, b in cuts], pa.binary()),
            }
        )
        del own, words, pairs, triples
        give_back()
        return out

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, counts binary"
    return chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(run, schema)


def estimates(counts: bytes, n_tokens: int, n_types: int, deleted: int) -> tuple[np.ndarray, np.ndarray]:
    """Context buckets and the trigram, bigram, word and uniform estimates; deleted (0 or 1) is taken off each count."""
    values = unpacked(counts).astype(np.int64)
    starts, (words, pairs, triples) = values[-1:], values[:-1].reshape(3, -1) - deleted
    before = np.concatenate([starts - deleted, words[:-1]])
    two_before = np.concatenate([starts - deleted, pairs[:-1]])

    def ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.maximum(np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0), 0.0)

    def bucket(count: np.ndarray) -> np.ndarray:
        return np.frexp(np.maximum(count, 0).astype(float))[1]

    word = np.maximum(words / max(1, n_tokens - deleted), 0.0)
    found = np.stack([ratio(triples, two_before), ratio(pairs, before), word, np.full(len(word), 1 / (n_types + 1))], axis=1)
    return np.where(two_before > 0, bucket(two_before), ONE_TOKEN + bucket(before)), found


def code_of(bucket: np.ndarray, found: np.ndarray) -> np.ndarray:
    """One number for a bucket and the ratios of estimates to the uniform one, in steps of the logarithm."""
    code = bucket.astype(np.int64)
    for part in (found[:, :-1] / found[:, -1:]).T:
        step = np.full(len(part), NONE, np.int64)
        step[part > 0] = np.rint(STEPS * np.log2(part[part > 0])).astype(np.int64)
        code = code * RATIOS + step + RATIOS // 2
    return code


def ratios_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the ratios, that of the uniform estimate (1) last."""
    ratios = [np.ones(len(code))]
    for _ in range(3):
        step = code % RATIOS - RATIOS // 2
        ratios.insert(0, np.where(step == NONE, 0.0, np.exp2(step / STEPS)))
        code = code // RATIOS
    return code, np.stack(ratios, axis=1)


def ratio_counts(rows: DataFrame, n_tokens: int, n_types: int) -> DataFrame:
    """How many training tokens have which context bucket and ratios of estimates to the uniform one.

    There are some 100 buckets, and a ratio has STEPS values for each doubling
    between 1 and the corpus' tokens, so the rows are bounded by their product
    and in practice some ten thousands, whatever the input.
    """

    def run(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            for data in batch.column(0):
                code = code_of(*estimates(data.as_py(), n_tokens, n_types, 1))
                for c, n in zip(*(x.tolist() for x in np.unique(code, return_counts=True))):
                    seen[c] = seen.get(c, 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["code", "n"]
        )

    own = rows.where(~F.col("held_out")).select("counts").mapInArrow(run, "code bigint, n bigint")
    return own.groupBy("code").agg(F.sum("n").alias("n"))


def learned_weights(found: list[tuple[int, int]], iterations: int = ITERATIONS) -> dict[int, tuple[float, ...]]:
    """Weights of the trigram, bigram, word and uniform estimates by bucket; -1 holds those of all buckets together."""
    if not found:
        return {-1: (1 / 4,) * 4}
    code, n = (np.array(x, np.int64) for x in zip(*sorted(found)))
    buckets, ratios = ratios_of(code)

    def fitted(rows: np.ndarray) -> tuple[float, ...]:
        weights = np.full(4, 1 / 4)
        for _ in range(iterations):
            share = ratios[rows] * weights
            share /= share.sum(axis=1, keepdims=True)
            weights = (share * n[rows, None]).sum(axis=0) / n[rows].sum()
        weights = np.maximum(weights, LEAST_WEIGHT)
        return tuple(weights / weights.sum())

    return {-1: fitted(np.arange(len(code)))} | {int(b): fitted(np.flatnonzero(buckets == b)) for b in np.unique(buckets)}


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    chunks = scratch.table(chunked(rows), "chunks")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = 1 << (size // RANGE_BYTES).bit_length()
    bits = tuple(min(64, max(LEAST_BITS, size.bit_length() + more)) for more in SPARE_BITS)
    answered, n_types, n_tokens = exchanged(chunks, ranges, bits, scratch)
    kind = id_type(docs, id_col)
    found = scratch.table(counted(chunks, answered, bits, n_tokens, n_types, kind), "counted")
    weights = learned_weights([(r["code"], r["n"]) for r in ratio_counts(found, n_tokens, n_types).collect()])
    table = np.array([weights.get(b, weights[-1]) for b in range(2 * ONE_TOKEN + 1)])

    def run(batches):
        for batch in batches:
            scores = []
            for data in batch.column(5):
                bucket, found = estimates(data.as_py(), n_tokens, n_types, 0)
                scores.append(float(np.log10((table[bucket] * found).sum(axis=1)).sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([n_tokens] * batch.num_rows, pa.int64()), batch.column(4), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return found.mapInArrow(run, schema)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language-model score of every document."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_language_model": op8_language_model}
