"""Language identification by cross-parsing entropy.

A suffix automaton is built over labelled sample text of each language. A text
is parsed greedily into the longest phrases each automaton contains; phrases
times log2 of the sample's length, over the text's length, estimates the cross
entropy, and the language with the least wins. Sample and texts are folded by
one function. All texts of a batch step through all automata together, one byte
position at a time; long texts do so in pieces, and a second pass carries each
piece's last state into the next one until both parses agree, so the phrases are
those of the whole text.

Learned from a bounded sample: of each language about SAMPLE_DOCS labelled rows
by hash of id and text, twice as many at most, taken whole while they fit in
SAMPLE_BYTES, texts of few words last. A language whose rows are all longer than
that gives its shortest row, whole.

Defined cases: a null text or one without a letter is `und` with score 0; equal
estimates go to the smaller language name; with no labelled rows every text is
`und`; repeated rows get equal results and count once in the sample; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.llm.columns import ROWS, giving_back, id_type, map_texts, sliced

UNKNOWN = "und"
LETTER = r"\pL"

#: Bounds of the labelled sample: documents of a language, and its bytes in all.
SAMPLE_DOCS = 64
SAMPLE_BYTES = 24_000

#: Bytes of a text that step together; a longer text is parsed in pieces of this size that are joined again.
PIECE = 512
PIECES_AT_ONCE = 2048


def suffix_automaton(text: bytes) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Transitions, suffix links and longest lengths of the states of text's suffix automaton."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves, link, length


@dataclass
class CrossParser:
    """The automata of all languages in one table; row 0 of a language is its root."""

    languages: list[str]
    symbols: np.ndarray  # of a byte; the last symbol is in no sample
    table: np.ndarray  # next row by row * n_symbols + symbol, -1 if none
    roots: np.ndarray
    bits: np.ndarray  # of a phrase

    def step(self, state: np.ndarray, symbol: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a symbol, and the phrases it ends."""
        n = int(self.symbols.max()) + 1
        now = self.table[state * n + symbol]
        missed = now < 0
        ended = missed.astype(np.int32)
        if missed.any():
            now = np.where(missed, self.table[roots * n + symbol], now)
            stuck = now < 0  # a symbol that the sample lacks is a phrase of its own
            if stuck.any():
                ended += stuck & (state != roots)
                now = np.where(stuck, roots, now)
        return now, ended

    def parsed(self, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases ended and last states by piece and language; pieces: symbols by position, then piece, longest first."""
        counts = np.zeros((len(lengths), len(self.languages)), np.int32)
        state = np.repeat(self.roots[None, :], len(lengths), axis=0)
        active = len(lengths)
        for row in range(pieces.shape[0]):
            while active and lengths[active - 1] <= row:
                active -= 1
            if not active:
                break
            state[:active], ended = self.step(state[:active], pieces[row, :active, None], self.roots)
            counts[:active] += ended
        return counts, state

    def carried(self, pieces: np.ndarray, lengths: np.ndarray, counts: np.ndarray, state: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Corrects counts and state of pieces that start in the states before; whether each parse met the piece's own."""
        width = len(self.languages)
        piece, kind = np.divmod(np.arange(before.size), width)
        a, b, roots = self.roots[kind], before.ravel(), self.roots[kind]
        more = np.zeros(len(b), np.int32)
        whole = np.zeros(len(b), np.int32)
        met = a == b
        alive = np.flatnonzero(~met)
        for row in range(pieces.shape[0]):
            ends = lengths[piece[alive]] <= row
            if ends.any():
                alive = alive[~ends]
            if not len(alive):
                break
            symbol = pieces[row, piece[alive]]
            own, ended = self.step(a[alive], symbol, roots[alive])
            real, ended_too = self.step(b[alive], symbol, roots[alive])
            more[alive] += ended_too - ended
            whole[alive] += ended_too
            a[alive], b[alive] = own, real
            now = own == real
            met[alive[now]] = True
            alive = alive[~now]
        met, more, whole, b = (x.reshape(before.shape) for x in (met, more, whole, b))
        counts[:] = np.where(met, counts + more, whole)
        state[:] = np.where(met, state, b)
        return met

    def phrases(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrase counts of the texts raw[starts : starts + sizes] by text and language."""
        n_pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(sizes)), n_pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        start = starts[owner] + within * PIECE
        length = np.minimum(PIECE, (starts + sizes)[owner] - start)
        counts = np.zeros((len(owner), len(self.languages)), np.int32)
        state = np.zeros_like(counts)

        def blocks(chosen: np.ndarray):
            chosen = chosen[np.argsort(-length[chosen], kind="stable")]
            for at in range(0, len(chosen), PIECES_AT_ONCE):
                some = chosen[at : at + PIECES_AT_ONCE]
                places = np.minimum(start[some][None, :] + np.arange(int(length[some[0]]))[:, None], max(len(raw) - 1, 0))
                yield some, self.symbols[raw[places]]

        for some, symbols in blocks(np.arange(len(owner))):
            counts[some], state[some] = self.parsed(symbols, length[some])
        last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.empty(0, bool)
        lost = np.zeros(len(sizes), bool)
        before = np.roll(state, 1, axis=0)
        for some, symbols in blocks(np.flatnonzero(within > 0)):
            own, end = counts[some], state[some]
            met = self.carried(symbols, length[some], own, end, before[some])
            counts[some], state[some] = own, end
            lost[owner[some[~met.all(axis=1) & ~last[some]]]] = True
        totals = np.zeros((len(sizes), len(self.languages)), np.int64)
        np.add.at(totals, owner, counts + ((state != self.roots) & last[:, None]))
        for text in np.flatnonzero(lost):  # a parse that stays out of step for a whole piece, as periodic text may make it
            totals[text] = self.one_by_one(self.symbols[raw[starts[text] : starts[text] + sizes[text]]])
        return totals

    def one_by_one(self, symbols: np.ndarray) -> list[int]:
        """Phrase counts of one text by language."""
        n, table = int(self.symbols.max()) + 1, self.table
        out = []
        for root in self.roots.tolist():
            state, count = root, 0
            for c in symbols.tolist():
                to = int(table[state * n + c])
                if to < 0:
                    count += 1
                    to = int(table[root * n + c])
                    if to < 0:
                        count += state != root
                        to = root
                state = to
            out.append(count + (state != root))
        return out


def build_parser(samples: dict[str, bytes]) -> CrossParser:
    """A parser of the languages that have sample text."""
    languages = sorted(x for x in samples if samples[x])
    used = sorted(set(b"".join(samples[x] for x in languages)))
    symbols = np.full(256, len(used), np.int32)
    symbols[used] = np.arange(len(used))
    n = len(used) + 1
    parts, roots, base = [], [], 0
    for language in languages:
        moves, _, _ = suffix_automaton(samples[language])
        part = np.full((len(moves), n), -1, np.int32)
        for state, out in enumerate(moves):
            for c, to in out.items():
                part[state, symbols[c]] = to + base
        parts.append(part)
        roots.append(base)
        base += len(moves)
    table = np.concatenate(parts).ravel() if parts else np.empty(0, np.int32)
    bits = np.array([math.log2(len(samples[x]) + 1) for x in languages])
    return CrossParser(languages, symbols, table, np.array(roots, np.int32), bits)


def folded(texts: pa.Array) -> pa.Array:
    """UTF-8 texts in lower case, with every run of other than letters and marks as one space; null is empty."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    return pc.replace_substring_regex(lowered, pattern=r"[^\pL\pM]+", replacement=" ").cast(pa.large_binary())


def predict(parser: CrossParser, texts: pa.Array) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    seen = np.array(pc.fill_null(pc.match_substring_regex(texts, LETTER), False).to_pylist(), bool)
    if not parser.languages or not seen.any():
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    data = folded(texts)
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    sizes = np.where(seen, np.diff(offsets), 0)
    bits = parser.phrases(raw, offsets[:-1], sizes) * parser.bits / np.maximum(sizes, 1)[:, None]
    best = np.argmin(bits, axis=1)
    least = bits[np.arange(len(bits)), best]
    others = np.where(np.arange(len(parser.languages))[None, :] == best[:, None], np.inf, bits).min(axis=1)
    margin = 1 - np.divide(least, others, out=np.zeros(len(bits)), where=others > 0)
    names = [parser.languages[b] if s else UNKNOWN for b, s in zip(best, seen)]
    return names, np.where(seen, np.clip(margin, 0.0, 1.0), 0.0).tolist()


def sampled_rows(rows: DataFrame) -> list:
    """lang, place and text of a bounded sample of distinct rows (id, lang, text), by language and place."""
    fits = F.octet_length("text") <= SAMPLE_BYTES
    counts = rows.groupBy("lang").agg(F.count(F.when(fits, 1)).alias("n"), F.min(F.octet_length("text")).alias("least")).collect()
    if not counts:
        return []
    place = F.pmod(F.xxhash64("id", "text", F.lit("language sample")), F.lit(1 << 40))
    limits = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], int((1 << 40) * min(1.0, SAMPLE_DOCS / max(r["n"], 1))))))
    chosen = fits & (place < limits[F.col("lang")])
    for r in counts:
        if not r["n"]:
            chosen = chosen | ((F.col("lang") == r["lang"]) & (F.octet_length("text") == r["least"]))
    near = rows.where(chosen).groupBy("lang", place.alias("place")).agg(F.first("text").alias("text"))
    by = Window.partitionBy("lang").orderBy("place")
    return near.withColumn("r", F.row_number().over(by)).where(F.col("r") <= 2 * SAMPLE_DOCS).collect()


def labelled_sample(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> dict[str, bytes]:
    """Bounded text of each language, in whole rows.

    Texts of few words come last, so they count where words aren't spaced or others don't fill the bounds.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found: dict[str, list[bytes]] = {}
    for r in sorted(sampled_rows(rows.where("lang is not null and text is not null")), key=lambda r: (r["lang"], len(set(r["text"].split())) <= 5, r["place"])):
        own = found.setdefault(r["lang"], [])
        text = pa.array([r["text"]])
        new = folded(text)[0].as_py()
        if pc.match_substring_regex(text, LETTER)[0].as_py() and (not own or sum(map(len, own)) + len(own) + len(new) <= SAMPLE_BYTES):
            own.append(new)
    return {k: b" ".join(v) for k, v in found.items()}


def identify_language(
    docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = predict(shared.value, batch.column(1))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            names=["doc_id", "lang_pred", "score"],
        )

    return map_texts(docs, run, f"doc_id {id_type(docs, id_col)}, lang_pred string, score double", id_col, text_col)


def identified_only(docs: DataFrame, parser: CrossParser, text_col: str = "text") -> DataFrame:
    """The rows of docs in some learned language, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in sliced(batches, ROWS):
            names, _ = predict(shared.value, batch.column(at))
            yield batch.filter(pa.array([n != UNKNOWN for n in names], pa.bool_()))

    return docs.mapInArrow(giving_back(run), docs.schema)


def fitted_parser(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> CrossParser:
    """A parser learned from a bounded sample of the labelled rows that are not held out."""
    return build_parser(labelled_sample(docs.where(~held_out(id_col)), id_col, text_col, lang_col))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify_language(docs, fitted_parser(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
