"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a byte trie. Each node has a failure link and the number of
pieces that are popped on following it, so a word's piece count comes from one
pass over its bytes and no piece is built. A word is a run of other than ASCII
white space; it is matched with `lead` before it, as vocabularies mark word
starts.

Defined cases: a null or empty text has no words and no tokens; a word that the
vocabulary can't spell counts as one token; very long words are counted but not
remembered; repeated rows get equal results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docmill.llm.columns import id_type, map_texts, utf8_values

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Words whose counts a task remembers, and bytes of such a word; beyond that it starts afresh.
REMEMBERED = 1 << 17
SHORT = 64


@dataclass
class PieceCounter:
    """Trie edges by node << 8 | byte; by node: failure link (-1: none) and pieces popped on following it."""

    edges: dict[int, int]
    failure: list[int]
    popped: list[int]
    lead: bytes

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match split of lead + word; 1 if there is none."""
        edges, failure, popped = self.edges, self.failure, self.popped
        node = pieces = 0
        for c in self.lead + word:
            while (to := edges.get(node << 8 | c)) is None:
                pieces += popped[node]
                node = failure[node]
                if node < 0:
                    return 1
            node = to
        while node > 0:
            pieces += popped[node]
            node = failure[node]
        return pieces if node == 0 else 1


def build_counter(vocabulary: Iterable[bytes], lead: bytes = b" ") -> PieceCounter:
    """The automaton of a vocabulary of byte strings."""
    edges: dict[int, int] = {}
    is_piece, parents = [False], [(0, 0)]
    for piece in vocabulary:
        node = 0
        for c in piece:
            if (to := edges.get(node << 8 | c)) is None:
                to = edges[node << 8 | c] = len(is_piece)
                is_piece.append(False)
                parents.append((node, c))
            node = to
        is_piece[node] = node > 0
    failure, popped = [-1] * len(is_piece), [0] * len(is_piece)
    below: list[list[int]] = [[] for _ in is_piece]
    for node in range(1, len(is_piece)):
        below[parents[node][0]].append(node)
    todo = deque(below[0])
    while todo:
        node = todo.popleft()
        todo.extend(below[node])
        if is_piece[node]:
            failure[node], popped[node] = 0, 1
            continue
        parent, c = parents[node]
        pieces, back = popped[parent], failure[parent]
        while back >= 0 and (back << 8 | c) not in edges:
            pieces += popped[back]
            back = failure[back]
        if back >= 0:
            failure[node], popped[node] = edges[back << 8 | c], pieces
    return PieceCounter(edges, failure, popped, lead)


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The byte strings of a rank file, without those that hold white space past their first byte."""
    with open(path, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    return [x for x in pieces if len(x[1:].split()) == (len(x) > 1) and x[1:].strip() == x[1:]]


def count_tokens(
    docs: DataFrame, counter: PieceCounter, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_tokens and longest_word_tokens of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(counter)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count, known = shared.value.count, remembered
        out = []
        for text in utf8_values(batch.column(1)):
            words = text.split()
            if len(known) > REMEMBERED:
                known.clear()
            total = longest = 0
            for w in words:
                if (n := known.get(w)) is None:
                    n = count(w)
                    if len(w) <= SHORT:
                        known[w] = n
                total += n
                if n > longest:
                    longest = n
            out.append((len(words), total, longest))
        columns = [pa.array(x, pa.int64()) for x in zip(*out)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_tokens", "longest_word_tokens"])

    remembered: dict[bytes, int] = {}
    schema = f"doc_id {id_type(docs, id_col)}, n_words bigint, n_tokens bigint, longest_word_tokens bigint"
    return map_texts(docs, run, schema, id_col, text_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece lengths of every document."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), build_counter(read_vocabulary()))


QUERIES = {"op3_token_counts": op3_token_counts}
