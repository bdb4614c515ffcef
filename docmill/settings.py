"""Engine settings and fixed values of the retrieval semantics."""

from __future__ import annotations

from dataclasses import dataclass

#: Words that the index leaves out.
STOPWORDS = (
    "대한", "대해", "위해", "통해", "경우", "또한", "모든", "의한",
    "따라", "기타", "사항", "있거나", "있으며", "의하여", "관하여", "다만",
)

#: Counters that rejoin with the number before them.
NUMERIC_UNITS = (
    "개월", "단계", "등급", "시간", "개", "월", "일", "년", "번", "회",
    "차", "주", "명", "원", "점", "편", "권", "절", "관", "목",
)

#: Classifiers of legal numbering.
CLASSIFIERS = ("조", "호", "항", "절", "장", "편", "관", "목")

#: One-letter words that table repair never joins.
KEPT_LETTERS = "의및중후등수"


@dataclass(frozen=True)
class Settings:
    """Defaults of chunking, ranking, context and the quality gate."""

    parent_size: int = 1500
    parent_overlap: int = 150
    child_size: int = 400
    child_overlap: int = 50
    min_child: int = 50
    k1: float = 1.5
    b: float = 0.75
    delta: float = 1.0
    rrf_k: int = 60
    weight: float = 0.5
    retrieval_k: int = 50
    pool_min: int = 15
    rerank_docs: int = 5
    rerank_threshold: float = 0.60
    fallback_vector: float = 0.53
    fallback_overlap: float = 0.5
    cache_threshold: float = 0.95
    chars_per_token: float = 1.5
    context_tokens: int = 8192
    context_share: float = 0.75
    history_messages: int = 6
    history_turns: int = 5
    repeated_line_share: float = 0.8
    edge_lines: int = 2
    gate_drop_percent: float = 5.0
    gate_latency: float = 5.0
    cache_files: int = 50
    backups: int = 5
    trace_days: int = 7
    session_hours: int = 24


DEFAULTS = Settings()
