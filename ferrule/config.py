"""Defaults of the retrieval engine."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    # Defaults that decide results.
    chunk_chars: int = 280
    overlap_chars: int = 60
    dense_top_n: int = 12
    lexical_top_n: int = 12
    rrf_k: int = 60
    rerank_top_n: int = 12
    duplicate_threshold: float = 0.92
    mmr_lambda: float = 0.72
    final_max_k: int = 5
    min_rerank_score: float = 0.12
    gap_threshold: float = 0.28
    context_token_budget: int = 900
    parent_expansion_chars: int = 1200
    dimensions: int = 1024
    min_coverage: float = 0.18
    high_confidence: float = 0.35
    default_scopes: tuple[str, ...] = ("internal", "public")
    # Choices of this engine.
    paragraph_delimiter: str = "\n\n"
    embedding_provider: str = "local"
    embedding_model: str = "local-hash-embedding"
    lexical: str = "fts5"
    #: Queries shipped to the executors at once.
    query_block: int = 20_000
    #: An empty scope set falls back to ``default_scopes`` unless this is False.
    empty_scopes_mean_default: bool = True
    extra: dict = field(default_factory=dict)


# Words that are no terms.
STOPWORDS = (
    "的", "了", "吗", "呢", "是", "在", "和", "或", "与", "可以", "怎么", "如何", "什么", "一个", "用户",
)

#: Number of buckets of sparse vectors, fixed.
SPARSE_BUCKETS = 2147483647
