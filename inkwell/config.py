"""Settings of the engine; all are parameters with these defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    extensions: tuple[str, ...] = (".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp", ".xlsx")
    max_file_mb: int = 50
    low_confidence: float = 0.6
    least_page_chars: int = 30
    native_page_chars: int = 100
    least_usable_confidence: float = 0.2
    chunk_chars: int = 2000
    overlap_chars: int = 400
    table_rows: int = 12
    dense_weight: float = 0.6
    sparse_weight: float = 0.4
    fusion_constant: int = 60
    retrieve_k: int = 10
    rerank_n: int = 8
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    snippet_chars: int = 500
    rule_confidence: float = 0.5
    match_score: float = 0.86
    match_overlap: float = 0.6
    match_contained: float = 0.92
    reinforce: float = 0.1
    decay: float = 0.05
    prune_confidence: float = 0.2
    prune_decays: int = 2
    embedding_size: int = 64
    narrow_image: int = 1000
    widened_image: int = 1500
    vision_edge: int = 1800


DEFAULT = Config()
