"""Settings of the pipeline stages; defaults are the shipped values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Segmentation:
    window_turns: int = 2
    min_turns: int = 8
    max_tokens: int = 384
    lookback: int = 3
    z: float = 1.0
    max_similarity: float = 0.4
    drift_tolerance: float = 0.15
    drift_min_consecutive: int = 3


@dataclass(frozen=True)
class Keywords:
    top_k: int = 8
    mmr_lambda: float = 0.6
    max_phrase_words: int = 3
    jaccard_hard: float = 0.5
    jaro_winkler: float = 0.88
    freq_ratio: float = 3.0
    snap_max_freq: int = 2


@dataclass(frozen=True)
class Concepts:
    min_cluster_size: int = 3
    min_samples: int = 4


@dataclass(frozen=True)
class Domains:
    k: int = 15
    gamma: float = 0.025
    min_size: int = 5
    min_similarity: float = 0.25
    label_words: int = 3
    background: str = "Background / Minor Orbit"


@dataclass(frozen=True)
class Layout:
    n_neighbors: int = 10
    min_dist: float = 0.05
    alpha: float = 0.15
    z_range: float = 50.0
    coordinate_range: float = 100.0
    height_weights: tuple[float, float, float] = (0.4, 0.3, 0.3)


@dataclass(frozen=True)
class Density:
    components: int = 60
    concentration: float = 5.0
    covariance_scale: float = 0.3
    dof: float = 10.0
    grid: int = 150
    seed: int = 42
    terrain: float = 40.0
    effective_weight: float = 1e-3


@dataclass(frozen=True)
class Graph:
    min_chat_count: int = 3
    max_edges_per_node: int = 40


@dataclass(frozen=True)
class Phrases:
    min_pair: int = 5
    min_npmi: float = 0.55
    max_words: int = 3
    redundancy: float = 0.85


@dataclass(frozen=True)
class Supertopics:
    clusters: int = 80
