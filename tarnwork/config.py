"""Default parameters of the pipeline, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    # The pipeline's usual settings.
    top_k: int = 20
    few_shot: int = 4
    ignore_same_repository: bool = True
    summary_attempts: int = 5
    retries: int = 3
    agreement_threshold: float = 0.8
    cluster_commits: int = 10
    cluster_diff_chars: int = 2000
    summarise_min_size: int = 11
    combine_min_size: int = 16
    applicability_attempts: int = 5
    verified_attempts: int = 3
    optimisation_attempts: int = 3
    references: int = 3
    sample_size: int = 40_000
    class_a_quota: int = 50
    kmeans_k: int = 14_000
    pca_dims: int = 50
    density_min_cluster_size: int = 5
    density_min_samples: int = 5
    ward_k: tuple[int, int] = (2, 15)
    slice_rows: int = 10_000
    largest_repository_kb: int = 3 * 1024 * 1024


DEFAULTS = Defaults()
