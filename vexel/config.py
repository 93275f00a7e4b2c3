"""Search settings and the rules that derive candidate counts from them."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class SearchConfig:
    """Session-wide defaults of approximate search; out-of-range values raise.

    ``allowlist`` names the ids that searches may return, comma-separated; blank allows all.
    """

    bit_width_default: int = 4
    normalize_on_insert: bool = True
    search_k: int = 32
    oversample: float = 1.0
    hi_dim_rerank: str = "auto"
    probes: int = 16
    iterative_scan: str = "off"
    max_scan_tuples: int = 20_000
    max_probes: int = 64
    graph_build_partitions: int = -1
    strict_compat: bool = False
    allowlist: str = ""

    def __post_init__(self) -> None:
        limits = {"bit_width_default": (2, 4), "search_k": (1, 100_000), "oversample": (1, 100), "probes": (1, 65_536), "max_scan_tuples": (1, 10_000_000), "max_probes": (1, 65_536), "graph_build_partitions": (-1, 4096)}
        for name, (low, high) in limits.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        if self.hi_dim_rerank not in ("auto", "on", "off"):
            raise ValueError("hi_dim_rerank must be auto, on or off")
        if self.iterative_scan not in ("off", "relaxed_order"):
            raise ValueError("iterative_scan must be off or relaxed_order")

    def candidates(self, k: int, dim: int) -> int:
        """Candidates drawn before exact re-ranking.

        ``search_k`` times ``oversample``, raised for high dimensions to between 256 and 1024; at
        least ``k`` unless ``strict_compat`` asks for fewer rows than wanted in that case.
        """
        count = math.ceil(self.search_k * self.oversample)
        if self.hi_dim_rerank == "on" or self.hi_dim_rerank == "auto" and dim >= 256:
            count = max(count, min(max(dim, 256), 1024))
        return count if self.strict_compat else max(count, k)
