"""Settings of ingestion and retrieval."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    top_k: int = 6
    pool_factor: int = 4
    rrf_k: int = 60
    dense_weight: float = 0.5
    sparse_weight: float = 0.3
    exact_weight: float = 0.2
    dense_enabled: bool = True
    sparse_enabled: bool = True
    exact_enabled: bool = True
    chunk_size: int = 1000
    chunk_overlap: int = 200
    #: "sequential": every hit of a query's first knowledge base ranks before those of the next; "global": by score alone.
    cross_kb: str = "sequential"

    @property
    def pool(self) -> int:
        return self.top_k * self.pool_factor


#: Rows of a side that may be broadcast; beyond it both sides shuffle.
BROADCAST_ROWS = 200_000
