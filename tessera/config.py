"""Defaults of the engine, with their validation."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Retrieval:
    limit: int = 8
    most: int = 100  # any limit is clamped to this
    overfetch: int = 3
    semantic: float = 0.55
    lexical: float = 0.25
    structural: float = 0.20


@dataclass(frozen=True)
class Structural:
    depth: int = 3
    candidates: int = 32
    distance_decay: float = 0.65
    calls: float = 1.0
    references: float = 0.8
    implementations: float = 1.0
    tests: float = 1.0
    dependencies: float = 0.8
    other: float = 0.6


@dataclass(frozen=True)
class WorkingSet:
    half_life_minutes: float = 90.0
    increment: float = 0.35
    most: float = 1.0
    least: float = 0.01
    items: int = 100


@dataclass(frozen=True)
class Ranking:
    semantic: float = 0.24
    lexical: float = 0.16
    task: float = 0.14
    working_set: float = 0.14
    recency: float = 0.10
    provenance: float = 0.08
    freshness: float = 0.08
    structural: float = 0.06

    def total(self) -> float:
        return sum(self.__dict__.values())


@dataclass(frozen=True)
class Budget:
    """Shares of a packet's tokens that each category may use in the capped pass."""

    code: float = 0.50
    structural: float = 0.20
    memory: float = 0.15
    event: float = 0.10
    state: float = 0.05


@dataclass(frozen=True)
class Settings:
    retrieval: Retrieval = field(default_factory=Retrieval)
    structural: Structural = field(default_factory=Structural)
    working_set: WorkingSet = field(default_factory=WorkingSet)
    ranking: Ranking = field(default_factory=Ranking)
    budget: Budget = field(default_factory=Budget)
    recency_half_life_hours: float = 72.0
    candidate_pool: int = 50
    chunk_bytes: int = 3000
    chunk_overlap: int = 300
    debounce_ms: int = 300

    def validated(self) -> Settings:
        """These settings, or an error that names the first that can't be used."""
        r, s, w, b = self.retrieval, self.structural, self.working_set, self.budget
        checks = {
            "retrieval weights": min(r.semantic, r.lexical, r.structural) >= 0 and r.semantic + r.lexical > 0,
            "retrieval limit": 1 <= r.limit <= r.most,
            "structural depth": 1 <= s.depth <= 8,
            "distance decay": 0 < s.distance_decay <= 1,
            "half lives": w.half_life_minutes > 0 and self.recency_half_life_hours > 0,
            "activation": 0 <= w.least < w.most and 0 < w.increment <= w.most,
            "ranking weights": min(self.ranking.__dict__.values()) >= 0 and self.ranking.total() > 0,
            "budget shares": all(0 <= x <= 1 for x in b.__dict__.values()),
            "chunk size": 0 <= self.chunk_overlap < self.chunk_bytes,
        }
        for name, ok in checks.items():
            if not ok:
                raise ValueError(f"{name} out of range")
        return self


DEFAULTS = Settings().validated()
