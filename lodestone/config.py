"""Settings as dataclasses: checked when made, saved and loaded as JSON."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from .operators import preprocess as P


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class Storage:
    """form: a Spark source. path: a folder that all executors see; empty keeps tables where the caller has them."""

    form: str = "parquet"
    path: str = ""
    dimensions: int = 64

    def __post_init__(self) -> None:
        _require(self.form in ("parquet", "json", "orc"), f"unknown form {self.form!r}")
        _require(self.dimensions > 0, "dimensions must be positive")


@dataclass(frozen=True)
class Processing:
    strategy: str = "sentence"
    chunk_size: int = P.MAX_SIZE
    overlap: int = P.OVERLAP
    least_entity_confidence: float = 0.5
    least_claim_confidence: float = 0.6
    preprocess: bool = True

    def __post_init__(self) -> None:
        _require(self.strategy in ("sentence", "size", "paragraph"), f"unknown strategy {self.strategy!r}")
        _require(self.chunk_size > 0 and 0 <= self.overlap < self.chunk_size, "the overlap must be less than the chunk size")
        _require(0 <= self.least_entity_confidence <= 1 and 0 <= self.least_claim_confidence <= 1, "confidences are 0 to 1")


@dataclass(frozen=True)
class Retrieval:
    max_results: int = 10
    rrf_k: int = 60
    vector_weight: float = 1.0
    keyword_weight: float = 1.0
    least_similarity: float = 0.1

    def __post_init__(self) -> None:
        _require(0 < self.max_results <= 100, "max_results is 1 to 100")
        _require(self.rrf_k > 0 and self.vector_weight >= 0 and self.keyword_weight >= 0, "weights must not be negative")
        _require(-1 <= self.least_similarity <= 1, "a similarity is -1 to 1")


@dataclass(frozen=True)
class Config:
    storage: Storage = field(default_factory=Storage)
    processing: Processing = field(default_factory=Processing)
    retrieval: Retrieval = field(default_factory=Retrieval)


def save(config: Config, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(dataclasses.asdict(config), f, indent=2)


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    return Config(Storage(**raw.get("storage", {})), Processing(**raw.get("processing", {})), Retrieval(**raw.get("retrieval", {})))
