"""What a caller may ask for: recall, write, management, search and graph options, checked when they are made."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from .config import _require

MOST_RESULTS, MOST_DEPTH, MOST_NODES = 1000, 10, 10_000


def _share(x: float, name: str) -> None:
    _require(0 <= x <= 1, f"{name} must be between 0 and 1, got {x}")


def _results(n: int) -> None:
    _require(0 < n <= MOST_RESULTS, f"max results must be 1 to {MOST_RESULTS}, got {n}")


class _Changed:
    """Options do not change; these give new ones."""

    def with_filter(self, key: str, value: str):
        return replace(self, filters={**self.filters, key: value})

    def with_tag(self, tag: str):
        return self if tag in self.tags else replace(self, tags=(*self.tags, tag))

    def without_tag(self, tag: str):
        return replace(self, tags=tuple(t for t in self.tags if t != tag))


@dataclass(frozen=True)
class RecallOptions(_Changed):
    """The time budget, in seconds, is advice."""

    max_results: int = 10
    time_budget: float = 5.0
    include_graph: bool = False
    filters: Mapping[str, str] = field(default_factory=dict)
    min_confidence: float = 0.0
    sort_by: str = "relevance"
    sort_order: str = "desc"
    expand_query: bool = True

    def __post_init__(self) -> None:
        _results(self.max_results)
        _require(self.time_budget > 0, "the time budget must be positive")
        _share(self.min_confidence, "min confidence")
        _require(self.sort_by in ("", "relevance", "confidence", "date"), f"unknown sort column {self.sort_by!r}")
        _require(self.sort_order in ("", "asc", "desc"), f"unknown sort order {self.sort_order!r}")


@dataclass(frozen=True)
class WriteOptions(_Changed):
    source: str
    user_id: str = ""
    tags: tuple[str, ...] = ()
    confidence: float = 1.0
    require_evidence: bool = False
    language: str = "en"
    content_type: str = "text/plain"
    version: str = "1.0"
    metadata: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _require(self.source != "", "the source is empty")
        _share(self.confidence, "confidence")
        _require(len(self.language) in (0, 2), f"a language has two letters, got {self.language!r}")


@dataclass(frozen=True)
class ManageOptions:
    """ttl in seconds."""

    operation: str
    memory_ids: tuple[str, ...] = ()
    confidence: float = 0.0
    ttl: float = 86_400.0
    force: bool = False
    dry_run: bool = False
    batch_size: int = 100

    def __post_init__(self) -> None:
        _require(self.operation in ("pin", "forget", "decay", "merge"), f"unknown operation {self.operation!r}")
        _share(self.confidence, "confidence")
        _require(self.ttl >= 0, "the time to live must not be negative")
        _require(self.batch_size > 0, "the batch size must be positive")


@dataclass(frozen=True)
class SearchOptions(_Changed):
    query: str
    max_results: int = 10
    offset: int = 0
    filters: Mapping[str, str] = field(default_factory=dict)
    min_confidence: float = 0.0
    search_type: str = "hybrid"
    highlight: bool = False

    def __post_init__(self) -> None:
        _require(self.query != "", "the query is empty")
        _results(self.max_results)
        _require(self.offset >= 0, "the offset must not be negative")
        _share(self.min_confidence, "min confidence")
        _require(self.search_type in ("", "vector", "text", "hybrid"), f"unknown search type {self.search_type!r}")


@dataclass(frozen=True)
class GraphOptions:
    max_depth: int = 3
    edge_types: tuple[str, ...] = ()
    node_types: tuple[str, ...] = ()
    min_weight: float = 0.0
    max_nodes: int = 100
    algorithm: str = ""

    def __post_init__(self) -> None:
        _require(0 < self.max_depth <= MOST_DEPTH, f"max depth must be 1 to {MOST_DEPTH}, got {self.max_depth}")
        _require(self.min_weight >= 0, "min weight must not be negative")
        _require(0 < self.max_nodes <= MOST_NODES, f"max nodes must be 1 to {MOST_NODES}, got {self.max_nodes}")
        _require(self.algorithm in ("", "pagerank", "community", "shortest_path"), f"unknown algorithm {self.algorithm!r}")
