"""All registered queries of the engine with their DuckDB forms."""

from __future__ import annotations

from . import catalog_format, catalog_graph, catalog_ingest, catalog_records, catalog_search, catalog_understand

_PARTS = (catalog_search, catalog_graph, catalog_understand, catalog_ingest, catalog_format, catalog_records)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
