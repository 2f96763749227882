"""Driver queries and their SQL, one entry an operator shape."""

from __future__ import annotations

from tessera.plans import catalog_choices, catalog_groups, catalog_heldout, catalog_images, catalog_labels, catalog_points, catalog_sources

_PARTS = (catalog_points, catalog_labels, catalog_groups, catalog_choices, catalog_sources, catalog_images, catalog_heldout)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
