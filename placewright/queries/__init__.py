"""The registered queries over the driver tables and their DuckDB counterparts."""

from __future__ import annotations

from . import feeds, games, merging, places, shapes, sources

_ALL = (games, places, shapes, feeds, sources, merging)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _ALL for k, v in m.ORACLE_SQL.items()}
