"""Every registered query and its DuckDB SQL."""

from __future__ import annotations

from . import catalog, imaging, pixels, retrieval

QUERIES = {**catalog.QUERIES, **retrieval.QUERIES, **pixels.QUERIES, **imaging.QUERIES}
ORACLE_SQL = {**catalog.ORACLE_SQL, **retrieval.ORACLE_SQL, **pixels.ORACLE_SQL}
