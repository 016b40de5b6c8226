"""The engine's operators as queries over the test tables, each with its answer in plain SQL."""

from __future__ import annotations

from . import catalogs, documents, graphs, lifecycle, mappings, scalars, tables
from .data import Query

ALL: dict[str, Query] = {}
for _module in (tables, mappings, scalars, documents, lifecycle, catalogs, graphs):
    for _name, _query in _module.QUERIES.items():
        if _name in ALL:
            raise RuntimeError(f"query registered twice: {_name}")
        ALL[_name] = _query
