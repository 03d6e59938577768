"""All core queries and their SQL, by name."""

from __future__ import annotations

from . import conversation, metrics, more, surface, training, vectors

_MODULES = (conversation, metrics, more, vectors, surface, training)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
