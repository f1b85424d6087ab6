"""Training-data operators; nothing outside this folder imports it.

``queries()`` and ``oracle_sql()`` are what ``__spark_entry__.py`` registers.
"""

from __future__ import annotations

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
