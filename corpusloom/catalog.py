"""Every registered query of the library and the SQL it is compared with."""

from __future__ import annotations

from corpusloom.queries.registry import ORACLES, QUERIES
from corpusloom.queries import events, fulltext, gates, matching, planning, ranges, references, relational, retrieval, search, selection, serving, small, structured  # noqa: F401  they register themselves

__all__ = ["ORACLES", "QUERIES"]
