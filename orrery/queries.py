"""Registry of the scene-analytics queries and their SQL."""

from __future__ import annotations

from orrery.plans import association, ceilings, evaluation, masks, patches, polygons, questions, relations, repair, reports, retrieval

_MODULES = (relations, questions, masks, evaluation, retrieval, reports, polygons, patches, repair, ceilings, association)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = "qa_battery"
