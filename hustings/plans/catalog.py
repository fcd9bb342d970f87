"""Every query by name, and the SQL that must give the same rows."""

from __future__ import annotations

from . import atlas, census, elections, graphs, models, searches

_MODULES = (elections, census, graphs, models, searches, atlas)
QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
