"""All queries of the engine's own operators."""

from __future__ import annotations

from petrilens.plans import pixel, relational, sampling, spatial, statistics

_ALL = (relational, spatial, pixel, sampling, statistics)
QUERIES = {k: f for m in _ALL for k, f in m.Q.items()}
SQL = {k: s for m in _ALL for k, s in m.SQL.items()}
