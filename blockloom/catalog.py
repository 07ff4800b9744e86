"""The registered queries of the ordered operators and the sample statistics, and their DuckDB texts."""

from __future__ import annotations

from blockloom.queries import calls, core, stats

QUERIES = core.QUERIES | calls.QUERIES | stats.QUERIES
ORACLES = core.ORACLES | calls.ORACLES | stats.ORACLES
