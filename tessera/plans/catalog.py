"""Named queries of the panel engine and their SQL equivalents."""

from __future__ import annotations

from tessera.plans import model_queries, network_queries, panel_queries, strategy_queries  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "regime_features"
