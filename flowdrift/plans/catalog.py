"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from flowdrift.plans import queries_clean, queries_drift, queries_features, queries_invariants, queries_models, queries_runlog, queries_streams  # noqa: F401
from flowdrift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
