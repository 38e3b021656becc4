"""Every query of the engine by name, with its equivalent in DuckDB's SQL."""

from __future__ import annotations

from tracemill.plans import analytics, answers, behavior, checks, corpus, derived, evaluation, exports, folds, outcomes, records, streams, telemetry, texts, timelines  # noqa: F401  the modules register their queries
from tracemill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
