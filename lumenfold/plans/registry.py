"""All queries of the core library by name, and their SQL."""

from __future__ import annotations

from lumenfold.plans import corpus_plans, example_plans, metric_plans, record_plans, rule_plans  # noqa: F401
from lumenfold.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
