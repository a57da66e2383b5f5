"""All queries of the library by name, with SQL that gives the same rows."""

from __future__ import annotations

from corvane.plans import air, bus, choices, eligibility, footprint, graph, journeys, lines, measures, narrative, rules, series, supply  # noqa: F401  each registers its queries
from corvane.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = QUERIES["mode_share"]

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
