"""All queries over the driver's tables by name, and their SQL."""

from __future__ import annotations

from strata.plans import cases, checked, external, flows, proofs, ranked, relational, reports, review, scans, scored, stateful  # noqa: F401  registration
from strata.plans.catalog import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
