"""Registered queries: each operator bound to the driver's tables, with SQL for the oracle."""

from __future__ import annotations

from seamark.plans.derived import flagship
from seamark.plans.registry import ORACLE, QUERIES
from seamark.plans import derived, diagnostic, extended, fitted, inference, spatial  # noqa: F401, E402

__all__ = ["ORACLE", "QUERIES", "flagship"]
