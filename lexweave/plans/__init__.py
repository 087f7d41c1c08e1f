"""Registered queries: every operator over the given tables."""

from . import documents, matters, practice, quality, records, references, search, streams  # noqa: F401
from .base import ORACLES, QUERIES, oracle


def oracles() -> dict[str, str]:
    """Complete SQL per query."""
    return {name: oracle(sql) for name, sql in ORACLES.items()}


__all__ = ["QUERIES", "oracles"]
