"""The query catalogue."""

from tierdown.catalog import copies, reports, selection, streams  # noqa: F401
from tierdown.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
