"""All registered queries of the intake engine, with the SQL that gives the same rows."""

from __future__ import annotations

from . import documents, ledger_runs, messages, tables  # noqa: F401
from .define import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
