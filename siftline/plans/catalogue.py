"""All reference queries by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import extracts, files, mail, runs, stored, texts  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
