"""Where the queries are registered, each with the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str = "") -> Callable:
    def add(function: Callable) -> Callable:
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return add
