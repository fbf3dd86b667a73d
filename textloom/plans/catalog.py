"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from inspect import getmembers, isfunction

from textloom.plans import cases
from textloom.plans import queries as Q
from textloom.plans import sql_outputs
from textloom.plans.sql import oracle_sql as _sql


def queries() -> dict[str, Callable]:
    """Every public function of the query module, in order of definition."""
    own = [(f.__code__.co_firstlineno, n, f) for n, f in getmembers(Q, isfunction) if f.__module__ == Q.__name__ and not n.startswith("_")]
    return {n: f for _, n, f in sorted(own)} | cases.queries()


def oracle_sql() -> dict[str, str]:
    return _sql() | sql_outputs.oracle_sql() | sql_outputs.more_sql() | cases.oracle_sql()
