"""Validity, scope and branch predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAIN_BRANCHES = ("main", "master")


def active_at(time: Column, start: str = "valid_from", end: str = "valid_until") -> Column:
    """Half-open validity: start <= time < end, an open end when null."""
    return (F.col(start) <= time) & (F.col(end).isNull() | (F.col(end) > time))


def in_scopes(scopes: list[str], scope: str = "scope") -> Column:
    """Rows of the scopes and all global ones; without scopes, every row."""
    return F.col(scope).isin(*scopes, "global") if scopes else F.lit(True)


def scopes_compatible(a: Column, b: Column) -> Column:
    """A global scope goes with any other, else both must be the same."""
    return (a == "global") | (b == "global") | (a == b)


def branch_visible(branch: str | None, column: str = "branch") -> Column:
    """Rows without a branch and on the main ones are always visible; None, * and all show everything."""
    if branch in (None, "*", "all"):
        return F.lit(True)
    return F.col(column).isNull() | F.col(column).isin(*MAIN_BRANCHES, branch)
