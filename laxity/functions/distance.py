"""Distances between values, and the level of a distance on an attribute's grid, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import NUMBER, Attribute


def number_distance(a: Column, b: Column, digits: int) -> Column:
    """Absolute difference, rounded half up to the column's digits."""
    return F.round(F.abs(a.cast("double") - b.cast("double")), digits)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def bounded_edit_distance(a: Column, b: Column, most: int) -> Column:
    """The edit distance up to `most`; beyond it most + 1. Lengths are compared first."""
    near = F.abs(F.length(a) - F.length(b)) <= most
    found = F.when(near, F.levenshtein(a, b, most)).otherwise(F.lit(-1))
    return F.when(found < 0, F.lit(most + 1)).otherwise(found)


POLICIES = ("absolute", "normalised", "hybrid", "token")


def edits_allowed(a: Column, b: Column, policy: str, limit: float) -> Column:
    """Edits by which two strings may differ. absolute: `limit`; normalised: the share 1 - `limit` of the longer length, rounded down;
    hybrid: the same, but one at least."""
    if policy == "absolute":
        return F.lit(int(limit))
    if policy not in ("normalised", "hybrid"):
        raise ValueError(policy)
    share = F.floor(F.round(F.greatest(F.length(a), F.length(b)) * (1 - limit), 9)).cast("int")
    return share if policy == "normalised" else F.greatest(share, F.lit(1))


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(c, r"\s+"), ""))


def tokens_needed(a: Column, b: Column, limit: float) -> Column:
    """Common tokens that two strings need for a similarity of `limit`: limit / (1 + limit) of the tokens of both, rounded up."""
    return F.ceil(F.round((F.size(_tokens(a)) + F.size(_tokens(b))) * (limit / (1 + limit)), 9)).cast("int")


def similar(a: Column, b: Column, policy: str, limit: float) -> Column:
    """Whether two strings are similar. limit: edits for absolute, a similarity from 0 to 1 for the others."""
    if policy == "token":
        return F.size(F.array_intersect(_tokens(a), _tokens(b))) >= tokens_needed(a, b, limit)
    return F.levenshtein(a, b) <= edits_allowed(a, b, policy, limit)


def level_of(distance: Column, attribute: Attribute) -> Column:
    hits = [(distance <= t).cast("int") for t in attribute.thresholds]
    return reduce(lambda x, y: x + y, hits, F.lit(0)).cast("byte")


def level(a: Column, b: Column, attribute: Attribute) -> Column:
    """Level of a pair of clean values; equal values are within the tightest threshold."""
    if attribute.kind == NUMBER:
        return level_of(number_distance(a, b, attribute.digits), attribute)
    found = level_of(bounded_edit_distance(a, b, int(attribute.thresholds[-1])), attribute)
    return F.when(a == b, F.lit(attribute.levels).cast("byte")).otherwise(found)


def clean(column: Column, attribute: Attribute) -> Column:
    """Null numbers count as 0, null strings as empty."""
    if attribute.kind == NUMBER:
        return F.coalesce(column.cast("double"), F.lit(0.0))
    return F.coalesce(column.cast("string"), F.lit(""))
