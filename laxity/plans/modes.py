"""The whole way from a table to its rules, by the eight modes.

mode 1, 4: evidence of tuples, one task for each right-hand attribute; 2: evidence, lattice; 3, 7: lattice over evidence made pair by pair; 5: the k best of all by
normalised utility; 6: the k best of each attribute by logarithmic utility; 8: evidence from row shards. All find the same rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.evidence import evidence, evidence_blocked, evidence_by_row
from ..spec import Attribute, usable
from ..work import materialised
from .discover import discover
from .topk import top_k


def rules(df: DataFrame, attributes: Sequence[Attribute], mode: int = 1, error: float = 0.01, exact: bool = False, k: int = 50, shard: int = 10_000, key: str | None = None, found: DataFrame | None = None) -> DataFrame:
    """Rules of df. exact: no violations allowed. key: a unique column, for modes that compare rows. found: a saved evidence set instead of a new one."""
    if mode not in range(1, 9):
        raise ValueError(f"mode {mode} is not one of 1 to 8")
    attributes, error = usable(attributes), 0.0 if exact else error
    if found is None:
        if mode in (3, 7, 8) and key is None:
            raise ValueError(f"mode {mode} needs a key")
        made = evidence_blocked(df, attributes, key, shard) if mode == 8 else evidence_by_row(df, attributes, key) if mode in (3, 7) else evidence(df, attributes)
        found = materialised(made)
    method = "lattice" if mode in (2, 3, 7) else "separate" if mode in (1, 4, 8) else "grid"
    out = discover(found, attributes, error, method)
    if mode == 5:
        return top_k(out, attributes, k, "normalised", "global")
    if mode == 6:
        return top_k(out, attributes, k, "log", "per_rhs")
    return out
