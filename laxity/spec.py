"""Attributes, threshold grids and levels.

An attribute has ascending thresholds t1 < ... < tk. The level of a row pair on it is the number of thresholds that the pair's distance
does not exceed: 0 is farther than all, k within the tightest. Level l stands for the threshold that is l-th from the loosest.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

NUMBER, STRING = "number", "string"


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str
    thresholds: tuple[float, ...]
    digits: int = 0

    def __post_init__(self):
        if self.kind not in (NUMBER, STRING):
            raise ValueError(f"{self.name}: kind is {NUMBER} or {STRING}")
        found = tuple(sorted(set(self.thresholds)))
        if found and found[0] < 0:
            raise ValueError(f"{self.name}: a threshold is negative")
        object.__setattr__(self, "thresholds", found)

    @property
    def levels(self) -> int:
        return len(self.thresholds)

    def threshold(self, level: int) -> float:
        """The threshold that a level from 1 on stands for."""
        return self.thresholds[self.levels - level]


def usable(attributes: Iterable[Attribute]) -> list[Attribute]:
    """Those with thresholds; an attribute without any is left out of everything."""
    return [a for a in attributes if a.levels]


def total_levels(attributes: Sequence[Attribute]) -> int:
    return sum(a.levels for a in attributes)


def number_grid(low: float, high: float, share: float = 0.5, stages: int = 3) -> tuple[float, ...]:
    """Even steps up to a share of the range; 0 is not one of them."""
    reach = (high - low) * share
    return tuple(reach * (i + 1) / stages for i in range(stages)) if reach > 0 else ()


def string_grid(longest: int, share: float = 0.5, stages: int = 3) -> tuple[float, ...]:
    """1 up to a share of the longest length, or that many steps down from it."""
    reach = int(longest * share)
    if reach <= stages:
        return tuple(float(i) for i in range(1, reach + 1))
    step = reach // stages
    return tuple(float(reach - i * step) for i in reversed(range(stages)))


def thresholds_for(kind: str, stats: dict, share: float = 0.5, stages: int = 3) -> tuple[float, ...]:
    """A grid from an attribute's statistics: low and high of numbers, longest of strings."""
    if kind == NUMBER:
        return () if stats["low"] is None else number_grid(float(stats["low"]), float(stats["high"]), share, stages)
    return string_grid(int(stats["longest"] or 0), share, stages)


def from_lines(lines: Iterable[str], columns: Sequence[tuple[str, str, int]]) -> list[Attribute]:
    """Attributes from a threshold file: line c has the comma-separated thresholds of column c; an empty line leaves it out."""
    out = []
    for line, (name, kind, digits) in zip(list(lines) + [""] * len(columns), columns):
        out.append(Attribute(name, kind, tuple(float(x) for x in line.split(",") if x.strip()), digits))
    return out
