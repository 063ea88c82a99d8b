"""Rule specifications: plain data, checked when built.

Every rule class derives from :class:`Spec`. ``parse`` accepts a mapping and
rejects unknown keys, so rule files can be loaded from any plain format.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields
from typing import Any, Generic, TypeVar

S = TypeVar("S", bound="Spec")

# Duration units in microseconds.
UNITS_US = {"us": 1, "µs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}


def duration_us(value: str | int | float) -> int:
    """Microseconds of a duration such as ``"1h30m"`` or a number of seconds."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return round(value * 1_000_000)
    parts = re.findall(r"(\d+(?:\.\d+)?)(us|µs|ms|s|m|h)", str(value))
    if not parts or "".join(n + u for n, u in parts) != str(value):
        raise ValueError(f"bad duration {value!r}")
    return round(sum(float(n) * UNITS_US[u] for n, u in parts))


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def positive_window(value: str | int | float) -> int:
    us = duration_us(value)
    require(us > 0, "window must be positive")
    return us


@dataclass(frozen=True)
class Spec:
    """Base of all rules."""

    @classmethod
    def parse(cls: type[S], data: S | Mapping[str, Any]) -> S:
        if isinstance(data, cls):
            return data
        require(isinstance(data, Mapping), f"{cls.__name__}: expected a mapping")
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(data) - known)
        require(not unknown, f"{cls.__name__}: unknown keys {unknown}")
        try:
            return cls(**data)
        except TypeError as error:
            raise ValueError(f"{cls.__name__}: {error}") from error


def parse_all(spec: type[S], rules: Iterable[S | Mapping[str, Any]] | None, needed: bool = False) -> tuple[S, ...]:
    parsed = tuple(spec.parse(r) for r in (rules or ()))
    require(bool(parsed) or not needed, f"{spec.__name__}: at least one rule is required")
    return parsed


R = TypeVar("R")


@dataclass(frozen=True)
class Scoped(Generic[R]):
    """A default rule (set) and rule sets of single sources.

    ``default=None`` leaves sources without an own rule untouched.
    """

    default: R | None = None
    by_source: Mapping[str, R] = field(default_factory=dict)
    source: str = "source"

    @classmethod
    def of(cls, rules: R | Scoped[R]) -> Scoped[R]:
        return rules if isinstance(rules, Scoped) else cls(default=rules)
