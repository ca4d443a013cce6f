"""What a flow comes to: its tables and facts, or why it could not make them."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import wraps
from types import MappingProxyType


@dataclass(frozen=True)
class Failure:
    flow: str
    cause: Exception

    def __str__(self) -> str:
        return f"{self.flow}: {type(self.cause).__name__}: {self.cause}"


@dataclass(frozen=True)
class Outcome:
    """tables: a DataFrame or a dict of them, planned but not run; facts: small values that were settled on the way.

    A failed flow has neither, and ``get`` raises its cause.
    """

    tables: object = None
    facts: Mapping = MappingProxyType({})
    failure: Failure | None = None
    planning_seconds: float = 0.0

    def __bool__(self) -> bool:
        return self.failure is None

    def get(self, name: str | None = None):
        """All tables, or the one of this name."""
        if self.failure:
            raise self.failure.cause
        return self.tables if name is None else self.tables[name]


def flow(fn: Callable) -> Callable:
    """A function that returns tables, or (tables, facts), becomes one that returns an Outcome and does not raise."""

    @wraps(fn)
    def planned(*args, **kwargs) -> Outcome:
        began = time.perf_counter()
        try:
            made = fn(*args, **kwargs)
        except Exception as cause:  # callers of many flows (a pipeline over columns) go on with the others
            return Outcome(failure=Failure(fn.__name__, cause), planning_seconds=time.perf_counter() - began)
        tables, facts = made if isinstance(made, tuple) else (made, {})
        return Outcome(tables, MappingProxyType(facts), None, time.perf_counter() - began)

    return planned
