"""Frequencies: bucket labels, dense grids, future periods, seasonal periods.

Weeks are anchored on Sunday. Two conventions exist side by side: ``left`` bins start at their label, ``right`` bins
end at it; they differ for W and 2W alone. 2W and 6MS bins start from the series' own first date.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: unit: (sequence step, seasonal period, typical days)
UNITS = {
    "H": ("1 hour", 24, 1 / 24),
    "D": ("1 day", 7, 1.0),
    "W": ("7 days", 52, 7.0),
    "2W": ("14 days", 26, 14.0),
    "MS": ("1 month", 12, 30.44),
    "QS": ("3 months", 4, 91.31),
    "6MS": ("6 months", 2, 182.62),
    "YS": ("12 months", 1, 365.25),
}
ALIASES = {"h": "H", "M": "MS", "ME": "MS", "Q": "QS", "QE": "QS", "6M": "6MS", "A": "YS", "AS": "YS", "Y": "YS", "YE": "YS"}


@dataclass(frozen=True)
class Freq:
    unit: str
    closed: str = "left"

    @classmethod
    def of(cls, name: str | Freq, closed: str = "left") -> Freq:
        if isinstance(name, Freq):
            return name
        base = name if name in UNITS or name in ALIASES else name.split("-")[0]
        unit = ALIASES.get(base, base)
        if unit not in UNITS:
            raise ValueError(f"unknown frequency {name!r}")
        return cls(unit, closed)

    @property
    def step(self) -> str:
        return UNITS[self.unit][0]

    @property
    def period(self) -> int:
        return UNITS[self.unit][1]

    @property
    def days(self) -> float:
        return UNITS[self.unit][2]

    @property
    def needs_origin(self) -> bool:
        return self.unit in ("2W", "6MS")

    def bucket(self, ts: Column, origin: Column | None = None) -> Column:
        """Label of the bin that holds ``ts``; ``origin`` is the series' first timestamp for 2W and 6MS."""
        if self.unit == "H":
            return F.date_trunc("hour", ts).cast("timestamp_ntz")
        d = ts.cast("date")
        if self.unit == "D":
            return d
        if self.unit == "W":
            return self._sunday(d)
        if self.needs_origin and origin is None:
            raise ValueError(f"{self.unit} bins start from the first date: pass origin")
        if self.unit == "2W":
            first = self._sunday(origin.cast("date"))
            apart = F.datediff(d, first) / 14
            return F.date_add(first, (14 * (F.floor(apart) if self.closed == "left" else F.ceil(apart))).cast("int"))
        if self.unit == "6MS":
            first = F.trunc(origin.cast("date"), "MM")
            months = (F.year(d) - F.year(first)) * 12 + F.month(d) - F.month(first)
            return F.add_months(first, (6 * F.floor(months / 6)).cast("int"))
        return F.trunc(d, {"MS": "MM", "QS": "quarter", "YS": "year"}[self.unit])

    def _sunday(self, d: Column) -> Column:
        """The Sunday on or before a date, or on or after it in the right-closed convention."""
        if self.closed == "left":
            return F.date_sub(d, F.dayofweek(d) - 1)
        return F.date_add(d, (8 - F.dayofweek(d)) % 7)

    def sequence(self, first: Column, last: Column) -> Column:
        return F.sequence(first, last, F.expr(f"interval {self.step}"))

    def future(self, last: Column, horizon: int) -> Column:
        """Labels of the ``horizon`` periods after a bucket label."""
        return F.slice(self.sequence(last, last + F.expr(" + ".join([f"interval {self.step}"])) * horizon), 2, horizon)


def by_gap(days: float | None) -> str:
    """Frequency of a median gap in days; daily where there is none."""
    if days is None:
        return "D"
    for limit, unit in ((1, "D"), (7, "W"), (31, "MS"), (92, "QS")):
        if days <= limit:
            return unit
    return "YS"


def comparison(target: str, most: int = 3) -> list[str]:
    """Frequencies to compare a target with."""
    return [u for u in ("D", "W", "MS", "QS", "YS") if u != target][:most]
