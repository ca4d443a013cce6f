"""A working session over one table: roles, then accumulated, imputed and treated forms, all lazy DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.freq import Freq
from ..operators import missing, outliers, schema
from ..operators.resample import densify, detect_frequency, method_for, resample
from ..sources import files


@dataclass(frozen=True)
class Panel:
    """A confirmed table: time column ts, value columns as doubles, hierarchy columns as text."""

    df: DataFrame
    roles: schema.Roles
    freq: str
    ts: str = "ts"

    @property
    def keys(self) -> list[str]:
        return list(self.roles.hierarchy)

    @property
    def values(self) -> list[str]:
        return self.roles.values

    @property
    def target(self) -> str:
        return (self.roles.dependent or self.values)[0]

    def with_roles(self, roles: dict[str, str]) -> Panel:
        made = schema.Roles.of(roles)
        made.timestamp = made.timestamp or self.roles.timestamp
        return replace(self, roles=made)

    def methods(self, method: str = "auto", quantity: str = "flow") -> dict[str, str]:
        """Aggregate of each value column: dependents by quantity, independents averaged, events by maximum."""
        own = method_for(quantity) if method == "auto" else method
        return {c: own for c in self.roles.dependent} | {c: "mean" for c in self.roles.independent} | {c: "max" for c in self.roles.event}


@dataclass
class Session:
    """Loads a source, confirms its schema and keeps the most processed form of the panel."""

    spark: SparkSession
    raw: DataFrame | None = None
    panel: Panel | None = None
    forms: dict[str, DataFrame] = field(default_factory=dict)
    freq: str | None = None

    def load(self, source: object, schema_text: str | None = None) -> DataFrame:
        self.raw = files.read(self.spark, source, schema_text)
        return schema.profile(self.raw)

    def confirm(self, roles: dict[str, str] | None = None, fill: float | None = 0.0, frequency: str | None = None) -> Panel:
        """Apply roles (inferred where not given): parse time, coerce values, keep keys as text, detect the frequency."""
        if self.raw is None:
            raise ValueError("load a source first")
        made = schema.Roles.of(roles) if roles else schema.infer_roles(self.raw)
        made.timestamp = made.timestamp or schema.guess_timestamp(self.raw)
        if not made.values:
            raise ValueError("no value column")
        at = schema.parse_dates(self.raw, made.timestamp, "_ts")
        at = at.select(F.col("_ts").alias("ts"), *[F.col(c).cast("string").alias(c) for c in made.hierarchy], *made.values).filter("ts is not null")
        at, _ = schema.coerce(at, made.values, fill)
        freq = frequency or detect_frequency(at).first()["freq"]
        self.panel, self.freq = Panel(at, made, Freq.of(freq).unit), freq
        self.forms = {"base": at}
        return self.panel

    @property
    def current(self) -> DataFrame:
        """Treated, else imputed, else accumulated, else the confirmed table."""
        return next(self.forms[k] for k in ("treated", "imputed", "accumulated", "base") if k in self.forms)

    def accumulate(self, freq: str, method: str = "auto", quantity: str = "flow", by_key: bool = False) -> DataFrame:
        """Resample the panel: summed over series unless ``by_key``, which keeps the hierarchy."""
        panel = self._panel()
        keys = panel.keys if by_key else []
        at = resample(panel.df, freq, panel.methods(method, quantity), keys, ts=panel.ts)
        self.forms["accumulated"] = at.withColumnRenamed("bucket", "ts")
        self.freq = freq
        return self.forms["accumulated"]

    def impute(self, method: str = "auto", period: int = 7, treat_zero: bool = False) -> DataFrame:
        """Impute every value column of the accumulated form (or of the table summed by time, on its dense grid)."""
        at = self._by_time()
        columns = [c for c in self._panel().values if c in at.columns]
        long = at.unpivot(["ts"], columns, "variable", "v")
        done = missing.impute(long, ["variable"], method, period, treat_zero=treat_zero)
        self.forms["imputed"] = done.groupBy("ts").pivot("variable", columns).agg(F.first("imputed"))
        return self.forms["imputed"]

    def treat(self, methods: Sequence[str] = ("iqr", "zscore", "isof"), treatment: str = "cap") -> DataFrame:
        at = self.forms.get("imputed", self._by_time())
        columns = [c for c in self._panel().roles.dependent + self._panel().roles.independent if c in at.columns]
        long = at.unpivot(["ts"], columns, "variable", "v")
        done = outliers.treat(outliers.detect(long, ["variable"], methods), ["variable"], treatment)
        treated = done.groupBy("ts").pivot("variable", columns).agg(F.first("treated"))
        events = [c for c in at.columns if c not in columns]
        self.forms["treated"] = treated.join(at.select(*events), "ts") if len(events) > 1 else treated
        return self.forms["treated"]

    def _panel(self) -> Panel:
        if self.panel is None:
            raise ValueError("confirm the schema first")
        return self.panel

    def _by_time(self) -> DataFrame:
        if "accumulated" in self.forms:
            return self.forms["accumulated"]
        panel = self._panel()
        at = resample(panel.df, panel.freq, panel.methods(), ts=panel.ts, dense=False)
        return densify(at, panel.freq).withColumnRenamed("bucket", "ts")
