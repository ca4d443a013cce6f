"""Structured Streaming form of resampling: event-time buckets with a watermark."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sunday-anchored weeks start three days after the epoch's Thursday; two-week bins start with their origin's week.
WINDOWS = {"H": ("1 hour", None), "D": ("1 day", None), "W": ("7 days", "3 days"), "2W": ("14 days", None)}


def accumulate(stream: DataFrame, freq: str, keys: Sequence[str] = (), ts: str = "ts", value: str = "v", late: str = "1 day", origin: date | None = None) -> DataFrame:
    """Sum, count, least and greatest value of each bucket; rows later than the watermark are left out.

    Works alike on a stream (append mode) and a table; months have no fixed length and need the batch form.
    origin: a date in the first bin of 2W, which the batch form takes from the data; a stream can't know it.
    """
    if freq not in WINDOWS:
        raise ValueError(f"{freq} has no fixed length: use the batch resample")
    size, start = WINDOWS[freq]
    if freq == "2W":
        if origin is None:
            raise ValueError("2W needs the origin of its bins: a date in the first one")
        days = (origin - date(1970, 1, 1)).days
        start = f"{(days - (days + 4) % 7) % 14} days"  # the origin's Sunday
    window = F.window(ts, size, startTime=start) if start else F.window(ts, size)
    made = stream.withWatermark(ts, late).groupBy(*keys, window.alias("w")).agg(F.sum(value).alias("sum"), F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    return made.select(*keys, F.col("w.start").alias("bucket"), "sum", "n", "min", "max")
