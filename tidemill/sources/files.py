"""Readers and writers: CSV, spreadsheets, CSV text, records, frames, Parquet; exports, bundles and previews."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite

SUFFIXES = (".csv", ".xlsx", ".xls", ".parquet", ".json")


def read(spark: SparkSession, source: object, schema: str | None = None) -> DataFrame:
    """A DataFrame as it is; a record or a list of records; a path by its suffix; any other text as CSV content.

    Pass ``schema`` for CSV and JSON at scale: inferring types reads the files twice.
    """
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, dict):
        return spark.createDataFrame([source])
    if isinstance(source, (list, tuple)):
        return spark.createDataFrame(list(source))
    if not isinstance(source, str):
        raise TypeError(f"cannot read {type(source).__name__}")
    low = source.lower().rstrip("/")
    if "\n" not in source and low.endswith(SUFFIXES):
        if low.endswith(".parquet"):
            return spark.read.parquet(source)
        if low.endswith(".json"):
            return spark.read.schema(schema).json(source) if schema else spark.read.json(source)
        if low.endswith(".csv"):
            return _csv(spark, schema).csv(source)
        return read_excel(spark, source)
    if "\n" not in source:
        raise ValueError(f"unsupported source {source!r}: one of {SUFFIXES}, or CSV text")
    return csv_text(spark, source)


def _csv(spark: SparkSession, schema: str | None):
    reader = spark.read.option("header", True)
    return reader.schema(schema) if schema else reader.option("inferSchema", True)


def csv_text(spark: SparkSession, text: str) -> DataFrame:
    """A CSV literal: parsed by Spark's expression, types inferred from the first data row on the driver."""
    lines = [line for line in text.strip().splitlines() if line.strip()]
    names = [c.strip() for c in next(csv.reader([lines[0]]))]
    raw = spark.createDataFrame([(x,) for x in lines[1:]], "line string")
    row = F.from_csv("line", ", ".join(f"`{c.replace(chr(96), chr(96) * 2)}` string" for c in names))
    table = raw.select(row.alias("r")).select("r.*")
    held = [F.col(f"`{c.replace(chr(96), chr(96) * 2)}`") for c in names]
    counts = table.agg(*[(F.count(c) == F.count(c.try_cast("double"))).alias(f"_{i}") for i, c in enumerate(held)]).first()
    return table.select(*[c.cast("double").alias(n) if counts[f"_{i}"] else c for i, (n, c) in enumerate(zip(names, held))])


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """First sheet of a workbook, through the driver: spreadsheets are small. Needs an Excel engine for pandas."""
    import pandas as pd

    try:
        frame = pd.read_excel(path, sheet_name=sheet)
    except ImportError as missing:
        raise RuntimeError("reading spreadsheets needs openpyxl or xlrd") from missing
    return spark.createDataFrame(frame)


def write(df: DataFrame, path: str, form: str = "csv", mode: str = "errorifexists") -> None:
    """csv (with header), json or parquet."""
    if form not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported output {form!r}")
    writer = df.write.mode(mode)
    getattr(writer.option("header", True) if form == "csv" else writer, form)(path)


def write_excel(tables: dict[str, DataFrame], path: str, most: int = 1_000_000) -> None:
    """One workbook with a sheet a table, through the driver; larger tables than a sheet holds are refused."""
    import pandas as pd

    for name, df in tables.items():
        if df.limit(most + 1).count() > most:
            raise ValueError(f"{name} has more rows than a sheet holds")
    try:
        with pd.ExcelWriter(path) as book:
            for name, df in tables.items():
                df.toPandas().to_excel(book, sheet_name=name[:31], index=False)
    except ImportError as missing:
        raise RuntimeError("writing spreadsheets needs openpyxl") from missing


def write_bundle(tables: dict[str, DataFrame], path: str, report: str | None = None, forms: dict[str, str] | None = None) -> None:
    """Named tables under one folder (csv unless ``forms`` says otherwise), and a text report."""
    for name, df in tables.items():
        write(df, f"{path}/{name}", (forms or {}).get(name, "csv"))
    if report is not None and tables:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame([(line,) for line in report.splitlines() or [""]], "value string").coalesce(1).write.text(f"{path}/report")


def sanitised(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN and infinite values as null."""
    chosen = {n for n, t in df.dtypes if t in ("double", "float")} if columns is None else set(columns)
    return df.select(*[finite(F.col(f"`{c}`")).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])


def preview(df: DataFrame, rows: int = 200, order: Sequence[str] = ()) -> list[dict]:
    """The first rows as plain records with ISO dates and no NaN."""
    head = sanitised(df.orderBy(*order) if order else df).limit(rows)
    return [{k: (v.isoformat() if hasattr(v, "isoformat") else v) for k, v in r.asDict(recursive=True).items()} for r in head.collect()]
