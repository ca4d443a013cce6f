"""Helpers shared by the training-data operators: Arrow row mapping, shared storage, table reading."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that a worker takes up at once (one row at least). Spark itself bounds a batch by 64 MB.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a run within one process (tests) gets a folder of its own; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables:
    """Stored tables that one operator alone reads; ``drop`` removes those no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame | list[DataFrame], name: str) -> DataFrame:
        """Write ``df`` in the shared folder and read it back: cuts lineage, survives lost executors.

        A list is written one after another, as parts of one table.
        """
        path = shared_dir(self.spark, name)
        parts = df if isinstance(df, list) else [df]
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # for this write: once it is done, its shuffle files go
        try:
            for part in parts:
                part.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)
        out = self.spark.read.schema(parts[0].schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove these tables, or all: what reads them must have been stored itself."""
        for table in tables or [t for t, _ in self.paths.values()]:
            _, path = self.paths.pop(id(table))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A stored table that stays, as what the caller gets reads it."""
    return Tables(df.sparkSession).stored(df, name)


_held: dict = {}


def held(key: tuple, build: Callable[[], object]):
    """An object that a worker keeps from task to task (an encoder, an automaton): one a worker, the last one asked for,
    so that workers that serve several operators don't pile them up."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it


def give_back() -> None:
    """Returns freed memory to the system: workers are kept, and several share an executor."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size.astype(np.int64) + 32)
    first = 0
    while first < len(total):
        upto = (total[first - 1] if first else 0) + most
        last = max(first + 1, int(np.searchsorted(total, upto, side="right")))
        yield batch.slice(first, last - first)
        first = last
    give_back()


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns that an operator is about to add, so its own always win over clashing input columns."""
    low = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in low])


def add_columns(
    df: DataFrame,
    fields: list[T.StructField],
    fn: Callable[[pa.RecordBatch], list],
    keep: list[str] | None = None,
    by: str | None = None,
) -> DataFrame:
    """Row-wise Arrow map: ``fn(batch)`` returns one array for each of ``fields``; other columns pass through.

    Input columns that clash with ``fields`` are replaced; ``fn`` still sees them. by: the text column whose bytes bound
    what ``fn`` sees at once.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, by) if by else (whole,) if whole.num_rows else ():
                made = [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a, arrow.field(len(names) + i).type) for i, a in enumerate(fn(batch))]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *made], schema=pa.schema([*(pa.field(n, batch.schema.field(n).type) for n in names), *list(arrow)[len(names):]]))

    return df.mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """Texts of a batch as UTF-8 bytes, without decoding."""
    array = batch.column(batch.schema.get_field_index(column))
    return array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()).to_pylist()
