"""Shared helpers: tables, checkpoint folder, intermediate tables, Arrow mapping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import Scratch, cut, ship

__all__ = ["Scratch", "cut", "lists_of", "map_arrow", "map_stream", "read"]


#: Of a batch, which Spark bounds by spark.sql.execution.arrow.maxBytesPerBatch, Python objects are made of about so many
#: bytes at once.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the system: a worker process stays for later tasks of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType, rows: int = 512) -> DataFrame:
    """mapInArrow with a state that is made once a task (fn()), on slices of at most ``rows`` rows and some megabytes."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn()
        for batch in batches:
            step = max(1, min(rows, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                yield each(batch.slice(at, step))
        getattr(each, "close", int)()
        del each
        give_back()

    return df.mapInArrow(run, schema)


def map_stream(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, rows: int = 1024) -> DataFrame:
    """mapInArrow of a generator over a partition's rows in order, as tuples; results go out in batches of ``rows`` or of
    some megabytes of text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            step = max(1, min(4096, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)
        for row in fn(tuples(batches)):
            out.append(row)
            size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if len(out) >= rows or size >= SLICE_BYTES:
                yield pack()
                out, size = [], 0
        if out:
            yield pack()
        give_back()

    return df.mapInArrow(run, schema)


def lists_of(values, lengths, kind: pa.DataType) -> pa.Array:
    """A list array from flat values (numpy) and the length of each list."""
    import numpy as np

    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
