"""What the operators of this subpackage share: scratch tables, table readers and small checks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, scratch_dir, tidy
from ..session import bound_batches

__all__ = ["bound_batches", "cut", "is_unique", "only", "parts", "read", "release", "scratch_dir", "sum_arrays", "tidy"]

try:  # the GNU C library has it, others don't
    _LIBC = ctypes.CDLL(None)
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError, TypeError):
    _LIBC = None


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parts(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in slices of about `most_bytes` of a text or binary column, so that a task's Python side holds little at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
        del batch
        release()


def release() -> None:
    """Hand back what Arrow and the C library hold of finished batches: Python workers live on and would keep it through later stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def is_unique(df: DataFrame, column: str) -> bool:
    return df.groupBy(column).count().filter("count > 1").limit(1).count() == 0


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns under exactly these names; extra columns, also with clashing names in other case, go. Every operator starts
    here, so the bound of batches for Python is set here."""
    bound_batches(df.sparkSession)
    out = []
    for name in names:
        exact = [c for c in df.columns if c == name] or [c for c in df.columns if c.lower() == name.lower()]
        if not exact:
            raise ValueError(f"column {name} is missing")
        out.append(exact[0])
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(out, names, strict=True)])
    places = [df.columns.index(c) for c in out]
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{i}").alias(n) for i, n in zip(places, names, strict=True)])


def _adder(kind: str, code):
    """Adds up the arrays of a group; `code`, if any, makes bytes of the sum. Coding here keeps a stage to one Python worker a task."""

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(0, np.int64)
        for x in table["counts"]:
            own = np.frombuffer(x.as_buffer(), kind)
            total = own.astype(np.int64) if not len(total) else total + own
        raw = (code(total) if code else total).tobytes()
        return pa.table({"slice": table["slice"][:1], "part": table["part"][:1], "counts": pa.array([raw], pa.binary())})

    return run


def sum_arrays(df: DataFrame, n_parts: int, fan_in: int = 64, code=None, kind: str = "<i8") -> dict[int, np.ndarray]:
    """Sums of (slice int, part long, counts binary of `kind`) by slice, added up a tree of at most fan_in arrays a task.

    The arrays have a fixed length; it and the number of slices bound what reaches the driver. code: what the executors turn each sum into, an array of bytes.
    """
    while True:
        n_parts = -(-n_parts // fan_in)
        last = n_parts <= 1
        df = df.withColumn("part", F.floor(F.col("part") / fan_in).cast("long")).groupBy("slice", "part").applyInArrow(_adder(kind, code if last else None), "slice int, part long, counts binary")
        kind = "<i8"
        if last:
            return {r["slice"]: np.frombuffer(r["counts"], np.uint8 if code else "<i8") for r in df.collect()}
