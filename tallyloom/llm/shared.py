"""What the operators here share: tables, free column names, functions shipped by value."""

from __future__ import annotations

import gc
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import counted, discard, shared_dir, stored, tidy

__all__ = ["chunks", "counted", "discard", "free", "lean", "released", "shared_dir", "ship", "small", "stored", "table", "tidy"]

#: A side of at most so many rows of a few numbers is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch. Executor and worker hold more than one at once, grown by doubling, and Python's strings beside them.
BATCH_BYTES = 4 << 20
#: Rows that stand as Python objects at once.
CHUNK = 256


def ship(module: str) -> None:
    """Send the functions of a module to workers by value, so that they need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it has few rows."""
    return F.broadcast(df) if counted(df) <= BROADCAST_ROWS else df


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores as it takes to clash with no column of ``taken``."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def lean(spark: SparkSession) -> None:
    """From now on this session sends Arrow batches of ``BATCH_BYTES`` to workers, not of 10,000 rows whatever their length.

    It stays set, as it counts when a plan runs, not when it is made.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low in range(0, b.num_rows, CHUNK):
            yield b.slice(low, CHUNK)


def released() -> None:
    """Give back to the system what this process has freed; its allocators would keep it."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ship(__name__)
