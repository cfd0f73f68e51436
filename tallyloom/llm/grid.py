"""A stated set of queries against all rows, in blocks.

Candidates are packed into blocks once and stored; after that they are not
shuffled. Queries come in groups of a bounded number of blocks. A group is sent
to all tasks; each passes over its candidate blocks and keeps of each query
what can still be among its nearest. What the tasks keep is stored group by group,
so a lost executor costs tasks of one group. Work is queries times candidates,
traffic is the queries and what is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import counted, ship, stored, tidy

#: Blocks of queries that are sent to the tasks at once.
GROUP_BLOCKS = 16


def blocks(rows: DataFrame, name: str, fields: list[str], make: Callable[[int, bytes], list[bytes]], *, block_rows: int) -> DataFrame:
    """Rows of (id long, body binary, kind int) as stored rows of (block, kind, ids, ``fields``), each of one kind and at most ``block_rows``.

    ``make`` gives the binary fields from kind and joined bodies. Partitions are
    joined, not shuffled, to be no more than there are full blocks.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        open_: dict[int, tuple[list[int], list[bytes]]] = {}

        def out(kind: int) -> pa.RecordBatch:
            nonlocal made
            ids, bodies = open_.pop(kind)
            made += 1
            binary = [np.array(ids, "<i8").tobytes(), *make(kind, b"".join(bodies))]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.array([kind], pa.int32()), *(pa.array([x], pa.binary()) for x in binary)], ["block", "kind", "ids", *fields])

        for b in batches:
            for i, body, kind in zip(b.column("id").to_pylist(), b.column("body").to_pylist(), b.column("kind").to_pylist()):
                held = open_.setdefault(kind, ([], []))
                held[0].append(i)
                held[1].append(body)
                if len(held[0]) >= block_rows:
                    yield out(kind)
        for kind in list(open_):
            yield out(kind)

    few = rows.select("id", "body", "kind").coalesce(max(1, -(-counted(rows) // block_rows)))
    return stored(few.mapInArrow(pack, "block long, kind int, ids binary, " + ", ".join(f"{f} binary" for f in fields)), name)


def sweep(candidates: DataFrame, queries: DataFrame, search: Callable[[Iterator[dict], list[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``search`` finds for each group of query blocks in each partition of candidate blocks; stored. Blocks come as dictionaries of their columns."""
    spark = candidates.sparkSession
    with tidy(spark):
        names = sorted(r[0] for r in queries.select("block").collect())  # a number a block
    found = []
    for low in range(0, max(1, len(names)), GROUP_BLOCKS):
        with tidy(spark):
            asked = [r.asDict() for r in queries.filter(F.col("block").isin(names[low : low + GROUP_BLOCKS])).collect()]
        held = spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            yield from search((row for b in batches for row in b.to_pylist()), held.value)

        found.append(stored(candidates.mapInArrow(run, schema), "found"))
        held.unpersist()
    return reduce(DataFrame.unionByName, found)


ship(__name__)
