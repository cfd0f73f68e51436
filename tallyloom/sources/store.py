"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes the shuffle files of an execution at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where none is named, a local session gets a folder of its own; on a cluster
    that would be a folder which others can't read, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Actions in here remove their shuffle files when they end; nothing reads those again."""
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts the lineage: what reads the result needs none of the tasks before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables, once all that was made of them is stored too."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def counted(df: DataFrame) -> int:
    """Rows of ``df``; the shuffle files of the count go with it."""
    with tidy(df.sparkSession):
        return df.count()
