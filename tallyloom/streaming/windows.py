"""Windows over events, batch and stream alike: the same plan runs on either."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import named


def windowed(events: DataFrame, length: str = "7 days") -> DataFrame:
    """Counts and sums of tumbling windows by type."""
    w = events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd").alias("window_start"), "event_type", "n", "value")


def stream(spark: SparkSession, path: str, sink: str, *, length: str = "7 days", late: str = "1 day"):
    """Starts a query that folds new files of ``path`` into windows and appends closed ones to the memory table ``sink``."""
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed(source.withWatermark("ts", late), length).writeStream.format("memory").queryName(sink).outputMode("append").trigger(availableNow=True).start()


@named("""SELECT strftime(time_bucket(INTERVAL 7 DAY, cast(ts AS TIMESTAMP), TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def event_windows(t) -> DataFrame:
    return windowed(t.events)


@named("""WITH o AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events) SELECT user_id, cast(sum(fresh) AS bigint) AS sessions, count(*) AS n FROM o GROUP BY 1""")
def event_sessions(t) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.lag("ts").over(w).isNull() | (F.col("ts") > F.lag("ts").over(w) + F.expr("INTERVAL 12 HOURS"))
    return t.events.withColumn("fresh", fresh.cast("int")).groupBy("user_id").agg(F.sum("fresh").alias("sessions"), F.count(F.lit(1)).alias("n"))
