"""Counts and times of index runs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Upper bounds of the keys-per-leaf histogram, each inclusive; above the last is one more bucket.
BOUNDS = (0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)


#: Upper bounds of the histogram of durations, in milliseconds.
DURATIONS = tuple(10 * 2**k for k in range(16))


def histogram(df: DataFrame, value: Column, bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """(bucket, upper, n) with every bucket, the empty ones too; ``upper`` of the last is null."""
    place = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        place = F.when(value <= bounds[k], k).otherwise(place)
    counts = df.select(place.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    uppers = F.array(*map(F.lit, bounds))
    every = df.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("bucket"), F.get(uppers, F.col("id")).alias("upper"))
    return every.join(counts, "bucket", "left").select("bucket", "upper", F.coalesce("n", F.lit(0)).alias("n"))


class Progress(StreamingQueryListener):
    """Leaves a second, remaining leaves and the time they will take, of a running update."""

    def __init__(self, target: int | None = None):
        self.target, self.rows, self.reports = target, 0, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows += p.numInputRows
        rate = p.processedRowsPerSecond or 0.0
        left = max(0, self.target - self.rows) if self.target is not None else None
        self.reports.append({"leaves": self.rows, "per_second": rate, "remaining": left, "eta_s": left / rate if left is not None and rate > 0 else None, "durations": dict(p.durationMs)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def duration_histograms(spark: SparkSession, reports: list[dict]) -> DataFrame:
    """(phase, bucket, upper, n) of the phases that ``Progress.reports`` timed, such as reading, running and committing a batch."""
    rows = spark.createDataFrame([(k, int(v)) for r in reports for k, v in r["durations"].items()], "phase string, ms long")
    phases = [r.phase for r in rows.select("phase").distinct().orderBy("phase").collect()]  # a handful, named by Spark
    parts = [histogram(rows.where(F.col("phase") == p), F.col("ms"), DURATIONS).select(F.lit(p).alias("phase"), "*") for p in phases]
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "phase string, bucket int, upper int, n long")
