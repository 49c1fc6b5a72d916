"""Profiles of streams: mergeable partial moments by micro-batch, and event-time windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("n", "s1", "s2", "s3", "lo", "hi")


@dataclass
class StreamProfile:
    """Running moments of numeric columns; a batch that is delivered again counts once."""

    columns: Sequence[str]
    sums: dict[str, list[float]] = field(default_factory=dict)
    last_batch: int = -1

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: one aggregate a batch, one small row to the driver."""
        if batch_id <= self.last_batch:
            return
        aggs = []
        for c in self.columns:
            x = F.col(c).cast("double")
            aggs += [F.count(x).alias(f"{c}|n"), *(F.sum(F.pow(x, F.lit(k))).alias(f"{c}|s{k}") for k in (1, 2, 3)), F.min(x).alias(f"{c}|lo"), F.max(x).alias(f"{c}|hi")]
        row = batch.agg(*aggs).first()
        for c in self.columns:
            new = [row[f"{c}|{p}"] for p in PARTS]
            if new[0]:
                old = self.sums.get(c)
                self.sums[c] = new if old is None else [*(a + b for a, b in zip(old[:4], new[:4], strict=True)), min(old[4], new[4]), max(old[5], new[5])]
        self.last_batch = batch_id

    def rows(self, spark: SparkSession) -> DataFrame:
        """(column, nonblank, avg, stddev, min, max) of all that has arrived."""
        out = [(c, int(n), s1 / n, max(0.0, s2 / n - (s1 / n) ** 2) ** 0.5, lo, hi) for c, (n, s1, s2, _, lo, hi) in self.sums.items()]
        return spark.createDataFrame(out, "column string, nonblank long, avg double, stddev double, min double, max double")


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the Parquet table ``name`` in ``folder``."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def profile_stream(stream: DataFrame, columns: Sequence[str], checkpoint: str) -> StreamProfile:
    """Profile what is there now, batch by batch."""
    found = StreamProfile(columns)
    query = stream.writeStream.foreachBatch(found.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return found


def windowed(stream: DataFrame, stamp: str, keys: Sequence[str], value: str, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, keys, n, total) by tumbling windows of event time; rows later than ``late`` are not waited for."""
    timed = stream.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late)
    by = timed.groupBy(F.window(stamp, every), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return by.select(F.col("window.start").alias("start"), *keys, "n", "total")
