"""The audit log as a stream (an extension: the log is append-only, so its folder is a streaming source)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def tail(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """New rows of a log folder as they are committed, its sub-folders included."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def activity(events: DataFrame, time: str = "created_at", late: str = "10 minutes", width: str = "5 minutes", by: str = "action") -> DataFrame:
    """Counts of each kind of event in windows of time; rows later than the watermark are dropped, and state with them."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), by, "n")
    )


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over what is there and stop; exactly once for each checkpoint folder."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
