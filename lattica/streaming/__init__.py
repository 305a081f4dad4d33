"""Alert feeds as streams: unique by uuid within a watermark, then counted by day and type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def alert_stream(spark: SparkSession, folder: str, schema: str, per_batch: int = 100, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(fmt).load(folder)


def daily_counts(alerts: DataFrame, key: str = "uuid", ts: str = "ts", kind: str = "type", late: str = "2 days") -> DataFrame:
    """day, type, n. On a stream, repeats are recognised and late rows counted within the watermark; on a table, all are."""
    seen = alerts.withColumn("__ts", F.col(ts).cast("timestamp"))
    if alerts.isStreaming:
        seen = seen.withWatermark("__ts", late).dropDuplicatesWithinWatermark([key])
    else:
        seen = seen.groupBy(key).agg(F.min_by(kind, "__ts").alias(kind), F.min("__ts").alias("__ts"))
    counts = seen.groupBy(F.window("__ts", "1 day"), kind).agg(F.count("*").alias("n"))
    return counts.select(F.to_date("window.start").alias("day"), kind, "n")
