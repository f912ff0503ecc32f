"""Structured Streaming over event tables: tumbling windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; works alike on a stream and on a table."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withWatermark("at", late) if e.isStreaming else e
    return e.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def replay(spark, source: DataFrame, path: str, sink: str) -> DataFrame:
    """Run the windows as a stream over the files of ``path`` into a memory table, to its end."""
    stream = spark.readStream.schema(source.schema).parquet(path)
    q = tumbling(stream).writeStream.outputMode("complete").format("memory").queryName(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(sink)
