"""Structured Streaming over an append-only log of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.upkeep import feedback


def events_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, use_case, n, negative) by day of the event; batch and streaming alike. A stream forgets a day when the
    watermark has passed it."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    f = feedback(events.withWatermark("ts", late) if events.isStreaming else events)
    days = f.groupBy(F.window("ts", "1 day").alias("w"), "use_case").agg(F.count("*").alias("n"), F.count_if(F.col("sentiment") == "negative").alias("negative"))
    return days.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "use_case", "n", "negative")


def run_to_table(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Work through what is there, keep the counts in a table beside the checkpoint, and stop; a later call goes on from there.
    A batch that is run again writes the same table again."""

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").option("path", f"{checkpoint}-{name}").saveAsTable(name)

    return counts.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
