"""Structured streams over landing folders."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.session import shared_folder


def hourly_totals(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """(event_type, hour, n, total) of all events that have landed, kept as a streaming aggregate.

    The stream reads what is there, a bounded number of files a trigger, and stops; state is one row a type and hour. Late events are
    counted, for all data are taken before the result is read. The result is a written table in the shared folder.
    """
    schema = spark.read.parquet(folder).schema
    parent, _, name = folder.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    events = reader.option("pathGlobFilter", name).parquet(parent) if name.endswith(".parquet") and _is_file(spark, folder) else reader.parquet(folder)
    totals = events.groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result")

    stream = totals.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{out}/result").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def _is_file(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()


def watched_windows(events: DataFrame, watermark: str = "1 hour", window: str = "30 minutes") -> DataFrame:
    """Events a type and window with late data up to the watermark; works on streams and tables alike."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def new_pages(spark: SparkSession, folder: str, schema, seen_column: str = "page_id") -> DataFrame:
    """A stream of pages that land, each page_id once within the watermark of its load time."""
    return spark.readStream.schema(schema).parquet(folder).withWatermark("loaded_at", "1 day").dropDuplicatesWithinWatermark([seen_column])
