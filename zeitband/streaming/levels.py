"""Levels of a stream of values in tumbling windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zeitband.shared import scratch_folder


def levels(values: DataFrame, width: str = "1 hour", late: str = "120 seconds") -> DataFrame:
    """start_s, rms and peak of ``value`` in each window of ``ts``; on a stream, rows later than ``late`` are dropped
    once their window has closed, and its state goes."""
    rows = values.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if values.isStreaming else values
    rms = F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6)
    return rows.groupBy(F.window("ts", width).alias("w")).agg(rms.alias("rms"), F.max(F.abs("value")).alias("peak")).select(F.unix_timestamp("w.start").alias("start_s"), "rms", "peak")


def file_stream(spark: SparkSession, table: str) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream. A stream reads folders, so a table of one file is
    named by a pattern that nothing but itself fits."""
    at = spark._jvm.org.apache.hadoop.fs.Path(table)
    is_file = at.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(at)
    head, _, name = table.rpartition("/")
    return spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{head}/[{name[0]}]{name[1:]}" if is_file else table)


def run_levels(spark: SparkSession, events: str, width: str = "1 hour", late: str = "120 seconds") -> DataFrame:
    """Read the Parquet files of ``events`` as a stream to their end; each batch appends the windows that it changed,
    and the last version of each window is the result."""
    place = scratch_folder(spark, "levels")
    stream = file_stream(spark, events)

    def write(batch: DataFrame, number: int) -> None:
        # A batch that runs again after a failure writes over its own folder.
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    query = levels(stream, width, late).writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{place}/rows")
    return rows.groupBy("start_s").agg(F.max_by(F.struct("rms", "peak"), "batch").alias("x")).select("start_s", "x.rms", "x.peak")
