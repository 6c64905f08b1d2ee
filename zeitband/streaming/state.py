"""What queries with state of their own need: the state store that can hold it, and runs to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zeitband.shared import scratch_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def needs_rocksdb(spark: SparkSession) -> None:
    """State of several kinds (maps, timers) lives in the RocksDB provider alone. A session that names none gets it."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)


def run_appended(spark: SparkSession, stream: DataFrame, what: str) -> DataFrame:
    """All rows that ``stream`` appends until its sources end, as a table in the shared folder. Each batch has a folder
    of its own, which it writes over if it runs again after a failure."""
    place = scratch_folder(spark, what)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows").select(*stream.columns)
