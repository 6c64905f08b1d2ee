"""WAV files as tables, and tables as WAV files. Files are read and written by the tasks, one row each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zeitband.functions.audio import decode_wav, decode_wav_range, encode_wav


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """name and samples of each file; a file that is not mono 16-bit of the usual rate ends the job."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), decode_wav("content").alias("samples"))


def read_wav_ranges(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """``ranges`` (name, start_ms, end_ms) with the samples between; null where a range is empty, over a minute or not
    all there."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    named = rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return ranges.join(named, "name").withColumn("samples", decode_wav_range("content", "start_ms", "end_ms")).drop("content")


def write_wavs(rows: DataFrame, path: str) -> DataFrame:
    """Write a file ``<name>.wav`` of each row's ``samples``: name and bytes of what was written. A task that runs again
    writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = fs.FileSystem.from_uri(path)
        where.create_dir(folder, recursive=True)
        for b in batches:
            names, sizes = b.column(0).to_pylist(), []
            for name, raw in zip(names, b.column(1).to_pylist(), strict=True):
                with where.open_output_stream(f"{folder}/{name}.wav", compression=None) as out:
                    out.write(raw)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "n_bytes"])

    made = rows.filter("samples is not null").select(F.col("name").cast("string").alias("name"), encode_wav("samples").alias("raw"))
    return made.mapInArrow(run, "name string, n_bytes long")
