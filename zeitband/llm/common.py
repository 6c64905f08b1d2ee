"""What the training-data operators share: tables in the shared folder and Arrow batches of bounded size."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from zeitband.shared import new_folder


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the plan above it restarts from files that survive
    lost executors, and nothing below is computed twice."""
    path = new_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._zb_folder = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete the folders of materialized tables. All that was made from them must be written by then."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._zb_folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_checksums(rows: DataFrame, tokens: str = "tokens", name: str = "ids_crc32") -> DataFrame:
    """``rows`` with the column of token ids replaced by their CRC-32 as little-endian unsigned 32-bit integers."""
    kept = [c for c in rows.columns if c != tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(kept))
            values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(crc, pa.int64())], [*kept, name])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, tokens).mapInArrow(run, f"{schema}, {name} long")


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches in order; each slice holds at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = [x or 0 for x in pa.compute.binary_length(texts).to_pylist()]
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
