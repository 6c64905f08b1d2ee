"""Token ids in Parquet list columns: dictionary pages for the ids, delta encoding for the document columns, row
groups and pages of a set size with page indexes, so that ids or metadata can be read selectively.

A dataset is a folder of Parquet files in ascending document order: doc_id, n_tokens, tokens. Rows with a null
doc_id come first; a null text counts as empty; repeated ids keep one row each, in the order of a hash of their texts;
texts of any length are stored whole; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunk_encoder import encoder
from .common import blocks, with_checksums


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and tokens of each document, in the order of the rows; ``end_id`` closes each document."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(tokenizer)
        for b in blocks(batches, "text"):
            ids = [x + end for x in of.encode([t or "" for t in b.column(1).to_pylist()])]
            n = np.array([len(x) // 4 for x in ids], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "n_tokens", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens int, tokens array<int>")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode ``docs`` and write them as token files in ascending doc_id order.

    Documents are dealt by ranges of doc_id before they are encoded, so only raw text moves and no task holds more
    than its range. Rows that share a doc_id (or have none) are dealt by the hash of their text.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    dealt = keyed.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    (
        encode_documents(dealt, tokenizer, end_id)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("compression", "zstd")
        .parquet(path)
    )


def file_number(name: Column) -> Column:
    """The number of the task that wrote a file (``part-00012-...``); names alone are out of order from 100,000 on."""
    return F.regexp_extract(name, r"part-(\d+)", 1).cast("long")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, start, file and position of each document, without reading any token.

    ``start`` counts the tokens of all documents before it: a running sum inside each file, plus the totals of the
    files before (one row per file).
    """
    rows = spark.read.parquet(path).select("doc_id", "n_tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("position"))
    before = Window.orderBy(file_number(F.col("file"))).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total")).select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(totals, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "file", "position")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """file, position and ids_crc32 of each document, from its stored tokens."""
    return with_checksums(spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("position"), "tokens"))
