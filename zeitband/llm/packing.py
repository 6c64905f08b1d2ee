"""Packing by power-of-two decomposition: each document's ids are cut into pieces whose lengths are powers of two,
the longest first, and pieces of equal length form one bucket. Every piece is a sequence of its own, so no sequence
crosses documents and none is padded.

Defined cases: a null or empty text has the end id alone, one piece of length 1; every row of the table is packed,
repeated rows (each packed anew) and null ids included; an empty table gives no pieces; a text of any length is cut
whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunk_encoder import encoder
from .common import blocks, materialize


def piece_lengths(n: int, longest: int) -> list[int]:
    """``n`` as a sum of powers of two up to ``longest``, descending."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset (0: a piece is a sequence) and its
    tokens. Sequence ids are gapless and ascend with the length of the bucket.

    Pieces are written once by the tasks that cut them, each with its number among those of its length in the task.
    Where a task's numbers begin is one small row a task, so no token is moved to number the sequences.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, task = encoder(tokenizer), TaskContext.get().partitionId()
        met = {1 << k: 0 for k in range(longest.bit_length())}
        for b in blocks(batches, "text"):
            ids = [x + end for x in of.encode([t or "" for t in b.column(1).to_pylist()])]
            sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            lengths = [piece_lengths(n, longest) for n in sizes]
            row = np.repeat(np.arange(len(ids)), [len(x) for x in lengths])
            size = np.array([n for x in lengths for n in x], dtype=np.int64)
            starts = np.concatenate([np.cumsum(x) - x for x in map(np.array, lengths)])
            nth = np.empty(len(size), np.int64)
            for n in met:
                at = np.flatnonzero(size == n)
                nth[at] = met[n] + np.arange(len(at))
                met[n] += len(at)
            # Pieces of a document stand in its order, so the ids of all pieces in a row are those of the documents.
            offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
            columns = [b.column(0).take(pa.array(row)), pa.array(starts.astype(np.int64)), pa.array(size), pa.array(sizes[row]), pa.array(np.full(len(size), task, np.int64)), pa.array(nth), tokens]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "task", "nth", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, task long, nth long, tokens array<int>"
    return number_sequences(materialize(docs.select("doc_id", "text").mapInArrow(run, schema), "pieces"), longest)


def number_sequences(pieces: DataFrame, longest: int) -> DataFrame:
    """``pieces`` with sequence_id in place of task and nth: buckets by length, in each bucket task by task. What is
    broadcast is one row a task with a number a bucket, about 100 bytes for each file split of the input."""
    kinds = range(longest.bit_length())
    each = pieces.groupBy("task").agg(*[F.count_if(F.col("length") == 1 << k).alias(f"n{k}") for k in kinds])
    before, all_ = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("task").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shorter = F.lit(0)
    base = []
    for k in kinds:
        base.append(shorter + F.coalesce(F.sum(f"n{k}").over(before), F.lit(0)))
        shorter = shorter + F.sum(f"n{k}").over(all_)
    bases = each.select("task", F.array(*base).alias("bases"))
    number = F.get("bases", F.length(F.bin("length")) - 1) + F.col("nth")
    return pieces.join(F.broadcast(bases), "task").select("doc_id", "start", "length", "doc_tokens", number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "tokens")
