"""Target-distribution importance resampling over hashed n-grams, by bit-sliced aggregation.

1. Each text becomes bit planes: plane k has a bit for each of the buckets, set where bit k of the bucket's count in the
   text is set. A text of few repeats has two or three planes of 10,000 bits; they are written once.
2. The corpus counts are sums of planes, one partial sum a task; they meet in a table of one row a bucket. The target's
   counts come the same way. Both tables have as many rows as there are buckets, at any size of the corpus.
3. A bucket's gain, floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))), is an integer; gains become planes too, in two's
   complement. A document's weight is the sum over pairs of planes of the set bits they share, times the product of the
   planes' powers of two, the sign plane's negative: exact integers.
4. Gumbel noise from a hash of the doc_id makes the highest scores a draw without replacement in proportion to the
   weights. Scores are sorted by range over all tasks; a task's first rank is the number of rows in the tasks before.

Defined cases: a null text has no words, weight 0 and is not eligible; texts of any length are read whole; rows that
share a doc_id are documents of their own (same noise; of equal scores the order among them is open); a null doc_id has
the noise of the word ``null`` and comes last among equal scores; an empty corpus gives an empty result, and an empty
target counts nothing; columns other than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialize
from .terms import LETTERS_AND_DIGITS, words

#: Documents whose counts are held as one dense table.
ROWS = 256
CACHE_ENTRIES = 1_000_000


class BucketOf(dict):
    """Feature to bucket; forgets all when it grows too large."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        b = self[feature] = zlib.crc32(feature) % self.buckets
        return b


def bucket_counts(text: str | None, n: int, of: BucketOf) -> tuple[int, int, np.ndarray]:
    """Words, features (runs of 1 to n words), and features by bucket."""
    total = n_features = 0
    counts = np.zeros(of.buckets, np.int64)
    tail: list[bytes] = []
    for part in words(text, LETTERS_AND_DIGITS):
        total += len(part)
        before = len(tail)
        run = tail + part
        for k in range(1, n + 1):
            first = max(0, before - k + 1)
            grams = part if k == 1 else [b" ".join(run[i : i + k]) for i in range(first, len(run) - k + 1)]
            n_features += len(grams)
            counts += np.bincount(list(map(of.__getitem__, grams)), minlength=of.buckets)
        tail = run[-(n - 1) :] if n > 1 else []
    return total, n_features, counts


def to_planes(counts: np.ndarray) -> list[np.ndarray]:
    """Rows of counts as rows of planes: for each bit, the lowest first, one packed bit a bucket."""
    return [np.packbits((counts >> k) & 1, axis=-1, bitorder="little") for k in range(int(counts.max(initial=0)).bit_length())]


def bags(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features and planes (one after the other, as many as the highest count needs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = BucketOf(buckets)
        for block in blocks(batches, "text"):
            for at in range(0, block.num_rows, ROWS):
                b = block.slice(at, ROWS)
                found = [bucket_counts(t, n, of) for t in b.column(1).to_pylist()]
                counts = np.array([c for _, _, c in found])
                planes = to_planes(counts)
                used = [int(m).bit_length() for m in counts.max(axis=1)]
                packed = [b"".join(planes[k][i].tobytes() for k in range(u)) for i, u in enumerate(used)]
                columns = [b.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "planes"])

    kind = docs.schema["doc_id"].dataType.simpleString() if "doc_id" in docs.columns else "long"
    source = docs.select("doc_id" if "doc_id" in docs.columns else F.lit(None).cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, planes binary")


def corpus_counts(written: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket over all rows: a sum of planes in each task, then one row a bucket."""
    width = -(-buckets // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                held = [np.frombuffer(p, np.uint8).reshape(-1, width) for p in b.column(0).slice(at, ROWS).to_pylist()]
                for k in range(max((len(p) for p in held), default=0)):
                    bits = np.unpackbits(np.array([p[k] for p in held if len(p) > k]), axis=1, count=buckets, bitorder="little")
                    total += bits.sum(axis=0, dtype=np.int64) << k
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    found = written.select("planes").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for r in found.collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Each bucket's gain, computed in doubles."""
    top, bottom = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    ratio = (target + 1.0) * top / ((corpus + 1.0) * bottom)
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


class Weigher:
    """Weights of documents from their planes."""

    def __init__(self, gain: np.ndarray):
        self.width = -(-len(gain) // 8)
        self.words = -(-self.width // 8)
        bits = int(np.abs(gain).max(initial=0)).bit_length()
        # Two's complement: planes of 1, 2, 4 ..., and one of the sign.
        planes = [np.packbits((gain >> k) & 1, bitorder="little") for k in range(bits + 1)]
        self.gain = np.array([self.as_words(p[None, :])[0] for p in planes])
        self.worth = np.array([1 << k for k in range(bits)] + [-(1 << bits)], np.int64)

    def as_words(self, rows: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(rows), self.words * 8), np.uint8)
        wide[:, : rows.shape[1]] = rows
        return wide.view(np.uint64)

    def weights(self, packed: list[bytes]) -> np.ndarray:
        """One weight for each row of planes."""
        used = np.array([len(p) // self.width for p in packed], np.int64)
        result = np.zeros(len(packed), np.int64)
        if used.sum():
            planes = self.as_words(np.frombuffer(b"".join(packed), np.uint8).reshape(-1, self.width))
            worth = np.zeros(len(planes), np.int64)
            for plane, w in zip(self.gain, self.worth, strict=True):
                worth += np.bitwise_count(planes & plane).sum(axis=1, dtype=np.int64) * w
            row = np.repeat(np.arange(len(packed)), used)
            power = np.arange(len(planes)) - np.repeat(np.cumsum(used) - used, used)
            np.add.at(result, row, worth << power)
        return result


def weighed(written: DataFrame, gain: np.ndarray) -> DataFrame:
    """The rows of ``bags`` with ``weight`` in place of their planes."""
    kept = [c for c in written.columns if c != "planes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Weigher(gain)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(of.weights(b.column(len(kept)).to_pylist()))], [*kept, "weight"])

    schema = ", ".join(f"{c} {written.schema[c].dataType.simpleString()}" for c in kept)
    return written.select(*kept, "planes").mapInArrow(run, f"{schema}, weight long")


def ranked(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (eligible ones) with their rank by score, ties to the smaller doc_id; null below the drawn share."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = materialize(placed, "placed")
    task = F.shiftright("place", 33)
    # One row a task of the sort.
    counts = sorted((r[0], r[1]) for r in placed.groupBy(task.alias("task")).count().collect())
    drawn, starts, at = percent * sum(n for _, n in counts) // 100, [], 0
    for t, n in counts:
        starts.append((t, at))
        at += n
    first = F.broadcast(rows.sparkSession.createDataFrame(starts, "task long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("task", task).join(first, "task").withColumn("rank", F.when(rank <= drawn, rank)).drop("task", "before", "place")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each document; rank is null where it isn't drawn.

    ``target`` (text) gives the distribution that the draw is to have. Of the documents with at least ``least_words``
    words, ``percent`` in a hundred are drawn.
    """
    written = materialize(bags(docs, n, buckets), "bags")
    gain = gains(corpus_counts(bags(target, n, buckets), buckets), corpus_counts(written, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weighed(written, gain).withColumn("score", F.col("weight") + noise), "scored")
    enough = F.col("n_words") >= least_words
    shown = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(~enough).select(*shown, F.lit(None).cast("long").alias("rank"))
    return ranked(scored.filter(enough).select(*shown), percent).select(*shown, "rank").union(rest)
