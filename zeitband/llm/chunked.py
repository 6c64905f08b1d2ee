"""Texts in compressed chunks, and which hashes of their parts occur in more than one text.

A chunk is a row with a few megabytes of text. Two things travel by chunk: the texts, compressed, and what other
chunks know of its hashes. The hashes themselves (4 bytes each) are dealt by value to buckets of bounded size; each
bucket answers every chunk with those of its hashes that several texts have. A hash in all chunks costs one entry a
chunk.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

CHUNK_BYTES = 4_000_000
LOW = np.uint64(0xFFFFFFFF)


def bucket_of(s: np.ndarray, buckets: int) -> np.ndarray:
    return ((s >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def short(s: np.ndarray) -> np.ndarray:
    return ((s >> np.uint64(1)) & LOW).astype(np.uint32)


def chunks(kept: DataFrame) -> DataFrame:
    """``kept`` (doc_id, class, packed text) in chunks: chunk, ids, classes, sizes and the compressed texts as one blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=9), zstandard.ZstdDecompressor()
        held: list[tuple[int, bytes, bytes]] = []

        def flush() -> pa.RecordBatch:
            name = int.from_bytes(hashlib.blake2b(held[0][1] + struct.pack("<q", len(held)), digest_size=8).digest(), "little", signed=True)
            columns = [[name], [[x[0] for x in held]], [[x[1] for x in held]], [[len(x[2]) for x in held]], [pack.compress(b"".join(x[2] for x in held))]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chunk", "ids", "classes", "sizes", "packed"])

        n = 0
        for b in batches:
            for i, c, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append((i, c, unpack.decompress(packed)))
                n += len(held[-1][2])
                if n >= CHUNK_BYTES:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return kept.select("doc_id", "class", "packed").mapInArrow(run, "chunk long, ids array<long>, classes array<binary>, sizes array<long>, packed binary")


def open_chunk(sizes: list[int], packed: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    ends = np.cumsum(sizes)
    return [raw[e - n : e] for n, e in zip(sizes, ends, strict=True)]


def shared_counts(held: DataFrame, keys_of: Callable[[list[bytes]], list[np.ndarray]], buckets: int) -> DataFrame:
    """chunk, and of its hashes in one bucket those that several texts have: short hashes, and in how many texts.

    ``keys_of`` gives the distinct hashes of each text."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, sizes, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                all_ = np.concatenate(keys_of(open_chunk(sizes, packed)))
                at = bucket_of(all_, buckets)
                order = np.argsort(at, kind="stable")
                at, all_ = at[order], short(all_[order])
                cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))[: len(at) + 1]
                rows = []
                for s, e in zip(cut[:-1], cut[1:], strict=True):
                    h, n = np.unique(all_[s:e], return_counts=True)
                    many = n > 1
                    rows.append((int(at[s]), chunk, h[~many].tobytes(), h[many].tobytes(), n[many].astype(np.uint32).tobytes()))
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "chunk", "once", "many", "counts"])

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(a + b, np.uint32) for a, b in zip(rows["once"], rows["many"], strict=True)]
        weights = [np.concatenate([np.ones(len(a) // 4, np.uint32), np.frombuffer(c, np.uint32)]) for a, c in zip(rows["once"], rows["counts"], strict=True)]
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        h, where = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(where, np.concatenate(weights))
        keep = total[where] > 1
        of, hashes, n = of[keep], h[where[keep]], np.minimum(total[where[keep]], 2**32 - 1).astype(np.uint32)
        cut = np.searchsorted(of, np.arange(len(parts) + 1))
        found = [(c, hashes[s:e].tobytes(), n[s:e].tobytes()) for c, s, e in zip(rows["chunk"], cut[:-1], cut[1:], strict=True) if s < e]
        return pd.DataFrame({"chunk": [x[0] for x in found], "bucket": np.full(len(found), rows["bucket"].iloc[0], np.int32), "hashes": [x[1] for x in found], "counts": [x[2] for x in found]})

    dealt = held.select("chunk", "sizes", "packed").mapInArrow(spread, "bucket int, chunk long, once binary, many binary, counts binary")
    return dealt.groupBy("bucket").applyInPandas(gather, "chunk long, bucket int, hashes binary, counts binary")


