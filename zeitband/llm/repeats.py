"""Removal of repeated substrings by enhanced suffix arrays and their common-prefix interval trees.

Every byte that lies in a string of ``length`` bytes which also starts in a document with a smaller doc_id is removed.

1. Documents with equal text are one class; only its least doc_id goes on. All other rows of a class of ``length``
   bytes or more are removed whole.
2. Each window of ``length`` bytes is anchored at the place in it whose ``length - SPREAD`` bytes have the least hash
   (the leftmost on ties), so equal windows have equal anchors at equal offsets, in whatever text they lie. A run of
   windows with one anchor is a context: ``length`` bytes and at most ``SPREAD`` more.
3. Anchor hashes are counted over all chunks of text (4 bytes each, dealt by hash). Windows whose anchor no other text
   has are unique; the contexts of the others go to the bucket of their anchor, each distinct one once per chunk with
   the least doc_id that has it there. Anchors that over ``hot`` texts have would fill one bucket: their contexts are cut
   into windows, which go to the bucket of their own hash as 16 bytes each.
4. A bucket is worked off in slices of anchors, since only contexts of one anchor share a window. A slice sorts the
   suffixes of its distinct contexts and takes the longest common prefixes of neighbours. A stack
   scan of these gives the intervals of the common-prefix tree; an interval whose members are preceded by different
   bytes (or begin a context) is a maximal repeat, and all members learn the least doc_id of the group. Intervals
   with one and the same byte before all members are part of a longer repeat with the same members and are passed by.
5. The chunks get back what was found, and mark all their occurrences in documents of a larger doc_id.

Defined cases: a null text is empty and loses nothing, as do texts under ``length`` bytes; rows that share a doc_id do
not repeat each other; a null doc_id counts as larger than all others; repeated rows each get the same result; texts of
any length are read whole; an empty table gives an empty result; columns other than doc_id and text, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import bucket_of, chunks, open_chunk, shared_counts, short
from .common import blocks, materialize
from .shingles import _BYTE, _PRIME, _power, mix

#: A context holds up to so many windows more than one.
SPREAD = 24
#: Counted anchors in a bucket, and bytes of text behind the contexts of a bucket, about.
BUCKET = 1_000_000
BUCKET_TEXT = 8_000_000
#: Slices that a bucket is worked off in.
SLICES = 64
#: Texts that share an anchor, from which on its windows are dealt one by one.
HOT = 10_000
#: Bytes of text hashed at once, about; a longer text is hashed by itself.
STEP_BYTES = 1_000_000
#: Never part of UTF-8 text.
PAD = 0xFF
LAST_ID = 2**63 - 1
SPANS = "array<struct<start:long,end:long>>"
FOUND = ["all_least", "p_which", "p_start", "p_size", "p_least"]


def steps(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in runs of about ``STEP_BYTES``, each with the number of its first text."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > STEP_BYTES:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _power("up", len(raw)), dtype=np.uint64)))


def range_hashes(sums: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` bytes from each start on."""
    return mix((sums[start + length] - sums[start]) * _power("down", len(sums))[start] * _PRIME)


def context_runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of ``texts`` laid end to end: the bytes, and of each context its text, start, end and anchor hash."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    n, k = len(raw), length - SPREAD
    none = np.zeros(0, np.int64)
    if n < length:
        return raw, none, none, none, np.zeros(0, np.uint64)
    sums = prefix_sums(raw)
    hashes = mix((sums[k:] - sums[:-k]) * _power("down", n - k + 1) * _PRIME)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width < SPREAD + 1:
        step = min(width, SPREAD + 1 - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    whole = sizes >= length
    np.add.at(inside, (ends - sizes)[whole], 1)
    np.add.at(inside, (ends - length + 1)[whole], -1)
    at = np.flatnonzero(np.cumsum(inside)[: len(anchor)] > 0)
    if not len(at):
        return raw, none, none, none, np.zeros(0, np.uint64)
    new = np.flatnonzero(np.concatenate(([True], anchor[at[1:]] != anchor[at[:-1]])))
    start, last = at[new], at[np.concatenate((new[1:], [len(at)])) - 1]
    return raw, np.searchsorted(ends, start, side="right"), start, last + length, hashes[anchor[start]]


def anchors_of(texts: list[bytes], length: int) -> list[np.ndarray]:
    """The distinct anchor hashes of each text."""
    found = []
    for _, some in steps(texts):
        _, text, _, _, h = context_runs(some, length)
        cut = np.searchsorted(text, np.arange(len(some) + 1))
        found += [np.unique(h[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True)]
    return found


def padded_rows(raw: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The byte ranges as rows of a matrix."""
    at = start[:, None] + np.arange(width)
    out = raw[np.minimum(at, len(raw) - 1)]
    out[at >= end[:, None]] = PAD
    return out


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row, and the number of the distinct row at each place."""
    names = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()
    _, first, where = np.unique(names, return_index=True, return_inverse=True)
    return first, where


def intervals(lcp: list[int], left: list[int]) -> Iterator[tuple[int, int, int, list[tuple[int, int]]]]:
    """Stack scan of one part of an enhanced suffix array: depth, first and past-last member and child intervals of
    each common-prefix interval, children first.

    ``lcp[i]`` is the prefix that members i and i + 1 share. Only intervals that are left-diverse are given: their
    members are preceded by different bytes (``left``; below zero: nothing precedes, and it differs from all)."""
    diverse = -2
    stack: list[list] = []  # depth, first, byte before all members so far (or diverse), children
    for i in range(len(left)):
        before = diverse if left[i] < 0 else left[i]
        shared = lcp[i] if i < len(lcp) else -1
        node = [0, i, before, []]
        done = (i, i + 1)
        while stack and stack[-1][0] > shared:
            top = stack.pop()
            top[2] = top[2] if top[2] == node[2] else diverse
            top[3].append(done)
            if top[2] == diverse:
                yield top[0], top[1], i + 1, top[3]
            done, node = (top[1], i + 1), top
        if stack and stack[-1][0] == shared:
            stack[-1][2] = stack[-1][2] if stack[-1][2] == node[2] else diverse
            stack[-1][3].append(done)
        elif shared >= 0:
            stack.append([shared, done[0], node[2], [done]])


def maximal_repeats(rows: np.ndarray, sizes: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What distinct contexts learn from each other: context, start, size and the least id of a repeat group that has
    a smaller one than the context itself."""
    width = rows.shape[1]
    windows = sizes - length + 1
    of = np.repeat(np.arange(len(rows)), windows)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    wide = np.concatenate([rows, np.full((len(rows), SPREAD), PAD, np.uint8)], axis=1)
    suffixes = wide.ravel()[(of * (width + SPREAD) + offset)[:, None] + np.arange(width)]
    order = np.argsort(suffixes.view(np.dtype((np.void, width))).ravel())
    suffixes, of, offset = suffixes[order], of[order], offset[order]
    same = suffixes[1:] == suffixes[:-1]
    depth = sizes[of] - offset
    lcp = np.minimum(np.where(same.all(axis=1), width, same.argmin(axis=1)), np.minimum(depth[1:], depth[:-1]))
    left = np.where(offset > 0, wide[of, np.maximum(offset, 1) - 1].astype(np.int64), -1)
    # Parts with common prefixes of the length asked for; those with one byte before all members are passed by at once.
    edge = np.flatnonzero(np.concatenate(([True], lcp < length, [True])))
    first, size = edge[:-1], np.diff(edge)
    diverse = (np.minimum.reduceat(left, first) < 0) | (np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first))
    mins = least[of]
    apart = np.minimum.reduceat(mins, first) != np.maximum.reduceat(mins, first)
    found: list[tuple[np.ndarray, np.ndarray, int, int]] = []
    for s, m in zip(first[(size > 1) & diverse & apart], size[(size > 1) & diverse & apart], strict=True):
        part = mins[s : s + m]
        for d, a, z, children in intervals(lcp[s : s + m - 1].tolist(), left[s : s + m].tolist()):
            low = part[a:z].min()
            for b, e in children:
                # A child with the same least id has told its members already, over more bytes.
                if part[b:e].min() > low:
                    found.append((of[s + b : s + e], offset[s + b : s + e], d, int(low)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    many = [len(x[0]) for x in found]
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), np.repeat([x[2] for x in found], many), np.repeat(np.array([x[3] for x in found], np.int64), many)


def texts_once(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """All rows as doc_id, n_bytes and class; and of each class of long texts the least doc_id with the packed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        for b in blocks(batches, "raw"):
            packed = [pack.compress(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(packed, pa.binary())], ["doc_id", "class", "packed"])

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), F.unhex(F.sha2(raw, 256)).alias("class"), raw.alias("raw"))
    long_ = rows.filter(F.col("n_bytes") >= length).select("doc_id", "class", "raw")
    packed = long_.mapInArrow(run, "doc_id long, class binary, packed binary")
    least = packed.groupBy("class").agg(F.min_by(F.struct("doc_id", "packed"), "doc_id").alias("x"))
    return rows.drop("raw"), least.select("x.doc_id", "class", "x.packed")


def shared_contexts(held: DataFrame, shared: DataFrame, length: int, buckets: int, parts: int, hot: int) -> DataFrame:
    """By chunk and bucket: the distinct contexts with their least doc_id, and where each occurs (text and start).

    Buckets from ``parts`` on hold windows of frequent anchors: a window is named by two hashes in place of its bytes.
    ``slices`` counts the contexts of each slice of a bucket, in order."""
    width = length + SPREAD

    def rows_of(chunk: int, key: np.ndarray, names: np.ndarray, sizes: np.ndarray, ids: np.ndarray, text: np.ndarray, start: np.ndarray, first_part: int, pack: zstandard.ZstdCompressor) -> Iterator[tuple]:
        slice_ = (key % np.uint64(parts * SLICES)).astype(np.int64)
        order = np.argsort(slice_, kind="stable")
        part = slice_[order] // SLICES
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))[: len(part) + 1]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            at = order[s:e]
            first, where = distinct_rows(names[at])
            # Distinct contexts in the order of their slices.
            by_slice = np.argsort(slice_[at[first]], kind="stable")
            first, where = first[by_slice], np.argsort(by_slice)[where]
            least = np.full(len(first), LAST_ID)
            np.minimum.at(least, where, ids[at])
            counts = np.bincount(slice_[at[first]] % SLICES, minlength=SLICES).astype(np.uint32)
            places = [text[at].astype(np.uint32), start[at].astype(np.uint32), where.astype(np.uint32)]
            yield (chunk, first_part + int(part[s]), pack.compress(names[at[first]].tobytes()), sizes[at[first]].astype(np.uint32).tobytes(), least.tobytes(), counts.tobytes(), *(pack.compress(x.tobytes()) for x in places))

    def run(own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(own) and len(back):
            known = np.concatenate([np.frombuffer(h, np.uint32).astype(np.uint64) | np.uint64(b) << np.uint64(32) for b, h in zip(back["bucket"], back["hashes"], strict=True)])
            often = np.concatenate([np.frombuffer(c, np.uint32) for c in back["counts"]])
            order = np.argsort(known)
            known, often = known[order], often[order]
            pack = zstandard.ZstdCompressor(level=3)
            for chunk, all_ids, sizes, packed in zip(own["chunk"], own["ids"], own["sizes"], own["packed"], strict=True):
                all_ids, kept, windows = np.array(all_ids, np.int64), [], []
                for base, some in steps(open_chunk(sizes, packed)):
                    raw, text, start, end, h = context_runs(some, length)
                    key = short(h).astype(np.uint64) | bucket_of(h, buckets).astype(np.uint64) << np.uint64(32)
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    begin = np.cumsum([0, *map(len, some)])
                    keep = np.flatnonzero((known[at] == key) & (often[at] <= hot))
                    if len(keep):
                        kept.append((h[keep], padded_rows(raw, start[keep], end[keep], width), end[keep] - start[keep], all_ids[base + text[keep]], base + text[keep], start[keep] - begin[text[keep]]))
                    many = np.flatnonzero((known[at] == key) & (often[at] > hot))
                    if len(many):
                        n = end[many] - start[many] - length + 1
                        of = np.repeat(many, n)
                        place = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                        own_hash = range_hashes(prefix_sums(raw), place, length)
                        names = np.column_stack([own_hash, h[of]]).view(np.uint8)
                        windows.append((own_hash, names, np.full(len(of), length), all_ids[base + text[of]], base + text[of], place - begin[text[of]]))
                for rows, first_part in ((kept, 0), (windows, parts)):
                    if rows:
                        made += rows_of(chunk, *map(np.concatenate, zip(*rows, strict=True)), first_part, pack)
        return pd.DataFrame(made, columns=["chunk", "part", "rows", "lengths", "least", "slices", "text", "start", "which"])

    schema = "chunk long, part int, rows binary, lengths binary, least binary, slices binary, text binary, start binary, which binary"
    return held.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(run, schema)


def group_repeats(contexts: DataFrame, length: int, parts: int) -> DataFrame:
    """By chunk and bucket: the least id of each of the chunk's contexts in all texts, and the repeats in part of a
    context that reach smaller ids (context, start, size, id)."""

    def learn(rows: np.ndarray, sizes: np.ndarray, own: np.ndarray, whole: bool) -> tuple[np.ndarray, ...]:
        """Of one slice: the least id of each context, and context, start, size and id of the repeats in part."""
        first, where = distinct_rows(rows)
        least = np.full(len(first), LAST_ID)
        np.minimum.at(least, where, own)
        none = np.zeros(0, np.int64)
        context, start, size, low = (none, none, none, none) if whole or len(first) < 2 or least.min() == least.max() else maximal_repeats(rows[first], sizes[first], least, length)
        order = np.argsort(context, kind="stable")
        context, start, size, low = context[order], start[order], size[order], low[order]
        a, z = np.searchsorted(context, where), np.searchsorted(context, where, side="right")
        n = z - a
        pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        return least[where], np.repeat(np.arange(len(where)), n), start[pick], size[pick], low[pick]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        whole = rows["part"].iloc[0] >= parts
        width = 16 if whole else length + SPREAD
        each = [np.frombuffer(unpack.decompress(x), np.uint8).reshape(-1, width) for x in rows["rows"]]
        sizes = [np.frombuffer(x, np.uint32).astype(np.int64) for x in rows["lengths"]]
        least = [np.frombuffer(x, np.int64) for x in rows["least"]]
        ends = np.cumsum([np.frombuffer(x, np.uint32) for x in rows["slices"]], axis=1, dtype=np.int64)
        told: list[list[tuple]] = [[] for _ in each]
        for i in range(SLICES):
            s, e = (ends[:, i - 1] if i else np.zeros(len(each), np.int64)), ends[:, i]
            at = np.flatnonzero(e > s)
            if not len(at):
                continue
            found = learn(*(np.concatenate([x[c][s[c] : e[c]] for c in at]) for x in (each, sizes, least)), whole)
            edge = np.concatenate(([0], np.cumsum(e[at] - s[at])))
            split = np.searchsorted(found[1], edge)
            for k, c in enumerate(at):
                a, z = split[k], split[k + 1]
                told[c].append((found[0][edge[k] : edge[k + 1]], found[1][a:z] - edge[k] + s[c], *(x[a:z] for x in found[2:])))
        kinds = (np.int64, np.uint32, np.uint32, np.uint32, np.int64)
        made = [(chunk, part, *(pack.compress(np.concatenate(x).astype(kind).tobytes()) for x, kind in zip(zip(*t, strict=True), kinds, strict=True))) for chunk, part, t in zip(rows["chunk"], rows["part"], told, strict=True)]
        return pd.DataFrame(made, columns=["chunk", "part", "all_least", "p_which", "p_start", "p_size", "p_least"])

    schema = "chunk long, part int, all_least binary, p_which binary, p_start binary, p_size binary, p_least binary"
    return contexts.select("chunk", "part", "rows", "lengths", "least", "slices").groupBy("part").applyInPandas(run, schema)


def marked(found: dict, unpack: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one chunk and bucket: text, start, size and least id of all repeats at all their occurrences."""
    read = lambda name, kind: np.frombuffer(unpack.decompress(found[name]), kind)
    text, start, which = read("text", np.uint32).astype(np.int64), read("start", np.uint32).astype(np.int64), read("which", np.uint32).astype(np.int64)
    size, least = np.frombuffer(found["lengths"], np.uint32).astype(np.int64), read("all_least", np.int64)
    p_which, p_start, p_size, p_least = read("p_which", np.uint32), read("p_start", np.uint32).astype(np.int64), read("p_size", np.uint32).astype(np.int64), read("p_least", np.int64)
    # Repeats in part of a context stand in the order of its number.
    a, z = np.searchsorted(p_which, which), np.searchsorted(p_which, which, side="right")
    n = z - a
    pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
    at = np.repeat(np.arange(len(which)), n)
    return np.concatenate([text, text[at]]), np.concatenate([start, start[at] + p_start[pick]]), np.concatenate([size[which], p_size[pick]]), np.concatenate([least[which], p_least[pick]])


def repeated_spans(docs: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, the removed spans (start and end byte, maximal, ascending), the
    SHA-256 of the whole text, the bytes that are left where anything is removed, and the SHA-256 of what is left. ``hot`` changes how work is
    dealt, not what is found."""
    if length <= 2 * SPREAD:
        raise ValueError(f"length must be over {2 * SPREAD}")
    rows, once = texts_once(docs, length)
    held = materialize(chunks(once), "chunks")
    volume = held.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets, parts = max(16, math.ceil(volume / 10 / BUCKET)), max(16, math.ceil(volume / BUCKET_TEXT))
    shared = shared_counts(held, lambda texts: anchors_of(texts, length), buckets)
    contexts = materialize(shared_contexts(held, shared, length, buckets, parts, hot), "contexts")
    found = group_repeats(contexts, length, parts)
    # Places and what was found at them meet where the chunk's text is.
    back = contexts.select("chunk", "part", "lengths", "text", "start", "which").unionByName(found, allowMissingColumns=True)

    def run(own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        unpack, made = zstandard.ZstdDecompressor(), []
        for ids, names, sizes, packed in zip(own["ids"], own["classes"], own["sizes"], own["packed"], strict=True):
            texts, ids, total = open_chunk(sizes, packed), np.array(ids, np.int64), int(np.sum(sizes))
            begin = np.cumsum(sizes) - np.array(sizes)
            cover = np.zeros(total + 1, np.int32)
            told = back[back["all_least"].notna()].set_index("part")
            for x in back[back["which"].notna()].to_dict("records"):
                text, start, size, least = marked(x | told.loc[x["part"], FOUND].to_dict(), unpack)
                hit = least < ids[text]
                at = begin[text[hit]] + start[hit]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + size[hit], -1)
            gone = np.cumsum(cover)[:-1] > 0
            for i, (name, t, b) in enumerate(zip(names, texts, begin, strict=True)):
                own_gone = gone[b : b + len(t)]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], own_gone.astype(np.int8), [0]))))
                spans = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                left = np.frombuffer(t, np.uint8)[~own_gone].tobytes() if spans else None
                made.append((int(ids[i]), name, spans, left, hashlib.sha256(left).hexdigest() if spans else name.hex()))
        return pd.DataFrame(made, columns=["doc_id", "class", "spans", "left", "left_sha256"])

    kept = held.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(run, f"doc_id long, class binary, spans {SPANS}, left binary, left_sha256 string")
    first = kept.withColumn("first", F.lit(True))
    copy = (F.col("n_bytes") >= length) & F.col("first").isNull()
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return rows.join(first, ["doc_id", "class"], "left").select(
        F.when(F.col("doc_id") < LAST_ID, F.col("doc_id")).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        "n_bytes",
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"),
        F.lower(F.hex("class")).alias("text_sha256"),
        F.when(copy, F.lit(b"")).otherwise(F.col("left")).alias("left"),
        F.when(copy, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("left_sha256", F.lower(F.hex("class")))).alias("left_sha256"),
    )
