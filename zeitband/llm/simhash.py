"""SimHash near-duplicates: fingerprints of 64 bits, linked through BK-trees.

1. Each text gets its fingerprint; equal fingerprints are one vertex from here on.
2. Fingerprints are dealt to groups that hold every link. Of four parts of 16 bits, two differing bits leave two parts
   equal, so each fingerprint stands in six groups, one for each pair of parts, with all that agree with it there.
   Groups of one have no link. A group above ``MOST`` is dealt once more by thirds of its free bits (one of three is
   equal), and once more by thirds of those: at most 15 bits are free then, so no group can hold over 32,768.
3. Groups are put together to shards of about ``SHARD`` fingerprints. A task roots the shard's BK-trees, one for each
   group: a child hangs under its parent by their Hamming distance. The trees are sent to the tasks that hold the
   shard's probes, a shard's worth of bytes each and never more. A probe at distance d from a node follows the edges
   from d - radius to d + radius alone.
4. A task links what it finds at once and passes on a spanning set; the components of those edges are the result.

Defined cases: a null text, or one without words, has the fingerprint 0 and is linked like any other; a text of one or
two words is one shingle; texts of any length are read whole; rows that share a doc_id are linked by their
fingerprints alone; a row with a null doc_id links like any other, but never names its component (which is null if
all its rows are such); an empty table gives an empty result; columns other than doc_id and text, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, materialize
from .graph import components
from .terms import NO_BLANKS, words

#: Fingerprints of a group that are not dealt any further, and of a shard, about.
MOST = 32_768
SHARD = 16_384
#: Tasks among which a shard's probes are dealt; each gets the shard's trees.
SLICES = 4
#: Probes that walk at a time.
WALKERS = 256
#: Rows of one fingerprint are dealt to so many tasks.
SALTS = 256
RADIUS = 2


def shingle_hashes(text: str | None, k: int, seed: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles of k words, repeats included, in several arrays; of all words if they are fewer."""
    tail: list[bytes] = []
    whole = False
    for part in words(text, NO_BLANKS):
        run = tail + part
        if len(run) >= k:
            whole = True
            grams = map(b" ".join, zip(*(run[i:] for i in range(k)), strict=False))
            yield np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64)
        tail = run[-(k - 1) :] if whole and k > 1 else [] if whole else run
    if not whole and tail:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), seed)], np.uint64)


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, k, seed):
        for at in range(0, len(h), 1 << 16):
            some = h[at : at + (1 << 16)]
            ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            found = np.array([fingerprint(t, k, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _parts(free: list[int], n: int) -> list[list[int]]:
    """The bits ``free`` in n parts of nearly equal size."""
    return [free[i * len(free) // n : (i + 1) * len(free) // n] for i in range(n)]


def _mask(bits: list[int]) -> int:
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def schemes() -> list[list[tuple[int, list[int]]]]:
    """For each level of dealing and each way to agree there: which way of the level before it refines, and the bits that
    agree. By the pigeonhole principle every pair within ``RADIUS`` agrees in one way of each level at least."""
    four = _parts(list(range(64)), 4)
    levels = [[(0, four[i] + four[j]) for i in range(4) for j in range(i)]]
    for _ in range(2):
        before = levels[-1]
        levels.append([(way, fixed + part) for way, (_, fixed) in enumerate(before) for part in _parts([b for b in range(64) if b not in fixed], 3)])
    return levels


def grouped(fps: DataFrame, most: int) -> DataFrame:
    """key and fp: groups of at most ``most`` fingerprints, or of 32,768, such that each link is inside one of them."""
    result, rest = None, fps.select(F.lit(0).alias("way"), "fp")
    for level, ways in enumerate(schemes()):
        entries = [F.struct(F.lit(i).alias("way"), F.col("fp").bitwiseAND(F.lit(_mask(fixed))).alias("bits"), F.lit(of).alias("of")) for i, (of, fixed) in enumerate(ways)]
        rows = rest.select(F.col("way").alias("was"), "fp", F.explode(F.array(*entries)).alias("x")).filter("x.of = was")
        rows = rows.select("x.way", F.xxhash64(F.lit(level), "x.way", "x.bits").alias("key"), "fp")
        rows = rows.join(rows.groupBy("key").count().filter("count > 1"), "key")
        last = level == 2
        small = rows if last else rows.filter(F.col("count") <= most)
        small = small.select("key", "fp")
        result = small if result is None else result.union(small)
        if last:
            break
        rest = materialize(rows.filter(F.col("count") > most).select("way", "fp"), "hot")
        if rest.isEmpty():
            break
    return result


class Forest:
    """BK-trees over (key, fp), one for each key. ``parent`` is -1 at roots, ``edge`` the distance to the parent."""

    def __init__(self, keys: np.ndarray, fps: np.ndarray, parent: np.ndarray | None = None, edge: np.ndarray | None = None):
        if parent is None:
            order = np.lexsort((fps, keys))
            keys, fps = keys[order], fps[order]
        self.keys, self.fps = keys, fps.view(np.uint64)
        self.names, self.roots = np.unique(keys, return_index=True)
        #: Children by node and distance, with room for the radius on both sides.
        self.width = 65 + 2 * RADIUS
        self.child = np.full(len(keys) * self.width, -1, np.int32)
        if parent is None:
            self.parent, self.edge = self._plant()
        else:
            self.parent, self.edge = parent, edge
            inner = np.flatnonzero(parent >= 0)
            self.child[parent[inner].astype(np.int64) * self.width + edge[inner] + RADIUS] = inner

    def _plant(self) -> tuple[np.ndarray, np.ndarray]:
        """All nodes sink from their roots at once, a level a step; the first to come by an edge stays there."""
        n = len(self.keys)
        parent, edge = np.full(n, -1, np.int32), np.zeros(n, np.uint8)
        at = self.roots[np.searchsorted(self.names, self.keys)]
        moving = np.flatnonzero(at != np.arange(n))
        at = at[moving]
        while len(moving):
            d = np.bitwise_count(self.fps[moving] ^ self.fps[at]).astype(np.int64)
            slot = at * self.width + d + RADIUS
            free = np.flatnonzero(self.child[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            stay = free[first]
            self.child[slot[stay]] = moving[stay]
            parent[moving[stay]], edge[moving[stay]] = at[stay], d[stay]
            on = np.ones(len(moving), bool)
            on[stay] = False
            moving, at = moving[on], self.child[slot[on]].astype(np.int64)
        return parent, edge

    def near(self, keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place of the probe, node) at distances from 1 to the radius, in steps."""
        fps = fps.view(np.uint64)
        start = self.roots[np.searchsorted(self.names, keys)]
        for s in range(0, len(fps), WALKERS):
            probe = np.arange(s, min(len(fps), s + WALKERS))
            node = start[probe]
            while len(probe):
                d = np.bitwise_count(self.fps[node] ^ fps[probe]).astype(np.int64)
                hit = (d > 0) & (d <= RADIUS)
                if hit.any():
                    yield probe[hit], node[hit]
                # Edges d - radius to d + radius stand side by side in the table.
                below = self.child[(node * self.width + d)[:, None] + np.arange(2 * RADIUS + 1)]
                row, column = np.nonzero(below >= 0)
                probe, node = probe[row], below[row, column].astype(np.int64)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of all pairs (a, b); ``label`` holds each place's least known place."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label != (flat := label[label])).any():
            label[:] = flat


def plant(shard: pd.DataFrame) -> pd.DataFrame:
    f = Forest(shard["key"].to_numpy(), shard["fp"].to_numpy())
    return pd.DataFrame({"shard": shard["shard"].iloc[:1], "slice": [list(range(SLICES))], "keys": [f.keys.tobytes()], "fps": [f.fps.tobytes()], "parent": [f.parent.tobytes()], "edge": [f.edge.tobytes()]})


def walk(probes: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    """A spanning set of the links that the probes of one slice find in the trees of their shard."""
    if probes.empty:
        return pd.DataFrame({"u": [], "v": []}, dtype=np.int64)
    t = trees.iloc[0]
    f = Forest(*(np.frombuffer(t[c], kind) for c, kind in (("keys", np.int64), ("fps", np.int64), ("parent", np.int32), ("edge", np.uint8))))
    keys, fps = probes["key"].to_numpy(), probes["fp"].to_numpy()
    # Fingerprints by number: those of the probes and of the nodes.
    every, number = np.unique(np.concatenate((fps, f.fps.view(np.int64))), return_inverse=True)
    label = np.arange(len(every))
    for probe, node in f.near(keys, fps):
        merge(label, number[probe], number[len(fps) + node])
    some = np.flatnonzero(label != np.arange(len(every)))
    return pd.DataFrame({"u": every[some], "v": every[label[some]]})


def links(fps: DataFrame, most: int = 0) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fps`` (fp), of which the components are those of all links."""
    groups = materialize(grouped(fps, most or MOST), "groups")
    shards = max(1, -(-groups.count() // SHARD))
    rows = groups.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    trees = rows.groupBy("shard").applyInPandas(plant, "shard int, slice array<int>, keys binary, fps binary, parent binary, edge binary")
    trees = trees.withColumn("slice", F.explode("slice"))
    probes = rows.withColumn("slice", F.pmod(F.xxhash64("fp"), F.lit(SLICES)).cast("int"))
    by = ["shard", "slice"]
    edges = materialize(probes.groupBy(*by).cogroup(trees.groupBy(*by)).applyInPandas(walk, "u long, v long").distinct(), "links")
    discard(groups)
    return edges


def simhash_components(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id that links reach) of each document."""
    kind = docs.schema["doc_id"].dataType
    all_ = materialize(fingerprints(docs, k, seed), "fingerprints")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    all_ = all_.withColumn("salt", salt)
    # A fingerprint in slices of its rows: what all of them must know moves once a slice.
    slices = materialize(all_.groupBy("fp", "salt").agg(F.min("doc_id").alias("least")), "slices")
    named = slices.groupBy("fp").agg(F.min("least").alias("least"))
    roots = components(links(named.select("fp"))).withColumnRenamed("u", "fp")
    rooted = named.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    told = slices.select("fp", "salt").join(found, "fp")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return all_.join(told, ["fp", "salt"]).select(F.col("doc_id").cast(kind).alias("doc_id"), shown, F.col("component_id").cast(kind).alias("component_id"))
