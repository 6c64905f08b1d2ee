"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures and exact intersections.

1. Texts with equal shingle sets are one class; the class's smallest doc_id stands for it. From here on only class
   representatives move, their texts compressed and gathered in chunks.
2. Half of the shingles, chosen by their hash, are counted over all chunks (4 bytes each, dealt by hash), and each
   chunk learns which of its shingles occur in more than one class, and in how many.
3. Two sets of similarity t share at least t of either's shingles. So a set whose rarest shingles, more in number than
   it may miss, occur nowhere else has no partner at all; of the others, those rarest shingles (the prefix) are shared
   with every partner. Sets that share one, in the same or a neighbouring size band, are hung on the least of them;
   the components of that graph hold every link.
4. Each component is cut into tiles of bounded size (sets, and shingles in them) by size band. In a tile, bitmaps in which every shingle flips one
   bit bound the overlap of a pair from above (each differing bit is a shingle that only one of both has); pairs that
   may still link are decided by intersecting the sorted arrays. Links between sets that are already connected
   are not looked for, since they change no component.
5. Components of more than one tile go on: the least members of the tiles' components are compared with each other,
   and what is still apart after that is compared tile by tile, those pairs of tiles that share a prefix shingle and
   whose bands allow a link.

Defined cases: texts without words (or null) have an empty set and link with nothing; rows that share a doc_id are
one vertex, whatever their texts; rows with a null doc_id get their class's component and never give it its name;
texts of any length are read whole; equal texts and equal sets are linked; an empty table gives an empty result;
columns other than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunked import bucket_of, chunks, open_chunk, shared_counts, short
from .common import blocks, discard, materialize
from .graph import components
from .shingles import shingle_sets

#: Weight of a tile at most, about; a set weighs 1 for every so many shingles, 1 at least.
TILE = 1024
WEIGHT_SHINGLES = 4096
#: Counted shingles in a bucket, about.
BUCKET = 1_000_000
#: Rows of one class are dealt to so many tasks.
SALTS = 256


def required(n: int, percent: int) -> int:
    """The least overlap with any partner: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def counted(s: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The shingles of a set that are counted, and how many of them every partner shares at least.

    Half of the shingles are enough where every partner must share one of them. Else all are counted, and none may be
    missed; that is right against sets with half of theirs as well, whose prefix holds a shared shingle.
    """
    half = s[(s & np.uint64(1)) == 0]
    least = required(len(s), percent) - (len(s) - len(half))
    return (half, least) if least >= 1 else (s, 1)


def classes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n and the signature of the shingle set of each document, with its compressed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in blocks(batches, "text"):
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            sets = shingle_sets(texts, k)
            names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            packed = [pack.compress(t) if len(s) else None for t, s in zip(texts, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(packed, pa.binary())], ["doc_id", "n", "class", "packed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, class binary, packed binary")


def with_partners(held: DataFrame, shared: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """The sets that may have a partner: doc_id, n, the whole set, and the shared shingles of its prefix."""

    def run(own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(back):
            keys = np.concatenate([np.frombuffer(h, np.uint32).astype(np.uint64) | np.uint64(b) << np.uint64(32) for b, h in zip(back["bucket"], back["hashes"], strict=True)])
            n = np.concatenate([np.frombuffer(c, np.uint32) for c in back["counts"]])
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            for ids, sizes, packed in zip(own["ids"], own["sizes"], own["packed"], strict=True):
                for i, s in zip(ids, shingle_sets(open_chunk(sizes, packed), k), strict=True):
                    some, least = counted(s, percent)
                    key = short(some).astype(np.uint64) | bucket_of(some, buckets).astype(np.uint64) << np.uint64(32)
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    count = np.where(keys[at] == key, n[at], 1)
                    prefix = len(some) - least + 1
                    room = prefix - int((count == 1).sum())
                    if room > 0:
                        several = np.flatnonzero(count > 1)
                        first = several[np.lexsort((some[several], count[several]))[:room]]
                        if len(first):
                            found.append((i, len(s), s.tobytes(), some[first].astype(np.int64).tolist()))
        return pd.DataFrame(found, columns=["doc_id", "n", "shingles", "prefix"])

    return held.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(run, "doc_id long, n long, shingles binary, prefix array<long>")


def band(percent: int) -> Column:
    """The size band of a set; sizes of linked sets lie in the same band or in neighbouring ones."""
    return F.floor(F.log(F.col("n")) / F.lit(-math.log(percent / 100)) + F.lit(1e-9)).cast("int")


def candidate_edges(sets: DataFrame, percent: int) -> DataFrame:
    """Each set hung on the least set that shares a prefix shingle in one of its bands."""
    b = band(percent)
    # A set is listed under its band and the next, so sets of neighbouring bands are both listed under the upper one.
    listed = sets.select("doc_id", F.explode("prefix").alias("h"), b.alias("b0")).select("doc_id", "h", F.explode(F.array("b0", F.col("b0") + 1)).alias("b"))
    least = listed.groupBy("h", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least <> most").drop("most")
    return listed.join(least, ["h", "b"]).filter("doc_id <> least").select(F.col("doc_id").alias("u"), F.col("least").alias("v")).distinct()


class Tile:
    """Sets to be compared: sizes, sorted arrays, bitmaps, and which are already known to be connected."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], groups: np.ndarray, labels: np.ndarray, percent: int):
        order = np.argsort([len(s) for s in sets], kind="stable")
        self.ids, self.sets, self.groups = ids[order], [sets[i] for i in order], groups[order]
        self.n = np.array([len(s) for s in self.sets], np.int64)
        self.percent = percent
        _, first, self.root = np.unique(labels[order], return_index=True, return_inverse=True)
        self.root = first[self.root].copy()
        bits = 1 << int(np.clip(2 * self.n.max(initial=1), 256, 8192) - 1).bit_length()
        self.maps = np.zeros((len(self.sets), bits // 64), np.uint64)
        for i, s in enumerate(self.sets):
            flips = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
            self.maps[i] = np.packbits(flips.astype(np.uint8)).view(np.uint64)

    def links(self, across: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Edges that connect what links connect and was not connected before: of one set of each label to the least one
        of its component (sets of one label are connected already). Pairs are of one group; with ``across``, of
        both its sides."""
        before = self.root.copy()
        for i in range(len(self.sets)):
            end = np.searchsorted(self.n, self.n[i] * 100 // self.percent, side="right")
            j = np.arange(i + 1, end)
            j = j[(self.groups[j] == self.groups[i]) & (self.root[j] != self.root[i])]
            if across is not None:
                j = j[across[j] != across[i]]
            if not len(j):
                continue
            total = self.n[i] + self.n[j]
            differ = np.bitwise_count(self.maps[j] ^ self.maps[i]).sum(axis=1).astype(np.int64)
            j = j[(100 + self.percent) * ((total - differ) // 2) >= self.percent * total]
            for x in j:
                if self.root[x] == self.root[i]:
                    continue
                both = len(np.intersect1d(self.sets[i], self.sets[x], assume_unique=True))
                if (100 + self.percent) * both >= self.percent * (self.n[i] + self.n[x]):
                    self.root[self.root == self.root[x]] = self.root[i]
        _, first = np.unique(before, return_index=True)
        _, of = np.unique(self.root, return_inverse=True)
        least = np.full(of.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, of, self.ids)
        joined = np.bincount(of[first]) > 1
        return [(int(self.ids[i]), int(least[of[i]])) for i in first if joined[of[i]] and self.ids[i] != least[of[i]]]


def tile_links(rows: DataFrame, key: str, percent: int, across: bool = False) -> DataFrame:
    """Links found in each tile of ``rows`` (key, comp, label, doc_id, shingles and, with ``across``, side)."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, np.uint64) for s in tile["shingles"]]
        t = Tile(tile["doc_id"].to_numpy(), sets, tile["comp"].to_numpy(), tile["label"].to_numpy(), percent)
        sides = tile["side"].to_numpy()[np.argsort([len(s) for s in sets], kind="stable")] if across else None
        return pd.DataFrame(t.links(sides), columns=["u", "v"], dtype=np.int64)

    return rows.select(key, "comp", "label", "doc_id", "shingles", *["side"] * across).groupBy(key).applyInPandas(run, "u long, v long")


def relabel(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with ``label`` replaced by the root of its doc_id under ``edges``."""
    roots = components(edges).withColumnsRenamed({"u": "doc_id"})
    return rows.drop("label").join(roots, "doc_id", "left").withColumn("label", F.coalesce("root", "doc_id")).drop("root")


def weight() -> Column:
    return F.ceil(F.greatest(F.col("n"), F.lit(1)) / F.lit(WEIGHT_SHINGLES))


def verified_edges(sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """A spanning set of the links between the sets of each candidate component."""
    rows = sets.join(comps, "doc_id").withColumns({"band": band(percent), "w": weight()})
    sizes = materialize(rows.groupBy("comp", "band").agg(F.sum("w").alias("m")), "sizes")
    whole = sizes.groupBy("comp").agg(F.sum("m").alias("all"))
    small = rows.drop("prefix").join(whole.filter(F.col("all") <= TILE), "comp").withColumn("label", F.col("doc_id"))
    tiles = max(1, -(-(whole.filter(F.col("all") <= TILE).agg(F.sum("all")).first()[0] or 0) // TILE))
    small = small.withColumn("tile", F.pmod(F.xxhash64("comp"), F.lit(tiles)))
    edges = tile_links(small, "tile", percent)
    if whole.filter(F.col("all") > TILE).isEmpty():
        return materialize(edges, "links")
    # Components of several tiles. First each tile by itself.
    large = rows.join(sizes.join(whole.filter(F.col("all") > TILE), "comp"), ["comp", "band"]).withColumn("label", F.col("doc_id"))
    deal = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.ceil(F.col("m") / F.lit(TILE)))
    large = materialize(large.withColumn("tile", F.xxhash64("comp", "band", deal)).drop("all", "m"), "large")
    edges = materialize(edges.union(tile_links(large, "tile", percent)), "links")
    # Then the least members of the tiles' components, dealt anew.
    labelled = materialize(relabel(large.drop("tile"), edges), "labelled")
    discard(large)
    least = labelled.filter("doc_id = label")
    count = least.groupBy("comp").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("m")).filter("k > 1")
    again = least.join(count, "comp").withColumn("tile", F.xxhash64("comp", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.ceil(F.col("m") / F.lit(TILE))))).drop("k", "m")
    edges = materialize(edges.union(tile_links(again, "tile", percent)), "links")
    # What is still apart: pairs of tiles with a common prefix shingle, of bands that allow a link and not of one label alone.
    relabelled = materialize(relabel(labelled, edges), "labelled")
    discard(labelled)
    apart = relabelled.groupBy("comp").agg(F.min("label").alias("a"), F.max("label").alias("z")).filter("a <> z").select("comp")
    if apart.isEmpty():
        return edges
    left = relabelled.join(apart, "comp", "left_semi")
    per = left.groupBy("comp", "band", "label").agg(F.sum("w").alias("m"))
    # Labels of under half a tile share tiles; larger ones have tiles of their own.
    own = F.when(F.col("m") * 2 > TILE, F.col("label"))
    mixed = per.filter(F.col("m") * 2 <= TILE).groupBy("comp", "band").agg(F.sum("m").alias("rest"))
    dealt = left.join(per, ["comp", "band", "label"]).join(mixed, ["comp", "band"], "left").withColumn("own", own)
    many = F.ceil(F.when(F.col("own").isNotNull(), F.col("m")).otherwise(F.col("rest")) / F.lit(TILE))
    slot = F.pmod(F.xxhash64(F.when(F.col("own").isNotNull(), F.col("doc_id")).otherwise(F.col("label"))), many)
    dealt = materialize(dealt.withColumn("part", F.xxhash64("comp", "band", F.coalesce("own", F.lit(-1)), slot)).select("comp", "band", "own", "part", "doc_id", "label", "prefix", "shingles"), "dealt")
    # Shingles that the same parts have give the same pairs, so each list of parts is paired once.
    lists = dealt.select("comp", "band", "own", "part", F.explode("prefix").alias("h")).distinct().groupBy("comp", "h").agg(F.array_sort(F.collect_list(F.struct("part", "band", "own"))).alias("parts")).select("comp", "parts").distinct()
    one = lists.select("comp", "parts", F.explode("parts").alias("p"))
    pairs = one.select("comp", "p", F.explode("parts").alias("q")).filter("p.part <= q.part and abs(p.band - q.band) <= 1 and not (p.own <=> q.own and p.own is not null)")
    pairs = pairs.select("comp", F.col("p.part").alias("part"), F.col("q.part").alias("part_")).distinct()
    pairs = materialize(pairs.select("comp", F.xxhash64("part", "part_").alias("tile"), "part", "part_"), "pairs")
    same = pairs.filter("part = part_").select("tile", "part", F.lit(-1).alias("side"))
    crossed = pairs.filter("part <> part_").select("tile", F.explode(F.array(F.struct("part", F.lit(0).alias("side")), F.struct(F.col("part_").alias("part"), F.lit(1).alias("side")))).alias("x")).select("tile", "x.part", "x.side")
    edges = materialize(edges.union(tile_links(dealt.join(same, "part"), "tile", percent)).union(tile_links(dealt.join(crossed, "part"), "tile", percent, across=True)), "links")
    discard(relabelled, dealt, pairs)
    return edges


def repeated_ids(thin: DataFrame, named: DataFrame) -> DataFrame:
    """Edges between the representatives of all classes that one doc_id has."""
    several = thin.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).filter("a <> z and doc_id is not null").select("doc_id")
    reps = thin.join(several, "doc_id", "left_semi").select("doc_id", "class").distinct().join(named, "class").select("doc_id", "rep")
    return reps.join(reps.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id").select(F.col("rep").alias("u"), F.col("least").alias("v"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each document."""
    all_ = materialize(classes(docs, k), "classes")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    thin = materialize(all_.select("doc_id", "n", "class"), "thin")
    # A class in slices of its rows: what all of them must know moves once a slice.
    slices = materialize(thin.filter("n > 0").groupBy("class", salt).agg(F.min("doc_id").alias("least")), "slices")
    named = slices.groupBy("class").agg(F.min("least").alias("rep"))
    buckets = max(16, math.ceil((thin.agg(F.sum("n")).first()[0] or 0) / 2 / BUCKET))
    # Copies are dropped task by task before their texts move.
    kept = all_.filter("n > 0").groupBy("class").agg(F.min_by(F.struct("doc_id", "packed"), "doc_id").alias("x")).select("x.doc_id", "class", "x.packed").filter("doc_id is not null")
    held = materialize(chunks(kept), "chunks")
    discard(all_)
    sets = materialize(with_partners(held, shared_counts(held, lambda texts: [counted(s, percent)[0] for s in shingle_sets(texts, k)], buckets), k, percent, buckets), "sets")
    discard(held)
    comps = components(candidate_edges(sets, percent))
    comps = comps.select(F.col("u").alias("doc_id"), F.col("root").alias("comp"))
    comps = materialize(comps.union(comps.select(F.col("comp").alias("doc_id"), "comp")).distinct(), "comps")
    links = verified_edges(sets, comps, percent)
    discard(sets)
    roots = components(links.union(repeated_ids(thin, named))).withColumnRenamed("u", "rep")
    found = named.join(roots, "rep", "left").select("class", F.coalesce("root", "rep").alias("component_id"))
    told = slices.drop("least").join(found, "class")
    kind = docs.schema["doc_id"].dataType
    joined = thin.withColumn("salt", salt).join(told, ["class", "salt"], "left")
    return joined.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").cast(kind).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each component, the one that gives it its name. Rows with a null doc_id, which no
    component can name, are passed on. Rows that share that doc_id stay if their texts differ; of those with one text
    (equal but for other columns, if at all) one stays."""
    names = jaccard_components(docs.filter("doc_id is not null"), k, percent).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(names, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id is null")).select(*docs.columns)
