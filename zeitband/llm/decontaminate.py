"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

Every document is cut into overlapping passages twice as long as the longest item (64 words at least), so each item
that a document holds lies whole in one of its passages. A passage is a query: items whose BM25 score reaches
``share`` of the score that the item's own words give are retrieved, all of them. Passages that cannot reach it are
left out by a bound first: an item's essential terms are its heaviest ones, those that carry ``ESSENTIAL`` of its
weight; a passage whose essential terms, with all the rest granted, stay below the threshold needs no search. For
what is retrieved, the document must share the word runs of both parts of the item: the question (up to the last
question mark or colon, else the first three quarters) and the answer (the rest).

The index is written to the shared folder in shards, each built by one task from distinct texts of at most about
``SHARD_BYTES`` (or one longer text). A task that searches holds one shard and a few megabytes of documents at a time
and meets every shard, so its memory does not grow with the list of items. Number and mean length of the items, the
longest one and the frequencies of terms are counted once over all items, so no result depends on how the shards are
dealt.

Defined cases: items and documents that are null, empty or without a word match nothing; repeated items and rows
count each; items with a null id are searched like others; of passages with equal scores any gives the same row; texts of
any length are searched whole; an empty table on either side gives no matches; columns other than doc_id, text, item_id,
whatever their names, are ignored by the search and passed on by the filter.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import pickle
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zeitband.shared import new_folder

from .common import blocks, discard, materialize

K1, B = 1.2, 0.75
BLOCK = 16
ESSENTIAL = 0.8
SHARD_BYTES = 4 << 20
#: Hash buckets of texts for each shard, about.
FINE = 64
#: Bytes of documents that meet a shard at once, about.
HELD_BYTES = 4 << 20
LEAST_WINDOW = 64
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def runs(words: list[str], n: int) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def overlap(part: list[str], passage: list[str], n: int = 3) -> float:
    """The share of the part's runs of ``n`` words (all its words, if fewer) that the passage holds."""
    if not part:
        return 1.0
    n = min(n, len(part))
    there = set(runs(passage, n))
    wanted = runs(part, n)
    return sum(x in there for x in wanted) / len(wanted)


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words of an item."""
    for mark in ("?", ":"):
        head, found, tail = text.rpartition(mark)
        if found and words_of(head) and words_of(tail):
            return words_of(head), words_of(tail)
    words = words_of(text)
    cut = max(1, len(words) * 3 // 4)
    return words[:cut], words[cut:]


class Postings:
    """One term's items in ascending order with their weights, and each block's last item and largest weight."""

    def __init__(self, entries: list[tuple[int, float]]):
        self.items = [d for d, _ in entries]
        self.weights = [w for _, w in entries]
        self.top = max(self.weights)
        self.last = [self.items[min(i + BLOCK, len(entries)) - 1] for i in range(0, len(entries), BLOCK)]
        self.block_top = [max(self.weights[i : i + BLOCK]) for i in range(0, len(entries), BLOCK)]


class Totals(NamedTuple):
    """Of all items that have a word: their number, words and the words of the longest."""

    count: int
    words: int
    longest: int


class ItemIndex:
    """BM25 weights of each distinct text's terms, divided by the score of the item's own words. ``frequency`` holds at
    least the terms of ``texts``; it and ``totals`` are those of all items."""

    def __init__(self, texts: list[str], totals: Totals, frequency: dict[str, int]):
        self.ids = [hashlib.sha256(text.encode()).digest() for text in texts]
        self.parts = [split_item(text) for text in texts]
        counts = [Counter(q + a) for q, a in self.parts]
        mean = totals.words / max(1, totals.count)
        entries: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.essential: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.spare = np.zeros(len(counts))
        for d, c in enumerate(counts):
            norm = K1 * (1 - B + B * sum(c.values()) / mean)
            raw = {t: math.log(1 + (totals.count - frequency[t] + 0.5) / (frequency[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in c.items()}
            total, carried = sum(raw.values()), 0.0
            for t, w in sorted(raw.items(), key=lambda x: (-x[1], x[0])):
                entries[t].append((d, w / total))
                if carried < ESSENTIAL:
                    self.essential[t].append((d, w / total))
                    carried += w / total
            self.spare[d] = max(0.0, 1 - carried)
        self.postings = {t: Postings(e) for t, e in entries.items()}
        self.longest = totals.longest
        # Essential postings as flat arrays, for whole batches of passages at once.
        self.number = {t: i for i, t in enumerate(self.essential)}
        lists = list(self.essential.values())
        self.from_ = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        self.of = np.array([d for x in lists for d, _ in x], np.int64)
        self.by = np.array([w for x in lists for _, w in x])

    def search(self, terms: set[str], least: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose weights over ``terms`` sum to ``least`` or more."""
        cursors = [[p.items[0], 0, p] for t in terms if (p := self.postings.get(t))]
        found: list[tuple[int, float]] = []
        slack = least - 1e-9

        def move(c: list, to: int) -> None:
            at = bisect.bisect_left(c[2].items, to, c[1])
            c[0], c[1] = (c[2].items[at], at) if at < len(c[2].items) else (math.inf, at)

        while True:
            cursors = sorted((c for c in cursors if c[0] < math.inf), key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[2].top
                if bound >= slack:
                    pivot = i
                    break
            if pivot < 0:
                return found
            d = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == d:
                pivot += 1
            ahead, leave = 0.0, math.inf
            for c in cursors[: pivot + 1]:
                k = bisect.bisect_left(c[2].last, d)
                if k < len(c[2].last):
                    ahead += c[2].block_top[k]
                    leave = min(leave, c[2].last[k] + 1)
            if ahead < slack:
                # No item up to the end of the nearest block, or the next list's item, can reach it.
                to = max(d + 1, min(leave, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf))
                for c in cursors[: pivot + 1]:
                    move(c, to)
            elif cursors[0][0] == d:
                score = sum(c[2].weights[c[1]] for c in cursors[: pivot + 1])
                if score >= slack:
                    found.append((d, score))
                for c in cursors[: pivot + 1]:
                    move(c, d + 1)
            else:
                for c in cursors[: pivot + 1]:
                    if c[0] < d:
                        move(c, d)

    def candidates(self, texts: list[list[str]], least: float) -> list[tuple[int, int, int]]:
        """Text, first and last word of the passages that may reach ``least`` for some item; exact bound, in bulk."""
        stride = max(LEAST_WINDOW, self.longest)
        sizes = np.array([len(w) for w in texts], np.int64)
        number = self.number.get
        ids = np.fromiter((number(w, -1) for words in texts for w in words), np.int64, int(sizes.sum()))
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        begin = np.cumsum(sizes) - sizes
        text = np.searchsorted(begin, at, side="right") - 1
        # Passage k of a text takes its words k*stride up to (k+2)*stride; a word lies in passages k and k-1.
        slots = sizes // stride + 2
        base = np.cumsum(slots) - slots
        own = base[text] + (at - begin[text]) // stride + 1
        pairs = np.unique(np.concatenate([own, own - 1]) * len(self.number) + np.concatenate([ids[at], ids[at]]))
        slot, term = pairs // len(self.number), pairs % len(self.number)
        n = self.from_[term + 1] - self.from_[term]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.from_[term], n)
        key = np.repeat(slot, n) * len(self.ids) + self.of[inside]
        group, where = np.unique(key, return_inverse=True)
        reached = np.bincount(where, self.by[inside]) + self.spare[group % len(self.ids)]
        hot = np.unique(group[reached >= least - 1e-9] // len(self.ids))
        of = np.searchsorted(base, hot, side="right") - 1
        k = hot - base[of] - 1
        return [(int(t), max(0, int(x) * stride), (int(x) + 2) * stride) for t, x in zip(of, k, strict=True)]


def distinct_texts(items: DataFrame) -> DataFrame:
    """Each distinct text that has a word, with the number of items that have it, its words and its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            words = [q + a for q, a in map(split_item, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(len, words), pa.int64()), pa.array([list(set(w)) for w in words], pa.list_(pa.string()))], ["text", "n", "words", "terms"])

    counted = items.filter(F.col("text").isNotNull()).groupBy("text").agg(F.count("*").alias("n"))
    return counted.mapInArrow(run, "text string, n long, words long, terms array<string>").filter("words > 0")


def write_shards(items: DataFrame) -> list[str]:
    """Write the indexes of the items' distinct texts, and return their files, one for each shard."""
    spark = items.sparkSession
    path = new_folder(spark, "item-index")
    texts = materialize(distinct_texts(items), "items")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not size:
        return []
    bucket = F.pmod(F.xxhash64("text"), F.lit(FINE * math.ceil(size / SHARD_BYTES))).alias("bucket")
    sums = texts.groupBy(bucket).agg(F.sum(F.octet_length("text")), F.sum("n"), F.sum(F.col("n") * F.col("words")), F.max("words")).collect()
    totals = Totals(sum(r[2] for r in sums), sum(r[3] for r in sums), max(r[4] for r in sums))
    dealt, shard, held = [], 0, 0
    for r in sorted(sums):
        if held and held + r[1] > SHARD_BYTES:
            shard, held = shard + 1, 0
        held += r[1]
        dealt.append((r[0], shard))
    placed = texts.withColumn("bucket", bucket).join(F.broadcast(spark.createDataFrame(dealt, "bucket long, shard int")), "bucket")
    terms = placed.select("shard", "n", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("n").alias("n"), F.collect_set("shard").alias("shards"))
    frequencies = terms.select(F.explode("shards").alias("shard"), "term", "n")

    def build(own: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        index = ItemIndex(sorted(own["text"]), totals, dict(zip(counted["term"], counted["n"], strict=True)))
        where, folder = fs.FileSystem.from_uri(path)
        where.create_dir(folder, recursive=True)
        # Files of lost or repeated tasks are named nowhere.
        name = uuid.uuid4().hex
        with where.open_output_stream(f"{folder}/{name}", compression=None) as out:
            out.write(pickle.dumps(index))
        return pd.DataFrame({"name": [name]})

    built = placed.select("shard", "text").groupBy("shard").cogroup(frequencies.groupBy("shard")).applyInPandas(build, "name string")
    names = [f"{path}/{r['name']}" for r in built.collect()]
    discard(texts)
    return names


@lru_cache(maxsize=1)
def load_shard(name: str) -> ItemIndex:
    where, path = fs.FileSystem.from_uri(name)
    with where.open_input_stream(path, compression=None) as file:
        return pickle.loads(file.read())


def matches(index: ItemIndex, texts: list[list[str]], share: float, least_overlap: float) -> dict[tuple[int, bytes], tuple[float, float, float]]:
    """Text and item of each verified match, with the score and both overlaps of its best passage."""
    best: dict[tuple[int, bytes], tuple[float, float, float]] = {}
    for t, start, end in index.candidates(texts, share):
        passage = texts[t][start:end]
        for d, score in index.search(set(passage), share):
            q, a = (overlap(part, passage) for part in index.parts[d])
            if q >= least_overlap and a >= least_overlap:
                best[t, index.ids[d]] = max(best.get((t, index.ids[d]), (0.0, 0.0, 0.0)), (score, q, a))
    return best


def all_matches(texts: list[str | None], shards: list[str], share: float, least_overlap: float) -> dict[tuple[int, bytes], tuple[float, float, float]]:
    """The matches of ``texts`` in all shards; no item is in two of them."""
    words = [words_of(t) if t else [] for t in texts]
    found: dict[tuple[int, bytes], tuple[float, float, float]] = {}
    for name in shards:
        found |= matches(load_shard(name), words, share, least_overlap)
    return found


def find_leaks(docs: DataFrame, items: DataFrame, share: float = 0.6, least_overlap: float = 0.6) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, score, question_overlap, answer_overlap."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shards = write_shards(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", HELD_BYTES):
            best = all_matches(b.column(1).to_pylist(), shards, share, least_overlap)
            numbers = [pa.array([x[i] for x in best.values()], pa.float64()) for i in range(3)]
            item = pa.array([i for _, i in best], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([t for t, _ in best], pa.int64())), item, *numbers], ["doc_id", "item", "score", "question_overlap", "answer_overlap"])

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item binary, score double, question_overlap double, answer_overlap double")
    ids = items.filter(F.col("text").isNotNull()).select("item_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("item"))
    return found.join(ids, "item").select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")


def drop_leaking(docs: DataFrame, items: DataFrame, share: float = 0.6, least_overlap: float = 0.6) -> DataFrame:
    """The documents that hold no item, judged row by row; columns and all other rows stay."""
    place = docs.columns.index("text")
    shards = write_shards(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", HELD_BYTES):
            bad = {t for t, _ in all_matches(b.column(place).to_pylist(), shards, share, least_overlap)}
            yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
