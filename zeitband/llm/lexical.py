"""Ranked lexical search in integers (a form of BM25), scored once for each class of documents with equal bags.

1. Items are taken in blocks of bounded text; a block's distinct terms are the vocabulary. Each document is restricted
   to it: its bag is a sorted vector of term numbers and frequencies, written once with the document's length.
2. One aggregate gives the number of documents and of terms, another the document frequencies of the vocabulary.
3. A document's score depends on its bag and on its length norm m alone. Documents are gathered by a hash of both;
   where hashes meet, m and the vectors themselves are compared, so a class holds equal bags only. Classes are
   gathered in each task before they move, and of a class only the k smallest doc_ids can be in any result: at most k
   ids move from each task, however many copies there are.
4. A task scores each of its classes once against all items of the block that share a term, expands members by
   ascending doc_id and keeps the k best of each item; those meet in one ranking by item.

Defined cases: null texts and texts without terms count in nothing and are never found; texts of any length are read
whole; repeated rows are documents each; equal scores go by ascending doc_id, null doc_ids last; items with equal texts
are searched once, and each gets the result; an item without terms, or whose terms no document holds, has no rows; an
empty table of either kind gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, materialize
from .terms import LETTERS_AND_DIGITS, words

#: Bytes of distinct item texts in a block, about.
ITEM_BYTES = 4_000_000
#: Classes that a task holds before it passes them on.
HELD = 20_000
#: Scores, and addends to scores, in memory at a time.
CELLS = 500_000


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text) and bag: the numbers of the known terms in order, then their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            sizes, found = [], []
            for t in b.column(1).to_pylist():
                n, tf = 0, Counter()
                for part in words(t, LETTERS_AND_DIGITS):
                    n += len(part)
                    tf.update(map(vocabulary.get, part))
                tf.pop(None, None)
                terms = sorted(tf)
                sizes.append(n)
                found.append(np.array([*terms, *map(tf.__getitem__, terms)], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n", "bag"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, bag binary")


def document_frequencies(written: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is; partial counts by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            bags = [np.frombuffer(x, "<u4") for x in b.column(0).to_pylist()]
            if bags:
                total += np.bincount(np.concatenate([x[: len(x) // 2] for x in bags]), minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "n"])

    df = np.zeros(n_terms, np.int64)
    for r in written.select("bag").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    return df


def _first(ids: list[int | None], k: int) -> list[int | None]:
    return sorted(ids, key=lambda i: (i is None, i or 0))[:k]


def gathered(written: DataFrame, n_docs: int, n_all: int, k: int, b: int) -> DataFrame:
    """h, m, bag and ids (the k smallest): the classes of each task. Documents without known terms are in none."""

    def rows(held: dict[tuple[int, bytes], list]) -> pa.RecordBatch:
        h = [xxhash.xxh64_intdigest(bag, m) - 2**63 for m, bag in held]
        columns = [pa.array(h, pa.int64()), pa.array([m for m, _ in held], pa.int64()), pa.array([x for _, x in held], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([_first(i, k) for i in held.values()], pa.list_(pa.int64()))], ["h", "m", "bag", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}
        for batch in batches:
            for i, n, bag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not bag:
                    continue
                ids = held.setdefault((100 - b + b * n * n_docs // n_all, bag), [])
                ids.append(i)
                if len(ids) >= 8 * k:
                    ids[:] = _first(ids, k)
            if len(held) >= HELD:
                yield rows(held)
                held.clear()
        if held:
            yield rows(held)

    return written.select("doc_id", "n", "bag").mapInArrow(run, "h long, m long, bag binary, ids array<long>")


class Scorer:
    """The best documents of each item so far."""

    def __init__(self, of_term: list[list[int]], n_items: int, weights: np.ndarray, k: int, k1: int):
        self.k, self.k1, self.weights, self.n_items = k, k1, weights, n_items
        self.many = np.array([len(x) for x in of_term], np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.items = np.array([i for x in of_term for i in x], np.int64)
        # Item, score, doc_id and whether there is one, of what is best so far; and what any item's last place has.
        self.best = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        self.last = np.zeros(n_items, np.int64)

    def add(self, classes: list[tuple[int, bytes, list]]) -> None:
        at = max(1, CELLS // max(1, self.n_items))
        for s in range(0, len(classes), at):
            self._add(classes[s : s + at])

    def scores(self, classes: list[tuple[int, bytes, list]]) -> np.ndarray:
        """A row of scores for each class, a column for each item."""
        pairs = [np.frombuffer(bag, "<u4").astype(np.int64) for _, bag, _ in classes]
        half = [len(p) // 2 for p in pairs]
        term = np.concatenate([p[:n] for p, n in zip(pairs, half, strict=True)])
        tf = np.concatenate([p[n:] for p, n in zip(pairs, half, strict=True)])
        of = np.repeat(np.arange(len(classes)), half)
        m = np.array([m for m, _, _ in classes], np.int64)[of]
        worth = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + self.k1 * m))
        total = np.zeros(len(classes) * self.n_items, np.int64)
        many = self.many[term]
        steps = np.cumsum(many) // CELLS
        for cut in np.split(np.arange(len(term)), np.flatnonzero(np.diff(steps)) + 1):
            n = many[cut]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[term[cut]], n)
            np.add.at(total, np.repeat(of[cut] * self.n_items, n) + self.items[place], np.repeat(worth[cut], n))
        return total.reshape(len(classes), self.n_items)

    def _add(self, classes: list[tuple[int, bytes, list]]) -> None:
        score = self.scores(classes)
        row, item = np.nonzero((score > 0) & (score >= self.last))
        sizes = np.array([len(ids) for _, _, ids in classes])
        ids = [i for _, _, x in classes for i in x]
        none = np.array([i is None for i in ids], bool)
        ids = np.array([i or 0 for i in ids], np.int64)
        n = sizes[row]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(sizes) - sizes)[row], n)
        new = [np.repeat(item, n), np.repeat(score[row, item], n), ids[place], none[place]]
        item, score, ids, none = (np.concatenate(x) for x in zip(self.best, new, strict=True))
        order = np.lexsort((ids, none, -score, item))
        item = item[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[nth < self.k]
        item, nth = item[nth < self.k], nth[nth < self.k]
        self.best = [item, score[order], ids[order], none[order]]
        full = nth == self.k - 1
        self.last[item[full]] = self.best[1][full]


def best_by_task(classes: DataFrame, of_term: list[list[int]], n_items: int, weights: np.ndarray, k: int, k1: int) -> DataFrame:
    """item (its number), doc_id and score: the k best of each item in each task. ``classes`` stand in order of h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(of_term, n_items, weights, k, k1)
        now, same, ready = None, {}, []
        for batch in batches:
            for h, m, bag, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != now:
                    ready += [(*key, _first(x, k)) for key, x in same.items()]
                    now, same = h, {}
                # Equal hashes alone make no class: m and the bag are the key.
                held = same.setdefault((m, bag), [])
                held += ids
                if len(held) >= 8 * k:
                    held[:] = _first(held, k)
            if ready:
                scorer.add(ready)
                ready = []
        ready += [(*key, _first(x, k)) for key, x in same.items()]
        if ready:
            scorer.add(ready)
        item, score, ids, none = scorer.best
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=none), pa.array(score)], ["item", "doc_id", "score"])

    return classes.mapInArrow(run, "item long, doc_id long, score long")


def _search_block(docs: DataFrame, texts: list[str], k: int, b: int, k1: int) -> DataFrame:
    """item (its place in ``texts``), rank, doc_id and score."""
    vocabulary: dict[bytes, int] = {}
    of_term: list[list[int]] = []
    for i, text in enumerate(texts):
        for w in {w for part in words(text, LETTERS_AND_DIGITS) for w in part}:
            if w not in vocabulary:
                vocabulary[w] = len(of_term)
                of_term.append([])
            of_term[vocabulary[w]].append(i)
    written = materialize(bags(docs, vocabulary), "bags")
    n_docs, n_all = written.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(written, len(of_term)).tolist()
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df], np.int64)
    classes = gathered(written, n_docs, max(1, n_all), k, b).repartition("h").sortWithinPartitions("h")
    found = best_by_task(classes, of_term, len(texts), weights, k, k1)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, b: int = 90, k1: int = 8) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` best documents (doc_id, text) of each item (item_id, text).

    ``b`` is the weight of a document's length in hundredths, ``k1`` the saturation of frequencies in tenths.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    items = items.select("item_id", "text").filter("text is not null")
    texts = items.select("text").distinct()
    n_blocks = -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES) or 1
    texts = materialize(texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n_blocks))), "texts") if n_blocks > 1 else texts.withColumn("block", F.lit(0))
    result = None
    for i in range(n_blocks):
        block = sorted(r["text"] for r in texts.filter(F.col("block") == i).collect())
        named = spark.createDataFrame(list(enumerate(block)), "item long, text string")
        found = _search_block(docs, block, k, b, k1).join(named, "item").join(items, "text")
        found = found.select("item_id", "rank", F.col("doc_id").cast(kind).alias("doc_id"), "score")
        result = found if result is None else result.union(found)
    return result
