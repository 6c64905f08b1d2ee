"""Search against a plain version: copies, ties, hashes that meet, several blocks of items, and edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from zeitband.llm import lexical

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def plain(docs, items, k=10, b=90, k1=8):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    held = [(d, Counter(cut(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_all = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    rows = []
    for item, text in items:
        scored = []
        for d, c, n in held:
            m = 100 - b + b * n * n_docs // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + k1 * m)) for w in set(cut(text)) if w in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        rows += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(rows, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Straße", "ÄÖ", "x_y", "THE", "the"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(300)]
    docs += [(1000 - i, docs[7][1]) for i in range(60)]  # copies, in no order
    docs += [(2000 + i, "w1 w2 other" + " filler" * 3) for i in range(20)]
    docs += [(2100 + i, f"w1 w2 other{i}" + " filler" * 3) for i in range(20)]  # equal bags, other texts
    docs += [(None, "w1 w2"), (3000, None), (3001, ""), (3002, "?!"), (3003, "w3 " * 20_000), (5, docs[5][1]), (5, docs[5][1])]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "nothing-of-this"), (93, items[0][1]), (93, items[0][1]), (None, "w1 w2 w1"), (94, "w1 w2")]
    return docs, items


@pytest.mark.parametrize("k, item_bytes, held, cells, one_hash", [(10, 4_000_000, 20_000, 500_000, False), (3, 60, 9, 50, False), (10, 4_000_000, 9, 50, True)])
def test_against_a_plain_version(spark, tables, monkeypatch, k, item_bytes, held, cells, one_hash):
    docs, items = tables
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)
    monkeypatch.setattr(lexical, "HELD", held)
    monkeypatch.setattr(lexical, "CELLS", cells)
    real = lexical.gathered
    if one_hash:
        # All hashes meet: classes must still be told apart by their bags.
        monkeypatch.setattr(lexical, "gathered", lambda *a: real(*a).withColumn("h", F.lit(1).cast("long")))
    got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), k=k)
    assert found(got) == plain(docs, items, k)


def test_scorer_counts_whole_classes():
    """Ten members of one class fill a list; of equal scores the smaller ids win over classes."""
    s = lexical.Scorer([[0]], 1, np.array([1000]), 4, 8)
    bag = np.array([0, 1], "<u4").tobytes()
    s.add([(100, bag, [5, 9, 12]), (100, bag, [2, 30, None])])
    s.add([(100, bag, [1, 11])])
    assert s.best[2].tolist() == [1, 2, 5, 9]


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    items = spark.createDataFrame([(1, "a"), (2, None)], ITEMS)
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs.filter("doc_id = 2"), items).collect() == []
    want = found(lexical.search(docs, items))
    names = ("n", "bag", "h", "m", "ids", "item", "rank", "score", "block")
    clash = lambda df, more: df.withColumns({c: F.lit("x") for c in (*names, more)})
    assert found(lexical.search(clash(docs, "item_id"), clash(items, "doc_id"))) == want and len(want) == 1
