"""Bit planes against plain sums; the draw against a plain version with longer runs and other buckets; edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from zeitband.llm import resample, terms

SCHEMA = "doc_id long, text string"


def plain(docs, target, n, buckets, least, percent, seed=2024):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    found = [(d, *features(x)) for d, x in docs]
    for _, _, f in found:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, features(x)[1], 1)
    gain = [math.floor(1000 * math.log(float(b + 1) * float(s.sum() + buckets) / (float(a + 1) * float(t.sum() + buckets)))) for a, b in zip(s, t)]
    rows = []
    for d, words, f in found:
        h = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words >= least])
    order = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("n, buckets, percent", [(1, 10_000, 10), (2, 61, 50), (3, 1000, 100)])
def test_against_plain_sums(spark, n, buckets, percent, monkeypatch):
    monkeypatch.setattr(resample, "ROWS", 7)
    rng = random.Random(n)
    vocabulary = ["Wort", "ÄÖ", "x1", "the", "of", "und", "y"] + [f"w{i}" for i in range(50)]
    docs = [(i, " ,".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(150)]
    docs += [(200, None), (201, ""), (None, "the " * 30), (202, "the " * 5000), (203, "?! \x1c\x00"), (204, docs[3][1])]
    target = ["the of und y", None, "Wort wort WORT", "the of und y"]
    got = resample.resample(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), n, buckets, 20, percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, target, n, buckets, 20, percent)


def test_weights_are_exact():
    rng = np.random.default_rng(3)
    for buckets in (1, 8, 10_000):
        gain = rng.integers(-30_000, 30_000, buckets)
        counts = rng.integers(0, 3_000_000, (5, buckets)) * (rng.random((5, buckets)) < 0.2)
        planes = resample.to_planes(counts)
        packed = [b"".join(planes[k][i].tobytes() for k in range(int(c.max()).bit_length())) for i, c in enumerate(counts)]
        assert resample.Weigher(gain).weights(packed).tolist() == (counts * gain).sum(axis=1).tolist()


def test_features_across_pieces(monkeypatch):
    text = " ".join(f"w{i % 17}" for i in range(300))
    whole = [x.tolist() if isinstance(x, np.ndarray) else x for x in resample.bucket_counts(text, 3, resample.BucketOf(101))]
    monkeypatch.setattr(terms, "PIECE", 5)
    assert [x.tolist() if isinstance(x, np.ndarray) else x for x in resample.bucket_counts(text, 3, resample.BucketOf(101))] == whole


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c " * 9), (1, "a b c " * 9), (2, None)], SCHEMA)
    target = spark.createDataFrame([("a b",)], "text string")
    assert resample.resample(docs.limit(0), target).collect() == []
    want = sorted(map(repr, resample.resample(docs, target, percent=50).collect()))
    extra = docs.withColumns({c: F.lit("x") for c in ("score", "weight", "rank", "planes", "place", "task", "n_words")})
    assert sorted(map(repr, resample.resample(extra, target.withColumn("doc_id", F.lit("y")), percent=50).collect())) == want
    assert len(want) == 3 and sum("rank=1" in r for r in want) == 1
    assert resample.resample(docs, target.limit(0)).count() == 3
