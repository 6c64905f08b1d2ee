"""Fingerprints and components against all pairs, groups that are dealt again, and edge cases."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from zeitband.llm import simhash, terms

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=2):
    """Least index of each component, over all pairs."""
    x = np.array(fps, np.uint64)
    label = np.arange(len(x))
    for i in range(len(x)):
        near = np.flatnonzero(np.bitwise_count(x ^ x[i]) <= radius)
        least = label[near].min()
        label[np.isin(label, label[near])] = least
    return label.tolist()


def signed(fps):
    return np.array(fps, np.uint64).view(np.int64).tolist()


def planted(seed, clusters, walk, spread=64):
    """Chains of fingerprints: each a step of one to four bits, within ``spread`` bits, from the one before."""
    rng = random.Random(seed)
    out = set()
    for _ in range(clusters):
        f = rng.getrandbits(64)
        for _ in range(walk):
            out.add(f)
            for _ in range(rng.randrange(1, 5)):
                f ^= 1 << rng.randrange(spread)
    out = sorted(out)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed, clusters, walk, spread, most", [(1, 40, 12, 64, 0), (2, 2, 500, 64, 8), (3, 1, 900, 20, 4), (4, 3, 200, 30, 1)])
def test_links_against_all_pairs(spark, monkeypatch, seed, clusters, walk, spread, most):
    monkeypatch.setattr(simhash, "SHARD", 300)
    monkeypatch.setattr(simhash, "WALKERS", 50)
    fps = planted(seed, clusters, walk, spread)
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed(fps)], "fp long"), most)
    where = {f: i for i, f in enumerate(signed(fps))}
    label = np.arange(len(fps))
    pairs = [(where[r["u"]], where[r["v"]]) for r in edges.collect()]
    if pairs:
        simhash.merge(label, *np.array(pairs).T)
    assert label.tolist() == plain_components(fps)


def test_each_way_of_agreeing_is_covered():
    """Any two bits may differ: at each level some way has both among its free bits, and refines one that has."""
    levels = simhash.schemes()
    assert [len(x) for x in levels] == [6, 18, 54] and max(64 - len(fixed) for _, fixed in levels[2]) <= 15
    for a in range(64):
        for b in range(a):
            free = [{i for i, (_, fixed) in enumerate(x) if not {a, b} & set(fixed)} for x in levels]
            assert free[0]
            for before, now, level in zip(free, free[1:], levels[1:]):
                assert before == {level[i][0] for i in now}


def test_trees_find_what_all_pairs_find():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = np.unique(base[rng.integers(0, 30, 3000)] ^ (np.uint64(1) << rng.integers(0, 12, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 12, 3000, dtype=np.uint64)))
    keys = (fps >> np.uint64(50)).astype(np.int64)
    f = simhash.Forest(keys, fps.view(np.int64))
    again = simhash.Forest(f.keys, f.fps.view(np.int64), f.parent, f.edge)
    inner = np.flatnonzero(f.parent >= 0)
    assert (np.bitwise_count(f.fps[inner] ^ f.fps[f.parent[inner]]) == f.edge[inner]).all()
    slots = np.stack([f.parent[inner].astype(int), f.edge[inner].astype(int)])
    assert len(np.unique(slots, axis=1).T) == len(inner)  # one child an edge
    want = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[(keys == keys[i]) & (np.bitwise_count(fps ^ a) <= 2) & (fps != a)]}
    for tree in (f, again):
        assert {(int(fps[p]), int(tree.fps[n])) for ps, ns in tree.near(keys, fps.view(np.int64)) for p, n in zip(ps, ns)} == want


def test_whole_query_against_all_pairs(spark):
    rng = random.Random(8)
    words = [f"W{i}" for i in range(300)]
    docs = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.randrange(3, 400))]
        docs.append((i, " ".join(t)))
        for j in range(3):
            t = list(t)
            t[rng.randrange(len(t))] = rng.choice(words)
            docs.append((500 - 4 * i - j, "\t".join(t)))
    docs += [(900, docs[0][1].upper()), (901, None), (902, ""), (903, " \n"), (904, "one two"), (905, "one  TWO"), (None, docs[1][1]), (None, "alone in the world"), (906, "wort " * 50_000), (4, docs[8][1])]
    fps = [plain_fingerprint(t) for _, t in docs]
    label = plain_components(fps)
    least = {}
    for (d, _), c in zip(docs, label):
        least[c] = min(least.get(c, 2**63), 2**63 if d is None else d)
    want = sorted(((d, f"{f:016x}", None if least[c] == 2**63 else least[c]) for (d, _), f, c in zip(docs, fps, label)), key=repr)
    got = simhash.simhash_components(spark.createDataFrame(docs, SCHEMA).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert len(set(label)) < len(set(fps))


def test_fingerprints_of_pieces(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(500))
    texts = [text, "a", "a b", "a b c", ""]
    whole = [simhash.fingerprint(t) for t in texts]
    assert whole == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(terms, "PIECE", 3)
    assert [simhash.fingerprint(t) for t in texts] == whole


def test_edges(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (1, "a b c d"), (2, None), (2, None)], SCHEMA)
    assert simhash.simhash_components(docs.limit(0)).collect() == []
    want = sorted(map(repr, simhash.simhash_components(docs).collect()))
    extra = docs.withColumns({c: F.lit("x") for c in ("fp", "salt", "key", "shard", "slice", "u", "v", "root", "least", "component_id", "fingerprint")})
    assert sorted(map(repr, simhash.simhash_components(extra).collect())) == want and len(want) == 4
