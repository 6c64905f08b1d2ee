"""The index of voices against all pairs, and how much it leaves out."""

import math
import random

import pytest

from zeitband.operators import identity, neighbours

QUERIES, BANK = "session long, vec_id long, embedding array<double>", "session long, speaker int, voice array<double>, pending boolean"


def cosine(a, b):
    norms = math.sqrt(sum(x * x for x in a or [])) * math.sqrt(sum(x * x for x in b or []))
    return sum(x * y for x, y in zip(a, b)) / norms if a and b and len(a) == len(b) and norms else 0.0


def plain(queries, bank):
    rows = []
    for session, vec, x in queries:
        own = [(round(cosine(x, v), 6), not p, -s) for t, s, v, p in bank if t == session]
        sim, sure, place = max(own, default=(0.0, True, 0))
        rows.append((vec, sim, -place if own and sim > (0.62 if sure else 0.35) else None))
    return sorted(rows, key=repr)


def clustered(rng, n, dim, centres, spread):
    return [[c + rng.gauss(0, spread) for c in rng.choice(centres)] for _ in range(n)]


def tables(seed, dim=8, n_voices=60, n_queries=40, spread=0.15):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    bank = [(s, i, v, rng.random() < 0.3) for s in (1, 2) for i, v in enumerate(clustered(rng, n_voices, dim, centres, spread))]
    queries = [(rng.choice((1, 2)), i, v) for i, v in enumerate(clustered(rng, n_queries, dim, centres, spread))]
    return queries, bank


@pytest.mark.parametrize("n_bytes", [1 << 24, 0])
def test_index_like_all_pairs(spark, monkeypatch, n_bytes):
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", n_bytes)
    queries, bank = tables(1)
    bank += [(1, 100, bank[3][2], False), (1, 99, [2 * x for x in bank[3][2]], True), (3, 1, [0.0] * 8, False), (3, 2, None, False), (4, 1, [1.0, 0.0], False), (5, 1, [1.0] * 8, None)]
    queries += [(1, 100, bank[3][2]), (1, 101, [0.0] * 8), (1, 102, None), (9, 103, [1.0] * 8), (3, 104, [1.0] * 8), (4, 105, [-1.0] * 8), (4, 106, [-1.0, 0.0]), (1, 107, [-x for x in bank[0][2]]), (5, 108, [1.0] * 8)]
    got = identity.identify(spark.createDataFrame(queries, QUERIES).repartition(3), spark.createDataFrame(bank, BANK))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(queries, [(*b[:3], bool(b[3])) for b in bank])


@pytest.mark.parametrize(("spread", "most"), [(0.05, 0.35), (0.3, 0.9)])
def test_most_pairs_are_left_out(spark, spread, most):
    """Voices in groups: a query is compared with the voices of few cells."""
    queries, bank = tables(2, dim=16, n_voices=300, n_queries=100, spread=spread)
    n = neighbours.scored(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(bank, BANK)).count()
    pairs = sum(sum(b[0] == q[0] for b in bank) for q in queries)
    assert 0 < n <= most * pairs


def test_empty_tables(spark):
    queries, bank = spark.createDataFrame([(1, 1, [1.0])], QUERIES), spark.createDataFrame([(1, 1, [1.0], False)], BANK)
    assert identity.identify(queries.limit(0), bank).collect() == []
    assert [tuple(r) for r in identity.identify(queries, bank.limit(0)).collect()] == [(1, 0.0, None)]
