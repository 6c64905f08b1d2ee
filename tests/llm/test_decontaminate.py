import math
import random
from collections import Counter

from zeitband.llm import decontaminate
from zeitband.llm.decontaminate import B, K1, overlap, split_item, words_of

WORDS = [f"w{i}" for i in range(150)]


def tables(spark):
    rng = random.Random(5)
    items = [" ".join(rng.choices(WORDS, k=rng.randint(4, 30))) + rng.choice(["", "? yes it is w1"]) for _ in range(60)]
    items += [items[0]] * 25 + ["", "?!", None]
    docs = []
    for _ in range(150):
        words = rng.choices(WORDS, k=rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            own = words_of(rng.choice(items[:60]))
            cut = own[rng.randint(0, len(own) // 3) :]
            at = rng.randint(0, len(words))
            words[at:at] = cut
        docs.append(" ".join(words))
    docs += ["", None]
    items = [(None if i == 7 else i, t) for i, t in enumerate(items)]
    return items, docs, spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")


def brute_force(items, docs, share, least):
    """Plain BM25 over all items, passage by passage."""
    cut = [(i, *split_item(t)) for i, t in items if t and words_of(t)]
    counts = [Counter(q + a) for _, q, a in cut]
    df = Counter(t for c in counts for t in c)
    mean = sum(sum(c.values()) for c in counts) / len(counts)
    stride = max(decontaminate.LEAST_WINDOW, max(sum(c.values()) for c in counts))
    found = Counter()
    for d, text in enumerate(docs):
        words = words_of(text or "")
        for (i, q, a), c in zip(cut, counts):
            n = sum(c.values())
            raw = {t: math.log(1 + (len(counts) - df[t] + 0.5) / (df[t] + 0.5)) * k * (K1 + 1) / (k + K1 * (1 - B + B * n / mean)) for t, k in c.items()}
            best = None
            for start in range(-stride, len(words), stride):
                passage = words[max(0, start) : start + 2 * stride]
                score = sum(w for t, w in raw.items() if t in set(passage)) / sum(raw.values())
                both = overlap(q, passage), overlap(a, passage)
                if score >= share - 1e-9 and min(both) >= least:
                    best = max(best or (0, 0, 0), (score, *both))
            if best:
                found[(d, i, *(round(x, 6) for x in best))] += 1
    return found


def test_every_way_to_deal_gives_plain_bm25(spark, monkeypatch):
    items, docs, item_rows, doc_rows = tables(spark)
    want = brute_force(items, docs, 0.6, 0.6)
    assert len(want) > 50
    for size in (4 << 20, 2000):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", size)
        got = Counter((r[0], r[1], *(round(x, 6) for x in r[2:])) for r in decontaminate.find_leaks(doc_rows, item_rows).collect())
        assert got == want
        clean = {r["doc_id"] for r in decontaminate.drop_leaking(doc_rows, item_rows).collect()}
        assert clean == set(range(len(docs))) - {d for d, *_ in want}


def test_shards_are_bounded_and_share_their_statistics(spark, monkeypatch):
    _, _, item_rows, _ = tables(spark)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 2000)
    shards = [decontaminate.load_shard(name) for name in decontaminate.write_shards(item_rows)]
    assert len(shards) > 2 and sum(len(x.ids) for x in shards) == 60
    assert len({x.longest for x in shards}) == 1
    assert all(sum(len(" ".join(q + a)) for q, a in x.parts) <= 2000 for x in shards)


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (2, "?")], "item_id long, text string")
    assert decontaminate.find_leaks(docs, none).count() == 0 and decontaminate.drop_leaking(docs, none).count() == 1
