import hashlib
import random

import numpy as np
import pytest

from zeitband.llm.queries import op5_suffix_dedup
from zeitband.llm.repeats import intervals, repeated_spans


def brute(rows, length=50):
    """n_bytes, n_removed, n_spans and kept_sha256 of each (doc_id, text), from a table of all windows."""
    least = {}
    for d, t in rows:
        raw, d = (t or "").encode(), 2**63 if d is None else d
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, np.int8)
        for i in range(len(raw) - length + 1):
            if least[raw[i : i + length]] < (2**63 if d is None else d):
                gone[i + 1 : i + 1 + length] = 1
        left = bytes(b for b, g in zip(raw, gone[1:]) if not g)
        out.append((d, len(raw), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path + "/documents.parquet")
    return sorted([tuple(r) for r in op5_suffix_dedup(spark, path).collect()], key=repr)


def test_like_brute_force(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 8))]
        text = " ".join(parts)
        if rng.random() < 0.3 and len(text) > 60:
            a = rng.randrange(len(text) - 50)
            text = text[a : a + rng.randint(40, 200)]
        rows.append((i, text))
    rows += [(200, rows[5][1]), (201, rows[5][1]), (5, rows[5][1]), (202, "a" * 500), (203, "a" * 49), (204, "a" * 60), (205, None), (206, ""), (None, rows[7][1]), (None, "\x00" * 80), (207, "\x00" * 70), (208, "a\x00" * 40)]
    rng.shuffle(rows)
    want = brute(rows)
    assert run(spark, rows, tmp_path) == want
    # Nothing depends on how the windows of frequent anchors are dealt.
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for hot in (1, 4):
        for r in repeated_spans(docs, hot=hot).filter("left is not null").collect():
            assert hashlib.sha256(r["left"]).hexdigest() == r["left_sha256"]
        spans = [(r["doc_id"], r["n_bytes"], sum(e - s for s, e in r["spans"]), len(r["spans"])) for r in repeated_spans(docs, hot=hot).collect()]
        assert sorted(spans, key=repr) == sorted((w[:4] for w in want), key=repr)


def test_real_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, class string, left int")
    assert repeated_spans(empty).collect() == []
    docs = spark.createDataFrame([(1, "x" * 60, "c", 1), (2, "x" * 60, "c", 1)], "doc_id long, text string, class string, left int")
    assert {(r["doc_id"], len(r["spans"])) for r in repeated_spans(docs).collect()} == {(1, 0), (2, 1)}
    with pytest.raises(ValueError):
        repeated_spans(docs, 30)


def test_interval_tree():
    # Suffixes of "banana$" by order: a, ana, anana, banana, na, nana.
    found = {(d, a, z) for d, a, z, _ in intervals([1, 3, 0, 0, 2], [ord("n"), ord("n"), ord("b"), -1, ord("a"), ord("a")])}
    assert (3, 1, 3) in found and (1, 0, 3) in found and (2, 4, 6) not in found
