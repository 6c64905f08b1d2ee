from collections import Counter

import numpy as np

from zeitband.llm.language_id import WINDOW, ByteGRU, identify, padded, pooled, sample


def test_sample_is_bounded_for_each_language(spark):
    """A rare language beside a hot one, copies and null ids."""
    made = [(i, f"the cat and the dog number {i}", "en") for i in range(20_000)]
    made += [(20_000 + i, f"ryba plywa szybko {i}", "pl") for i in range(4)]
    made += [(None, f"le chat noir {i}", "fr") for i in range(300)]
    made += [(0, "der hund", "de")] * 500 + [(None, None, "xx"), (1, "a", None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = sample(docs, rows=100, chars=200)
    found = Counter(lang for _, lang in got)
    assert found["en"] == 100 and found["fr"] == 100 and found["de"] == 1 and 1 <= found["pl"] <= 4 and set(found) == {"en", "fr", "de", "pl"}
    assert got == sample(docs.repartition(7), rows=100, chars=200)
    assert {r["lang_pred"] for r in identify(docs.filter("lang = 'pl'").unionByName(docs.filter("lang = 'en'")), rows=100, hidden=8, steps=150).collect()} == {"en", "pl"}


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert sample(docs) == []


def test_gradients_like_finite_differences():
    net = ByteGRU(["a", "b", "c"], 4, seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, n = padded(["hello wörld".encode(), b"xyz", b"abcdabcd", b"a"])
    y = np.array([0, 2, 1, 1])
    made = net.gradients(x, n, y)
    for k, w in net.w.items():
        for i in list(np.ndindex(w.shape))[::5]:
            old = w[i]
            w[i] = old + 1e-6
            up = net.loss(x, n, y)
            w[i] = old - 1e-6
            down = net.loss(x, n, y)
            w[i] = old
            assert abs((up - down) / 2e-6 - made[k][i]) < 1e-7


def test_pooling_reads_every_byte_once():
    """Texts of any length beside each other, against one stretch after the other."""
    net = ByteGRU(["a", "b"], 4, seed=2)
    texts = [b"x", b"ab" * 64, b"abc" * 100, b"q" * 129]
    for text, mean in zip(texts, pooled(net, texts)):
        parts = [text[i : i + WINDOW] for i in range(0, len(text), WINDOW)]
        assert np.allclose(sum(net.log_probabilities(*padded([p])).sum(axis=0)[:, 0] for p in parts) / len(text), mean, atol=1e-5)


def test_words_are_read_in_their_context():
    net = ByteGRU(["a", "b"], 4, seed=3)
    alone, after = net.log_probabilities(*padded([b"die "]))[:, :, 0], net.log_probabilities(*padded([b"to die "]))[3:, :, 0]
    assert not np.allclose(alone, after)
