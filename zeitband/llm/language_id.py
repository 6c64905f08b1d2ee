"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a stretch of text from both sides, labels every position, and the log probabilities
of all positions of a document are pooled (averaged, then normalised). It is trained in numpy by backpropagation
through time on a sample of labelled documents, bounded for each language, and applied to whole texts, in stretches of
``WINDOW`` bytes of running text; at the ends of a stretch one of the two directions has read the whole of it.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; if no labelled row can be learned from,
every text is; rows with a null id may be learned from, and are never held out; of languages with equal scores the
first by name is taken; repeated rows give a row each; texts of any length are read whole; an empty table gives an empty
result; columns other than doc_id, text and lang, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks

#: Bytes of a stretch, and stretches read at once.
WINDOW = 128
AT_ONCE = 1024
#: Lengths of the stretches that a batch of training may have, and bytes of a batch.
LENGTHS = (16, 32, 64, 128)
BATCH_BYTES = 4096


def squash(x: np.ndarray) -> np.ndarray:
    """Between -1 and 1, as tanh is, from additions and one division alone; its slope is (1 - |squash(x)|) ** 2. Gates
    are half of it, plus a half."""
    return x / (1 + np.abs(x))


def backwards(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Columns (along the first axis) of real length ``n``, each read from its end; what pads it stays behind."""
    at = np.arange(len(x))[:, None]
    at = np.where(at < n, n - 1 - at, at)
    return np.take_along_axis(x, at if x.ndim == 2 else at[:, None, :], axis=0)


class ByteGRU:
    """Two gated recurrent layers, one for each direction, and a linear label layer over both.

    Arrays are (direction, unit, stretch); either direction's stretches begin at their first byte, padding comes last
    and so never reaches a real position."""

    def __init__(self, labels: list[str], hidden: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        small = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
        self.w = {"entry": small(2, 3 * hidden, 256), "inner": small(2, 3 * hidden, hidden), "out": small(2, len(labels), hidden), "bias": np.zeros(len(labels), np.float32)}

    def scan(self, both: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """State before, update and reset gate, recurrent part, candidate and state of each position; ``both`` holds
        the bytes as (direction, time, stretch)."""
        n, entry, inner = self.hidden, self.w["entry"], self.w["inner"]
        h, a = np.zeros((2, n, both.shape[2]), entry.dtype), np.empty((2, 3 * n, both.shape[2]), entry.dtype)
        for t in range(both.shape[1]):
            for i in (0, 1):
                np.take(entry[i], both[i, t], axis=1, out=a[i], mode="clip")
            g = inner @ h
            zr = 0.5 + 0.5 * squash(a[:, : 2 * n] + g[:, : 2 * n])
            z, r, u = zr[:, :n], zr[:, n:], g[:, 2 * n :]
            c = squash(a[:, 2 * n :] + r * u)
            before, h = h, c + z * (h - c)
            yield before, z, r, u, c, h

    def logits(self, x: np.ndarray, n: np.ndarray, steps: list | None = None) -> np.ndarray:
        """(time, label, stretch); the steps of the scan are kept in ``steps``."""
        out = self.w["out"]
        made = np.empty((2, len(x), len(self.labels), x.shape[1]), out.dtype)
        for t, step in enumerate(self.scan(np.stack([x, backwards(x, n)]).astype(np.intp))):
            made[:, t] = out @ step[-1]
            if steps is not None:
                steps.append(step)
        return made[0] + backwards(made[1], n) + self.w["bias"][:, None]

    def log_probabilities(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        logits = self.logits(x, n)
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def loss(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> float:
        """The mean cross-entropy over all real positions, each labelled with its document's language."""
        own = self.log_probabilities(x, n)[:, y, np.arange(len(y))]
        return -float(own[np.arange(len(x))[:, None] < n].mean())

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of ``loss``, by backpropagation through time."""
        steps: list[tuple[np.ndarray, ...]] = []
        logits = self.logits(x, n, steps)
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, y, np.arange(len(y))] -= 1
        p *= (np.arange(len(x))[:, None] < n)[:, None, :] / n.sum()
        p = p.astype(logits.dtype)
        each = np.stack([p, backwards(p, n)], axis=1)
        states = np.stack([s[-1] for s in steps])
        grad = {"bias": p.sum(axis=(0, 2)), "out": np.matmul(each, states.transpose(0, 1, 3, 2)).sum(axis=0)}
        into = self.w["out"].transpose(0, 2, 1) @ each
        grad["inner"], inner_t = np.zeros_like(self.w["inner"]), self.w["inner"].transpose(0, 2, 1)
        back, entered = np.zeros_like(states[0]), np.empty((2, 3 * self.hidden, *x.shape), logits.dtype)
        for t in range(len(x) - 1, -1, -1):
            before, z, r, u, c, _ = steps[t]
            d = into[t] + back
            dc = d * (1 - z) * (1 - np.abs(c)) ** 2
            dz = d * (before - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dc * u * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            dg = np.concatenate([dz, dr, dc * r], axis=1)
            back = d * z + inner_t @ dg
            grad["inner"] += dg @ before.transpose(0, 2, 1)
            entered[:, :, t] = np.concatenate([dz, dr, dc], axis=1)
        both = (x.ravel(), backwards(x, n).ravel())
        grad["entry"] = np.stack([[np.bincount(both[i], row.ravel(), 256) for row in entered[i]] for i in (0, 1)]).astype(logits.dtype)
        return grad


def padded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as a (time, stretch) array, and the lengths."""
    n = np.array([len(p) for p in parts])
    x = np.zeros((n.max(), len(parts)), np.uint8)
    x.T[np.arange(n.max()) < n[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
    return x, n


def bytes_of(text: str) -> bytes:
    return text.lower().encode()


def train(samples: list[tuple[str, str]], hidden: int = 16, steps: int = 700, rate: float = 0.01, seed: int = 0) -> ByteGRU | None:
    """Fit the network on (text, language) samples by Adam; every batch draws languages evenly, and stretches of one
    length from anywhere in their texts."""
    labels = sorted({lang for _, lang in samples})
    if not labels:
        return None
    pools = [[raw for t, lang in samples if lang == label and (raw := bytes_of(t))] or [b" "] for label in labels]
    rng, net = np.random.default_rng(seed), ByteGRU(labels, hidden, seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    for step in range(1, steps + 1):
        length = LENGTHS[step % len(LENGTHS)]
        y = rng.integers(len(labels), size=BATCH_BYTES // length)
        parts = []
        for k in y:
            raw = pools[k][rng.integers(len(pools[k]))]
            at = rng.integers(max(1, len(raw) - length + 1))
            parts.append(raw[at : at + length])
        for k, g in net.gradients(*padded(parts), y).items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.005 * (g * g - v[k])
            net.w[k] -= (rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: ByteGRU, texts: list[bytes]) -> np.ndarray:
    """The mean over all positions of each text of the log probabilities of the labels."""
    parts = [t[i : i + WINDOW] for t in texts for i in range(0, len(t), WINDOW)]
    of = np.repeat(np.arange(len(texts)), [-(-len(t) // WINDOW) for t in texts])
    total = np.zeros((len(texts), len(net.labels)))
    # Stretches of like length together; all but the last of each text are of full length.
    order = np.argsort([len(p) for p in parts], kind="stable")
    for i in range(0, len(order), AT_ONCE):
        at = order[i : i + AT_ONCE]
        x, n = padded([parts[k] for k in at])
        log_p = np.where((np.arange(len(x))[:, None] < n)[:, None, :], net.log_probabilities(x, n), 0)
        np.add.at(total, of[at], log_p.sum(axis=0, dtype=np.float64).T)
    return total / np.array([[len(t)] for t in texts])


def predict(net: ByteGRU | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    if net is None or not known:
        return langs, scores
    mean = pooled(net, [bytes_of(texts[i]) for i in known])
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    for i, each, best in zip(known, p / p.sum(axis=1, keepdims=True), p.argmax(axis=1), strict=True):
        langs[i], scores[i] = net.labels[best], float(each[best])
    return langs, scores


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows: int = 3000, chars: int = 1500) -> list[tuple[str, str]]:
    """The bounded sample that is learned from: of each language ``rows`` distinct labelled documents (id and text) that
    are not held out, or all if there are fewer, in the order of a hash; of each a stretch of ``chars`` characters from a
    place that the hash of the id gives. So many hashes are let through that hardly more than these reach the driver."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    place = F.xxhash64(F.col("doc_id").cast("string"))
    start = F.pmod(place, F.greatest(F.lit(1), F.length("text") - F.lit(chars) + 1)) + 1
    order = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "text"), 1)
    enough, top = 1.2 * rows + 6 * math.sqrt(rows) + 50, 2**63 - 1
    counts = usable.groupBy("lang").agg(F.approx_count_distinct(order, 0.02).alias("n")).collect()
    limits = docs.sparkSession.createDataFrame([(r["lang"], top if r["n"] <= enough else int(enough / r["n"] * top)) for r in counts], "lang string, most long")
    taken = usable.select("lang", order.alias("order"), F.substr("text", start.cast("int"), F.lit(chars)).alias("text")).join(F.broadcast(limits), "lang").filter("order <= most")
    found: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for r in taken.select("lang", "order", "text").distinct().collect():
        found[r["lang"]].append((r["order"], r["text"]))
    return [(text, lang) for lang in sorted(found) for _, text in sorted(found[lang])[:rows]]


def identify(docs: DataFrame, rows: int = 3000, chars: int = 1500, hidden: int = 16, steps: int = 700) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; the network learns from ``sample(docs, rows, chars)``."""
    net = train(sample(docs, rows, chars), hidden, steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            langs, scores = predict(net, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
