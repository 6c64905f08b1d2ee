"""Token counts by rank-synchronous array merging.

A text is cut into pre-tokens by the vocabulary's own normalizer and pre-tokenizer; the distinct pre-tokens of a batch
are laid out as one ragged array of symbols, and in every round each sequence applies its own lowest-rank pair, all
sequences at once, until none has a pair left. The symbols that survive are its tokens. Counts of white-space-free
chunks are kept per worker, since chunks repeat and no token crosses white space. Chunks of ASCII letters, digits and
marks, which any normalizer of this kind only puts in lower case, are cut by a pattern; vocabularies of another kind are
refused.

Defined cases: a null or empty text has 0 tokens and 0 bytes; every row gives one row, repeated rows and null or
repeated ids included; texts of any length are counted whole; other columns, whatever their names, are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

# Fixed values of the vocabulary file: its normalizer, and its pre-tokenizer's contractions, letter runs, single digits
# and runs of the rest.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-case ASCII.
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
#: str.split() also cuts at these, which are not white space to the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: White space of the tokenizer (the Unicode property), for texts with separators.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
NO_RANK = np.int64(2**62)
#: Chunks that a worker keeps at most: those that it met first, the frequent ones among them. Rarer ones are kept for
#: their batch alone.
CACHE_ENTRIES = 250_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    spare = iter(range(256, 512))
    return [shown[b] if b in shown else chr(next(spare)) for b in range(256)]


def check_vocabulary(spec: dict, path: str) -> None:
    """Refuse vocabularies whose texts may not be cut at white space and read in lower case."""
    normalizers = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    splits = [p["pattern"].get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
    if normalizers != NORMALIZERS or splits != [SPLIT] or spec["model"]["type"] != "BPE":
        raise ValueError(f"{path} is not a lower-case byte-level BPE vocabulary with word ends")


class MergeTable:
    """Pair ranks of a byte-level BPE vocabulary with word ends, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_vocabulary(spec, path)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        shown = byte_characters()
        self.inner = np.array([vocab[c] for c in shown], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in shown], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.size = max(vocab.values()) + 1
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        # A rank may be applied everywhere in a sequence at once if no pair with the symbol that it makes comes earlier.
        first_use = np.full(self.size, NO_RANK)
        np.minimum.at(first_use, left, np.arange(len(pairs)))
        np.minimum.at(first_use, right, np.arange(len(pairs)))
        self.at_once = first_use[made] > np.arange(len(pairs))
        self.special = [t["content"] for t in spec["added_tokens"]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The surviving symbols of each non-empty word."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.final[raw[ends - 1]]
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        names = np.arange(len(words))
        while len(names):
            starts = np.cumsum(lengths) - lengths
            last = starts + lengths - 1
            row = np.repeat(np.arange(len(names)), lengths)
            rank = np.full(len(symbols), NO_RANK)
            if len(symbols) > 1:
                rank[:-1] = self.rank(symbols[:-1], symbols[1:])
            rank[last] = NO_RANK
            least = np.minimum.reduceat(rank, starts)
            done = least == NO_RANK
            if done.any():
                for i in np.flatnonzero(done):
                    out[names[i]] = symbols[starts[i] : starts[i] + lengths[i]].copy()
                keep = ~done[row]
                symbols, rank = symbols[keep], rank[keep]
                names, lengths, least = names[~done], lengths[~done], least[~done]
                if not len(names):
                    break
                row = np.repeat(np.arange(len(names)), lengths)
            at = np.flatnonzero(rank == least[row])
            of = row[at]
            first = np.concatenate(([True], of[1:] != of[:-1]))
            at = at[first | self.at_once[least[of]]]
            # Where hits touch, as in "aaa", every second one of the run is taken, from the left.
            begins = np.concatenate(([True], np.diff(at) != 1))
            run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.made[least[row[at]]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols = symbols[keep]
            lengths = lengths - np.bincount(row[at], minlength=len(names))
        return out


class TokenCounter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.table = MergeTable(path)
        of = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = of.normalizer, of.pre_tokenizer
        self.special = re.compile("(" + "|".join(map(re.escape, self.table.special)) + ")")
        self.byte = {c: b for b, c in enumerate(byte_characters())}
        self.counts: dict[str, int] = {}

    def chunks(self, text: str) -> list[str]:
        return [x for x in SPACE.split(text) if x] if SEPARATORS.search(text) else text.split()

    def words(self, part: str) -> list[bytes]:
        """The pre-tokens of a text without special tokens."""
        if part.isascii():
            return [w.encode() for w in ASCII_SPLIT.findall(part.lower())]
        shown = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))
        return [bytes(map(self.byte.__getitem__, w)) for w, _ in shown]

    def pre_tokens(self, chunk: str) -> tuple[list[bytes], int]:
        """The pre-tokens of a chunk, and how many special tokens it holds."""
        words: list[bytes] = []
        special = 0
        for i, part in enumerate(self.special.split(chunk) if "<|" in chunk else [chunk]):
            if i % 2:
                special += 1
            elif part:
                words += self.words(part)
        return words, special

    def learn(self, chunks: list[str]) -> None:
        cut = [self.pre_tokens(c) for c in chunks]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in cut for w in words))}
        sizes = [len(x) for x in self.table.merge(list(distinct))] if distinct else []
        for chunk, (words, special) in zip(chunks, cut, strict=True):
            self.counts[chunk] = special + sum(sizes[distinct[w]] for w in words)

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.chunks(t) for t in texts]
        if new := list(set().union(*cut) - self.counts.keys()):
            self.learn(new)
        known = self.counts.__getitem__
        found = [sum(map(known, chunks)) for chunks in cut]
        for c in new[max(0, CACHE_ENTRIES - len(self.counts) + len(new)) :]:
            del self.counts[c]
        return found


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``tokenizer`` is the path of a byte-level BPE vocabulary with word ends, present on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(tokenizer)
        for b in blocks(batches, "text"):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = of.count(texts)
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
