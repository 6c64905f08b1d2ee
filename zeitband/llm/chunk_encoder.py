"""Token ids from the tokenizers library, as little-endian unsigned 32-bit integers.

The library encodes each distinct word of the white-space-free chunks of a batch once; no token crosses white space in
the vocabularies used here, so the ids of a text are those of its chunks in a row. Arrow cuts the texts and numbers
their distinct chunks, and numpy puts the ids of the chunks in a row. The vocabulary reads lower case, so chunks are
looked up in lower case where that cannot change the ids. A worker keeps the ids of the words that it met first, up to
a bound; frequent words are among them, and rarer ones are kept for their batch alone.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .token_counts import SEPARATORS, check_vocabulary

#: Words without their marks that a worker keeps at most.
WORD_ENTRIES = 600_000
MARKS = ".,;:!?*#$%&|"
#: Longer chunks are not kept.
KEPT_CHARS = 200
#: Chunks whose ids are put in a row at once.
GATHERED = 500_000
#: Bytes that are letters or digits of ASCII.
ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])


def lowered(text: str) -> str:
    """The text in lower case, unless that could turn a string into a special token, choose a final sigma or meet
    text that is not composed, before or after."""
    if "<|" in text or "\u03a3" in text or not unicodedata.is_normalized("NFC", text):
        return text
    low = text.lower()
    return low if unicodedata.is_normalized("NFC", low) else text


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            check_vocabulary(json.load(f), path)
        self.of = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}

    def direct(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.of.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, chunk: str) -> tuple[str, str]:
        """A chunk as its word and the marks that end it, which are pre-tokens of their own; or as it is."""
        word = chunk.rstrip(MARKS)
        if len(word) == len(chunk) or not word or "<|" in chunk:
            return chunk, ""
        if not (word[-1].isascii() or unicodedata.is_normalized("NFC", word[-1])) or not word[-1].lower()[-1].isalnum():
            return chunk, ""
        return word, chunk[len(word) :]

    def learn(self, words: set[str]) -> list[str]:
        """Add the ids of words, and return those that were new."""
        fresh = list(words - self.words.keys())
        for i in range(0, len(fresh), 10_000):
            self.words.update(zip(fresh[i : i + 10_000], self.direct(fresh[i : i + 10_000]), strict=True))
        return fresh

    def ids_of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks in a row, and how many each has, from their words' ids."""
        bare = pc.ascii_rtrim(chunks, characters=MARKS)
        ends = np.frombuffer(bare.buffers()[1], np.int64)[bare.offset :][: len(bare) + 1]
        letters = np.frombuffer(bare.buffers()[2] or b"", np.uint8)
        full, cut = np.diff(ends), pc.binary_length(chunks).to_numpy(zero_copy_only=False)
        marked = full < cut
        plain = marked & (full > 0) & ~pc.match_substring(chunks, "<|").to_numpy(zero_copy_only=False)
        plain[plain] = ALNUM[letters[ends[1:][plain] - 1]]
        words, marks = chunks.to_numpy(zero_copy_only=False).tolist(), {}
        for i, word in zip(np.flatnonzero(plain).tolist(), bare.filter(pa.array(plain)).to_numpy(zero_copy_only=False).tolist(), strict=True):
            marks[i], words[i] = words[i][len(word) :], word
        for i in np.flatnonzero(marked & ~plain).tolist():
            words[i], marks[i] = self.parts(words[i])
        fresh = self.learn({*words, *marks.values()})
        ids = list(map(self.words.__getitem__, words))
        for i, mark in marks.items():
            ids[i] += self.words[mark]
        forget(self.words, fresh, WORD_ENTRIES)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return np.frombuffer(b"".join(ids), "<u4"), sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        cut = pc.utf8_split_whitespace(pa.array(["" if SEPARATORS.search(t) else lowered(t) for t in texts], pa.large_string()))
        # Spaces at either end of a text leave empty strings there.
        coded = pc.dictionary_encode(cut.values)
        places, ends = coded.indices.to_numpy(zero_copy_only=False), cut.offsets.to_numpy()
        values, sizes = self.ids_of(coded.dictionary)
        starts = np.cumsum(sizes) - sizes
        own = sizes[places]
        ends = np.concatenate(([0], np.cumsum(own)))[ends]
        made = np.empty(len(places) and ends[-1], "<u4")
        at = 0
        for i in range(0, len(places), GATHERED):
            some, n = places[i : i + GATHERED], own[i : i + GATHERED]
            m = int(n.sum())
            made[at : at + m] = values[np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(m)]
            at += m
        raw, ends = memoryview(made).cast("B"), (4 * ends).tolist()
        return [bytes(raw[a:b]) if b > a else self.direct([t])[0] for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True)]


def forget(known: dict[str, bytes], new: list[str], most: int) -> None:
    """Drop new entries: the long ones, and those beyond the bound."""
    room = max(0, most - len(known) + len(new))
    for i, x in enumerate(new):
        if i >= room or len(x) > KEPT_CHARS:
            del known[x]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)
