import time

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from zeitband.llm.chunk_encoder import encoder
from zeitband.llm.secrets import all_spans


def test_long_bare_words_take_linear_time():
    start = time.perf_counter()
    assert all_spans("pwd=xxxx" * 50_000) == []
    assert len(all_spans("api_key='Ab3dEf6hIj9k'\n" * 5_000)) == 5_000
    assert time.perf_counter() - start < 30


def test_bare_words_inside_others():
    text = "url=http://host/?pwd=Ab3dEf6hIj9k"
    assert [text[s:e] for s, e, kind, _ in all_spans(text) if kind == "named"] == ["Ab3dEf6hIj9k"]


def test_letters_that_compose_in_lower_case_only():
    path = public_tokenizers.path("word_bpe_49k.json")
    for text in ("H̱ello", "İstanbul", "W̊ J̌"):
        ids = np.frombuffer(encoder(path).encode([text])[0], "<u4").tolist()
        assert ids == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_plain_words_are_cut_without_python():
    import random

    from zeitband.llm.chunk_encoder import ChunkEncoder

    of = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    looked, parts = [], of.parts
    of.parts = lambda chunk: looked.append(chunk) or parts(chunk)
    texts = [" ".join(f"word{i}{m}" for i in range(500) for m in ("", ",", "...", "!?"))]
    assert of.encode(texts) == of.direct(texts) and looked == []
    random.seed(3)
    bits = ["a", "Z", "é", "é", "Σ", "İ", "ß", " ", "\n", "\x1c", "\x85", "\xa0", "　", ".", ",", "...", "'s", "7", "<|", "<|endoftext|>", "|>", "日本", "😀", "</w>", "\0"]
    odd = ["", "  ", " a", "a "] + ["".join(random.choices(bits, k=12)) for _ in range(2000)]
    assert of.encode(odd) == of.direct(odd) and of.encode([]) == []
