"""The transducer against the tokenizers library, and the decoders."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = bpe.load(PATH)
ENCODER = bpe.Encoder(SPEC)
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def own(text):
    return np.frombuffer(ENCODER.encode(text), "<u4").tolist()


TEXTS = [
    "", " ", "The cat's on the mat, isn't it?  I'll\tgo\n\n", "ΟΔΥΣΣΕΥΣ Σ ΑΣ.", "İstanbul ſtraße ǅ", "é ñ Å ẛ̣",
    "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext|", "数学は難しい 한국어", "½ ² Ⅷ ٣ ४", "a\x1cb\x1d c\x85d e　f\x00g",
    "don't've 's 're'd", "_under_score_ #$%^&*", "😀😀👩‍👩‍👧", "﻿x​y­z",
]


@pytest.mark.parametrize("text", TEXTS)
def test_fixed_texts(text):
    assert own(text) == library(text)


@given(st.text(max_size=80))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    assert own(text) == library(text)


def test_long_words_come_out_in_parts():
    draw = random.Random(3)
    alphabet = [t.removesuffix("</w>") for t in list(SPEC["tokens"].values())[600:20000] if t.removesuffix("</w>").isascii() and t.removesuffix("</w>").isalpha()]
    for _ in range(20):
        word = "".join(draw.choice(alphabet) for _ in range(1500)).lower()
        assert own(word) == library(word)
        parts = list(ENCODER.stream(word.encode()))
        assert len(parts) > 1 and sum(parts[:-1], []) != []
    for word in ("a" * 5000, "!" * 3000, "ha" * 2000, "=-" * 1500):
        assert own(word) == library(word)


def test_held_symbols_stay_bounded():
    word = bpe.Transducer(ENCODER.merge, ENCODER.lengths, SPEC["lookahead"])
    longest = max(ENCODER.lengths.values())
    for _ in range(200):
        word.feed([SPEC["inside"][b] for b in b"internationalization"])
        assert len(word.held) <= SPEC["lookahead"] + longest + 1


def test_lookahead_of_a_small_list():
    # ab, then bc can take the b away from it only if it has the lower rank.
    assert bpe.sufficient_lookahead([(1, 2, 10), (0, 1, 11)]) == 2
    assert bpe.sufficient_lookahead([(0, 1, 11), (1, 2, 10)]) == 1


def test_decoding_by_parts():
    text = "Grüße aus 東京 😀 isn't"
    ids = own(text)
    for as_bytes in (False, True):
        whole = bpe.Decoder(SPEC, as_bytes)
        expected = whole.feed(ids) + whole.finish()
        machine = bpe.Decoder(SPEC, as_bytes)
        assert "".join(machine.feed([i]) for i in ids) + machine.finish() == expected
    assert bpe.Decoder(SPEC).feed(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    assert expected == "grüße aus 東京 😀 isn 't "


def test_rows(spark):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (None, ""), (3, "x" * 300000)]
    frame = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_tokens int")
    out = sorted(map(tuple, bpe.tokenized(frame, PATH).collect()), key=str)
    expected = []
    for i, t in rows:
        ids = library(t or "")
        packed = np.array(ids, "<u4").tobytes()
        decoded = LIBRARY.decode(ids, skip_special_tokens=False) if ids else ""
        expected.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert out == sorted(expected, key=str)
    assert bpe.tokenized(frame.limit(0), PATH, with_ids=True).collect() == []
