"""Ids and decoded texts against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flockmetrics.llm.bpe import Bpe, with_codes

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "  ", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|>", "Don't we'll I'VE 're ''s", "aaaaaaaaaaa aaaa aa", "ÀÉ é ΑΣ ΟΔΟΣ İstanbul ß",
    "日本語 テスト 123 ４５", "a\x1cb\x1d c\x85d​e　f g", "😀👍🏽 <|x|>", "\x00\x01 ﻿", "'S'LL", "x" * 3000, "!!??..--''", "é ͅ", "ǅ ﬁ Ⅷ ² ½",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()

    def encode(text):
        ids = t.encode(text, add_special_tokens=False).ids
        return len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False)

    return encode


def random_texts(n):
    rnd = random.Random(2)
    pieces = ["the", "ing", "Straße", " ", "  ", "\n", "'s", "'LL", "!!", "99", "é", "日", "😀", "x", "zz", "<|endoftext|>", "Σ", "ﬁ"]
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("table", [250_000, 5])
def test_same_as_library(library, table):
    bpe = Bpe(PATH, table)
    texts = ODD + random_texts(300)
    assert bpe.encode(texts) == [library(t) for t in texts]
    assert [bpe.encode([t])[0] for t in texts] == [library(t) for t in texts]


def test_round_trip_of_ids(library):
    bpe = Bpe(PATH)
    n, ids, decoded = bpe.encode(["Back and forth, twice."])[0]
    assert bpe.decode(map(int, ids.split())) == decoded and n == len(ids.split())


def test_rows(spark, awkward, nothing, library):
    rows = with_codes(awkward, PATH, "codes").collect()
    assert len(rows) == awkward.count()
    assert all(tuple(r.codes) == library(r.text or "") for r in rows)
    assert with_codes(nothing, PATH, "codes").collect() == []
