"""Strings of added tokens in a text, against a fresh tokenizer."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lapsegrid.llm.common import tokenizer_path
from lapsegrid.llm.tokens import coder


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_in_a_text_have_their_own_ids(name):
    fresh, draw = Tokenizer.from_file(tokenizer_path(name)), random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "endoftext", " ", "\n", "hello", " world", "é", ".", "12"]
    texts = ["hello <|endoftext|> world", None, "", *("".join(draw.choices(parts, k=draw.randint(1, 9))) for _ in range(1500))]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder(name).encode(texts)] == [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
