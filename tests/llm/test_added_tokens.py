"""Texts that hold added tokens get the ids that a fresh tokenizer gives."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shiori.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "one <|endoftext|> two", "<|endoftext|>", "a  <|endoftext|>\n\u00e9 <|endoftext|", "<|endoftext|"])
def test_ids_equal_a_fresh_tokenizer(text):
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert list(memoryview(packing.WordIds(PATH).text(text)).cast("I")) == ids
    assert (50256 in ids) == ("<|endoftext|>" in text)
