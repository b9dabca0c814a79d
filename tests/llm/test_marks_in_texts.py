"""Characters of a text are never taken for marks of the encoder."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomkb.llm.tokens import Encoder


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("plain", [False, True])
def test_nul_after_a_space_is_text(name, plain):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = plain
    encode = Encoder(name, plain_specials=plain)
    for text in ("a \0b", "\0b", "b \0", " \0b \0\0 b", "\0", " \0"):
        assert np.frombuffer(next(encode([text])), encode.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("plain", [False, True])
def test_strings_of_special_tokens(name, plain):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = plain
    encode = Encoder(name, plain_specials=plain)
    for text in ("x <|startoftext|> y", "<|endoftext|>", "a  <|endoftext|>  b", "A<|EndOfText|>B <|endoftext|", "\u00e9<|endoftext|>\u00e9"):
        assert np.frombuffer(next(encode([text])), encode.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids
