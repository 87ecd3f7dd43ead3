import pytest
from tokenizers import Tokenizer

from lakequill.llm import tokens


@pytest.mark.parametrize("text", ["foo \x00bar", "\x00foo bar", "a\x00 b", "foo \x00", "one\n\x00two \x00\x00three", "foo \x00bar!", "plain foo bar"])
def test_texts_with_nul_are_encoded_as_they_are(text):
    path = tokens.default_tokenizer()
    got = tokens.Encoder(path)([b"foo bar bar!", text.encode()])[1]
    assert got.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
