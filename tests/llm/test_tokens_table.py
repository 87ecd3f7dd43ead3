"""The encoder's table of words: each is encoded once, whatever its length, the marks after it and the numbers that it meets."""

import itertools
import string

import numpy as np
import pytest
from tokenizers import Tokenizer

from lakequill.llm import tokens

PATH = tokens.default_tokenizer()


def exact(texts):
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    return [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_800000_words_are_encoded_once():
    encode = tokens.Encoder(PATH)
    words = ["".join(w) for w in itertools.islice(itertools.product(string.ascii_lowercase, repeat=5), 800_000)]
    texts = [("so " + " ".join(words[i : i + 1000])).encode() for i in range(0, len(words), 1000)]
    made = [x.tolist() for i in range(0, 800, 200) for x in encode(texts[i : i + 200])]
    assert made[::100] == exact([t.decode() for t in texts[::100]])

    class Unused:
        def encode_batch_fast(self, texts, **_):
            assert not texts
            return []

    encode.tokenizer = Unused()
    assert [x.tolist() for i in range(0, 800, 200) for x in encode(texts[i : i + 200])] == made


@pytest.mark.parametrize("most", [10, 1_500_000])
def test_words_of_all_lengths_and_runs_of_marks(most):
    words = [c * n + m * k + "\xa0" * (n == 7 and k == 3) for c in ("a", "é", "漢", "1") for n in range(1, 30) for m, k in (("#", 0), ("#", 3), (")", 8), ("!", 9), ("…", 2))]
    texts = [s.join((a, b, a)) for s in (" ", "\n") for a, b in itertools.pairwise(words)] + words
    got = tokens.Encoder(PATH, most)([t.encode() for t in texts])
    assert [x.tolist() for x in got] == exact(texts)


def test_words_whose_numbers_meet_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens._Table, "hashes", lambda self, keys: keys[:, 0] & np.uint64(1) << np.uint64(63))
    texts = [f"{a}x{b} {b}y{a}{a}, {a}longer{b}\nline{a}" for a in "abcdé" for b in "fghi"]
    assert [x.tolist() for x in tokens.Encoder(PATH, 20).batches([t.encode() for t in texts], 60)] == exact(texts)


def test_bytes_that_are_no_utf8_are_replaced_as_in_whole_texts():
    texts = [b"caf\xe9 bar\xff, so", b"caf\xe9  bar\xff, so", b"\xe9 \xe9\n\xe9"]
    assert [x.tolist() for x in tokens.Encoder(PATH)(texts)] == exact([t.decode("utf-8", "replace") for t in texts])
