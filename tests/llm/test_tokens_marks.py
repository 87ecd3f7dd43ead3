"""The encoder's cuts at blanks and marks against the tokenizers library on whole texts."""

import random

from tokenizers import Tokenizer

from lakequill.llm import tokens

SIGNS = ["a", "b", "é", "1", "²", "'s", ",", ".", "!", "?", ";", ":", ")", "(", "-", "…", " ", " ", " ", "\n", "\r", "\t", "\xa0", "　", "漢", "́", "😀", "<|endoftext|>", "\0", "\x1c", "_", "word", "Other."]


def test_texts_of_marks_and_blanks():
    path = tokens.default_tokenizer()
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    r = random.Random(12)
    texts = ["".join(r.choice(SIGNS) for _ in range(r.randrange(14))) for _ in range(20_000)]
    texts += [" ".join(r.choice(("so", "it", "is", "said,", "then.", "x1,", "on)", "say),", "\"no.\"", "3.5,")) for _ in range(400)) + r.choice(("", " ", ".", "\n", ", ")) for _ in range(50)]
    for most in (695_000, 200):
        got = list(tokens.Encoder(path, most).batches([t.encode() for t in texts], 50_000))
        assert [x.tolist() for x in got] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
