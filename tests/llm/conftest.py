import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r: random.Random, words: int, bank: int = 400) -> str:
    """Invented prose: words from a bank, with sentences and lines."""
    out = []
    for i in range(words):
        k = int(bank * r.random() ** 2)
        w = "".join("bcdfglmnprst"[(k * 7 + j * 5) % 12] + "aeiou"[(k // (j + 1)) % 5] for j in range(1 + k % 3 + 1)) + ("n" if k % 2 else "")
        out.append(w + ("." if i % 11 == 10 else "") + ("\n" if i % 47 == 46 else ""))
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def texts():
    """Texts of all kinds: prose, copies, near copies, repetition, noise, blanks, one word, very long, null."""
    r = random.Random(5)
    base = [prose(r, n) for n in (60, 80, 120, 200, 300, 500, 90, 150)]
    near = []
    for t in base[:5]:
        w = t.split(" ")
        for at in (len(w) // 2, len(w) // 3):
            near.append(" ".join([*w[:at], "edited", *w[at + 1 :]]))
    return [
        *base, *near, base[0], base[0], base[3].upper(), "", " \n\t ", "one", "one two", "two words", None, None, "x " * 300, "same line\n" * 80,
        "".join(chr(33 + r.randrange(90)) for _ in range(3000)), prose(r, 9000, 2000), "ünï cödé wörds " * 30, "a b c d", "tab\tand  two  blanks\r\nend ",
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 9 == 8 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
