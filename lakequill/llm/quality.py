"""Quality rules: base statistics and compression bands.

Zstandard is the judge of repetition: text that shrinks much more than prose of its length does is repetitive or
templated, text that hardly shrinks is noise. How much prose shrinks depends on its length, so the limits do too. They
hold for the whole document and, with one pair of limits, for its fixed chunks, of which more than half must not be
outside; a long document is thus rejected for what most of it is like, not for one odd passage.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import common

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_TAILS = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio of bytes to compressed bytes.

    ``limits``: (binary logarithm of the bytes, least, most), between which limits are interpolated. They come from
    the ratios of documents labelled good: most is just above nearly all of them, least well below all. Beyond 93 KB
    the upper limit rises by 0.16 with each doubling, above the ratios of good documents of a language joined to texts
    of up to 5 MB. What remains after the last whole chunk is judged by the limits of its own length, from ``tail`` on.
    """

    level: int = 3
    chunk: int = 2048
    tail: int = 256
    chunk_least: float = 1.5
    chunk_most: float = 2.14
    limits: tuple[tuple[float, float, float], ...] = field(
        default=(
            (8.0, 1.10, 1.93), (8.5, 1.20, 1.93), (9.0, 1.28, 1.95), (9.5, 1.35, 2.01), (10.0, 1.42, 2.07), (10.5, 1.50, 2.13),
            (11.0, 1.58, 2.19), (11.5, 1.64, 2.24), (12.0, 1.70, 2.30), (12.5, 1.76, 2.35), (13.0, 1.82, 2.41), (13.5, 1.86, 2.44),
            (14.0, 1.90, 2.47), (14.5, 1.93, 2.51), (15.0, 1.96, 2.55), (15.5, 1.98, 2.57), (16.5, 2.00, 2.61), (24.5, 2.00, 3.89),
        )
    )


def base(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text; null has none of them."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    chars = len(text.translate(None, _TAILS + _SPACE))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = text.split(b"\n")
    dup_lines = 0
    if len(set(lines)) < len(lines):
        dup_lines = sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.split())
    repeat = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(windows) > len(seen := set(windows)):
        del seen
        twice = {w for w, n in Counter(windows).items() if n > 1}
        end = 0
        for i, w in enumerate(windows):
            if w in twice:
                repeat += i + 3 - max(end, i)
                end = i + 3
    return len(words), chars, symbols, dup_lines, repeat


class Judge:
    """The method's verdict on a text."""

    def __init__(self, bands: Bands = Bands()) -> None:
        self.bands, self.zstd = bands, zstandard.ZstdCompressor(level=bands.level)
        self.at, self.least, self.most = (np.array(x) for x in zip(*bands.limits, strict=True))

    def ratio(self, part: bytes | memoryview) -> float:
        return len(part) / len(self.zstd.compress(part)) if len(part) else 0.0

    def fits(self, size: int, ratio: float) -> bool:
        """Whether a ratio is within the limits of a length."""
        at = np.log2(size)
        return bool(np.interp(at, self.at, self.least) <= ratio <= np.interp(at, self.at, self.most))

    def __call__(self, text: bytes | None) -> tuple[bool, float, int, int]:
        """Whether the text is within its bands, its ratio, and how many of its chunks are outside, of how many."""
        if not text:
            return False, 0.0, 0, 0
        b, whole = self.bands, self.ratio(text)
        fits = self.fits(len(text), whole)
        view = memoryview(text)
        ratios = [self.ratio(view[i : i + b.chunk]) for i in range(0, len(text) - b.chunk + 1, b.chunk)]
        inside = [b.chunk_least <= r <= b.chunk_most for r in ratios]
        rest = view[len(ratios) * b.chunk :]
        if ratios and len(rest) >= b.tail:
            inside.append(self.fits(len(rest), self.ratio(rest)))
        outside = inside.count(False)
        return fits and 2 * outside <= len(inside), whole, outside, len(inside)


def judged(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """For every row of docs(doc_id, text), its base statistics and verdict; other columns are not looked at.

    A null or empty text has no words, so it fails the base rules and is not kept. Ties, repeated rows and null ids
    need no care: each row is judged by its own text alone.
    """

    def each(batch: pa.RecordBatch):
        judge = Judge(bands)
        rows = []
        for text in common.raw(batch.column(1)):
            stats = base(text)
            failed = stats[0] < 50 or 100 * stats[4] > 50 * stats[0]
            fits, whole, outside, chunks = judge(text)
            rows.append((*stats, failed, fits and not failed, whole, outside, chunks))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunks_outside", "n_chunks")
        yield {"doc_id": batch.column(0)} | {n: pa.array(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)}

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks_outside long, n_chunks long"
    return common.mapped(docs.selectExpr("cast(doc_id as long) doc_id", "text"), each, schema)


def passing(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs that are kept, all their columns as they are, whatever their names.

    Null and empty texts go. Rows that repeat are judged alike; an empty table stays empty.
    """
    at = docs.columns.index("text")

    def run(it):
        judge = Judge(bands)
        for batch in common.batches(it):
            keep = []
            for text in common.raw(batch.column(at)):
                stats = base(text)
                keep.append(not (stats[0] < 50 or 100 * stats[4] > 50 * stats[0]) and judge(text)[0])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(common.trimmed(run), docs.schema)
