"""Language-model scoring by context-tree weighting.

A text is its words in lower case, joined by blanks and ended by a line feed, as bytes. The next byte is decomposed into
eight binary decisions; each decision in each context of 0 to 5 preceding bytes has a Krichevsky-Trofimov estimator, and
the estimators of all depths are mixed by their evidence, as context-tree weighting (Willems et al., 1995) does: a
node's weighted probability is half its own estimate and half the product of its children's. Over a whole corpus only
counts matter, so they are summed by Spark, the tree is weighted bottom up once, and texts are scored with the tree as
it then stands.

The tree is a table of (context, byte) entries, dealt by the three nearest bytes; nothing in it is merged or left out.
Entries that only texts to score have are in it with a count of 0, which changes no other entry. Contexts of five to
three bytes are weighted where the entries were dealt, those of two after one more exchange, and those of one byte and
none, of which there are 65,536 entries at most whatever the corpus, on the driver. Mixed probabilities then go down the
same way. Texts are scored in blocks: the distinct entries of a block are joined with the table and meet its texts again.
`Tree` is the same tree in one place, for small corpora.

The base score is a unigram model over words with counts from the whole training folds. Counts of the most frequent
words, of a bounded number, are broadcast; all other words of a text are joined with the table of counts.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH = 5
#: Most words whose counts are broadcast.
FREQUENT = 1 << 18
#: About the bytes of a block of texts, and entries that a task weighs together at least, if it has as many.
BLOCK = 1 << 25
TOGETHER = 1 << 18
#: Levels at which entries are dealt by their contexts.
_DEALT, _NEAR = 3, 2
OTHER = 256
_SYMBOL = 9
_END = b"\n"
_PAD = _END * DEPTH
_M = np.uint64(0x9E3779B97F4A7C15)


def normal(text: bytes | None) -> tuple[list[bytes], bytes]:
    words = common.split(text)
    return words, b" ".join(words) + _END


def events(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bytes of the streams, and where each stream's begin.

    A key is the preceding bytes, the nearest first, 9 bits each, and the byte. Before a stream come line feeds.
    """
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    b = np.frombuffer(_PAD + _PAD.join(streams), dtype=np.uint8).astype(np.int64)
    key = b[DEPTH:].copy()
    for d in range(1, DEPTH + 1):
        key |= b[DEPTH - d : len(b) - d] << (8 + _SYMBOL * (DEPTH - d))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    if len(streams) > 1:
        keep = np.ones(len(key), dtype=bool)
        for i in range(DEPTH):
            keep[starts[1:] + DEPTH * np.arange(len(starts) - 1) + i] = False
        key = key[keep]
    return key, starts


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _contexts(it):
    """Counts of keys, one row for each in a task."""
    held, rows, buffered, streams = [], 0, 0, []

    def flush():
        nonlocal held, rows, buffered, streams
        if streams:
            k, n = np.unique(events(streams)[0], return_counts=True)
            held.append((k, n))
            rows += len(k)
            buffered, streams = 0, []
        if rows > 4_000_000:
            held = [_summed(held)]
            rows = len(held[0][0])

    for batch in common.batches(it):
        for text in common.raw(batch.column(0)):
            streams.append(normal(text)[1])
            buffered += len(streams[-1])
            if buffered > 2_000_000:
                flush()
    flush()
    if held:
        keys, n = _summed(held)
        for i in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 17)]), pa.array(n[i : i + (1 << 17)])], names=["key", "n"])


def _block_contexts(it):
    """Counts of keys by block of texts, in training texts; keys that only other texts have count 0."""
    block, held, rows, buffered = None, [], 0, 0
    streams: tuple[list[bytes], list[bytes]] = ([], [])

    def flush():
        nonlocal held, rows, buffered
        for some, counted in zip(streams, (1, 0), strict=True):
            if some:
                k, n = np.unique(events(some)[0], return_counts=True)
                held.append((k, n * counted))
                rows += len(k)
                some.clear()
        buffered = 0
        if rows > 1_500_000:
            held = [_summed(held)]
            rows = len(held[0][0])

    def out():
        nonlocal held, rows
        flush()
        if held:
            keys, n = _summed(held)
            for i in range(0, len(keys), 1 << 17):
                k = keys[i : i + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block, np.int64)), pa.array(k), pa.array(n[i : i + (1 << 17)])], names=["block", "key", "n"])
        held, rows = [], 0

    for batch in common.batches(it):
        for b, test, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.raw(batch.column(2)), strict=True):
            if b != block:
                yield from out()
                block = b
            stream = normal(text)[1]
            streams[test].append(stream)
            buffered += len(stream)
            if buffered > 1_000_000:
                flush()
    yield from out()


def _words(it):
    """Counts of words, about one row for each in a task, and of texts as the word null."""
    seen: Counter = Counter()
    texts = 0

    def out():
        some = list(seen.items())
        for i in range(0, len(some), 1 << 16):
            part = some[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])
        seen.clear()

    for batch in common.batches(it):
        for text in common.raw(batch.column(0)):
            texts += 1
            seen.update(common.split(text))
        if len(seen) > 800_000:
            yield from out()
    yield from out()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([texts], pa.int64())], names=["word", "n"])


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1/2) of whole n."""
    return _log_gamma(n + 0.5)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 6, brought down to x."""
    low = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4) * (x + 5))
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - low


def _estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones in any order."""
    return _log_gamma_half(n0) + _log_gamma_half(n1) - _log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class Tree:
    """The weighted tree. Level d has the counts of (d nearest bytes, byte), sorted, as keys and running sums."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys: list[np.ndarray] = [np.zeros(0, np.int64)] * (DEPTH + 1)
        self.runs: list[np.ndarray] = [np.zeros(1, np.int64)] * (DEPTH + 1)
        self.shares: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        keys, counts = keys[order].astype(np.int64), counts[order].astype(np.int64)
        maps: list[np.ndarray] = [np.zeros(0, np.int64)] * (DEPTH + 1)
        levels: list[np.ndarray] = [counts] * (DEPTH + 1)
        self.keys[DEPTH] = keys
        for d in range(DEPTH - 1, -1, -1):
            deeper = self.keys[d + 1]
            short = ((deeper >> (8 + _SYMBOL)) << 8) | (deeper & 255)
            self.keys[d], maps[d + 1] = np.unique(short, return_inverse=True)
            levels[d] = np.bincount(maps[d + 1], weights=levels[d + 1], minlength=len(self.keys[d])).astype(np.int64)
        for d in range(DEPTH + 1):
            self.runs[d] = np.concatenate([[0], np.cumsum(levels[d])])
        self.log10 = np.zeros(len(keys), dtype=np.float64)
        if len(keys):
            for bit in range(8):
                self._weigh(bit, levels, maps)
        else:
            self.shares = [[np.zeros(0, np.float32)] * 8 for _ in range(DEPTH)]
        self.log10 = self.log10.astype(np.float32)

    def _weigh(self, bit: int, levels: list[np.ndarray], maps: list[np.ndarray]) -> None:
        node, sides, first, own = [], [], [], []
        for d in range(DEPTH + 1):
            code = self.keys[d] >> (8 - bit)
            begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            at = np.cumsum(np.bincount(begins, minlength=len(code))) - 1
            one = (self.keys[d] >> (7 - bit)) & 1
            n1 = np.bincount(at, weights=levels[d] * one, minlength=len(begins))
            n0 = np.bincount(at, weights=levels[d], minlength=len(begins)) - n1
            node.append(at)
            first.append(begins)
            own.append(_estimate(n0, n1))
            sides.append((np.where(one == 1, n1[at], n0[at]) + 0.5) / ((n0 + n1)[at] + 1))
        weighted = own[DEPTH]
        share: list[np.ndarray] = [np.zeros(0)] * DEPTH
        for d in range(DEPTH - 1, -1, -1):
            parents = node[d][maps[d + 1][first[d + 1]]]
            product = np.bincount(parents, weights=weighted, minlength=len(own[d]))
            share[d] = 1 / (1 + np.exp(np.clip(product - own[d], -700, 700)))
            weighted = np.logaddexp(own[d], product) - math.log(2)
        p, up = sides[DEPTH], np.arange(len(self.keys[DEPTH]))
        for d in range(DEPTH - 1, -1, -1):
            up = maps[d + 1][up]
            mixed = share[d][node[d]]
            p = mixed[up] * sides[d][up] + (1 - mixed[up]) * p
        self.log10 += np.log10(p)
        for d in range(DEPTH):
            self.shares[d].append(share[d][node[d]].astype(np.float32))

    def predict(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the mixed probabilities of keys, from the nodes; contexts not held are their parent's "other"."""
        keys = keys.copy()
        for d in range(DEPTH, 0, -1):
            low = _SYMBOL * (DEPTH - d)
            context = keys >> 8
            cut = self.keys[DEPTH] >> (8 + low)
            at = np.searchsorted(cut, context >> low)
            held = (at < len(cut)) & (cut[np.minimum(at, len(cut) - 1)] == context >> low) if len(cut) else np.zeros(len(keys), dtype=bool)
            clear = (1 << _SYMBOL) - 1
            keys = np.where(held, keys, (keys & ~(clear << (8 + low))) | (OTHER << (8 + low)))
        out = np.zeros(len(keys))
        for bit in range(8):
            p = np.full(len(keys), 0.5)
            for d in range(DEPTH, -1, -1):
                joint = ((keys >> (8 + _SYMBOL * (DEPTH - d))) << 8) | (keys & 255)
                code = joint >> (8 - bit)
                low, mid, high = (np.searchsorted(self.keys[d], c) for c in (code << (8 - bit), ((code << 1) | 1) << (7 - bit), (code + 1) << (8 - bit)))
                run = self.runs[d]
                n0, n1 = run[mid] - run[low], run[high] - run[mid]
                own = (np.where((joint >> (7 - bit)) & 1 == 1, n1, n0) + 0.5) / (n0 + n1 + 1)
                if d == DEPTH:
                    p = own
                else:
                    share = np.full(len(keys), 0.5)
                    seen = high > low
                    share[seen] = self.shares[d][bit][low[seen]]
                    p = share * own + (1 - share) * p
            out += np.log10(p)
        return out


class Lookup:
    """The tree's table of entries, hashed with open addressing."""

    def __init__(self, tree: Tree) -> None:
        self.tree = tree
        keys = tree.keys[DEPTH]
        self.bits = max(10, int(math.ceil(math.log2(max(1, 3 * len(keys))))))
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.value = np.zeros(1 << self.bits, dtype=np.float32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            _, first = np.unique(slot, return_index=True)
            first = first[self.key[slot[first]] == -1]
            self.key[slot[first]] = keys[left[first]]
            self.value[slot[first]] = tree.log10[left[first]]
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _M) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.key[slot]
        out = self.value[slot].astype(np.float64)
        open_ = np.flatnonzero(found != keys)
        slot, missing = slot[open_], []
        while len(open_):
            empty = self.key[slot] == -1
            missing.append(open_[empty])
            open_, slot = open_[~empty], (slot[~empty] + 1) & ((1 << self.bits) - 1)
            hit = self.key[slot] == keys[open_]
            out[open_[hit]] = self.value[slot[hit]]
            open_, slot = open_[~hit], slot[~hit]
        missing = np.concatenate(missing) if missing else np.zeros(0, np.int64)
        if len(missing):
            new, at = np.unique(keys[missing], return_inverse=True)
            out[missing] = self.tree.predict(new)[at]
        return out


class _Entries:
    """Entries of a block of texts, as Lookup takes them."""

    def __init__(self, keys: np.ndarray, log10: np.ndarray) -> None:
        self.keys, self.log10 = {DEPTH: keys}, log10

    def predict(self, keys: np.ndarray) -> np.ndarray:
        raise RuntimeError(f"{len(keys)} entries of a block's texts are not in its table: the texts changed between two reads")


def _shorter(keys: np.ndarray) -> np.ndarray:
    """Keys with contexts of one byte less."""
    return ((keys >> (8 + _SYMBOL)) << 8) | (keys & 255)


def _weigh(keys: np.ndarray, n: np.ndarray, deep: int, low: int, below: np.ndarray | None = None, state=None):
    """Weigh whole contexts of ``low`` bytes, given the distinct keys of depth ``deep`` in them and their counts.

    Without ``below``, these are the deepest. Otherwise it has the logarithms of their weighted probabilities: eight
    columns, one for each bit, each node's at its first byte and 0 at others, so that they can be summed by context and
    byte. Returns keys, counts and such columns of depth ``low``. With ``state``, a function from these keys to what
    shallower levels have mixed (eight columns of probabilities, then eight of the weight that is left), it returns the
    state of ``keys`` instead.
    """
    order = np.argsort(keys)
    level = {deep: keys[order]}
    counts = {deep: n[order].astype(np.float64)}
    maps = {}
    for d in range(deep - 1, low - 1, -1):
        level[d], maps[d + 1] = np.unique(_shorter(level[d + 1]), return_inverse=True)
        counts[d] = np.bincount(maps[d + 1], weights=counts[d + 1], minlength=len(level[d]))
    top = deep if below is None else deep - 1
    weights, mixed = np.zeros((len(level[low]), 8)), np.zeros((len(keys), 16))
    before = None if state is None else state(level[low])
    for bit in range(8):
        share, sides = {}, {}
        up = None if below is None else below[order, bit]
        for d in range(top, low - 1, -1):
            code = level[d] >> (8 - bit)
            begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            at = np.cumsum(np.bincount(begins, minlength=len(code))) - 1
            one = (level[d] >> (7 - bit)) & 1
            n1 = np.bincount(at, weights=counts[d] * one, minlength=len(begins))
            n0 = np.bincount(at, weights=counts[d], minlength=len(begins)) - n1
            own = _estimate(n0, n1)
            if d == DEPTH:
                weighted, share[d] = own, np.ones(len(level[d]))
            else:
                product = np.bincount(at[maps[d + 1]], weights=up, minlength=len(begins))
                weighted, share[d] = np.logaddexp(own, product) - math.log(2), (1 / (1 + np.exp(np.clip(product - own, -700, 700))))[at]
            sides[d] = (np.where(one == 1, n1[at], n0[at]) + 0.5) / ((n0 + n1)[at] + 1)
            up = np.zeros(len(level[d]))
            up[begins] = weighted
        weights[:, bit] = up
        if before is not None:
            p, left = before[:, bit], before[:, 8 + bit]
            for d in range(low, deep + 1):
                if d > low:
                    p, left = p[maps[d]], left[maps[d]]
                if d <= top:
                    p, left = p + left * share[d] * sides[d], left * (1 - share[d])
            mixed[order, bit], mixed[order, 8 + bit] = p, left
    return (level[low], counts[low].astype(np.int64), weights) if state is None else mixed


def _packed(it):
    """Rows of (block, key, p) as lists for each block, keys sorted and as differences."""
    held, rows = [], 0

    def out():
        table = pa.Table.from_batches(held)
        block, keys, p = (table.column(c).to_numpy() for c in ("block", "key", "p"))
        order = np.lexsort((keys, block))
        block, keys, p = block[order], keys[order], p[order]
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        steps = np.diff(keys, prepend=0)
        steps[first] = keys[first]
        ends = np.append(first, len(block)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(block[first]), pa.ListArray.from_arrays(ends, steps), pa.ListArray.from_arrays(ends, p)], names=["block", "keys", "ps"])

    for batch in common.batches(it):
        held.append(batch)
        rows += batch.num_rows
        if rows >= 1 << 20:
            yield from out()
            held, rows = [], 0
    if held:
        yield from out()


#: About the bytes of texts, and most of them, that are dealt out in one row.
BUNDLE, MOST_IN_BUNDLE = 1 << 20, 512
_BUNDLE = "block long, row long, rows array<long>, doc_ids array<long>, held_outs array<boolean>, sizes array<long>, texts binary"


def _bundled(it):
    """Rows of (block, row, doc_id, held_out, text), in order, as bundles of a block, whose texts are one compressed whole."""
    z = zstandard.ZstdCompressor(level=3)
    block, held, size = None, [], 0

    def out():
        if held:
            rows, doc_ids, held_outs, texts = zip(*held, strict=True)
            columns = [pa.array([block], pa.int64()), pa.array([rows[0]], pa.int64()), *(pa.array([x], pa.list_(t)) for x, t in ((rows, pa.int64()), (doc_ids, pa.int64()), (held_outs, pa.bool_())))]
            columns += [pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([z.compress(b"".join(texts))], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "row", "rows", "doc_ids", "held_outs", "sizes", "texts"])
            held.clear()

    for batch in common.slices(common.batches(it), MOST_IN_BUNDLE):
        for b, row, doc_id, held_out, text in zip(*(batch.column(c).to_pylist() for c in range(4)), common.raw(batch.column(4)), strict=True):
            text = text or b""
            if b != block or size + len(text) > BUNDLE or len(held) == MOST_IN_BUNDLE:
                yield from out()
                block, size = b, 0
            held.append((row, doc_id, held_out, text))
            size += len(text)
    yield from out()


def _wide(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), values.ravel())


def _whole(it):
    """Batches joined so that none ends inside a context, the first column."""
    held, rows = [], 0
    for batch in common.batches(it):
        held.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            table = pa.Table.from_batches(held).combine_chunks()
            context = table.column(0).to_numpy()
            cut = int(np.searchsorted(context, context[-1]))
            if cut:
                yield table.slice(0, cut).combine_chunks().to_batches()[0]
                # a copy, so that the rest does not keep the whole
                held, rows = table.slice(cut).combine_chunks().to_batches(), rows - cut
            else:
                held = table.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _up(deep: int, low: int):
    def run(it):
        for batch in _whole(it):
            below = None if deep == DEPTH else _wide(batch.column(3), 8)
            keys, n, weights = _weigh(batch.column(1).to_numpy(), batch.column(2).to_numpy(), deep, low, below)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), _lists(weights)], names=["key", "n", "w"])

    return run


def _dealt(table: DataFrame, depth: int, by: int) -> DataFrame:
    """A table of keys of ``depth`` bytes, with whole contexts of ``by`` bytes in a partition."""
    context = F.shiftright("key", 8 + _SYMBOL * (depth - by)).alias("context")
    return table.select(context, "key", *(c for c in table.columns if c in ("n", "w"))).repartition("context")


def log_probabilities(rows: DataFrame) -> DataFrame:
    """(key, p): log10 of the mixed probability of each key of rows(key, n), whose counts are summed."""
    spark = rows.sparkSession.sparkContext
    # summed where they are dealt to, so the counts are not dealt again for the deepest levels
    counts = common.kept(_dealt(rows, DEPTH, _DEALT).groupBy("context", "key").agg(F.sum("n").alias("n")))
    third = common.kept(counts.sortWithinPartitions("context").mapInArrow(_up(DEPTH, _DEALT), "key long, n long, w array<double>"))
    second = _dealt(third, _DEALT, _NEAR).sortWithinPartitions("context").mapInArrow(_up(_DEALT, _NEAR), "key long, n long, w array<double>")
    # contexts of one byte are at most 256, whatever the corpus
    one = F.shiftright("key", 8 + _SYMBOL).bitwiseAND(F.lit(255)) * 256 + F.col("key").bitwiseAND(F.lit(255))
    first = second.groupBy(one.alias("at")).agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("w")[i]) for i in range(8))).alias("w")).toArrow().combine_chunks()
    at = first["at"].to_numpy()
    near = ((at >> 8) << 8) | (at & 255)
    near, order = np.sort(near), np.argsort(near)
    # as if each context of one byte had one of two below it, whose weights are the sums
    known = np.zeros((0, 16))
    if len(near):
        below = _wide(first["w"].combine_chunks() if isinstance(first["w"], pa.ChunkedArray) else first["w"], 8)[order]
        known = _weigh(((near >> 8) << (8 + _SYMBOL)) | (near & 255), first["n"].to_numpy()[order], 2, 0, below, lambda k: np.repeat([[0.0, 1.0]], 8, axis=1).repeat(len(k), axis=0))
    held = spark.broadcast((near, known))

    def down(it):
        near, known = held.value
        for batch in _whole(it):
            keys = batch.column(1).to_numpy()
            mixed = _weigh(keys, batch.column(2).to_numpy(), _DEALT, _NEAR, _wide(batch.column(3), 8), lambda k: known[np.searchsorted(near, _shorter(k))])
            yield pa.RecordBatch.from_arrays([pa.array(keys), _lists(mixed)], names=["key", "s"])

    def last(it):
        for batch in _whole(it):
            top = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            shallow, state = batch.column(1).to_numpy()[top], _wide(batch.column(3).filter(pa.array(top)), 16)
            order = np.argsort(shallow)
            keys = batch.column(1).to_numpy()[~top]
            n = batch.column(2).filter(pa.array(~top)).to_numpy()
            p = np.log10(_weigh(keys, n, DEPTH, _DEALT, None, lambda k: state[order[np.searchsorted(shallow[order], k)]])[:, :8]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(p.astype(np.float32))], names=["key", "p"])

    states = _dealt(third, _DEALT, _NEAR).sortWithinPartitions("context").mapInArrow(down, "key long, s array<double>")
    states = states.select(F.shiftright("key", 8).alias("context"), "key", F.lit(None).cast("long").alias("n"), "s")
    entries = counts.select("context", "key", "n", F.lit(None).cast("array<double>").alias("s"))
    return states.union(entries).repartition("context").sortWithinPartitions("context").mapInArrow(last, "key long, p float")


def _bounded(counts: DataFrame, entries: int) -> DataFrame:
    """counts(key, n) with the rarest contexts merged until at most ``entries`` rows are left."""
    for d in range(DEPTH, 0, -1):
        if (rows := counts.count()) <= entries:
            break
        low = 8 + _SYMBOL * (DEPTH - d)
        sizes = common.stored(counts.groupBy(F.shiftright("key", low).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("e")), "contexts")
        kinds = sizes.groupBy(F.floor(F.log2("total")).alias("k")).agg(F.sum("e").alias("e")).orderBy(F.desc("k")).collect()
        room, least = entries // 2, 64
        for k, e in kinds:
            if e > room:
                break
            room, least = room - e, k
        rare = sizes.where(F.floor(F.log2("total")) < least).select("context")
        clear = ~(((1 << _SYMBOL) - 1) << low)
        named = counts.withColumn("context", F.shiftright("key", low))
        merged = named.join(rare, "context", "left_semi").select(F.col("key").bitwiseAND(F.lit(clear)).bitwiseOR(F.lit(OTHER << low)).alias("key"), "n")
        counts = common.stored(named.join(rare, "context", "left_anti").select("key", "n").union(merged).groupBy("key").agg(F.sum("n").alias("n")), "contexts")
        if counts.count() >= rows:
            break
    return counts


def fit_tree(training: DataFrame) -> Tree:
    """The tree in one place, for small corpora; ``scored`` keeps it in a table."""
    table = training.select("text").mapInArrow(_contexts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return Tree(table["key"].to_numpy(), table["n"].to_numpy())


def scored(docs: DataFrame, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs(doc_id, text).

    Rows whose crc32 of the id as text leaves 2 when divided by 7 are held out; a row without an id is not. A null,
    empty or blank text has its end alone. Without training rows no token is known and the tree gives 1/2 for each
    bit. Repeated rows count and are scored each. Other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.pmod(common.id_crc(), F.lit(7)) == 2, F.lit(False)).alias("held_out"), "text")
    training = docs.where(~F.col("held_out"))
    words = common.kept(training.select("text").mapInArrow(_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")))
    texts = (words.where("word is null").first() or {"c": 0})["c"]
    words = words.where("word is not null")
    kinds = words.groupBy(F.floor(F.log2("c")).alias("k")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).orderBy(F.desc("k")).collect()
    tokens, distinct = sum(r["n"] for r in kinds) + texts, sum(r["v"] for r in kinds) + (texts > 0)
    room, least = frequent, 64
    for r in kinds:
        if r["v"] > room:
            break
        room, least = room - r["v"], r["k"]
    many = words.where(F.floor(F.log2("c")) >= least).toArrow()
    known = {w: math.log10(c + 1) for w, c in zip(many["word"].to_pylist(), many["c"].to_pylist(), strict=True)}
    rest = words.where(F.floor(F.log2("c")) < least)
    size = docs.agg(F.avg(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 1
    texts_in_block = 1 << min(20, max(0, int(math.log2(max(1, block / size)))))
    # numbers of rows go on within a partition, so a block's texts lie side by side
    row = F.monotonically_increasing_id()
    rows = docs.select(row.alias("row"), "doc_id", "held_out", "text").select(F.floor(F.col("row") / texts_in_block).alias("block"), "*")
    needed = common.kept(rows.select("block", "held_out", "text").mapInArrow(_block_contexts, "block long, key long, n long"))
    entries = needed.select("block", "key").join(log_probabilities(needed), "key").mapInArrow(_packed, "block long, keys array<long>, ps array<float>")
    held = spark.sparkContext.broadcast(known)
    end, unit = math.log10(texts + 1), math.log10(tokens + distinct + 1)
    ends_known = int(texts > 0)

    def run(it):
        known, z = held.value, zstandard.ZstdDecompressor()
        block, pieces, look = None, [], None
        for batch in common.batches(it):
            blocks = batch.column(0).to_numpy()
            # a block's entries come first, then the bundles of its texts
            edges = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])).tolist()
            for begin, stop in zip(edges, [*edges[1:], len(blocks)], strict=True):
                if blocks[begin] != block:
                    block, pieces, look = blocks[begin], [], None
                n_entries = (stop - begin) - batch.column(1).slice(begin, stop - begin).null_count
                for i in range(begin, begin + n_entries):
                    pieces.append((np.cumsum(batch.column(1)[i].values.to_numpy()), batch.column(2)[i].values.to_numpy().copy()))
                for i in range(begin + n_entries, stop):
                    if look is None:
                        look, pieces = Lookup(_Entries(np.concatenate([k for k, _ in pieces]), np.concatenate([p for _, p in pieces]))), []
                    ends = np.cumsum(batch.column(7)[i].values.to_numpy()).tolist()
                    whole = z.decompress(batch.column(8)[i].as_py())
                    texts = [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                    yield score(known, look, [batch.column(c)[i].values for c in (4, 5, 6)], texts)

    def score(known, look, ids, texts):
        rows, streams = [], []
        for text in texts:
            words, stream = normal(text)
            found = [known.get(w) for w in words]
            rare = [w for w, f in zip(words, found, strict=True) if f is None] if None in found else []
            n = len(words) + 1
            rows.append((n, n - 1 - len(rare) + ends_known, math.fsum(f for f in found if f is not None) + end - n * unit, rare))
            streams.append(stream)
        keys, starts = events(streams)
        n, k, base, rare = zip(*rows, strict=True)
        columns = [*ids, pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(base), pa.array(np.add.reduceat(look(keys), starts)), pa.array(rare, pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    bundles = rows.select("block", "row", "doc_id", "held_out", "text").mapInArrow(common.trimmed(_bundled), _BUNDLE)
    none = [F.lit(None).cast(bundles.schema[c].dataType).alias(c) for c in bundles.columns[1:]]
    both = entries.select("block", "keys", "ps", *none).union(bundles.select("block", F.lit(None).cast("array<long>"), F.lit(None).cast("array<float>"), *bundles.columns[1:]))
    both = both.repartition("block").sortWithinPartitions("block", F.col("row").asc_nulls_first())
    first = common.kept(both.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>"))
    more = first.select("row", F.explode("rare").alias("word")).join(rest, "word").groupBy("row").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("c") + 1)).alias("s"))
    out = first.drop("rare").join(more, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("s", F.lit(0.0))).alias("base_score"), "score")
