"""N-gram Jaccard self-join with skipping by set relations.

A document's shingles are ranked by how rare their word pairs and words are in the corpus, rarest first. Two sets that
reach the threshold share one of a few first shingles, so only these go into index lists. Entries carry the set's size
and the shingle's position, which bound the overlap that the rest of both sets could still reach.

Skipping in lists: a list is ordered by size and cut into blocks, each with the bounds of its sizes, of what is left
from its positions on, and of its groups. A block is compared with those blocks only whose bounds let a pair through.

Skipping by answers: in the first round every set is compared with one leader of its lists, the same for most sets
alike. What a set shares with its leader is an answer from which its relation to the leader's other answers derives:
two sets that share x and y shingles with a leader share at most x and what the other has outside the leader, so most
such pairs are not compared. Sets found similar are a group, whose members' pairs are answered and never formed. Later
rounds compare each set with a few neighbours of other groups in its lists, near ones first; then all pairs across
groups that are left are listed, in blocks, and verified, closest first.

Before whole sets are verified, a pair must pass by parity bitmaps of 512 bits, whose differing bits are a lower bound
of the sets' difference. Identical sets are one class from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

#: Slots of the histograms of words and of word pairs, whose logarithms are broadcast as a byte each: 1.25 MB, whatever the corpus.
WORD_SLOTS, PAIR_SLOTS, _CHUNK = 1 << 18, 1 << 20, 1 << 16
BITMAP_WORDS = 8
#: Bits of the filter of ids whose whole sets are read: 1 MB, whatever the corpus.
ID_BITS = 1 << 23
#: Entries of a list that are compared with each other at once, and those whose bounds are taken together.
SEGMENT, BLOCK = 4096, 16
#: Rounds between groups: how far in its lists a set looks for neighbours, and how many it asks.
ROUNDS = ((4, 2), (16, 4), (64, 16), (256, 16))
_U = np.uint64
_MIX = (_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[1]
    x = (x ^ (x >> _U(27))) * _MIX[2]
    return x ^ (x >> _U(31))


def word_hashes(text: bytes | None) -> np.ndarray:
    words = common.split(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = max(0, len(words) - k + 1)
    with np.errstate(over="ignore"):
        h = np.full(n, _U(k))
        for i in range(k):
            h = mixed(h * _MIX[0] + words[i : n + i])
    return h


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles, of all words where they are fewer."""
    return np.unique(grams(words, min(k, len(words)))) if len(words) else words


def _places(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of words and of pairs of words."""
    return (words & _U(WORD_SLOTS - 1)).astype(np.int64), (grams(words, 2) & _U(PAIR_SLOTS - 1)).astype(np.int64)


def _histogram(it):
    seen = [np.zeros(s, dtype=np.int64) for s in (WORD_SLOTS, PAIR_SLOTS)]
    for batch in common.slices(it):
        at = [_places(word_hashes(t)) for t in common.raw(batch.column(0)) if t]
        for s, places in zip(seen, zip(*at, strict=True), strict=False):
            s += np.bincount(np.concatenate(places), minlength=len(s))
    z = zstandard.ZstdCompressor(level=1)
    parts = np.concatenate(seen).reshape(-1, _CHUNK)
    some = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([z.compress(parts[i].tobytes()) for i in some], pa.binary())], names=["part", "counts"])


def _summed(it):
    sums: dict[int, np.ndarray] = {}
    z = zstandard.ZstdDecompressor()
    for batch in it:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(z.decompress(counts), dtype=np.int64)
    logs = [np.clip(np.round(8 * np.log2(1 + s)), 0, 255).astype(np.uint8).tobytes() for s in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(logs, pa.binary())], names=["part", "counts"])


def rarity(docs: DataFrame) -> np.ndarray:
    """For each slot of words, then of pairs, 8 times the binary logarithm of what was counted there."""
    counts = docs.select("text").mapInArrow(common.trimmed(_histogram), "part int, counts binary")
    out = np.zeros((WORD_SLOTS + PAIR_SLOTS) // _CHUNK * _CHUNK, dtype=np.uint8).reshape(-1, _CHUNK)
    for part, logs in counts.repartition(len(out), "part").mapInArrow(_summed, "part int, counts binary").collect():
        out[part] = np.frombuffer(bytes(logs), dtype=np.uint8)
    return out.ravel()


def _costs(words: np.ndarray, k: int, logs: np.ndarray) -> np.ndarray:
    """A number for each run of k words that only they decide: by their rarest pair, then by all words."""
    one, two = _places(words)
    n = len(words) - k + 1
    total = np.convolve(logs[one].astype(np.int64), np.ones(k, dtype=np.int64), "valid")
    if k > 1:
        pairs = logs[WORD_SLOTS + two].astype(np.int64)
        least = pairs[:n]
        for i in range(1, k - 1):
            least = np.minimum(least, pairs[i : n + i])
        total += least << 16
    return total


def _bitmap(h: np.ndarray) -> np.ndarray:
    """Which of the bitmap's bits an odd number of shingles falls on."""
    odd = np.bincount(((h >> _U(20)) & _U(64 * BITMAP_WORDS - 1)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """A row for each document: doc_id, n (size of its set), fp (digest of the set), bitmap, prefix (its first shingles)."""
    logs = docs.sparkSession.sparkContext.broadcast(rarity(docs))

    def each(batch: pa.RecordBatch):
        sizes, digests, bitmaps, prefixes = [], [], [], []
        for text in common.raw(batch.column(1)):
            words = word_hashes(text)
            if not len(words):
                sizes.append(0)
                digests.append(None)
                bitmaps.append(None)
                prefixes.append(None)
                continue
            some = min(k, len(words))
            h, first = np.unique(grams(words, some), return_index=True)
            total = _costs(words, some, logs.value)[first]
            n = len(h)
            sizes.append(n)
            digests.append(xxhash.xxh3_128_digest(h.tobytes()))
            bitmaps.append(_bitmap(h))
            most = n - (num * n + den - 1) // den + 1
            # the total order: costs, then the hash
            few = np.arange(n)
            if most < n:
                few = np.flatnonzero(total <= np.partition(total, most - 1)[most - 1])
            prefixes.append(h[few[np.lexsort((h[few], total[few]))][:most]].view(np.int64))
        yield {"doc_id": batch.column(0), "n": pa.array(sizes, pa.int32()), "fp": pa.array(digests, pa.binary()), "bitmap": pa.array(bitmaps, pa.list_(pa.int64())), "prefix": pa.array(prefixes, pa.list_(pa.int64()))}

    return common.mapped(docs.select(F.col("doc_id").cast("long"), "text"), each, "doc_id long, n int, fp binary, bitmap array<long>, prefix array<long>")


def _whole_sets(docs: DataFrame, ids: DataFrame, k: int, in_one_task: int) -> DataFrame:
    """(id, whole) for the documents whose id is among ids: sent to the scan if few; if not, a bounded filter picks a few more."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")

    def hashed(batch: pa.RecordBatch):
        yield {"id": batch.column(0), "whole": pa.array([shingles(word_hashes(t), k).view(np.int64) for t in common.raw(batch.column(1))], pa.list_(pa.int64()))}

    if ids.count() <= in_one_task:
        return common.mapped(rows.join(F.broadcast(ids), "id", "left_semi"), hashed, "id long, whole array<long>")
    slot = F.pmod(F.xxhash64("id"), F.lit(ID_BITS))
    parts = ids.groupBy(F.floor(slot / 32768).alias("at")).agg(F.bitmap_construct_agg(slot % 32768).alias("bits")).collect()
    bits = np.zeros((ID_BITS // 32768, 4096), dtype=np.uint8)
    for at, part in parts:
        bits[at] = np.frombuffer(bytes(part), dtype=np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(bits.ravel())

    def each(batch: pa.RecordBatch):
        at = batch.column(2).to_numpy()
        hit = np.flatnonzero((held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        yield from hashed(pa.RecordBatch.from_arrays([c.take(pa.array(hit)) for c in batch.columns[:2]], names=["id", "text"]))

    return common.mapped(rows.select("id", "text", slot.alias("at")), each, "id long, whole array<long>")


def _reach(n1, p1, n2, p2, num: int, den: int):
    """For arrays: sizes within the threshold, and enough of both sets left from a common shingle on."""
    need = -((n1 + n2) * -num // (num + den))
    return (np.minimum(n1, n2) * den >= np.maximum(n1, n2) * num) & (np.minimum(n1 - p1, n2 - p2) >= need)


def _derived(i, j, n, leader, shared, num: int, den: int):
    """Pairs of rows that answers derived from a common leader do not rule out."""
    most = np.minimum(shared[i] + n[j] - shared[j], shared[j] + n[i] - shared[i])
    return (leader[i] != leader[j]) | (shared[i] < 0) | (shared[j] < 0) | (most >= -((n[i] + n[j]) * -num // (num + den)))


def _counted(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs and how often each came."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    key, c = np.unique(at[: len(a)] * len(ids) + at[len(a) :], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(ids[key // max(1, len(ids))]), pa.array(ids[key % max(1, len(ids))]), pa.array(c.astype(np.int64))], names=["a", "b", "c"])


_ENTRY = ("token", "id", "n", "pos", "g", "leader", "shared")


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy().astype(np.int64) for c in batch.columns]


def _led(num: int, den: int):
    """Of entries in the order of tokens: (a, b, c), each set with the leader of what a batch has of its list."""

    def run(it):
        for batch in common.batches(it):
            token, ident, n, pos = _columns(batch)
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            which = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(token)]))
            rank = mixed(ident.view(np.uint64) ^ _MIX[0])
            first = np.lexsort((rank, which))[starts]
            lead = first[which]
            ok = (ident[lead] != ident) & _reach(n, pos, n[lead], pos[lead], num, den)
            yield _counted(ident[ok], ident[lead[ok]])

    return run


def _beside(num: int, den: int, far: int):
    """Of entries in the order of lists: (a, b, c) with a < b, pairs of two groups at most so many places apart."""

    def run(it):
        last, old = None, 0
        for batch in common.batches(it):
            rows = _columns(batch)
            if last is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(last, rows, strict=True)]
            token, ident, n, pos, g, leader, shared = rows
            a, b = [], []
            for step in range(1, min(far, len(token) - 1) + 1):
                # pairs of the rows held over were formed with their batch
                i = np.arange(max(0, old - step), len(token) - step)
                i = i[(token[i + step] == token[i]) & (g[i + step] != g[i])]
                i = i[_reach(n[i], pos[i], n[i + step], pos[i + step], num, den)]
                i = i[_derived(i, i + step, n, leader, shared, num, den)]
                a.append(np.minimum(ident[i], ident[i + step]))
                b.append(np.maximum(ident[i], ident[i + step]))
            last = [x[-far:] for x in rows]
            old = len(last[0])
            if a:
                yield _counted(np.concatenate(a), np.concatenate(b))

    return run


def _across(num: int, den: int, block: int):
    """Of entries grouped by token, i, j and ordered by size: (a, b, c) with a < b, all pairs of two groups.

    Blocks are skipped by their bounds of sizes, of what is left from positions on, and of groups.
    """

    def pairs(rows):
        token, ident, n, pos, g, leader, shared, i, j, seg = rows
        starts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        lengths = np.diff(np.r_[starts, len(token)])
        rank = np.arange(len(token)) - np.repeat(starts, lengths)
        first = np.flatnonzero(rank % block == 0)
        size = np.diff(np.r_[first, len(token)])
        of = np.repeat(np.arange(len(starts)), -(-lengths // block))
        low, high = n[first], n[first + size - 1]
        left = np.maximum.reduceat(n - pos, first)
        g1, g2 = np.minimum.reduceat(g, first), np.maximum.reduceat(g, first)
        grid = np.arange(block * block)
        x, step = np.arange(len(first)), 0
        while len(x):
            x = x[x + step < len(first)]
            y = x + step
            # as lists are ordered by size, a block too large ends the search for its partner
            near = (of[x] == of[y]) & (low[y] * num <= high[x] * den)
            x, y = x[near], y[near]
            need = -((low[x] + low[y]) * -num // (num + den))
            open_ = (np.minimum(left[x], left[y]) >= need) & ((np.minimum(g1[x], g1[y]) != np.maximum(g2[x], g2[y])))
            for at in range(0, int(open_.sum()), 2048):
                bx, by = x[open_][at : at + 2048], y[open_][at : at + 2048]
                p = first[bx][:, None] + grid // block
                q = first[by][:, None] + grid % block
                ok = (grid // block < size[bx][:, None]) & (grid % block < size[by][:, None]) & (p < q)
                p, q = p[ok], q[ok]
                # two segments: pairs of one entry of each
                ok = (g[p] != g[q]) & ((i[p] == j[p]) | (seg[p] != seg[q]))
                p, q = p[ok], q[ok]
                ok = _reach(n[p], pos[p], n[q], pos[q], num, den) & _derived(p, q, n, leader, shared, num, den)
                p, q = ident[p[ok]], ident[q[ok]]
                if len(p):
                    yield _counted(np.minimum(p, q), np.maximum(p, q))
            step += 1

    def run(it):
        held = None
        for batch in common.batches(it):
            rows = _columns(batch)
            if held is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(held, rows, strict=True)]
            token, i, j = rows[0], rows[7], rows[8]
            whole = np.flatnonzero((token != token[-1]) | (i != i[-1]) | (j != j[-1]))
            end = int(whole[-1]) + 1 if len(whole) else 0
            if end:
                yield from pairs([x[:end] for x in rows])
            held = [x[end:] for x in rows]
        if held is not None and len(held[0]):
            yield from pairs(held)

    return run


def _differ(a: str, b: str):
    """Bits in which two bitmaps differ: no more than the shingles in which the sets do."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITMAP_WORDS)), F.lit(0))


def _apart(sizes, num: int, den: int):
    """In how many shingles sets of the threshold's similarity differ at most, by the sum of their sizes."""
    return sizes - 2 * F.ceil(sizes * F.lit(num) / F.lit(num + den))


def _by_id(rows: DataFrame) -> DataFrame:
    """Rows dealt out by id, so that the joins of all rounds find them where they are."""
    return common.kept(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id"))


class _Join:
    """Groups of verified links so far. A pair is compared only once, and only while its sets are in two groups."""

    def __init__(self, docs: DataFrame, lists: DataFrame, marks: DataFrame, k: int, num: int, den: int, in_one_task: int, segment: int) -> None:
        self.docs, self.lists, self.marks = docs, lists, marks
        self.k, self.num, self.den, self.in_one_task, self.segment = k, num, den, in_one_task, segment
        spark = docs.sparkSession
        self.groups = spark.createDataFrame([], "id long, component long")
        self.answers = spark.createDataFrame([], "id long, leader long, shared long")
        #: For each set, those that it asked for; a few a round.
        self.tried = spark.createDataFrame([], "x long, ys array<long>")
        self.whole: list[DataFrame] = []

    def _sent(self, df: DataFrame) -> DataFrame:
        """A table to join with: broadcast while it has few rows, of a few numbers each."""
        return F.broadcast(df) if df.count() <= self.in_one_task else df

    def entries(self) -> DataFrame:
        """Entries with their groups, leaders and what they share with these; a token's entries are in one partition."""
        state = self.groups.join(self.answers, "id", "full")
        few = state.count() <= self.in_one_task
        out = self.lists.join(F.broadcast(state) if few else state, "id", "left")
        out = out.select("token", "id", "n", "pos", F.coalesce("component", "id").alias("g"), F.coalesce("leader", "id").alias("leader"), F.coalesce("shared", F.lit(-1)).alias("shared"))
        return out if few else out.repartition("token")

    def close(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose bitmaps allow the threshold, and the bits d in which these differ."""
        for x in "ab":
            pairs = pairs.join(self.marks.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "bitmap"))), x)
        pairs = pairs.withColumn("d", _differ("bitmap_a", "bitmap_b"))
        return pairs.where(F.col("d") <= _apart(F.col("n_a") + F.col("n_b"), self.num, self.den)).select("a", "b", "d").groupBy("a", "b").agg(F.min("d").alias("d"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, shared, nb, link): whole sets compared; those not yet read are read first."""
        need = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        for sets in self.whole:
            need = need.join(sets.select("id"), "id", "left_anti")
        need, n = common.compact(need, "need")
        if n:
            self.whole.append(_by_id(_whole_sets(self.docs, need, self.k, self.in_one_task)))
        sets = self.whole[0]
        for more in self.whole[1:]:
            sets = sets.union(more)
        left, right = (sets.select(F.col("id").alias(x), F.col("whole").alias(f"whole_{x}")) for x in "ab")
        # a set in many pairs, as a leader is, gets several tasks
        most = pairs.groupBy("b").count().agg(F.max("count")).first()[0] or 0
        key = ["b"]
        if (parts := 1 + most * 16 // self.segment) > 1:
            key = ["b", "part"]
            pairs = pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(parts)))
            right = pairs.select(*key).distinct().join(right, "b")
        pairs = pairs.join(left, "a").join(right, key)
        pairs = pairs.select("a", "b", F.size(F.array_intersect("whole_a", "whole_b")).cast("long").alias("shared"), F.size("whole_a").cast("long").alias("na"), F.size("whole_b").cast("long").alias("nb"))
        pairs = pairs.withColumn("link", F.col("shared") * self.den >= (F.col("na") + F.col("nb") - F.col("shared")) * self.num)
        return common.compact(pairs, "verified")[0]

    def compare(self, pairs: DataFrame) -> tuple[DataFrame, int]:
        """Verify pairs(a, b) that bitmaps let pass, join their groups; the verified pairs and the number of links."""
        if pairs.isEmpty():
            return pairs.sparkSession.createDataFrame([], "a long, b long, shared long, nb long, link boolean"), 0
        found = self.verified(pairs)
        links = found.where("link").select("a", "b").distinct()
        n = links.count()
        if n:
            old = self.groups.select(F.col("id").alias("a"), F.col("component").alias("b"))
            self.groups = common.components(links.union(old), self.in_one_task).withColumnRenamed("node", "id")
        return found, n

    def _asked(self, picked: DataFrame) -> DataFrame:
        """The pairs of picked(x, ys), which are noted."""
        every = self.tried.union(picked).groupBy("x").agg(F.flatten(F.collect_list("ys")).alias("ys"))
        self.tried = common.compact(every, "tried")[0]
        pairs = picked.select("x", F.explode("ys").alias("y"))
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def lead(self) -> None:
        """The first round: each set with the leader of most of its lists."""
        led = self.lists.sortWithinPartitions("token", "n", "id").mapInArrow(_led(self.num, self.den), "a long, b long, c long")
        led = led.repartition("a").groupBy("a", "b").agg(F.sum("c").alias("c")).groupBy("a").agg(F.max_by("b", F.struct("c", F.xxhash64("b"))).alias("b"))
        led = common.compact(led, "led")[0]
        self._asked(led.select(F.col("a").alias("x"), F.array("b").alias("ys")))
        # a set is asked about its leader in this order, so that its answer is its own
        found, _ = self.compare(common.compact(self.close(led).select("a", "b"), "close")[0])
        own = found.select(F.col("a").alias("id"), F.col("b").alias("leader"), "shared")
        heads = found.select(F.col("b").alias("id"), F.col("b").alias("leader"), F.col("nb").alias("shared")).distinct().join(own.select("id"), "id", "left_anti")
        self.answers = common.compact(own.union(heads), "answers")[0]

    def neighbours(self, far: int, most: int) -> int:
        """A round: each set with neighbours of other groups, at most so far in most of its lists; how many pairs it formed."""
        near = self.entries().sortWithinPartitions("token", "n", "id").mapInArrow(_beside(self.num, self.den, far), "a long, b long, c long")
        near = near.groupBy("a", "b").agg(F.sum("c").alias("c"))
        # a set has so many neighbours in a list, and some lists, so few in all
        ways = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
        found = near.select("a", "b", "c", ways.alias("p")).groupBy("p.x").agg(F.collect_list(F.struct("c", F.xxhash64("a", "b").alias("h"), "p.y")).alias("found"))
        found = found.join(self._sent(self.tried), "x", "left")
        fresh = F.filter("found", lambda e: ~F.array_contains(F.coalesce("ys", F.array().cast("array<long>")), e.y))
        picked = found.select("x", F.transform(F.slice(F.sort_array(fresh, False), 1, most), lambda e: e.y).alias("ys")).where(F.size("ys") > 0)
        picked, n = common.compact(picked, "picked")
        if n:
            self.compare(common.compact(self.close(self._asked(picked)).select("a", "b"), "close")[0])
        return n

    def finish(self) -> None:
        """All pairs across groups that lists, bounds, derived answers and bitmaps leave."""
        num, den, cut = self.num, self.den, self.segment
        every = W.Window.partitionBy("token")
        rows = self.entries().select("*", F.min("g").over(every).alias("g1"), F.max("g").over(every).alias("g2"), F.count("*").over(every).alias("m")).where("g1 <> g2")
        rows = common.kept(rows.withColumn("seg", F.floor((F.row_number().over(every.orderBy("g", "n", "id")) - 1) / cut)))
        short = rows.where(F.col("m") <= cut).select(*_ENTRY, *(F.lit(0).cast("long").alias(x) for x in ("i", "j")), "seg")
        found = short.sortWithinPartitions("token", "n", "id").mapInArrow(_across(num, den, BLOCK), "a long, b long, c long")
        long_ = rows.where(F.col("m") > cut)
        if not long_.isEmpty():
            # segments of long lists, ordered by group: two are compared if their bounds let a pair through
            bounds = long_.groupBy("token", "seg").agg(F.min("g").alias("g1"), F.max("g").alias("g2"), F.min("n").alias("n1"), F.max("n").alias("n2"), F.max(F.col("n") - F.col("pos")).alias("rest"))
            u, v = (bounds.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("seg", "g1", "g2", "n1", "n2", "rest"))) for x in "uv")
            need = F.ceil((F.col("n1_u") + F.col("n1_v")) * F.lit(num) / F.lit(num + den))
            may = (F.col("seg_u") <= F.col("seg_v")) & (F.least("g1_u", "g1_v") != F.greatest("g2_u", "g2_v"))
            may &= (F.greatest("n1_u", "n1_v") * num <= F.least("n2_u", "n2_v") * den) & (F.least("rest_u", "rest_v") >= need)
            meet = u.join(v, "token").where(may).select("token", F.col("seg_u").alias("i"), F.col("seg_v").alias("j"))
            meet = meet.select("token", "i", "j", F.col("i").alias("seg")).union(meet.where("i <> j").select("token", "i", "j", F.col("j").alias("seg")))
            parts = long_.select(*_ENTRY, "seg").join(meet, ["token", "seg"]).select(*_ENTRY, "i", "j", "seg").repartition("token", "i", "j")
            found = found.union(parts.sortWithinPartitions("token", "i", "j", "n", "id").mapInArrow(_across(num, den, BLOCK), "a long, b long, c long"))
        pairs, left = common.compact(self.close(found.select("a", "b").distinct()), "rest")
        rows.unpersist()
        most = 4
        while left:
            for x in "ab":
                named = self.groups.select(F.col("id").alias(x), F.col("component").alias("_g"))
                pairs = pairs.join(self._sent(named), x, "left").withColumn(f"g{x}", F.coalesce("_g", x)).drop("_g")
            rank = [F.row_number().over(W.Window.partitionBy(x).orderBy("d", "a", "b")) for x in "ab"]
            pairs, _ = common.compact(pairs.where("ga <> gb").select("a", "b", "d").withColumn("r", F.least(*rank)), "rest")
            self.compare(pairs.where(F.col("r") <= most).select("a", "b"))
            pairs = pairs.where(F.col("r") > most).select("a", "b", "d")
            left, most = pairs.count(), 8 * most

    def free(self) -> None:
        for sets in self.whole:
            sets.unpersist()


def classes(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10, in_one_task: int = common.LINKS_IN_ONE_TASK, segment: int = SEGMENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text): the join's classes.

    Two documents link when the Jaccard similarity of their k-word shingle sets is at least num/den, compared in
    integers. component_id is the smallest doc_id that links reach. Null and blank texts have the size 0 and link with
    nothing, as do rows without an id, whose component_id is null. Rows with equal texts, also with equal ids, are one
    class. Very long texts are sets like others. An empty table has no rows. Other columns of docs are not looked at.
    in_one_task and segment only decide how the work is dealt out.
    """
    docs = docs.select("doc_id", "text")
    sets = common.kept(set_rows(docs, k, num, den))
    # written, so that no later plan repeats how they came
    kinds = common.stored(sets.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("m")), "kinds")
    # sets that more than a thousandth of the rows have: fewer than a thousand
    hot = kinds.where(F.col("m") * 1000 > (kinds.agg(F.sum("m")).first()[0] or 0)).where("m > 1")
    named = sets.withColumnRenamed("doc_id", "id")
    copies = _of_kinds(sets.where("n > 0 and doc_id is not null").select("doc_id", "fp"), kinds.select("fp", "id"), hot, "inner")
    copies, n = common.compact(copies.where("doc_id <> id").select(F.col("doc_id").alias("id"), "fp"), "copies")
    single = named.where("n > 0 and id is not null").join(F.broadcast(copies) if n <= in_one_task else copies, ["id", "fp"], "left_anti")
    order = W.Window.partitionBy("token").orderBy("n", "id")
    lists = single.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    lists = lists.select("token", "id", "n", "pos", F.lag("id").over(order).alias("before"), F.lead("id").over(order).alias("after"))
    lists = common.kept(lists.where("before is not null or after is not null").drop("before", "after"))
    marks = _by_id(single.select("id", "n", "bitmap").join(lists.select("id").distinct(), "id", "left_semi"))
    join = _Join(docs, lists, marks, k, num, den, in_one_task, segment)
    if not lists.isEmpty():
        join.lead()
        # neighbours first, then ever farther: what is near is most alike, and groups found make the rest few
        for far, most in ROUNDS:
            if not join.neighbours(far, most):
                break
        join.finish()
    lists.unpersist()
    marks.unpersist()
    join.free()
    out = kinds.join(join.groups, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    rows = sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "fp")
    found = _of_kinds(rows.where("fp is not null"), out, hot, "left").unionByName(rows.where("fp is null").withColumn("component_id", F.lit(None).cast("long")))
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _of_kinds(rows: DataFrame, kinds: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """rows joined with kinds by fp; the kinds of hot, which many rows have, are sent to the rows."""
    hot = F.broadcast(hot.select("fp"))
    often = rows.join(F.broadcast(kinds.join(hot, "fp", "left_semi")), "fp")
    return often.unionByName(rows.join(hot, "fp", "left_anti").join(kinds.join(hot, "fp", "left_anti"), "fp", how))


def deduplicated(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs without all but one document of each group: the one with the smallest doc_id stays.

    Rows without an id stay, as do null and blank texts. Of rows that repeat an id, all stay if the id stays. Columns
    may have any names.
    """
    found = classes(docs, k, num, den).where("doc_id <> component_id")
    # the only column of its side, so no name of docs clashes
    gone = found.select(F.col("doc_id").alias(common.fresh("gone", docs))).distinct()
    return docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")


#: The rows of classes() with its defaults, in DuckDB's SQL: all pairs that share a shingle, and a closure over links.
ORACLE = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 3 THEN w ELSE w[i : i + 2] END, ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM cut WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT DISTINCT a AS node, a AS root FROM ways UNION SELECT w.b, r.root FROM reached r JOIN ways w ON w.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reached GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(root, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN roots ON roots.node = d.doc_id
"""
