"""Best-fit packing by sums of squares.

A document is its token ids and an end id. What is longer than a sequence is cut into whole sequences, the shorter rest
first. Pieces then go to sequences by the sum-of-squares rule (Csirik et al., 2006): of all ways to place a piece, into
an open sequence or a new one, the one after which the squared counts of open sequences per residual gap have the
smallest sum. A shard's pieces come longest first; those of sequences that are still open at the end, and of as many full ones
of many pieces, are placed once more, by best fit, longest first, which fills nearly all of them. Pieces are dealt out to shards of a fixed mean size, each
packed by a task of its own; what a shard loses is a few sequences of its tens of thousands.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

ROOM = 1024
#: Pieces that one task packs, on average.
SHARD = 150_000


def place(lengths: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, in the order given; lengths are 1 to room."""
    counts = np.zeros(room + 1, dtype=np.int64)  # of open sequences by gap
    holders: dict[int, list[int]] = defaultdict(list)
    seq, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    far = 1 << 60
    gain = np.full(room + 1, far)  # change of the sum when a sequence leaves its gap
    loss = np.ones(room + 1, dtype=np.int64)  # and when one comes to a gap
    loss[0] = 0
    made = 0
    for i, size in enumerate(lengths.tolist()):
        costs = gain[size:] + loss[: room + 1 - size]
        best = int(costs.argmin()) if len(costs) else 0
        rest = room - size
        if len(costs) and gain[best + size] != far and costs[best] <= loss[rest]:
            gap = best + size
            s = holders[gap].pop()
            counts[gap] -= 1
            gain[gap] = 1 - 2 * counts[gap] if counts[gap] else far
            loss[gap] = 2 * counts[gap] + 1
            rest = gap - size
        else:
            gap, s = room, made
            made += 1
        seq[i], offset[i] = s, room - gap
        if rest:
            holders[rest].append(s)
            counts[rest] += 1
            gain[rest] = 1 - 2 * counts[rest]
            loss[rest] = 2 * counts[rest] + 1
    return seq, offset


def best_fit(lengths: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """As place(), by the smallest gap that holds a piece."""
    counts = np.zeros(room + 1, dtype=np.int64)
    holders: dict[int, list[int]] = defaultdict(list)
    seq, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made = 0
    for i, size in enumerate(lengths.tolist()):
        gap = size + int((counts[size:] > 0).argmax())
        if counts[gap]:
            counts[gap] -= 1
            s = holders[gap].pop()
        else:
            gap, s = room, made
            made += 1
        seq[i], offset[i] = s, room - gap
        if gap > size:
            counts[gap - size] += 1
            holders[gap - size].append(s)
    return seq, offset


def fitted(lengths: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """Sequence numbers and offsets: sums of squares, longest first, then best fit for open sequences and some full ones."""
    if not len(lengths):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    seq, offset = place(size, room)
    filled, pieces = np.bincount(seq, weights=size).astype(np.int64), np.bincount(seq)
    again = filled < room
    full = np.flatnonzero(~again)
    # full sequences of many pieces lend the small ones that gaps need
    again[full[np.argsort(-pieces[full], kind="stable")][: again.sum()]] = True
    left = np.flatnonzero(again[seq])
    if len(left):
        new, at = best_fit(size[left], room)
        if new.max() + 1 < again.sum():
            seq[left], offset[left] = new + len(filled), at
    out = np.empty_like(seq), np.empty_like(offset)
    out[0][order], out[1][order] = np.unique(seq, return_inverse=True)[1], offset
    return out


def pieces(docs: DataFrame, tokenizer: str, room: int = ROOM, end: int = tokens.END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for docs(doc_id, text)."""

    def each(batch: pa.RecordBatch):
        rows = []
        tail = np.array([end], dtype="<u4")
        for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.ids_of(batch.column(1), tokenizer), strict=True):
            ids = np.concatenate([ids, tail])
            n = len(ids)
            cuts = [0, *range(n % room or room, n + 1, room)]
            view = memoryview(ids.tobytes())
            rows += [(doc_id, k, a, b - a, zlib.crc32(view[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        doc_id, piece, start, length, crc = zip(*rows, strict=True)
        yield {"doc_id": pa.array(doc_id, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}

    return common.mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, "doc_id long, piece int, start long, length long, ids_crc32 long", uses="encoder")


def packed(docs: DataFrame, tokenizer: str | None = None, room: int = ROOM, shard: int = SHARD) -> DataFrame:
    """pieces() with the sequence_id and offset of each.

    A null or empty text is the end id alone. Each row of docs is packed, also one whose id is null or comes again; an
    empty table has no pieces. Other columns are not looked at. Reruns give the same sequences.
    """
    found = common.kept(pieces(docs, tokenizer or tokens.default_tokenizer(), room))
    shards = max(1, -(-found.count() // shard))

    def pack(key, pdf):
        pdf = pdf.sort_values(["h", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        seq, offset = fitted(pdf["length"].to_numpy(), room)
        return pdf.assign(sequence_id=seq * shards + key[0], offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    h = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = found.withColumn("h", h).withColumn("shard", F.pmod("h", F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInPandas(pack, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
