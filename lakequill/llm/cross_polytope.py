"""Near-duplicate vectors by cross-polytope hashing (Andoni et al., 2015).

A vector is turned by three rounds of random signs and a fast Hadamard transform; the coordinate of largest size, with
its sign, is a hash: the nearest vertex of the cross-polytope. A table's bucket joins several such hashes, the last
over fewer coordinates, so that the number of buckets follows the number of vectors. Each vector goes to its own
bucket of every table and, as multiprobe, to those which swap one hash for the nearest runner-up. Every pair that
meets in a bucket is verified by its cosine in double precision.

Vectors travel to buckets in which they meet another one only. A bucket larger than a block is cut into blocks, and
each pair of blocks is compared by one task as a matrix product. Pairs are never written: a task adds up each vector's
links, counting a pair in the first of its common buckets only, and joins groups to stars. Equal vectors are one class
from the start.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TABLES = 10
PROBES = 2
#: Buckets for each vector, as a power of two.
SPARE_BITS = 1
#: Rows of a bucket that are compared with each other at once.
BLOCK = 1024
_U = np.uint64


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d)


@functools.lru_cache(maxsize=64)
def _signs(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng(20_011 + dim).choice([-1.0, 1.0], size=(count, 3, dim))


def _plan(dim: int, bits: int) -> list[int]:
    """How many coordinates each hash of a table looks at: all of them, but for the last."""
    each = int(math.log2(2 * dim))
    full, rest = divmod(bits, each)
    return [dim] * full + ([1 << (rest - 1)] if rest else [])


def keys(x: np.ndarray, bits: int, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Bucket keys of unit vectors: a row each, with 1 + probes keys for every table, ordered by table."""
    n, d = x.shape
    dim = common.padded_bits(d)
    plan = _plan(dim, bits)
    padded = np.zeros((n, dim))
    padded[:, :d] = x
    signs = _signs(dim, tables * len(plan))
    out = np.empty((n, tables, 1 + probes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for t in range(tables):
            own, swaps, costs = [], [], []
            for i, wide in enumerate(plan):
                y = padded
                for s in signs[t * len(plan) + i]:
                    y = _hadamard(y * s)
                y = y[:, :wide] / np.linalg.norm(y, axis=1, keepdims=True)
                both = np.concatenate([y, -y], axis=1)
                few = min(1 + probes, both.shape[1])
                top = np.argsort(-both, axis=1, kind="stable")[:, :few]
                high = np.take_along_axis(both, top, 1)
                own.append(top[:, 0])
                for j in range(1, few):
                    swaps.append((i, top[:, j]))
                    costs.append(high[:, 0] - high[:, j])
            codes = [c.astype(np.uint64) for c in own]
            out[:, t, 0] = _key(codes, t, d)
            if probes:
                best = np.argsort(np.stack(costs, 1), axis=1, kind="stable")[:, :probes]
                made = np.stack([_key([c.astype(np.uint64) if j == i else codes[j] for j in range(len(plan))], t, d) for i, c in swaps], 1)
                found = np.take_along_axis(made, best, 1)
                out[:, t, 1 : 1 + found.shape[1]] = found
                out[:, t, 1 + found.shape[1] :] = out[:, t, :1]
    return out.reshape(n, -1).view(np.int64)


def _key(codes: list[np.ndarray], t: int, d: int) -> np.ndarray:
    h = np.full(codes[0].shape, _U(t * 1_000_003 + d))
    for c in codes:
        h = (h ^ c) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return h


def _usable(v) -> np.ndarray | None:
    """The vector in double precision, or None where it links with nothing."""
    if v is None or any(x is None for x in v):
        return None
    x = np.asarray(v, dtype=np.float64)
    return x if len(x) and np.isfinite(x).all() and x.any() else None


def _raw(df: DataFrame) -> DataFrame:
    def each(batch: pa.RecordBatch):
        col = batch.column(1)
        flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64) if col.flatten().null_count == 0 else None
        if flat is not None and col.null_count == 0:
            ends = np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())])
            vectors = [flat[a:b] for a, b in zip(ends, ends[1:])]
            vectors = [v if len(v) and np.isfinite(v).all() and v.any() else None for v in vectors]
        else:
            vectors = [_usable(v.as_py()) for v in col]
        raw = [None if v is None else v.tobytes() for v in vectors]
        yield {"vec_id": batch.column(0), "kind": pa.array([None if r is None else xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), "v": pa.array(raw, pa.binary())}

    return common.mapped(df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")), each, "vec_id long, kind binary, v binary")


def _units(raw: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places and unit vectors."""
    sizes = np.array([len(r) for r in raw])
    out = {}
    for s in np.unique(sizes):
        at = np.flatnonzero(sizes == s)
        x = np.frombuffer(b"".join(raw[i] for i in at), dtype=np.float64).reshape(len(at), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out[int(s)] = at, x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def _bucketed(kinds: DataFrame, bits: int) -> DataFrame:
    def each(batch: pa.RecordBatch):
        raw = batch.column(1).to_pylist()
        for at, x in _units(raw).values():
            k = keys(x, bits)
            # a key twice in a row would let a vector meet itself
            ids = np.repeat(batch.column(0).to_numpy()[at], k.shape[1])
            both = np.unique(np.stack([ids, k.ravel()], 1), axis=0)
            yield {"id": both[:, 0], "key": both[:, 1]}

    return common.mapped(kinds.select("id", "v"), each, "id long, key long")


def _compared(rows: DataFrame, bits: int, num: float) -> DataFrame:
    """rows(key, i, j, block, id, m, v), grouped by key, i, j and sorted: (id, n) of links and (id, other) of groups."""

    def pairs(key, i, j, block, ids, mult, raw, forest, links):
        for at, x in _units(raw).values():
            if len(at) < 2:
                continue
            own = at[block[at] == i], at[block[at] == j]
            place = {int(a): n for n, a in enumerate(at)}
            left, right = (np.array([place[int(a)] for a in o], dtype=int) for o in own)
            if not len(left) or not len(right):
                continue
            near = x[left] @ x[right].T >= num
            if i == j:
                near = np.triu(near, 1)
            if not near.any():
                continue
            p, q = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            near = near[np.ix_(p, q)]
            kp, kq = keys(x[left[p]], bits), keys(x[right[q]], bits)
            # a pair counts in the first common bucket, in the order of keys
            known = np.unique(np.concatenate([kp.ravel(), kq.ravel()]))
            known = known[known < key]
            if len(known):
                earlier = []
                for k in (kp, kq):
                    has = np.zeros((len(k), len(known) + 1), dtype=np.float32)
                    where = np.searchsorted(known, k)
                    where[k >= key] = len(known)
                    np.put_along_axis(has, where, 1, axis=1)
                    earlier.append(has[:, :-1])
                near &= ~(earlier[0] @ earlier[1].T > 0)
            lm, rm = mult[at[left[p]]], mult[at[right[q]]]
            for o, n in ((at[left[p]], near @ rm), (at[right[q]], near.T @ lm)):
                for a, c in zip(ids[o].tolist(), n.tolist()):
                    if c:
                        links[a] = links.get(a, 0) + int(c)
            a, b = np.nonzero(near)
            la, rb = ids[at[left[p]]], ids[at[right[q]]]
            for r in np.unique(a):
                for c in b[a == r].tolist():
                    forest.join(int(la[r]), int(rb[c]))

    def run(it):
        held, head = [], None
        forest, links = common.Forest(), {}

        def close():
            if len(held) and sum(len(h[1]) for h in held) > 1:
                block, ids, mult = (np.concatenate([h[n] for h in held]) for n in (0, 1, 2))
                pairs(*head, block, ids, mult, [r for h in held for r in h[3]], forest, links)

        for batch in common.batches(it):
            key, i, j, block, ids, mult = (batch.column(n).to_numpy() for n in range(6))
            raw = batch.column(6)
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, len(key)]):
                now = (int(key[a]), int(i[a]), int(j[a]))
                if now != head:
                    close()
                    held, head = [], now
                held.append((block[a:b], ids[a:b], mult[a:b], raw.slice(a, b - a).to_pylist()))
        close()
        found = [(a, None, n) for a, n in links.items()] + [(x, r, 0) for x in list(forest.up) if (r := forest.root(x)) != x]
        for s in range(0, len(found), 65536):
            part = found[s : s + 65536]
            yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in part], pa.int64()) for c in range(3)], names=["id", "other", "n"])

    return rows.mapInArrow(run, "id long, other long, n long")


def near_vectors(df: DataFrame, least: float = 0.95, in_one_task: int = common.LINKS_IN_ONE_TASK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of df(vec_id, embedding).

    n_links counts the other rows found with a cosine of at least ``least``; component_id is the smallest vec_id that
    links reach; kept tells rows whose vec_id it is. Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing, nor do vectors of different lengths or rows without an id (whose component_id is
    null and which are kept). Other columns of df are not looked at. Rows that repeat an id are rows of their own to
    n_links.
    """
    raw = common.kept(_raw(df))
    kinds = common.kept(raw.where("kind is not null and vec_id is not null").groupBy("kind").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.min("v").alias("v")))
    bits = max(8, round(math.log2(max(1, kinds.count()))) + SPARE_BITS)
    met = _bucketed(kinds, bits)
    met = common.kept(met)
    sizes = met.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    asked = met.join(sizes, "key").groupBy("id").agg(F.collect_list(F.struct("key", "blocks")).alias("asked"))
    rows = kinds.join(asked, "id").select("id", "m", "v", F.explode("asked").alias("x")).select("id", "m", "v", "x.key", "x.blocks")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "id", "m", "v")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found, _ = common.compact(_compared(rows, bits, least), "links")
    links = found.where("other is null").groupBy("id").agg(F.sum("n").alias("found"))
    groups = common.components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), in_one_task)
    done = kinds.select("kind", "id", "m").join(links, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    done = done.select("kind", (F.coalesce("found", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    out = raw.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("kind")).alias("kind")).join(done, "kind", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


#: The rows of near_vectors() with its defaults, in DuckDB's SQL: every pair compared, and a closure over links.
ORACLE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
counts AS (SELECT a, count(*) AS n FROM ways GROUP BY a),
reached AS (SELECT DISTINCT a AS node, a AS root FROM ways UNION SELECT w.b, r.root FROM reached r JOIN ways w ON w.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reached GROUP BY node)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN roots ON roots.node = vec_id
"""
