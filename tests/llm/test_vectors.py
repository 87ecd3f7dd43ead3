import numpy as np
import pytest
from pyspark.sql import functions as F

from lakequill.llm import common, cross_polytope


def plain(vectors, least=0.95):
    ok = [v is not None and None not in v and len(v) > 0 and np.isfinite(v).all() and np.any(v) for v in vectors]
    links, forest = [0] * len(vectors), common.Forest()
    for a in range(len(vectors)):
        for b in range(a):
            if ok[a] and ok[b] and len(vectors[a]) == len(vectors[b]):
                x, y = (np.array(v, float) / np.abs(v).max() for v in (vectors[a], vectors[b]))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[a] += 1
                    links[b] += 1
                    forest.join(a, b)
    return {i: (links[i], forest.root(i)) for i in range(len(vectors))}


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(4)
    out = []
    for size in (1, 1, 2, 5, 30):
        centre = r.normal(size=64)
        out += [(centre + r.normal(size=64) * 0.15).tolist() for _ in range(size)]
    out += [r.normal(size=64).tolist() for _ in range(150)]
    out += [out[3], out[3], (np.array(out[3]) * 5).tolist(), [0.0] * 64, None, [1.0, None], [float("nan")] * 64, [float("inf")] * 64, [], [3.0], [5.0], [-1.0], [1e-300, 0.0], [1e300, 0.0]]
    return out


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int").repartition(3)


@pytest.mark.parametrize("block", [1024, 4])
def test_links_and_groups(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(cross_polytope, "BLOCK", block)
    got = {r.vec_id: (r.n_links, r.component_id) for r in cross_polytope.near_vectors(frame(spark, vectors)).collect()}
    wanted = plain(vectors)
    assert got == wanted
    kept = {r.vec_id for r in cross_polytope.near_vectors(frame(spark, vectors)).where("kept").collect()}
    assert kept == {i for i, (_, c) in wanted.items() if i == c}


def test_recall_near_the_threshold(spark):
    """Pairs whose cosine is just over 0.95, among many vectors."""
    r = np.random.default_rng(7)
    out = []
    for _ in range(400):
        x, y = r.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        y -= x * (x @ y)
        y /= np.linalg.norm(y)
        c = r.uniform(0.951, 0.96)
        out += [x.tolist(), (c * x + np.sqrt(1 - c * c) * y).tolist()]
    found = cross_polytope.near_vectors(frame(spark, out)).agg(F.sum("n_links")).first()[0] / 2
    assert found >= 0.95 * 400


def test_odd_rows(spark, vectors):
    df = frame(spark, vectors)
    for c in ("kind", "v", "id", "key", "m", "n", "kept", "n_links"):
        df = df.withColumn(c, F.lit(3))
    df = df.union(df.where("vec_id = 2").withColumn("vec_id", F.lit(None).cast("long")))
    got = cross_polytope.near_vectors(df).where("vec_id is null").first()
    assert (got.n_links, got.component_id, got.kept) == (0, None, True)
    assert cross_polytope.near_vectors(df.limit(0)).count() == 0


def test_the_transform_is_orthogonal():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.linalg.norm(cross_polytope._hadamard(x), axis=1) == pytest.approx(8 * np.linalg.norm(x, axis=1))
    assert cross_polytope.keys(x, 14).shape == (5, cross_polytope.TABLES * (1 + cross_polytope.PROBES))
