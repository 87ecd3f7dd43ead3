"""The set join's lists: blocks against all pairs, and large clusters dealt out in small segments."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lakequill.llm import set_join

from .conftest import prose
from .test_text_operators import plain_classes


def listed(r, lists, num, den):
    rows = []
    for token in range(lists):
        n = r.choice((1, 2, 3, 9, 40, 150))
        ids = r.sample(range(400), n)
        rows += sorted(((token, i, r.randrange(5, 60), r.randrange(5), r.choice((7, i)), r.choice((-1, 3, i)), r.randrange(1, 40), 0, 0, 0) for i in ids), key=lambda x: (x[0], x[2], x[1]))
    return rows


def plain_across(rows, num, den):
    out = set()
    for x, a in enumerate(rows):
        for b in rows[x + 1 :]:
            if a[0] != b[0]:
                break
            (_, i, n1, p1, g1, l1, s1), (_, j, n2, p2, g2, l2, s2) = a[:7], b[:7]
            need = -(-(n1 + n2) * num // (num + den))
            if g1 == g2 or min(n1, n2) * den < max(n1, n2) * num or min(n1 - p1, n2 - p2) < need:
                continue
            if l1 == l2 and min(s1 + n2 - s2, s2 + n1 - s1) < need and min(s1, s2) >= 0:
                continue
            out.add((min(i, j), max(i, j)))
    return out


@pytest.mark.parametrize(("num", "den", "block", "size"), [(9, 10, 16, 10**6), (1, 2, 4, 97), (4, 5, 1, 10)])
def test_blocks_leave_out_no_pair(num, den, block, size):
    rows = listed(random.Random(block), 60, num, den)
    table = pa.table(dict(zip([*set_join._ENTRY, "i", "j", "seg"], map(list, zip(*rows, strict=True)), strict=True)))
    got = set()
    for batch in set_join._across(num, den, block)(table.to_batches(size)):
        got |= set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    assert got == plain_across(rows, num, den)


def test_derived_answers_rule_out_no_link():
    r = random.Random(3)
    lead = set(range(100))
    sets = []
    for _ in range(60):
        sets.append(set(r.sample(range(100), r.randrange(60, 100))) | {r.randrange(1000, 1040) for _ in range(r.randrange(30))})
    n, shared = np.array([len(s) for s in sets]), np.array([len(s & lead) for s in sets])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    kept = set_join._derived(i, j, n, np.zeros(60, dtype=np.int64), shared, 9, 10)
    links = np.array([len(sets[a] & sets[b]) * 10 >= len(sets[a] | sets[b]) * 9 for a, b in zip(i, j, strict=True)])
    assert not (links & ~kept).any()
    assert not kept.all()


@pytest.mark.parametrize(("bound", "segment"), [(0, 16), (10**6, 16)])
def test_large_clusters_in_small_segments(spark, bound, segment):
    """Clusters of many near copies, most pairs of which just miss or just reach the threshold."""
    r = random.Random(21)
    texts = []
    for copies, edits in ((90, 4), (60, 6)):
        w = prose(r, 160, 2000).split()
        for _ in range(copies):
            v = list(w)
            for _ in range(edits):
                v[r.randrange(len(v))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(v))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in set_join.classes(docs, 5, 4, 5, bound, segment).collect()}
    assert got == plain_classes(list(enumerate(texts)), 5, 4, 5)
