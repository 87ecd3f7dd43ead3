"""The context tree kept in a table, against the tree in one place."""

import inspect
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakequill.llm import context_tree

from .conftest import prose


def test_the_table_scores_as_the_whole_tree_does(spark, docs, monkeypatch):
    monkeypatch.setattr(context_tree, "TOGETHER", 500)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tree = context_tree.fit_tree(spark.createDataFrame([x for x in rows if not held[x[0]]], "doc_id long, text string"))
    look = context_tree.Lookup(tree)
    for block in (1, 5000, context_tree.BLOCK):
        got = {r.doc_id: r.score for r in context_tree.scored(docs, block=block).collect()}
        assert len(got) == len(rows)
        for i, text in rows:
            assert got[i] == pytest.approx(look(context_tree.events([context_tree.normal(text and text.encode())[1]])[0]).sum(), rel=1e-5)


def test_nothing_is_merged_however_many_entries(spark):
    assert "entries" not in inspect.signature(context_tree.scored).parameters
    r = random.Random(3)
    keys = np.unique([context_tree.events([prose(r, 3000, 3000).encode()])[0]])
    counts = spark.createDataFrame([(int(k), 1 + int(k) % 5) for k in keys], "key long, n long")
    got = {x.key: x.p for x in context_tree.log_probabilities(counts).collect()}
    tree = context_tree.Tree(keys, 1 + keys % 5)
    assert sorted(got) == keys.tolist()
    assert [got[k] for k in keys.tolist()] == pytest.approx(tree.log10.tolist(), rel=1e-4)
    assert counts.agg(F.sum("n")).first()[0] == int((1 + keys % 5).sum())
