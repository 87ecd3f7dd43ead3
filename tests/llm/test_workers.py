"""Python workers live on after their tasks: there are few of them, and they let go of what other operators' tasks used."""

from __future__ import annotations

import pyarrow as pa

from lakequill.llm import common, tokens


def test_tasks_let_go_of_an_encoder_unless_they_use_it():
    tokens.encoder(tokens.default_tokenizer())
    list(common.trimmed(lambda it: it, "encoder")(iter([])))
    assert tokens.encoder.cache_info().currsize == 1
    list(common.trimmed(lambda it: it)(iter([])))
    assert tokens.encoder.cache_info().currsize == 0


def test_rows_are_picked_and_mapped_in_one_step(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(300)] + [(None, "none")], "doc_id long, text string")
    made = common.likely(rows, rows.where("doc_id % 50 = 7").select("doc_id"), lambda b: [{"doc_id": b.column(0), "n": pa.array([len(t) for t in b.column(1).to_pylist()], pa.int64())}], "doc_id long, n long")
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    found = {r["doc_id"]: r["n"] for r in made.collect()}
    assert {i: len(f"t{i}") for i in range(7, 300, 50)}.items() <= found.items() and None not in found and len(found) < 20
