"""op7 deals texts out as bundles of compressed ones."""

from __future__ import annotations

import pyarrow as pa
import zstandard

from lakequill.llm import context_tree


def _opened(bundle):
    whole, at = zstandard.ZstdDecompressor().decompress(bundle["texts"]), 0
    for row, doc_id, held_out, size in zip(bundle["rows"], bundle["doc_ids"], bundle["held_outs"], bundle["sizes"], strict=True):
        yield bundle["block"], row, doc_id, held_out, whole[at : at + size]
        at += size


def test_bundles_hold_every_text_of_one_block():
    texts = [None, "", "one two ä", "x " * 700_000, None] + [f"some words of text {i}, and words again" for i in range(3000)]
    rows = [(i // 1100, i, None if i == 2 else i * 7, i % 3 == 0, t) for i, t in enumerate(texts)]
    schema = pa.schema([("block", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string())])
    batches = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema).to_batches(max_chunksize=700)
    bundles = [b for batch in context_tree._bundled(iter(batches)) for b in batch.to_pylist()]
    assert [x for b in bundles for x in _opened(b)] == [(*r[:4], (r[4] or "").encode()) for r in rows]
    assert all(b["row"] == b["rows"][0] and len(b["rows"]) <= context_tree.MOST_IN_BUNDLE for b in bundles)
    assert sum(len(b["texts"]) for b in bundles) * 4 < sum(len(t or "") for t in texts)


def test_bundles_of_nothing_but_empty_texts():
    batch = pa.RecordBatch.from_pydict({"block": [0, 0], "row": [0, 1], "doc_id": [4, 5], "held_out": [True, False], "text": pa.array([None, ""], pa.string())})
    (bundle,) = (b for x in context_tree._bundled(iter([batch])) for b in x.to_pylist())
    assert [x[4] for x in _opened(bundle)] == [b"", b""]
