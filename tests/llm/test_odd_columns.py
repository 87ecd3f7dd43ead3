"""Long clean texts, and stages over columns whose names an operator might use for itself."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lakequill.llm import mixing, quality, set_join

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es"])
def test_long_clean_texts_stay_within_their_bands(lang):
    """Good documents of a language, each taken once, in texts of 0.2 to 5 MB as far as they reach; and a repetitive text."""
    rows = duckdb.sql(f"SELECT DISTINCT text FROM '{FOLDER}/documents.parquet' JOIN '{FOLDER}/labels.parquet' USING (doc_id) WHERE quality = 1 AND toxic = 0 AND lang = '{lang}'").fetchall()
    judge = quality.Judge()
    texts = sorted(r[0].encode() for r in rows)
    random.Random(1).shuffle(texts)
    whole = b"\n".join(texts)
    for size in (200_000, 500_000, 1_500_000, 5_000_000):
        if len(whole) >= size:
            assert judge(whole[:size])[0], (lang, size, judge(whole[:size]))
    assert not judge(whole[:40_000] * 20)[0]


def test_tails_are_judged():
    judge = quality.Judge()
    noise = bytes(random.Random(2).randrange(33, 126) for _ in range(2000))
    same = b"the same words " * 600
    assert judge(same[: 2048 * 2] + noise)[2:] == (3, 3)


def test_stages_take_fresh_names(spark, docs):
    odd = docs
    for c in ("_h", "_n", "_s", "_whole", "_threshold", "_gone", "mix_hash", "mix_n", "mix_source", "MIX_WHOLE", "gone", "_g"):
        odd = odd.withColumn(c, F.lit(3))
    for stage in (mixing.repeated, set_join.deduplicated, quality.passing):
        plain, got = stage(docs), stage(odd)
        assert got.columns == odd.columns
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in plain.select("doc_id").collect())
