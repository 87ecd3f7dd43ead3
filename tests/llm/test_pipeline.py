import corpus_pipeline
from lakequill.llm import common, packing, quality, queries, set_join, tokens, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = common.table(spark, FOLDER, "documents")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "ngram_jaccard_join", "mixing_sources", "best_fit_packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    raw = common.table(spark, FOLDER, "documents")
    good = {r.doc_id for r in quality.judged(raw).where("kept").collect()}
    clean = {r.doc_id for r in toxicity.scored(raw, common.table(spark, FOLDER, "labels")).where("predicted = 0").collect()}
    assert kept[0] == good and kept[1] == good & clean and kept[2] <= kept[1] and kept[3] <= kept[2]
    second = raw.where(raw.doc_id.isin(list(kept[1])))
    assert kept[2] == {r.doc_id for r in set_join.classes(second, 5, 4, 5).where("doc_id = component_id").collect()}
    pieces = packing.packed(docs, tokens.default_tokenizer()).collect()
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(out) == sorted(pieces) and {r.doc_id for r in out} == kept[3]


def test_every_query_runs(spark):
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == [1, 2, 3, 4, 5, 7, 8, 9, 10] or len(queries.queries()) == 10
    for name, query in queries.queries().items():
        assert query(spark, FOLDER).count() > 0, name
    assert set(queries.oracle_sql()) <= set(queries.queries())
