import corpus_pipeline
from foliant.llm import jaccard, quality


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    good = corpus_pipeline.keep_good(spark, docs, sf).cache()
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.score(docs, model).filter("predicted = 1").collect()}
    single = corpus_pipeline.drop_near_copies(spark, good, sf).cache()
    assert jaccard.linked(single).filter("n_links > 0 OR n_copies > 1").count() == 0
    bare = corpus_pipeline.drop_repeated_strings(spark, single, sf).cache()
    assert {r.doc_id for r in bare.collect()} == {r.doc_id for r in single.collect()}
    mixed = corpus_pipeline.mix_sources(spark, bare, sf).cache()
    assert good.columns == single.columns == bare.columns == mixed.columns == columns
    last = corpus_pipeline.encode(spark, mixed, sf)
    texts = {r.doc_id: r.text for r in bare.collect()}
    rows = last.collect()
    assert len(rows) == mixed.count() and all(r.text == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_every_stage_takes_odd_rows_and_empty_tables(spark, sf, odd_docs):
    for docs in (odd_docs, odd_docs.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            rows = out.collect()
            assert len(rows) <= 9 * 3 and ({"doc_id", "text"} <= set(out.columns)), name
            assert k == 4 or out.columns == docs.columns, name
            if docs is not odd_docs:
                assert not rows
    # of copies the least id stays, with all rows that it has
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, odd_docs, sf).filter("doc_id IN (1, 2)").collect()] == [1, 1]
