import corpus_pipeline
from tests.llm import frames
from threadloom.llm import minhash, mixing, pii, quality_classifier, registry

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SMALL)
        if i < 4:
            assert made.columns == docs.columns
        before, after = docs.count(), made.count()
        assert 0 < after <= before
        docs = made
    assert docs.columns[-1] == "copies"
    text = " ".join(r["text"] for r in docs.select("text").collect())
    assert all(k >= len(pii.BASE) for _, k, _ in pii.find_spans(text)) or "<email>" in text


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = quality_classifier.keep_good(docs, labels)
    unique = minhash.keep_first(good)
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()}
    assert ids <= {r["doc_id"] for r in unique.select("doc_id").collect()}
    assert len(ids) > 0.5 * unique.count()


def test_run_leaves_the_session_as_it_was(spark):
    before = spark.conf.get(corpus_pipeline.BATCH_ROWS)
    corpus_pipeline.run(spark, SMALL)
    assert spark.conf.get(corpus_pipeline.BATCH_ROWS) == before


def test_stages_take_awkward_rows(spark, tmp_path):
    frames.labels(spark, [(4, 1), (5, 1)], "quality").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "an item of the benchmark, long enough")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (frames.awkward(spark), frames.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, str(tmp_path))
            assert made.count() <= docs.count()


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES)
    assert numbers == list(range(1, 14))
    assert mixing.WEIGHTS == (1, 2, 3)


def test_first_stage_takes_short_and_blank_texts(spark, tmp_path):
    texts = ["a good word " * 9, "%% ** " * 9, "De.", "x y", "", " ", None]
    docs = frames.documents(spark, texts).coalesce(1)
    frames.labels(spark, [(i, i % 2) for i in range(len(texts))], "quality").write.parquet(f"{tmp_path}/labels.parquet")
    kept = dict(corpus_pipeline.STAGES)["quality classifier"](spark, docs, str(tmp_path))
    assert set(kept.collect()) <= set(docs.collect()) and kept.columns == docs.columns
