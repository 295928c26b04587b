"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline
from brindle.llm import decontaminate, runtime
from tests.llm.common import awkward, empty, words
from tests.llm.test_minhash import brute as groups
from tests.llm.test_packing import check
from tests.llm.test_repeats import brute as repeats


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, inputs = docs.columns, []
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs.collect())
        docs = runtime.materialise(stage(spark, docs, sf))
        assert at == 4 or docs.columns == columns
    toxic_in, near_in, repeat_in, leak_in, pack_in = inputs
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rejected = {r.doc_id for r in toxic_in} - {r.doc_id for r in near_in}
    assert rejected and all(marks.get(i, 1) for i in rejected)
    gone = {i for i, _ in groups(sorted((r.doc_id, r.text) for r in near_in))}
    assert {r.doc_id for r in repeat_in} == {r.doc_id for r in near_in} - gone
    spans = repeats([(r.doc_id, r.text) for r in repeat_in], 50)
    want = {r.doc_id: [w for i, w in enumerate(words(r.text)) if i not in spans.get(r.doc_id, ())] for r in repeat_in}
    assert {r.doc_id: words(r.text) for r in leak_in} == {i: w for i, w in want.items() if w or not spans.get(i)}
    leaks = decontaminate.leaks(spark.createDataFrame(leak_in), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    assert {r.doc_id for r in pack_in} == {r.doc_id for r in leak_in} - {r.doc_id for r in leaks}
    check(docs.collect(), {r.doc_id: len(words(r.text)) + 1 for r in pack_in}, 2048)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_awkward_and_empty_tables(spark, sf, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns go through all stages."""
    labels = spark.createDataFrame([(1, 0, 0), (2, None, None), (None, 1, 1), (6, 0, 0), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "naïve ünïcode ☃ " * 8), (2, None), (None, "short")], "item_id bigint, text string")
    for name, docs in (("awkward", awkward(spark)), ("empty", empty(spark))):
        folder = tmp_path / name
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
            df.write.parquet(f"{folder}/{table}.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        schema, before = now.dtypes, now.count()
        for at, (stage, work) in enumerate(corpus_pipeline.STAGES):
            now = runtime.materialise(work(spark, now, str(folder)))
            if at < 4:
                assert now.dtypes == schema, stage
                if name == "awkward":
                    assert now.where("doc_id is null").count() == 2, stage
                    assert {r.doc_id for r in now.where("doc_id in (3, 4, 5, 7, 11)").collect()} == {3, 4, 5, 7, 11}, stage
            if stage == "near_duplicates" and name == "awkward":
                assert now.where("doc_id = 10").count() == 0 and now.where("doc_id = 1").count() == 1
            if stage == "repeated_passages" and name == "awkward":  # a text that repeats three words keeps them once
                assert {r.text.strip() for r in now.where("doc_id = 9").collect()} == {"naïve ünïcode ☃"}
        assert (now.count() > 0) == (before > 0)
        assert corpus_pipeline.run(spark, str(folder)).count() == now.count()
