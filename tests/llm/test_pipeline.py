"""The corpus pipeline against brute force, stage by stage, on the smallest tables."""

from collections import Counter as Tally

import corpus_pipeline
from test_llm_operators import check_shards, plain_components, plain_contamination, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_keep_and_drop_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    toxic, near, leaks, mix, shard = (f for _, f in corpus_pipeline.STAGES)
    clean = toxic(spark, docs, SF)
    assert clean.columns == columns and 0 < clean.count() <= docs.count()
    rows = [(r.doc_id, r.text, r.source) for r in clean.collect()]
    classes = plain_components([r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows])
    one = near(spark, clean, SF)
    assert one.columns == columns and Tally(r.doc_id for r in one.collect()) == Tally(set(classes))
    rows = [(r.doc_id, r.text, r.source) for r in one.collect()]
    pure = leaks(spark, one, SF)
    assert pure.columns == columns and sorted(r.doc_id for r in pure.collect()) == sorted(x[0] for x in plain_contamination(rows, items) if not x[5])
    mixed = mix(spark, pure, SF)
    assert mixed.columns == columns
    rows = [(r.doc_id, r.text, r.source) for r in mixed.collect()]
    check_shards(shard(spark, mixed, SF).collect(), rows)
    assert Tally(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == Tally(r[0] for r in rows)


def test_only_the_last_table_stays(spark):
    import os

    from docflow.llm.common import shared_folder

    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF)
    assert [x.rpartition("-")[0] for x in set(os.listdir(folder)) - before] == ["pipeline-sharding"] and out.count() > 0
