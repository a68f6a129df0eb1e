"""The pipeline: each stage's decisions take effect and all but the last keep the columns of documents."""

import corpus_pipeline as P
from weftline.llm.common import read

D = "/root/testdata/sf0.01"


def test_stages_in_a_row(spark, tmp_path):
    docs = read(spark, D, "documents")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, D)
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
            assert seen[name] <= {r.doc_id for r in before.select("doc_id").collect()}
    labels = {r.doc_id: r for r in read(spark, D, "labels").collect()}
    everyone = {r.doc_id for r in read(spark, D, "documents").select("doc_id").collect()}
    good = {i for i, r in labels.items() if r.quality == 1} & everyone
    assert seen["line_dedup"] == seen["quality_rules"]
    assert seen["packing"] == seen["mix_sources"] < seen["near_dedup"] < seen["line_dedup"] < everyone
    assert len(good & seen["quality_rules"]) > 0.9 * len(good)


def test_run_and_empty_tables(spark, tmp_path):
    for t in ("documents", "labels"):
        read(spark, D, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
