"""The near-copy stage of the pipeline against brute force at a similarity of 0.80."""

import corpus_pipeline as P
from intervalia.llm import nearcopy
from tests.llm.test_nearcopy import brute, synthetic


def test_stage_links_at_80(spark):
    rows = [(5000 - i, t) for i, t in enumerate(synthetic(3, 60))]
    # 20, 25 and 26 runs of five words: 20 of 25 is linked, 20 of 26 alone is not.
    word = [f"w{k}" for k in range(30)]
    rows += [(9000, " ".join(word[:24])), (9001, " ".join(word[:29])), (9002, " ".join(word[:30]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()}
    want = {d for d, _, _, kept in brute(rows, 80) if kept}
    assert got == want and 9000 in got and 9001 not in got
    assert want != {d for d, _, _, kept in brute(rows) if kept}


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()) == [d for d, _, _, kept in brute(rows, 80) if kept]


def test_keys_of_shares():
    assert [len(nearcopy.subsets(s)) for s in (85, 80)] == [40, 50]
