"""The pipeline's stages against brute force, each on its own input."""

import hashlib
import re

import corpus_pipeline as P
from tests.llm.test_free_style import brute_contamination
from tests.llm.test_nearcopy import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in rows}
            assert len(after) == len(rows)
        if name == "toxicity":
            gone = set(before) - set(after)
            insult = re.compile("idiot|moron|worthless|clown", re.I)
            assert len(gone) < len(before) / 4 and sum(bool(insult.search(t or "")) for t in after.values()) <= 2
        elif name == "line_dedup":
            assert set(after) == set(before) and all(set((after[d] or "").split("\n")) <= set((before[d] or "").split("\n")) for d in after)
        elif name == "near_copies":
            want = {d for d, _, _, kept in brute(list(before.items()), 80) if kept}
            assert after == {d: before[d] for d in want}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            hit = {d for d, w in zip(before, brute_contamination(list(before.values()), items), strict=True) if w[1] >= 8}
            assert set(after) == set(before) - hit
        else:
            assert {r.doc_id: r.decoded_sha256 for r in rows} == {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in before.items()}
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, rows))


def test_empty_and_odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0
    # Names that the stages use themselves, and names that are no identifiers.
    rows = [(None, None, "en", None, 0, 1, "x", 2, "y"), (1, "", "en", None, 0, 1, "x", 2, "y"), (2, "w " * 40000, "en", "s", 0, 1, "x", 2, "y"), (3, "a b c d e f", "en", "s", 0, 1, "x", 2, "y"), (4, "a b c d e f", "en", "s", 0, 1, "x", 2, "y")]
    clash = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _id int, _text string, `odd name:x` int, _row string")
    for name, stage in P.STAGES:
        out = stage(spark, clash, SF)
        assert name == "byte_bpe" or out.columns == clash.columns
        assert out.count() == 5 - (name == "near_copies")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], docs.schema)
    for _, stage in P.STAGES:
        assert stage(spark, odd, SF).count() == 3
