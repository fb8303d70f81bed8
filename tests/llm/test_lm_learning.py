"""Operator 4 learns from every id of every training document."""

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from intervalia.llm import lm, queries


@pytest.fixture(scope="module")
def raw():
    return lm.rank_file(P.path(queries.RANKS))


def test_every_id_is_a_target_once(raw):
    pieces = lm.Pieces(raw)
    texts = [b"one", None, b"", b"A text of several windows " * 30, b" \n", b"x " * 16, b"last of all"]
    source = lm.Windows(pieces, pa.array(texts, pa.binary()))
    sequences = lm.sequences_of(pieces, [lm.words_of(t) for t in texts])
    context, targets, weight = source.take(np.arange(len(source)))
    assert targets[weight > 0].tolist() == np.concatenate(sequences).tolist()
    before = np.concatenate([np.append(lm.END, s[:-1]) for s in sequences])
    assert context[weight > 0].tolist() == before.tolist()


def test_every_place_teaches(spark, raw):
    """A change of any one word of a long text changes what is learnt."""
    from pyspark.sql import functions as F

    words = ["one two three four five".split()[i * i % 5] for i in range(4000)]

    def learnt(at):
        text = " ".join("other" if i == at else x for i, x in enumerate(words))
        return lm.flat(lm.refined(spark.createDataFrame([(1, text)], "doc_id bigint, text string").coalesce(1), F.lit(True), raw, lm.started()))

    same = learnt(None)
    assert np.array_equal(same, learnt(None))
    assert all(not np.array_equal(same, learnt(at)) for at in (0, 777, 1999, 3210, 3999))


def test_rounds_share_out_all_documents(spark, raw, monkeypatch):
    """No sample: the rounds together read each training document once, and no other."""
    from pyspark.sql import functions as F

    seen = []

    def refined(docs, rule, raw, start, *more):
        seen.append([r.doc_id for r in docs.where(rule).collect()])
        return start

    monkeypatch.setattr(lm, "refined", refined)
    docs = spark.createDataFrame([(i, "a few words") for i in range(3000)] + [(None, "no id")], "doc_id bigint, text string")
    lm.trained(docs, F.coalesce(F.col("doc_id") % 5 != 1, F.lit(False)), raw, 3000 * 4)
    assert sorted(i for x in seen for i in x) == [i for i in range(3000) if i % 5 != 1]
    assert 0 < len(seen[0]) < len(seen[1]) < len(seen[2])


def test_gradient_in_lots():
    """Any lots give the same gradient, and weights of zero leave positions out."""
    w, r = {k: v.astype(np.float64) for k, v in lm.started().items()}, np.random.default_rng(5)
    context, targets = (r.integers(0, lm.PIECES + 1, (70, lm.WINDOW)) for _ in range(2))
    weight = (r.random((70, lm.WINDOW)) < 0.7).astype(np.float64)
    whole, lots = lm.gradient(w, context, targets, weight, 1000, 10**6), lm.gradient(w, context, targets, weight, 32, 100)
    targets[weight == 0] = 7
    others = lm.gradient(w, context, targets, weight)
    parts = [lm.gradient(w, context[x], targets[x], weight[x]) for x in (slice(0, 30), slice(30, 70))]
    share = weight[:30].sum() / weight.sum()
    assert set(whole) == set(w)
    for k in w:
        assert np.allclose(whole[k], lots[k], atol=1e-12) and np.allclose(whole[k], others[k], atol=1e-12)
        assert np.allclose(whole[k], share * parts[0][k] + (1 - share) * parts[1][k], atol=1e-12)
