"""Operator 4: the base by brute force, the model position by position, gradients by differences, held-out likelihood."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from intervalia.llm import lm, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw():
    return lm.rank_file(P.path(queries.RANKS))


def brute_base(rows):
    """id -> (held out, tokens, known, N, base) for (id, text) rows."""
    words = [(i, lm.words_of((t or "").encode())) for i, t in rows]
    train = [w for i, w in words if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(x for w in train for x in w)
    c[None] = len(train)
    c += Counter()
    n, v = sum(c.values()), len(c)
    out = []
    for i, w in words:
        tokens = [*w, None]
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(tokens), sum(c[x] > 0 for x in tokens), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)))
    return out


def compare(got, rows):
    key = lambda r: (str(r[0]), r[2])
    got, want = sorted(got, key=key), sorted(brute_base(rows), key=key)
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert all(math.isclose(r.base_score, w[5], rel_tol=1e-9, abs_tol=1e-9) for r, w in zip(got, want, strict=True))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    compare(queries.op4_lm_scoring(spark, SF).collect(), rows)


def test_better_than_the_base(spark):
    """On documents that neither the counts nor the model have seen."""
    got = queries.op4_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_odd(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 3)
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "Ab aB AB", "é É x", "w " * 50000, "\x00 \x1c y", "日本 語"])] + [(None, "ab new"), (3, "Ab aB AB")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id bigint, text string, score int, _word string")
    compare(lm.scored(docs, P.path(queries.RANKS)).collect(), rows)
    assert lm.scored(docs.limit(0), P.path(queries.RANKS)).count() == 0
    none = lm.scored(docs.where("doc_id is null"), P.path(queries.RANKS)).collect()
    assert [(r.n_known, r.train_tokens, round(r.base_score, 9)) for r in none] == [(0, 0, 0.0)]


def test_every_id_scored_once(raw):
    w = lm.started()
    scorer = lm.Scorer(w)
    pieces = lm.Pieces(raw)
    text = lm.sequences_of(pieces, [lm.words_of(b"the word of a text that is long enough to need several windows of the model " * 4)])[0]
    for n in (1, 7, 8, 15, 16, 17, 24, 25, len(text)):
        x = text[:n]
        stream = np.concatenate([[lm.END], x, np.full(lm.WINDOW, lm.END)]).astype(int)
        total = 0.0
        for i in range(n):
            first = 0 if i < lm.WINDOW else ((i - lm.WINDOW) // (lm.WINDOW - lm.OVERLAP) + 1) * (lm.WINDOW - lm.OVERLAP)
            state = lm.hidden(w, stream[first : first + lm.WINDOW][None])[0][0, i - first]
            total += lm.log_probabilities(w, state[None], x[i : i + 1].astype(int))[0]
        assert math.isclose(total, scorer.score([x[:3], x])[1], rel_tol=1e-4)


def test_probabilities_sum_to_one():
    w = lm.started()
    state = np.random.default_rng(1).normal(size=(1, lm.WIDTH)).astype(np.float32)
    everything = lm.log_probabilities(w, np.repeat(state, lm.PIECES + 1, 0), np.arange(lm.PIECES + 1))
    assert math.isclose((10**everything).sum(), 1, rel_tol=1e-4)


def test_gradient():
    w = {k: v.astype(np.float64) for k, v in lm.started().items()}
    r = np.random.default_rng(0)
    context, targets = (r.integers(0, lm.PIECES + 1, (2, lm.WINDOW)) for _ in range(2))
    g = lm.gradient(w, context, targets, np.ones((2, lm.WINDOW)))
    loss = lambda: -lm.log_probabilities(w, lm.hidden(w, context)[0].reshape(-1, lm.WIDTH), targets.ravel()).mean() * math.log(10)
    for k in w:
        at = tuple(r.integers(0, n) for n in w[k].shape)
        at = (context[0, 3], 5) if k == "E" else (targets[0, 1] // lm.GROUP, *at[1:]) if k in "Mm" else at
        keep = w[k][at]
        w[k][at] = keep + 1e-4
        up = loss()
        w[k][at] = keep - 1e-4
        down = loss()
        w[k][at] = keep
        assert math.isclose((up - down) / 2e-4, g[k][at], rel_tol=2e-2, abs_tol=1e-6)
