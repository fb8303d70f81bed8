"""Operator 4: the score mixes word counts of every training document with the model, whichever way a word's count travels; the model learns on from every one."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from intervalia.llm import lm, queries

SF = "/root/testdata/sf0.001"


def brute_scores(rows, w):
    """id -> score: word by word, from the model's probabilities and Counter's."""
    words = [lm.words_of((t or "").encode()) for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(x for t, h in zip(words, held, strict=True) if not h for x in t)
    once = sum(n == 1 for n in c.values())
    c[None] = held.count(False)
    n = sum(c.values())
    keep = 0.5 * (1 - once / n)
    pieces, scorer, out = lm.Pieces(lm.rank_file(P.path(queries.RANKS))), lm.Scorer(w), {}
    for (i, _), t in zip(rows, words, strict=True):
        each = [*(len(pieces.ids([x])[0]) for x in t), 1]
        found, at, total = scorer.positions(lm.sequences_of(pieces, [t])), 0, 0.0
        for x, k in zip([*t, None], each, strict=True):
            total += math.log10(keep * c[x] / n + (1 - keep) * 10 ** max(-300.0, found[at : at + k].sum()))
            at += k
        out[i] = total
    return out


@pytest.mark.parametrize("hot", [lm.HOT, 50, 0])
def test_all_training_documents_count(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "trained", lambda *_: lm.started())
    monkeypatch.setattr(lm, "refined", lambda *x: x[-1])
    monkeypatch.setattr(lm.hot_words, "__defaults__", (hot,))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_scores([(r.doc_id, r.text) for r in docs.collect()], lm.started())
    got = lm.scored(docs, P.path(queries.RANKS)).collect()
    assert len(got) == len(want) and all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-4) for r in got)


def test_every_training_document_teaches(spark):
    """The model's change comes from each task's training documents, and from these only."""
    from pyspark.sql import functions as F

    raw, start = lm.rank_file(P.path(queries.RANKS)), lm.started()
    docs = spark.createDataFrame([(i, "one two three four five " * 8) for i in range(400)], "doc_id bigint, text string").repartition(5)
    same = lm.refined(docs, F.lit(False), raw, start)
    assert all(np.array_equal(same[k], start[k]) for k in start)
    text = [lm.sequences_of(lm.Pieces(raw), [lm.words_of(b"one two three four five " * 8)])[0]]
    learned = lm.refined(docs, F.lit(True), raw, start)
    assert lm.Scorer(learned).score(text)[0] > lm.Scorer(start).score(text)[0]


def test_lists_hold_every_occurrence():
    rnd = np.random.default_rng(2)
    word, doc, q = rnd.integers(0, 5, 2000), rnd.integers(0, 7, 2000), rnd.integers(0, 3, 2000).astype(np.float32)
    words, offsets, at, found = lm.listed(word, doc, q)
    got = Counter()
    for k, w in enumerate(words):
        for j in range(offsets[k], offsets[k + 1]):
            got[int(w), int(at[j]) >> lm.COUNT_BITS, float(found[j])] += int(at[j]) & ((1 << lm.COUNT_BITS) - 1)
    assert got == Counter(zip(word.tolist(), doc.tolist(), q.tolist()))
    many = lm.listed(np.zeros(1_200_000, int), np.zeros(1_200_000, int), np.zeros(1_200_000, np.float32))
    assert sum(int(x) & ((1 << lm.COUNT_BITS) - 1) for x in many[2]) == 1_200_000
