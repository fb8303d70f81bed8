"""Operator 5 against all pairs by brute force."""

import random

from intervalia.llm import nearcopy, queries

SF = "/root/testdata/sf0.001"


def brute(rows, share=85):
    """(id, n, component, kept) for (id, text) rows."""

    def items(t):
        w = bytes(t or "", "utf-8").lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < 5 else zip(w, w[1:], w[2:], w[3:], w[4:]))

    sets = [items(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= share * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def synthetic(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(rnd.randint(30, 200))] for _ in range(6)]
    hot = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 6])):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [" ".join(hot + [word() for _ in range(rnd.randint(0, 60))]) for _ in range(n)]
    texts += [None, "", " \n\t", "One", "one", "a b c d", "A B C  D", "a b c d e", "É b c d e f", "é b c d e f", "x " * 30000, "x x x x x", texts[0], texts[0] + " tail"]
    return texts


def test_matches_all_pairs(spark):
    for seed, block in ((1, nearcopy.BLOCK), (2, 7)):
        rows = [(5000 - i, t) for i, t in enumerate(synthetic(seed, 60))]
        docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id bigint, text string, component_id int, kept string")
        assert sorted(map(tuple, nearcopy.report(docs, block).collect())) == brute(rows)


def test_odd(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (None, None), (3, "")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nearcopy.report(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (2, 0, 2, True), (None, 0, None, True), (3, 0, 3, True)], key=str)
    assert nearcopy.report(docs.limit(0)).count() == 0
    assert sorted(nearcopy.keep_one(docs).collect(), key=str) == sorted([(1, "a b c d e f"), (2, None), (None, None), (3, "")], key=str)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op5_near_copies(spark, SF).collect()))
    assert got == brute(rows) and any(not r[3] for r in got)
