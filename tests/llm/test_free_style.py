"""Operators 2, 3, 6, 8 and 10 against brute force, exact round trips and held-out accuracy, with odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from intervalia.llm import bpe, decontam, langid, queries, topk, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, ids int, _text string"


def frame(spark, texts, lang="en"):
    rows = [(i, t, lang, f"s{i % 2}", len(t or ""), "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:1], DOCS)


ODD = [None, "", "   ", "a", "Straße ÄÖİ x", "\U0001f600 é 日本語テキスト", "a  b\n\n c\t\x0b\x1c d \n", "'s 're it's  1234 ... !!", "word " * 30000, "x" * 50000, "   nb", "<|endoftext|>"]


def test_bpe_round_trip(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path(queries.RANKS)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.rank_file(path)), special_tokens={})
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice(" \n\tab'stre1-_=éñ日́ .") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    docs = frame(spark, texts)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, path, P.PATTERN).collect())
    want = []
    for i, t in [*enumerate(texts), (0, texts[0])]:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    encoded = bpe.encode(docs, path, P.PATTERN)
    for r in bpe.decode(encoded, path, P.PATTERN).collect():
        assert r.text == (texts[r.doc_id] or "")
    for r in encoded.collect():
        text = texts[r.doc_id] or ""
        assert len(r.ids) == len(r.starts) == len(r.ends)
        assert all(0 <= a < b <= len(text) for a, b in zip(r.starts, r.ends, strict=True))
        assert not text or (r.starts[0] == 0 and r.ends[-1] == len(text))
    assert bpe.round_trip(docs.limit(0), path, P.PATTERN).count() == 0


def test_bpe_split_character():
    model = bpe.loaded(bpe.rank_file(P.path(queries.RANKS)), P.PATTERN)
    ids = model.encode_batch(["\U0001f9ff"])[0]
    assert len(ids) > 1 and model.decode_text(ids) == "\U0001f9ff" and "�" in model.decode_text(ids[:1])
    assert model.offsets(ids).tolist() == [[0, 1]] * len(ids)


def test_bpe_query(spark):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.rank_file(P.path(queries.RANKS))), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op3_byte_bpe(spark, SF).collect():
        ids = np.array(own.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def brute_contamination(texts, items, size=8):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = [(str(i), [w[k : k + size] for k in range(max(1, len(w) - size + 1))]) for i, w in ((i, low(t)) for i, t in items) if w]
    index = {}
    for i, ws in wins:
        for w in ws:
            index.setdefault(tuple(w), set()).add(i)
    lengths = {len(k) for k in index}
    out = []
    for t in texts:
        w, hit, found = low(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if own := index.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


@pytest.mark.parametrize("limit", [10**9, 40])
def test_contamination_small(spark, limit):
    items = [(1, "One two three four FIVE six seven eight nine"), (10, "tiny item"), (2, None), (3, " . "), (4, "tiny item"), (5, "é ü x")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = ODD + ["zero one, two three\nfour five six! seven eight nine ten TINY  item tiny", "one two three four five six seven", "tinyitem tiny-item é", "a tiny item tiny item b É ü x"]
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(decontam.scan(frame(spark, texts), bench, limit=limit)).collect())
    want = [(i, *x) for i, x in enumerate(brute_contamination(texts, items))]
    assert got == sorted(want + want[:1])
    for r in decontam.scan(frame(spark, texts), bench, limit=limit).collect():
        for a, b in r.spans:
            assert re.fullmatch(r"[^\W_].*[^\W_]", texts[r.doc_id][a:b], re.S)
    assert decontam.scan(frame(spark, texts).limit(0), bench).count() == 0
    assert {r.n_hit for r in decontam.report(decontam.scan(frame(spark, texts), bench.limit(0))).collect()} == {0}


def test_contamination_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_contamination([r.text for r in docs], items)
    got = queries.op8_decontamination(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r)[:6] for r in got] == [(d.doc_id, *w) for d, w in zip(docs, want, strict=True)]
    assert any(w[4] for w in want) or any(w[1] for w in want)


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd(spark):
    docs = frame(spark, ODD + ["the and of", "12 34", "\u00bd \u2460 \u0301"])
    rows = langid.identify_held_out(docs).collect()
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 13, 14)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id == 3} == {"en"}
    assert langid.identify_held_out(docs.limit(0)).count() == 0
    none = langid.identify_held_out(spark.createDataFrame([(None, "abc", None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()
    assert [(r.held_out, r.lang_pred) for r in none] == [(False, "und")]


def test_every_language_is_learned():
    """Many languages: their compressors are made in groups, with the same result."""
    words = {f"l{k}": " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in ("ra", "mo", "ti", "su")) * 20 for k in range(300)}
    content = langid.dictionaries({k: [langid.letters(t)] for k, t in words.items()})
    found = langid.Classifier(content).classify(list(words.values()))
    assert [x[0] for x in found] == list(words)
    assert langid.letters("\u0915\u094d\u0937\u093f 12 A") == "\u0915\u094d\u0937\u093f a".encode()


def test_contamination_in_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(map(tuple, queries.op8_decontamination(spark, SF).collect())) == sorted(con.execute(decontam.SQL).fetchall())


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_toxicity(spark, sf).collect()
    insult = re.compile("idiot|moron|worthless|clown", re.I)
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == len(text) and all(r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and label.get(r.doc_id) is not None]
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.9
    assert np.mean([r.predicted for r in rows if insult.search(text[r.doc_id])]) > 0.8


def test_toxicity_odd(spark):
    docs = frame(spark, ODD + ["you idiot", "fine words"])
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(14)] + [(3, None, 2), (None, 1, 3)], "doc_id bigint, toxic int, score int")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == len(ODD) + 3 and all(0 <= r.score <= 1 for r in rows)
    assert all(abs(r.score - 0.05) < 1e-9 for r in toxicity.classify(docs, labels.limit(0)).collect())
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def brute_top(rows, every, k):
    good = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out, done = [], set()
    for q, v in sorted(good):
        if q % every == 0 and q not in done:
            done.add(q)
            best = sorted((-dot(v, w), i) for i, w in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_odd(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "SHARD", 50)
    rnd = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=6).round(1)]) for i in range(300)]
    rows += [(300, None), (400, []), (500, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (600, [float("inf")] * 6), (700, [None, 1.0]), (None, [1.0] * 6), (800, [1e20, 1.0]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows], "vec_id bigint, embedding array<double>, rank int, score string")
    for every, k in ((10, 10), (1, 3)):
        small = [r for r in rows if r[0] != 800]
        assert sorted(map(tuple, topk.top_k(df.where("vec_id is null or vec_id <> 800"), every, k).collect())) == brute_top(small, every, k)
    assert topk.top_k(df, 10, 10).count() > 0
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id < 4"), 3, 10).count() == 6
