"""Operators 1, 7 and 9 against DuckDB and brute force, with odd inputs."""

import hashlib
import re

import duckdb

from intervalia.llm import linededup, pii, queries, urlfilter

SF = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    ok = [lambda m: True, lambda m: all(int(p) <= 255 for p in m[0].split(".")), lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15]
    return sorted((m.start(), k, m.end()) for k, p in enumerate((EMAIL, IP, CARD, PHONE)) for m in p.finditer(text or "") if ok[k](m))


def brute_row(text):
    spans = brute_base(text)
    joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    return (*(sum(k == i for _, k, _ in spans) for i in range(4)), hashlib.sha256(joined.encode()).hexdigest())


TEXTS = [
    None, "", "a@b.c_d@e.f x@y@z.w.v", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1 1.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111", "+1 (988) 555-2485. +1 2 +49 30 1234567 8",
    "é mail: ü.ö@x.de tel +4930123456 ip 10.0.0.1, " * 60, "1" * 40000, "a" * 40000 + "@", "4 " * 30000, "+1" + "(" * 20000, "name (at) host (dot) org", "4337166598464398 card 4337166598464399", "..@..", "x@a-b.c-d.e, %+-@z.q",
]


def test_base_spans(spark):
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, s int, spans string, base string")
    got = sorted(tuple(r)[:6] for r in pii.report(docs).collect())
    want = [(i, *brute_row(t)) for i, t, *_ in rows + rows[:3]]
    assert got == sorted(want)
    for r in pii.report(docs).collect():
        base = {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_base(TEXTS[r.doc_id])}
        assert base <= set(r.spans.split(","))  | ({""} if not base else set())
    assert pii.report(docs.limit(0)).count() == 0
    assert "b.c" not in "".join(r.text for r in pii.redact(docs).where("doc_id = 2").collect())


def test_pii_query(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_pii(spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert tuple(r)[1:6] == brute_row(text[r.doc_id])


def test_boosting_selects():
    """A threshold for each kind: cells of unknown candidates go by what their features share with labelled ones."""
    good, bad, unknown = "3|1|10|() -|1|1||.|.", "3|0|12||0|0||x|x", "3|1|10|() -|1|0||.|."
    table = [(good, half, 100, 99) for half in (True, False)] + [(bad, half, 100, 3) for half in (True, False)] + [(unknown, True, 0, 0)]
    assert pii.selected(table) == sorted([good, unknown])
    assert pii.selected([]) == []


def test_added_spans(spark):
    """Planted spellings that the base misses, secrets, and runs that are nothing of the kind."""
    rows, want, no = [], {}, {}
    for i in range(160):
        phone, card, key = f"(0{i % 90 + 10}) 555-{1000 + i}", f"{4000000000000000 + 7919 * i}", hashlib.sha1(str(i).encode()).hexdigest()
        text = f"word call +1 {phone} and mail some.{i}@mail{i % 9}.example.com thing token = \"{key}\" and 10.{i}.0.{i} also {card} end"
        if i % 8 == 0:
            extra = f" call {phone} now, mail name{i} (at) host (dot) org to \"{hashlib.sha1(text.encode()).hexdigest()}\" there"
            want[i] = [phone, f"name{i} (at) host (dot) org", hashlib.sha1(text.encode()).hexdigest(), key]
            text += extra
        no[i] = [] if luhn(card) else [card]
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: [dict(rows)[r.doc_id][int(s) : int(e)] for _, s, e in (x.split(":") for x in r.spans.split(","))] for r in pii.report(docs).collect()}
    hits = [any(x in y or y in x for y in found[i]) for i, xs in want.items() for x in xs]
    assert sum(hits) / len(hits) > 0.9
    assert not [x for i, xs in no.items() for x in xs if x in found[i]]


def test_url_filters(spark):
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.org/es/1?x#y", "http://a.example.org/en/12", "http://b.org", "http://b.org/", "http://x.com/fr/1", "http://x.com/de/1", "http://xcom/de/1", "ftp://u@h:8/a//b/c/d/e#f?g", "http://É.Net/Ä/1?q://z/"]
    rows = [(i, u, "h", "r", 1.0) for i, u in enumerate(urls)] + [(None, "http://x.com/de/", None, None, None), (4, urls[4], "h", "r", 1.0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, rule string, purity double")
    got = urlfilter.judge(pages).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got if r.page_id is not None}
    assert len(got) == len(rows)
    assert [by[i][:3] for i in range(4)] == [("", "", None)] * 4
    assert by[4] == ("example.org", "/es/1", "example.org/es/", "block") and by[5][2:] == ("example.org/en/1", "block")
    assert by[6][:3] == ("b.org", "", None) and by[7][2:] == ("org/", "allow")
    assert by[8][2:] == ("com/fr/", "allow") and by[9][2:] == ("com/de/", "block") and by[10][2] is None
    assert by[11][:3] == ("u@h:8", "/a//b/c/d/e", None) and by[12][:2] == ("É.net", "/Ä/1")
    assert urlfilter.judge(pages.limit(0)).count() == 0


def brute_tree(pages):
    """page_id -> verdict, purity, in plain Python from the module's description."""
    rows = []
    for i, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", re.sub("^[^/?#]*", "", rest))[0]
        bad = None
        for verdict, rule in sorted(urlfilter.RULES, key=lambda r: len(r[1])):
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                bad = int(verdict == "block")
        parts = [re.sub("[0-9]+", "{n}", re.sub("[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{16,}", "{x}", x)) for x in path.split("/", 3)[1:]]
        rows.append([i, host, bad, *(parts + ["", "", ""])[:3]])
    for level in range(3):
        groups = {}
        for r in rows:
            groups.setdefault((r[1], *r[3 : 3 + level]), []).append(r)
        for own in groups.values():
            kinds = len({r[3 + level] for r in own})
            if kinds > urlfilter.WIDE and len(own) < urlfilter.FEW * kinds:
                for r in own:
                    r[3 + level] = "*"

    def count(key):
        out = {}
        for r in rows:
            k, b = out.get(key(r), (0, 0))
            out[key(r)] = (k + (r[2] is not None), b + (r[2] or 0))
        return out

    hosts, first = count(lambda r: r[1]), count(lambda r: (r[1], r[3]))
    across = count(lambda r: tuple(r[3:]))
    for r in rows:
        (k, b), (hk, hb) = first[r[1], r[3]], hosts[r[1]]
        r.append("~" if k >= urlfilter.SURE and (b * hk - k * hb) ** 2 <= 4 * k * hb * (hk - hb) else r[3])
    branch, own, every = count(lambda r: (r[1], r[6])), count(lambda r: (r[1], r[6], r[4], r[5])), count(lambda r: 0)[0]
    out = {}
    for r in rows:
        p = every[1] / every[0] if every[0] else 0.0
        for k, b in (across[tuple(r[3:6])], hosts[r[1]], branch[r[1], r[6]], own[r[1], r[6], r[4], r[5]]):
            p = (b + urlfilter.WEIGHT * p) / (k + urlfilter.WEIGHT)
        out[r[0]] = ("block" if r[2] == 1 or (r[2] is None and p >= urlfilter.PURE) else "allow", round(p, 5))
    return out


def test_url_tree(spark):
    urls = [r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    # A host whose judged pages are all blocked: its other pages go by the host.
    urls += [f"http://bad.example.com/de/{k}/{k % 3}" for k in range(60)] + [f"http://bad.example.com/other/{k}" for k in range(9)] + ["http://bad.example.com/x/" + "ab12" * 6]
    # Variable segments.
    urls += [f"http://b.net/{chr(97 + k % 26)}{chr(97 + k // 26)}/z" for k in range(80)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.verdict, round(r.purity, 5)) for r in urlfilter.judge(pages).collect()}
    want = brute_tree(list(enumerate(urls)))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-5 for k in want)
    by = {urls[k]: v[0] for k, v in got.items()}
    assert by["http://bad.example.com/other/3"] == "block" and by["http://b.net/ab/z" if "http://b.net/ab/z" in by else "http://b.net/aa/z"] == "allow"
    assert {r.truth for r in urlfilter.agreement(pages).collect()} <= {0, 1}


def duck(sql):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.execute(sql).fetchall()


def test_url_query_in_sql(spark):
    assert sorted(map(tuple, queries.op7_url_filters(spark, SF).collect())) == sorted(duck(urlfilter.SQL))


def test_line_query_in_sql(spark):
    assert sorted(map(tuple, queries.op1_line_dedup(spark, SF).collect())) == sorted(duck(linededup.SQL))


def test_line_dedup_small(spark):
    page = "menu\n\nbody {}\n footer \t"
    rows = [(i, page.format(i), "a", 1, "x") for i in range(20)] + [(20, None, "a", 1, "x"), (21, "", "a", 1, "x"), (22, "menu\nfooter", "a", 1, "x"), (23, "menu\nmenu\nz", None, 1, "x"), (24, "menu\nq", None, 1, "x"), (None, "menu", "b", 1, "x"), (0, page.format(0), "a", 1, "x"), (25, "w\n" * 50000, "b", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _n int, _lines string")
    for limit in (linededup.BROADCAST, 0):
        got = {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in linededup.report(docs, limit=limit).collect()}
        assert {(0, 4, 2, "\nbody 0"), (7, 4, 2, "\nbody 7"), (20, 0, 0, None), (21, 1, 0, ""), (22, 2, 2, ""), (23, 3, 0, "menu\nmenu\nz"), (None, 1, 0, "menu")} <= got
        assert "menu\nfooter" in {r.text for r in linededup.clean(docs, limit=limit, spare=True).where("doc_id = 22").collect()}
        out = linededup.clean(docs, limit=limit)
        assert out.columns == docs.columns and out.count() == len(rows)
    assert linededup.report(docs.limit(0)).count() == 0
