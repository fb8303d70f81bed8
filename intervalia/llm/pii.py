"""Personal data by candidate gradient boosting, in DataFrame operations only.

1. Base spans: each kind's pattern, leftmost and non-overlapping, with its check (octets, Luhn, number of digits). They always stay.
2. Candidates: three high-recall patterns, whose matches may overlap: around @ and its spellings; runs of digits with separators, which get a kind by their form; long runs of
   letters and digits, of the kind secret. Each has a check (a name at the end of a host, octets, Luhn, number of digits and no letter beside them, letters and digits mixed), format
   features (digits or length, separators or alphabet, bracket, plus) and context features (cue word before it, what stands on either side), all of a few values, so
   that a candidate is one of a bounded number of cells.
3. Labels: a candidate that overlaps a base span is personal, and so is each such span in another spelling (@ and dots as words, a phone number without its country code, a card with
   dots), which the base would not find; a secret is personal where a word such as token or password stands before it, which is none of its features. A candidate that fails its check
   is not personal. All others are unknown. Over all texts, candidates are counted by cell and label. Boosted trees of depth two are fitted to the counts of a random half of the texts
   (by a hash); the other half calibrates a threshold for each kind: the lowest score, of even odds at least, at which PRECISION of its labelled candidates are personal. Counts are sums over
   cells, so the driver gets a table whose size does not depend on the data.
4. Candidates at or over their kind's threshold that pass their check and overlap no base span are added.

Positions come from the gaps between matches, in code points. Patterns start only where a match of the contract's pattern can start, and use
possessive groups: no run of characters is scanned from each of its positions, none needs a deep stack.

Defined cases: a null text is an empty text; empty texts have no spans and the digest of nothing; spans of different kinds may overlap, added ones overlap nothing
in the base; repeated rows give repeated results; without candidates nothing is added; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of the base, and one that only the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: The contract's patterns, in forms that need no backtracking from every position.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without a match of this has no match of the pattern.
NEEDS = {"email": "@[A-Za-z0-9-]++[.]", "ip": "[0-9][.][0-9]", "card": "[0-9][ -]?[0-9]", "phone": "[+][0-9]"}
AT = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:@|[(\[](?:at|AT)[)\]]) ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]++)*+"
RUN = r"(?<![0-9])[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,}+"
KEY = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+"
CUE = r"(?i)(mail|phone|tel|call|fax|card|visa|account|server|host|address|ip)[^ ]* $"
KEY_CUE = r"(?i)(key|token|secret|passw(or)?d|pwd|bearer|auth)[^A-Za-z0-9]{1,5}$"
PRECISION = 0.98
ROUNDS, SHRINK, SMOOTH = 40, 0.3, 1.0
FEATURES = ("kind", "check", "digits", "separators", "bracket", "plus", "cue", "before", "after")


def matches(text: Column, kind_pattern: str, needs: str) -> Column:
    """array<struct<a, m>>: the gap before each match, and the match."""
    pattern = F.lit(kind_pattern)
    empty = F.expr("cast(array() as array<struct<a:int,m:string>>)")
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, kind_pattern, -1)
    zipped = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("a"), m.alias("m")))
    return F.when(text.rlike(needs), zipped).otherwise(empty)


def valid(kind: str) -> str:
    """SQL test of a match x.m."""
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    luhn = (
        f"aggregate(sequence(1, length({digits})), 0L, (t, i) -> t + case when (length({digits}) - i) % 2 = 0 then cast(substr({digits}, i, 1) as int) "
        f"else (2 * cast(substr({digits}, i, 1) as int)) div 10 + (2 * cast(substr({digits}, i, 1) as int)) % 10 end) % 10 = 0"
    )
    return {
        "email": "true",
        "ip": "x.m rlike '^(0*+(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)[.]){3}0*+(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)$'",
        "card": f"case when length(x.m) between 12 and 37 and length({digits}) between 12 and 19 then {luhn} else false end",
        "phone": f"length({digits}) between 9 and 15",
    }[kind]


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, _t (text), _base array<struct<s, k, e>>: start, place of the kind in KINDS, end; in order."""
    df = docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("_t"))
    df = df.select("*", *[matches(F.col("_t"), PATTERNS[k], NEEDS[k]).alias(f"_m_{k}") for k in BASE])
    df = df.select("doc_id", "_t", *[F.expr(f"case when size(_m_{k}) = 0 then cast(array() as array<struct<s:int,e:int,m:string>>) else {placed_text(k)} end").alias(f"_p_{k}") for k in BASE])
    spans = [F.expr(f"transform(filter(_p_{k}, x -> {valid(k)}), x -> struct(x.s as s, {i} as k, x.e as e))") for i, k in enumerate(BASE)]
    return df.select("doc_id", "_t", F.array_sort(F.concat(*spans)).alias("_base"))


def placed_text(kind: str) -> str:
    return PLACED.replace("{name}", f"_m_{kind}")


PLACED = """flatten(aggregate(
  sequence(0, greatest(size({name}) - 1, 0) div 128),
  struct(0 as at, cast(array() as array<array<struct<s:int,e:int,m:string>>>) as out),
  (acc, b) -> struct(
    cast(acc.at + aggregate(slice({name}, b * 128 + 1, 128), 0, (t, x) -> t + x.a + length(x.m)) as int) as at,
    concat(acc.out, array(aggregate(slice({name}, b * 128 + 1, 128),
      struct(acc.at as at, cast(array() as array<struct<s:int,e:int,m:string>>) as out),
      (q, x) -> struct(cast(q.at + x.a + length(x.m) as int) as at, concat(q.out, array(struct(cast(q.at + x.a as int) as s, cast(q.at + x.a + length(x.m) as int) as e, x.m as m))) as out),
      q -> q.out))) as out),
  acc -> acc.out))"""


DIGITS = "length(regexp_replace({m}, '[^0-9]', ''))"


def beside(c: str, none: str) -> str:
    """The class of a neighbouring character."""
    return f"case when {c} = '' then '{none}' when {c} rlike '[0-9A-Za-z]' then 'x' when {c} rlike '[[:space:]]' then ' ' when ascii({c}) in (34, 39, 96) then 'q' else '.' end".replace("[[:space:]]", "[ \\\\t\\\\n]")


def cell(m: str) -> str:
    """The features of x in the spelling m, in the order of FEATURES."""
    digits = DIGITS.format(m=m)
    return f"""concat_ws('|', x.k, cast(x.ok as int),
      case when x.k = 4 then least(length({m}) div 8, 8) else least({digits}, 20) end,
      case when x.k = 0 then case when {m} like '%@%' then '@' else 'at' end
        when x.k = 4 then case when {m} rlike '^[0-9a-f]+$' then 'hex' when {m} rlike '^[0-9A-Z]+$' then 'upper' else 'mixed' end
        else substr(regexp_replace({m}, '[0-9A-Za-z+]', ''), 1, 4) end,
      cast({m} like '%(%' as int), cast({m} like '%+%' as int), x.cue, x.before, x.after)"""


def candidates(based: DataFrame) -> DataFrame:
    """Adds _cand array<struct<s, k, e, hit, ok, cell, rows>>: hit if it overlaps a base span, ok if it passes its check, cell: its features; rows: what it teaches, as cell and label."""
    found = {"at": (AT, "@|(?i)[(\\[]at[)\\]]"), "run": (RUN, "[0-9]"), "key": (KEY, "[A-Za-z0-9_-]{16}")}
    df = based.select("*", *[matches(F.col("_t"), pattern, needs).alias(f"_m_{n}") for n, (pattern, needs) in found.items()])
    digits = DIGITS.format(m="x.m")
    run = f"case when x.m rlike '^[0-9]+([.][0-9]+){{3}}$' then 1 when {digits} between 12 and 19 and x.m rlike '^[0-9](?:[ .-]?[0-9])++$' then 2 else 3 end"
    kinds = {"at": "0", "run": run, "key": "4"}
    none = "cast(array() as array<struct<s:int,e:int,m:string,k:int>>)"
    each = ", ".join(f"case when size(_m_{n}) = 0 then {none} else transform({placed_text(n)}, x -> struct(x.s as s, x.e as e, x.m as m, cast({k} as int) as k)) end" for n, k in kinds.items())
    df = df.select("doc_id", "_t", "_base", F.expr(f"concat({each})").alias("_all"))
    before, after = beside("substr(_t, x.s, least(x.s, 1))", "^"), beside("substr(_t, x.e + 1, 1)", "$")
    ok = f"""case when x.k = 0 then x.m rlike '([.]|(dot|DOT)[)\\\\]]) ?[A-Za-z]{{2,}}$' when x.k = 1 then {valid("ip")} when x.k = 2 then {valid("card")}
      when x.k = 3 then {digits} between 9 and 15 and {before} <> 'x' and {after} <> 'x' else x.m rlike '[0-9]' and x.m rlike '[A-Za-z]' and length(x.m) >= 20 end"""
    back = "substr(_t, greatest(x.s - 15, 1), least(x.s, 16))"
    cue = f"case when x.k = 4 then '' else lower(regexp_extract({back}, '{CUE}', 1)) end"
    known = f"""transform(_all, x -> struct(x.s as s, x.k as k, x.e as e, x.m as m, exists(_base, b -> b.s < x.e and x.s < b.e) as hit, {ok} as ok,
      {cue} as cue, x.k = 4 and {back} rlike '{KEY_CUE}' as named, {before} as before, {after} as after))"""
    df = df.select("doc_id", "_t", "_base", F.expr(known).alias("_all"))
    # Other spellings of what the base finds: they stand for what it misses.
    other = {
        0: "replace(replace(x.m, '@', ' (at) '), '.', ' (dot) ')",
        2: "regexp_replace(x.m, '[ -]', '.')",
        3: "regexp_replace(x.m, '^[+][0-9]{1,3}[ .-]?', '')",
    }
    spelled = " ".join(f"when x.hit and x.k = {k} then array(struct({cell(m)} as cell, true as y))" for k, m in other.items())
    empty = "cast(array() as array<struct<cell:string,y:boolean>>)"
    label = "case when x.hit or (x.named and x.ok) then true when not x.ok then false end"
    rows = f"concat(array(struct({cell('x.m')} as cell, {label} as y)), case {spelled} else {empty} end)"
    return df.select("doc_id", "_t", "_base", F.expr(f"transform(_all, x -> struct(x.s as s, x.k as k, x.e as e, x.hit as hit, x.ok as ok, {cell('x.m')} as cell, {rows} as rows))").alias("_cand"))


def counts(cands: DataFrame) -> list[tuple[str, bool, int, int]]:
    """cell, half, labelled candidates, personal ones: sums over all texts; the number of cells is bounded by the features' values."""
    half = (F.pmod(F.xxhash64("_t"), F.lit(2)) == 0).alias("half")
    rows = cands.select(half, F.explode(F.flatten("_cand.rows")).alias("c")).groupBy("c.cell", "half").agg(F.count("c.y").alias("n"), F.count_if("c.y").alias("hits"))
    return [(r.cell, r.half, r.n, r.hits) for r in rows.collect()]


def boosted(cells: list[tuple[str, ...]], n: list[float], hits: list[float], rounds: int = ROUNDS) -> list[float]:
    """Scores of the cells by gradient-boosted trees of depth two: each split is feature = value or not, chosen by the gain in logistic loss."""
    total, positive = sum(n), sum(hits)
    score = [math.log((positive + SMOOTH) / (total - positive + SMOOTH))] * len(cells)
    tests = sorted({(j, c[j]) for c in cells for j in range(len(c))})

    def best(rows: list[int], g: list[float], h: list[float]) -> tuple[float, tuple[int, str] | None]:
        gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
        sums = dict.fromkeys(tests, (0.0, 0.0))
        for i in rows:
            for t in enumerate(cells[i]):
                a, b = sums[t]
                sums[t] = (a + g[i], b + h[i])
        value = lambda a, b: a * a / (b + SMOOTH)
        gains = [(value(a, b) + value(gs - a, hs - b) - value(gs, hs), t) for t, (a, b) in sums.items() if 0 < b < hs]
        return max(gains, default=(0.0, None))

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [y - m * q for y, m, q in zip(hits, n, p, strict=True)]
        h = [m * q * (1 - q) for m, q in zip(n, p, strict=True)]
        leaves = [list(range(len(cells)))]
        for _ in range(2):
            grown = []
            for rows in leaves:
                gain, test = best(rows, g, h)
                grown += [[i for i in rows if (cells[i][test[0]] == test[1]) == side] for side in (True, False)] if test and gain > 1e-9 else [rows]
            leaves = grown
        for rows in leaves:
            step = SHRINK * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + SMOOTH)
            for i in rows:
                score[i] += step
    return score


def selected(table: list[tuple[str, bool, int, int]], precision: float = PRECISION) -> list[str]:
    """The cells whose score reaches their kind's calibrated threshold."""
    names = sorted({c for c, *_ in table})
    if not names:
        return []
    by = {(c, half): (n, hits) for c, half, n, hits in table}
    fit, rest = ([by.get((c, half), (0, 0)) for c in names] for half in (True, False))
    score = boosted([tuple(c.split("|")) for c in names], [x[0] for x in fit], [x[1] for x in fit])
    out: list[str] = []
    for kind in range(len(KINDS)):
        own = sorted((i for i, c in enumerate(names) if c.split("|")[0] == str(kind)), key=lambda i: -score[i])
        threshold, n, hits = math.inf, 0, 0
        for at, i in enumerate(own):
            n, hits = n + rest[i][0], hits + rest[i][1]
            last = at + 1 == len(own) or score[own[at + 1]] < score[i]
            if last and n and hits >= precision * n and score[i] >= 0:
                threshold = score[i]
        out += [names[i] for i in own if score[i] >= threshold]
    return sorted(out)


def find(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """doc_id, text, base and spans array<struct<s, k, e>>: the base spans, and these with the added ones, in order."""
    cands = candidates(base_spans(docs))
    cells = selected(counts(cands), precision)
    # A list of cells is as long as the features' values allow, not as the data.
    chosen = F.array(*map(F.lit, cells)) if cells else F.expr("cast(array() as array<string>)")
    added = F.transform(F.filter("_cand", lambda c: ~c.hit & c.ok & F.array_contains(chosen, c.cell)), lambda c: F.struct(c.s.alias("s"), c.k.alias("k"), c.e.alias("e")))
    return cands.select("doc_id", F.col("_t").alias("text"), F.col("_base").alias("base"), F.array_sort(F.array_union("_base", added)).alias("spans"))


def listed(name: str) -> Column:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.array_join(F.transform(name, lambda x: F.concat_ws(":", F.element_at(F.expr(f"array({kinds})"), x.k + 1), x.s.cast("string"), x.e.cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find(docs)
    n = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint) as n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *n, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id, text with each span replaced by its kind in brackets; overlapping spans are replaced together, under the first one's kind."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return find(docs).select(
        "doc_id",
        F.expr(
            f"""aggregate(spans, struct(0 as at, '' as out),
              (a, x) -> case when x.e <= a.at then a when x.s < a.at then struct(x.e as at, a.out as out)
                else struct(x.e as at, concat(a.out, substr(text, a.at + 1, x.s - a.at), '[', element_at(array({kinds}), x.k + 1), ']') as out) end,
              a -> concat(a.out, substr(text, a.at + 1)))"""
        ).alias("text"),
    )
