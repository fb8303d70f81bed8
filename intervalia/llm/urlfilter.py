"""URL filters by a path-template tree, in SQL only.

A url's host and path are cut out; rules judge the pages that they fit, the longest first. Rule-judged pages are the labels of the method:
each host has a tree of path templates, three levels deep (first segment, second segment, all that follows).

1. Segments get their shape: long hexadecimal runs become {x}, digits {n}. Then, level by level, a node with over WIDE kinds of child and under FEW pages a kind is
   variable there, and its children become one wildcard *.
2. First-level branches of a host with at least SURE labelled pages whose share of blocked pages is within two standard errors of the host's are
   statistically similar and are merged into one branch ~.
3. A template's purity is its share of blocked pages, smoothed by its parent's as WEIGHT pages more: a template by its branch, a branch by its host, a host by the same template
   on all hosts, that by the share of all labelled pages. A template of purity PURE or more is rejected: its pages without a rule are blocked, all others are allowed. So a
   template without labels goes by its branch's, its host's or other hosts' labels.

All counts are aggregates over (host, shapes), combined before the shuffle; pages meet their template by an equi-join on these
columns, which adaptive execution splits where a host or template is hot. No page list is ever collected.

Defined cases: a null url, or one without ://, has an empty host and an empty path and no rule; an empty path fits no rule; without any labelled page p0 is 0 and all
are allowed; ids may be null or repeated, each row is judged; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, checkpointed

# The rules, as (verdict, rule).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
WIDE, FEW, SURE, WEIGHT, PURE = 32, 4, 5, 4.0, 0.8

#: What the two dialects call the same things.
SPARK = {"pages": "{pages}", "cut": "regexp_extract(rest, '^([^/?#]*)([^?#]*)', {})", "shape": "regexp_replace(regexp_replace({}, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}|[0-9a-f]{{16,}}', '{{x}}'), '[0-9]+', '{{n}}')", "parts": "split(path, '/', 4)", "part": ["get(parts, 1)", "get(parts, 2)", "get(parts, 3)"]}
DUCK = SPARK | {"pages": "pages", "shape": "regexp_replace(regexp_replace({}, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}|[0-9a-f]{{16,}}', '{{x}}', 'g'), '[0-9]+', '{{n}}', 'g')", "parts": "string_split(path, '/')", "part": ["parts[2]", "parts[3]", "CASE WHEN len(parts) > 3 THEN array_to_string(parts[4:], '/') END"]}


def fits(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"(host = '{host}' OR host LIKE '%.{host}') AND substr(path, 1, {len(slash + path)}) = '{slash}{path}'"


def case(values: dict[str, str]) -> str:
    """CASE over the rules, the longest first."""
    return "CASE " + " ".join(f"WHEN {fits(r)} THEN {values[r]}" for r in sorted(values, key=lambda r: (-len(r), r))) + " END"


def parsed(dialect: dict[str, str], rules: list[tuple[str, str]]) -> str:
    """CTEs up to s: each page with its host, path, rule, label and shapes."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    names = case({r: f"'{r}'" for _, r in rules})
    bad = case({r: str(int(v == "block")) for v, r in rules})
    s1, s2, s3 = (f"coalesce({dialect['shape'].format(dialect['part'][k])}, '')" for k in range(3))
    return f"""
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {dialect["pages"]}),
u AS (SELECT page_id, translate({dialect["cut"].format(1)}, '{upper}', '{upper.lower()}') AS host, {dialect["cut"].format(2)} AS path FROM a),
r AS (SELECT page_id, host, path, {names} AS rule, {bad} AS bad FROM u),
p AS (SELECT *, {dialect["parts"]} AS parts FROM r),
s AS (SELECT page_id, host, path, rule, bad, {s1} AS s1, {s2} AS s2, {s3} AS s3 FROM p)"""


COUNTED = "SELECT host, s1, s2, s3, count(*) AS n, count(bad) AS known, coalesce(sum(bad), 0) AS bad FROM s GROUP BY host, s1, s2, s3"


def level(k: int, by: str, t: str) -> str:
    """CTEs that add g{k} to t: the shape at level k, or the wildcard."""
    return f"""
k{k} AS (SELECT {by}, count(*) AS kinds, sum(n) AS pages FROM (SELECT {by}, s{k}, sum(n) AS n FROM {t} GROUP BY {by}, s{k}) AS x GROUP BY {by}),
t{k} AS (SELECT {t}.*, CASE WHEN kinds > {WIDE} AND pages < {FEW} * kinds THEN '*' ELSE s{k} END AS g{k} FROM {t} JOIN k{k} USING ({by}))"""


LEVELS = ",".join(level(k, by, f"t{k - 1}") for k, by in ((1, "host"), (2, "host, g1"), (3, "host, g1, g2")))

#: (b K - k B)^2 <= 4 k B (K - B) in whole numbers: b of k blocked is within two standard errors of B of K.
JUDGED = f"""
h AS (SELECT host, sum(bad) AS bad, sum(known) AS known FROM t3 GROUP BY host),
b AS (SELECT host, g1, sum(known) AS known, sum(bad) AS bad FROM t3 GROUP BY host, g1),
m AS (SELECT b.host, b.g1, CASE WHEN b.known >= {SURE} AND (b.bad * h.known - b.known * h.bad) * (b.bad * h.known - b.known * h.bad) <= 4 * b.known * h.bad * (h.known - h.bad) THEN '~' ELSE b.g1 END AS m1 FROM b JOIN h ON b.host = h.host),
f AS (SELECT t3.*, m.m1 FROM t3 JOIN m ON t3.host = m.host AND t3.g1 = m.g1),
z AS (SELECT coalesce(CAST(sum(bad) AS DOUBLE) / nullif(CAST(sum(known) AS DOUBLE), 0), 0) AS p0 FROM t3),
xt AS (SELECT g1, g2, g3, CAST(sum(bad) AS DOUBLE) AS bad, CAST(sum(known) AS DOUBLE) AS known FROM t3 GROUP BY g1, g2, g3),
bt AS (SELECT host, m1, CAST(sum(bad) AS DOUBLE) AS bad, CAST(sum(known) AS DOUBLE) AS known FROM f GROUP BY host, m1),
q AS (SELECT host, m1, g2, g3, CAST(sum(bad) AS DOUBLE) AS bad, CAST(sum(known) AS DOUBLE) AS known FROM f GROUP BY host, m1, g2, g3),
v AS (SELECT f.host, f.s1, f.s2, f.s3, concat('/', f.m1, '/', f.g2, '/', f.g3) AS template,
    (q.bad + {WEIGHT} * (bt.bad + {WEIGHT} * (h.bad + {WEIGHT} * (xt.bad + {WEIGHT} * z.p0) / (xt.known + {WEIGHT})) / (h.known + {WEIGHT})) / (bt.known + {WEIGHT})) / (q.known + {WEIGHT}) AS purity
  FROM f JOIN q ON f.host = q.host AND f.m1 = q.m1 AND f.g2 = q.g2 AND f.g3 = q.g3 JOIN bt ON f.host = bt.host AND f.m1 = bt.m1 JOIN h ON f.host = h.host
    JOIN xt ON f.g1 = xt.g1 AND f.g2 = xt.g2 AND f.g3 = xt.g3 CROSS JOIN z)"""

VERDICT = f"""
SELECT s.page_id, s.host, s.path, s.rule, CASE WHEN s.bad = 1 OR (s.bad IS NULL AND v.purity >= {PURE}) THEN 'block' ELSE 'allow' END AS verdict,
  v.template, round(v.purity, 6) AS purity
FROM s JOIN v ON s.host = v.host AND s.s1 = v.s1 AND s.s2 = v.s2 AND s.s3 = v.s3"""


def shapes(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, bad (null without a rule), s1, s2, s3."""
    text = f"WITH {parsed(SPARK, rules)} SELECT * FROM s".replace("{", "{{").replace("}", "}}").replace("{{pages}}", "{pages}")
    return pages.sparkSession.sql(text, pages=pages.select("page_id", pages["url"].cast("string").alias("url")))


def tree(s: DataFrame) -> DataFrame:
    """The counts by host and shapes, with g1, g2, g3; written, not computed again for each use."""
    sql = s.sparkSession.sql
    t0 = checkpointed(sql(COUNTED.replace("FROM s", "FROM {s}"), s=s))
    return checkpointed(sql(f"WITH t0 AS (SELECT * FROM {{t}}), {LEVELS} SELECT * FROM t3", t=t0))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity."""
    s = shapes(pages, rules)
    return s.sparkSession.sql(f"WITH s AS (SELECT * FROM {{s}}), t3 AS (SELECT * FROM {{t}}), {JUDGED} {VERDICT}", s=s, t=tree(s))


def agreement(pages: DataFrame, rules: list[tuple[str, str]] = RULES, every: int = 10) -> DataFrame:
    """truth (1: blocked), verdict (the method's, 1: blocked) and n, for rule-judged pages of one id in `every`, whose labels the tree has not seen."""
    s = shapes(pages, rules).withColumn("truth", F.col("bad")).withColumn("bad", F.when(F.coalesce(bucket(F.col("page_id"), every) != 0, F.lit(True)), F.col("bad")))
    chosen = f"SELECT s.truth, CAST(v.purity >= {PURE} AS INT) AS verdict, count(*) AS n FROM s JOIN v ON s.host = v.host AND s.s1 = v.s1 AND s.s2 = v.s2 AND s.s3 = v.s3 WHERE s.truth IS NOT NULL AND s.bad IS NULL GROUP BY ALL"
    return s.sparkSession.sql(f"WITH s AS (SELECT * FROM {{s}}), t3 AS (SELECT * FROM {{t}}), {JUDGED} {chosen}", s=s, t=tree(s))


SQL = f"WITH {parsed(DUCK, RULES)},\nt0 AS ({COUNTED}), {LEVELS}, {JUDGED} {VERDICT}"
