"""Line dedup by site-relative frequency, in DataFrame operations only.

A document's host is its source. For each host and line, the share of the host's documents that hold the line is
n(line) / n(host); a line on at least LEAST documents and on more than RATIO of them is boilerplate, and goes from each document of that host. Lines are
compared without spaces, tabs and returns at their ends, by the MD5 of their bytes; blank lines are never dropped. With `spare`, which only the pipeline's stage sets, a
document whose lines would all go stays as it is, as a copy of other documents for the near-copy operator; without, it is left with its blank lines or an empty text.

Counting is by (host, digest), combined before the shuffle, so a host with a third of all documents is no hot task. A document holds few lines on
average and boilerplate takes more than RATIO of the documents, so a host has at most (mean lines a document) / RATIO
boilerplate lines; the list for all hosts is broadcast only if it is under BROADCAST rows. Beyond that the documents meet it in a join that is salted by SALTS.

Defined cases: null text stays null, with no lines; empty text is one blank line; a null host is a host of its own; a line repeated in a document counts
once; repeated rows count as documents; empty tables give empty results; other columns are kept by clean() and ignored by report().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

RATIO = 0.1
LEAST = 3
BROADCAST = 20_000
SALTS = 64


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def digest(line: Column) -> Column:
    return F.unhex(F.md5(trimmed(line).cast("binary")))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """_host, _lines: the digests of each host's boilerplate lines."""
    text = docs.select(F.col("source").cast("string").alias("_host"), F.col("text").cast("string").alias("_text"))
    totals = text.groupBy("_host").agg(F.count(F.lit(1)).alias("_of"))
    held = F.array_distinct(F.transform(F.filter(lines(F.col("_text")), lambda x: trimmed(x) != ""), digest))
    counts = text.select("_host", F.explode(held).alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    common = counts.alias("c").join(totals.alias("t"), F.col("c._host").eqNullSafe(F.col("t._host"))).where(F.col("_n") > ratio * F.col("_of"))
    return common.groupBy("c._host").agg(F.collect_set("_line").alias("_lines")).select("_host", "_lines")


def with_lines(docs: DataFrame, ratio: float = RATIO, least: int = LEAST, limit: int = BROADCAST) -> DataFrame:
    """One row for each document: _row (a struct of its columns), _lines (its host's boilerplate, or null)."""
    found = checkpointed(boilerplate(docs, ratio, least))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    host = F.col("_row.source").cast("string")
    if found.agg(F.coalesce(F.sum(F.size("_lines")), F.lit(0)) + F.count(F.lit(1))).first()[0] <= limit:
        return rows.join(F.broadcast(found), host.eqNullSafe(F.col("_host")), "left").select("_row", "_lines")
    salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_key", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return rows.join(salted, host.eqNullSafe(F.col("_host")) & (F.col("_key") == F.col("_salt")), "left").select("_row", "_lines")


def cleaned(text: Column, drop: Column, spare: bool) -> tuple[Column, Column]:
    """The kept lines; the kept text."""
    kept = F.filter(lines(text), lambda x: (trimmed(x) == "") | ~F.array_contains(drop, digest(x)))
    whole = lines(text)
    stays = drop.isNull() | ~F.exists(kept, lambda x: trimmed(x) != "") if spare else drop.isNull()
    result = F.when(stays, whole).otherwise(kept)
    return result, F.when(drop.isNull(), text).otherwise(F.array_join(result, "\n"))


def report(docs: DataFrame, ratio: float = RATIO, least: int = LEAST, limit: int = BROADCAST, spare: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (cleaned)."""
    rows = with_lines(docs, ratio, least, limit)
    text = F.col("_row.text").cast("string")
    kept, out = cleaned(text, F.col("_lines"), spare)
    n = F.when(text.isNull(), 0).otherwise(F.size(lines(text)))
    rows = rows.select(F.col("_row.doc_id").alias("doc_id"), n.cast("bigint").alias("n_lines"), F.when(text.isNull(), 0).otherwise(F.size(kept)).cast("bigint").alias("_kept"), out.alias("text"))
    return rows.select("doc_id", "n_lines", (F.col("n_lines") - F.col("_kept")).alias("n_dropped"), "text")


def clean(docs: DataFrame, ratio: float = RATIO, least: int = LEAST, limit: int = BROADCAST, spare: bool = False) -> DataFrame:
    """docs with their boilerplate lines taken out of text; all columns, all rows."""
    rows = with_lines(docs, ratio, least, limit)
    _, out = cleaned(F.col("_row.text").cast("string"), F.col("_lines"), spare)
    return rows.withColumn("_text", out).select(*[(F.col("_text") if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


SQL = f"""
WITH l AS (
  SELECT DISTINCT source, row_id, trim(line, E' \\t\\r') AS line
  FROM (SELECT source, rowid_ AS row_id, unnest(string_split(text, E'\\n')) AS line FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents))
  WHERE trim(line, E' \\t\\r') <> ''
), c AS (SELECT source, line, count(*) AS n FROM l GROUP BY source, line HAVING count(*) >= {LEAST}),
t AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
b AS (SELECT c.source, list(c.line) AS lines FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE c.n > {RATIO} * t.n GROUP BY c.source),
k AS (
  SELECT d.doc_id, d.text, string_split(d.text, E'\\n') AS whole, b.lines AS bad,
    list_filter(string_split(d.text, E'\\n'), lambda x: trim(x, E' \\t\\r') = '' OR NOT list_contains(b.lines, trim(x, E' \\t\\r'))) AS kept
  FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
), r AS (
  SELECT doc_id, whole, CASE WHEN bad IS NULL THEN whole ELSE kept END AS res FROM k
)
SELECT doc_id, CAST(coalesce(len(whole), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(whole) - len(res), 0) AS BIGINT) AS n_dropped, array_to_string(res, E'\\n') AS text FROM r
"""
