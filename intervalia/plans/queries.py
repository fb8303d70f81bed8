"""One query for each operator over the driver's tables, and its DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import integrate, intervals, matrix, peaks, views
from ..sources import io, schema
from ..streaming import sessions as streaming
from .fixtures import CTES, Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Fixtures], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            SQL[f.__name__] = f"WITH {CTES}{sql}"
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def psf(k: str, mu: str) -> str:
    return f"greatest(1 - list_sum(list_transform(range(0, CAST(floor({k}) AS BIGINT) + 1), lambda i: exp(i * ln({mu}) - ({mu}) - lgamma(i + 1)))), 0)"


def islands_sql(minnum: int = 0, maxbetween: int = 2000) -> str:
    return f""",
pos AS (SELECT chr, start, count(*) AS n FROM ins GROUP BY chr, start),
led AS (SELECT *, lead(start) OVER w - start AS g0, lead(start, 2) OVER w - lead(start) OVER w AS g1, lead(n) OVER w AS c1, lead(n, 2) OVER w AS c2 FROM pos WINDOW w AS (PARTITION BY chr ORDER BY start)),
brk AS (SELECT chr, start, n, CASE WHEN coalesce(g0, {maxbetween + 1}) > {maxbetween} OR (coalesce(c1, 0) <= {minnum} AND (coalesce(g1, {maxbetween + 1}) > {maxbetween} / 3.0 OR coalesce(c2, 0) <= {minnum})) THEN 1 ELSE 0 END AS b FROM led),
isl AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY chr ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM brk),
islands AS (SELECT chr, greatest(min(start) - 200, 0) AS start, max(start) + 204 AS end_, CAST(sum(n) AS BIGINT) AS n FROM isl GROUP BY chr, i HAVING sum(n) >= 5)"""


def rc(table: str, lo: str, hi: str, of: str = "p") -> str:
    return f"(SELECT count(*) FROM {table} x WHERE x.chr = {of}.chr AND x.start >= {lo} AND x.start <= {hi})"


def fdr_sql(source: str, p: str, out: str, cutoff: float) -> str:
    return f""",
fm AS (SELECT floor(2730871774.0 / avg(end_ - start)) AS m FROM {source}),
fr AS (SELECT s.*, {p} * m / row_number() OVER (ORDER BY {p}) AS raw_ FROM {source} s CROSS JOIN fm),
fa AS (SELECT *, least(1.0, min(raw_) OVER (ORDER BY {p} DESC)) AS {out} FROM fr),
result AS (SELECT * FROM fa WHERE {out} <= {cutoff})"""


TRIM = "greatest(start, coalesce(lag(end_) OVER (PARTITION BY chr ORDER BY start), start)) AS start"
CHR = """,
ne AS (SELECT chr, count(*) AS ne FROM ins GROUP BY chr), ns AS (SELECT chr, count(*) AS ns FROM sites GROUP BY chr), nb AS (SELECT chr, count(*) AS nb FROM bg GROUP BY chr)"""
INT_ISLANDS = islands_sql()


# --- sources, filters, unions ---------------------------------------------------------------------------------------
@query("\nSELECT chr, start, reads, direction, barcode FROM ins WHERE chr IN ('chr1', 'chr2', 'chr7') AND reads > 2")
def clean_qbed(t):
    return intervals.clean_qbed(t.ins, ["chr1", "chr2", "chr7"], 2).select("chr", "start", "reads", "direction", "barcode")


@query("\nSELECT chr, start, 'exp' AS source FROM ins UNION ALL SELECT chr, start, 'bg' FROM bg")
def combine_qbed(t):
    return intervals.union_all([t.ins.select("chr", "start", F.lit("exp").alias("source")), t.bg.withColumn("source", F.lit("bg"))])


@query('\nSELECT chr, start, start + 4 AS "end", count(*) AS count FROM ins GROUP BY chr, start')
def bedgraph(t):
    return io.bedgraph(t.ins)


@query("\nSELECT chr, start, count(*) AS n FROM ins GROUP BY chr, start")
def position_counts(t):
    return peaks.positions(t.ins)


@query()
def down_sample(t):
    return peaks.down_sample(t.ins.select("chr", "start", "barcode"), 1000)


@query("\nSELECT DISTINCT barcode FROM ins")
def barcode_list(t):
    return t.ins.select("barcode").distinct()


@query(INT_ISLANDS + "\nSELECT chr, start, end_ AS \"end\", concat_ws('_', chr, start, end_) AS id FROM islands")
def motif_bed(t):
    return io.motif_bed(peaks.islands(t.ins))


# --- files: written, and read by the reader -------------------------------------------------------------------------------
def written(t, df: DataFrame, header: bool = False, sep: str = "\t") -> str:
    """The path of df as text, in the shared folder if the cluster names one."""
    folder = t.spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="files-")
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("sep", sep).option("header", header).csv(path)
    return path


@query('\nSELECT chr, start, end_ AS "end", reads, direction, barcode FROM ins')
def read_qbed(t):
    return io.read_qbed(t.spark, written(t, t.ins.select("chr", "start", "end", "reads", "direction", "barcode")))


@query('\nSELECT chr, start, start + 4 AS "end" FROM sites')
def read_reference_sites(t):
    return io.read_bed(t.spark, written(t, t.sites.select("chr", "start", (F.col("start") + 4).alias("end"))))


@query("\nSELECT DISTINCT barcode FROM obs")
def read_barcodes(t):
    return io.read_barcodes(t.spark, written(t, t.obs, header=True))


@query("\nSELECT gene, grp AS sample, value FROM (SELECT gene, grp, sum(value) AS value FROM rna GROUP BY 1, 2)")
def read_rna(t):
    wide = t.rna.groupBy("gene").pivot("group").agg(F.sum("value"))
    return io.read_rna(t.spark, written(t, wide, header=True, sep=",")).where("value is not null")


@query("\nSELECT chr_id, chr_pos, trait FROM gwas")
def read_gwas(t):
    return io.read_gwas(t.spark, written(t, t.gwas.select(F.col("chr_id").alias("CHR_ID"), F.col("chr_pos").alias("CHR_POS"), F.col("trait").alias("DISEASE/TRAIT")), header=True, sep=","))


@query("\nSELECT gene AS motif, pvalue, pvalue_adj AS qvalue FROM rna")
def read_motifs(t):
    named = t.rna.select(F.col("gene").alias("Motif Name"), F.col("pvalue").alias("P-value"), F.col("pvalue_adj").alias("q-value (Benjamini)"))
    return io.read_motifs(t.spark, written(t, named, header=True))


@query('\nSELECT chr, start, end_ AS "end", value FROM signal')
def read_bedgraph(t):
    return io.read_bedgraph(t.spark, written(t, t.signal.select("chr", "start", "end", "value")))


# --- intervals --------------------------------------------------------------------------------------------------------
@query(INT_ISLANDS + f'\nSELECT chr, start, end_ AS "end", n, {rc("sites", "p.start - 3", "p.end_")} AS sites, {rc("bg", "p.start - 3", "p.end_")} AS background FROM islands p')
def range_count(t):
    near = (F.col("start") - 3, F.col("end"))
    return intervals.range_count(intervals.range_count(peaks.islands(t.ins), t.sites, {"sites": near}), t.bg, {"background": near})


@query(INT_ISLANDS + f'\nSELECT chr, start, end_ AS "end", n, {rc("sites", "p.start - 50000 + 1 - 3", "p.end_ + 50000")} AS wide, {rc("sites", "p.start - 2.5", "p.end_ + 2.5")} AS near FROM islands p')
def range_count_wide(t):
    return intervals.range_count(peaks.islands(t.ins), t.sites, {"wide": (F.col("start") - 50000 + 1 - 3, F.col("end") + 50000), "near": (F.col("start") - 2.5, F.col("end") + 2.5)})


@query(""",
a AS (SELECT *, max(end_) OVER (PARTITION BY chr ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM genes),
b AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM a)
SELECT chr, min(start) AS start, max(end_) AS "end", count(*) AS n FROM b GROUP BY chr, run""")
def merge_intervals(t):
    return intervals.merge_intervals(t.genes)


@query('\nSELECT chr, start, end_ AS "end", gene FROM genes WHERE chr = \'chr3\' AND end_ >= 500000 - 10000 AND start <= 1500000 + 10000')
def overlap_area(t):
    return intervals.overlap_area(t.genes, "chr3", 500000, 1500000, 10000).select("chr", "start", "end", "gene")


@query("\nSELECT CAST(floor((start - 500000) / 20000) AS BIGINT) AS bin, count(*) AS n FROM ins WHERE chr = 'chr3' AND start >= 500000 AND start < 1500000 GROUP BY 1")
def area_histogram(t):
    return intervals.histogram(t.ins.where("chr = 'chr3'"), 500000, 1500000, 50)


KNN = """,
u AS (SELECT DISTINCT chr, start, end_ FROM islands),
d AS (SELECT u.*, g.refseq, g.gene, g.strand, g.start AS gs, g.end_ AS ge, CASE WHEN g.start > u.end_ THEN g.start - u.end_ + 1 WHEN g.end_ < u.start THEN g.end_ - u.start - 1 ELSE 0 END AS dist FROM u LEFT JOIN genes g ON g.chr = u.chr),
k AS (SELECT *, row_number() OVER (PARTITION BY chr, start, end_ ORDER BY abs(dist), gs, ge, refseq) AS r FROM d),
ann AS (SELECT chr, start, end_, max(refseq) FILTER (r = 1) AS refseq1, max(gene) FILTER (r = 1) AS gene1, max(strand) FILTER (r = 1) AS direction1, max(dist) FILTER (r = 1) AS distance1,
  max(refseq) FILTER (r = 2) AS refseq2, max(gene) FILTER (r = 2) AS gene2, max(strand) FILTER (r = 2) AS direction2, max(dist) FILTER (r = 2) AS distance2 FROM k GROUP BY chr, start, end_)"""
ANN = 'chr, start, end_ AS "end", refseq1, gene1, direction1, distance1, refseq2, gene2, direction2, distance2'


@query(INT_ISLANDS + KNN + f"\nSELECT {ANN} FROM ann")
def annotate_knn2(t):
    return intervals.nearest_genes(peaks.islands(t.ins), t.genes)


@query(INT_ISLANDS + KNN + f"\nSELECT ann.{ANN.replace(', ', ', ann.').replace('ann.end_', 'ann.end_')}, i.n FROM ann JOIN islands i ON i.chr = ann.chr AND i.start = ann.start AND i.end_ = ann.end_")
def combine_annotation(t):
    p = intervals.kept(peaks.islands(t.ins))
    return intervals.combine_annotation(p, intervals.nearest_genes(p, t.genes))


# --- peak callers -----------------------------------------------------------------------------------------------------
@query(INT_ISLANDS + '\nSELECT chr, start, end_ AS "end", n FROM islands')
def ccaller_islands(t):
    return peaks.islands(t.ins)


@query(islands_sql(1) + '\nSELECT chr, start, end_ AS "end", n FROM islands')
def ccaller_islands_minnum(t):
    return peaks.islands(t.ins, minnum=1)


TESTED = f""",
tst AS (SELECT p.*, {rc("sites", "p.start - 3", "p.end_")} AS rs, ne.ne, ns.ns FROM islands p JOIN ne ON ne.chr = p.chr JOIN ns ON ns.chr = p.chr),
lam AS (SELECT *, rs * (ne * 1.0 / ns) + 0.2 AS mu FROM tst), pv AS (SELECT *, {psf("n", "mu")} AS p FROM lam), ok AS (SELECT * FROM pv WHERE p <= 0.0001),
tr AS (SELECT chr, {TRIM}, end_, n, rs, mu, p FROM ok)"""


@query(INT_ISLANDS + CHR + TESTED + fdr_sql("tr", "p", "adj", 0.0001) + '\nSELECT chr, start, end_ AS "end", n AS experiment_insertions, rs AS reference_insertions, round(mu, 6) AS expected_insertions, round(p, 6) AS pvalue, round(adj, 6) AS pvalue_adj FROM result')
def ccaller_nobg(t):
    return rounded(peaks.call_peaks(t.ins, t.sites), "expected_insertions", "pvalue", "pvalue_adj")


LAMBDA = f""",
tst AS (SELECT p.*, {rc("sites", "p.start - 3", "p.end_")} AS rs, {rc("ins", "p.start - 50000 + 1 - 3", "p.end_ + 50000")} AS we, {rc("sites", "p.start - 50000 + 1 - 3", "p.end_ + 50000")} AS ws FROM islands p),
lam AS (SELECT *, rs * (we * 1.0 / ws) + 0.2 AS mu FROM tst WHERE ws > 0), pv AS (SELECT *, {psf("n", "mu")} AS p FROM lam), ok AS (SELECT * FROM pv WHERE p <= 0.01),
tr AS (SELECT chr, {TRIM}, end_, n, rs, mu, p FROM ok)"""


@query(INT_ISLANDS + LAMBDA + fdr_sql("tr", "p", "adj", 1.0) + '\nSELECT chr, start, end_ AS "end", n AS experiment_insertions, rs AS reference_insertions, round(mu, 6) AS expected_insertions, round(p, 6) AS pvalue, round(adj, 6) AS pvalue_adj FROM result')
def ccaller_lambda_window(t):
    return rounded(peaks.call_islands(t.ins, t.sites, pvalue_cutoff=0.01, pvalue_adj_cutoff=1.0, lam_win_size=100000), "expected_insertions", "pvalue", "pvalue_adj")


CUM = f"CASE WHEN nb >= ne THEN {psf('n + 0.2', 'b * (ne * 1.0 / nb) + 0.2')} ELSE {psf('n * (nb * 1.0 / ne) + 0.2', 'b + 0.2')} END"
BG = f""",
tst AS (SELECT p.*, {rc("sites", "p.start - 3", "p.end_")} AS rs, {rc("bg", "p.start - 3", "p.end_")} AS b, ne.ne, ns.ns, nb.nb FROM islands p JOIN ne ON ne.chr = p.chr JOIN ns ON ns.chr = p.chr JOIN nb ON nb.chr = p.chr),
lam AS (SELECT *, rs * (ne * 1.0 / ns) + 0.2 AS mu, b * (ne * 1.0 / nb) + 0.2 AS mb FROM tst), pv AS (SELECT *, {psf("n", "mu")} AS p, {CUM} AS pb FROM lam), ok AS (SELECT * FROM pv WHERE p <= 0.001 AND pb <= 0.1),
tr AS (SELECT chr, {TRIM}, end_, n, b, rs, mb, mu, pb, p FROM ok)"""


@query(INT_ISLANDS + CHR + BG + fdr_sql("tr", "p", "adj", 1.0) + '\nSELECT chr, start, end_ AS "end", n AS experiment_insertions, b AS background_insertions, rs AS reference_insertions, round(mb, 6) AS expected_background, round(mu, 6) AS expected_reference, round(pb, 6) AS pvalue_background, round(p, 6) AS pvalue_reference, round(adj, 6) AS pvalue_adj_reference FROM result')
def ccaller_bg(t):
    found = peaks.call_islands(t.ins, t.sites, t.bg, pvalue_cutoff_bg=0.1, pvalue_cutoff_sites=0.001, pvalue_adj_cutoff=1.0)
    return rounded(found, "expected_background", "expected_reference", "pvalue_background", "pvalue_reference", "pvalue_adj_reference")


@query(INT_ISLANDS + CHR + f""",
o AS (SELECT chr, min(start) AS o FROM pos GROUP BY chr),
g AS (SELECT p.chr, unnest(generate_series(greatest(CAST(ceil((p.start - o - 999) / 500.0) AS BIGINT), 0), CAST(floor((p.start - o + 3) / 500.0) AS BIGINT))) AS k, o, n FROM pos p JOIN o ON o.chr = p.chr),
w AS (SELECT chr, k, o + k * 500 AS start, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY chr, k, o HAVING sum(n) >= 5),
c AS (SELECT p.*, {rc("sites", "p.start - 3", "p.start + 999")} AS rs, ne, ns FROM w p JOIN ne ON ne.chr = p.chr JOIN ns ON ns.chr = p.chr)
SELECT chr, k, start, n, rs AS reference_insertions, round({psf("n + 0.2", "greatest(rs, 1) * (ne * 1.0 / ns) + 0.2")}, 6) AS pvalue FROM c""")
def maccs_window_stats(t):
    return rounded(peaks.window_statistics(t.ins, t.sites, None, 1000, 500, 3, None, 0.2, 5), "pvalue")


@query()
def maccs_nobg(t):
    return peaks.call_peaks(t.ins, t.sites, method="MACCs", window_size=1000, step_size=500, lam_win_size=1_000_000, pseudocounts=0.1)


@query()
def maccs_bg(t):
    return peaks.call_peaks(t.ins, t.sites, t.bg, method="MACCs", window_size=1000, step_size=500, lam_win_size=1_000_000, pseudocounts=0.1, pvalue_cutoff_bg=1e-1)


def local_sql(table: str, scaled: bool) -> str:
    return ", ".join(f"{rc(table, f'p.center - {lo} - 3', f'p.center + {hi}')} AS {'b' if scaled else 's'}{x}" for x, (lo, hi) in peaks.LOCAL_RATES.items())


RATES = ["b * sc / greatest(s, 1)", *(f"b{x} * sc / greatest(s{x}, 1)" for x in peaks.LOCAL_RATES)]


@query(f""",
pos AS (SELECT chr, start, count(*) AS n FROM ins GROUP BY chr, start), tt AS (SELECT (SELECT count(*) FROM ins) AS te, (SELECT count(*) FROM bg) AS tb),
g AS (SELECT chr, n, unnest(generate_series(greatest(CAST(ceil((start - 1499) / 500.0) AS BIGINT), 0), CAST(floor((start + 3) / 500.0) AS BIGINT))) AS k FROM pos),
w AS (SELECT chr, k, k * 500 AS start, sum(n) AS n FROM g GROUP BY chr, k HAVING sum(n) >= 2),
c AS (SELECT p.*, {rc("bg", "p.start - 3", "p.start + 1499")} AS b, te, tb FROM w p CROSS JOIN tt),
sg AS (SELECT * FROM c WHERE CASE WHEN tb >= te THEN {psf("n + 0.2", "b * (te * 1.0 / tb) + 0.2")} ELSE {psf("n * (tb * 1.0 / te) + 0.2", "b + 0.2")} END <= 0.0001),
rn AS (SELECT *, k - row_number() OVER (PARTITION BY chr ORDER BY k) AS r FROM sg), mg AS (SELECT chr, min(start) AS start, max(start) + 1499 AS end_ FROM rn GROUP BY chr, r),
md AS (SELECT m.chr, m.start, m.end_, count(*) AS n, median(i.start) AS center FROM mg m JOIN ins i ON i.chr = m.chr AND i.start >= m.start - 3 AND i.start <= m.end_ GROUP BY 1, 2, 3),
q AS (SELECT p.*, {rc("bg", "p.start - 3", "p.end_")} AS b, {rc("sites", "p.start - 3", "p.end_")} AS s, {local_sql("bg", True)}, {local_sql("sites", False)}, te, tb, CASE WHEN tb >= te THEN te * 1.0 / tb ELSE 1.0 END AS sc FROM md p CROSS JOIN tt),
l AS (SELECT *, greatest({", ".join(RATES)}) AS lam FROM q), v AS (SELECT *, lam * greatest(s, 1) AS held, CASE WHEN lam = {RATES[0]} THEN 'bg' WHEN lam = {RATES[1]} THEN '1k' WHEN lam = {RATES[2]} THEN '5k' ELSE '10k' END AS kind FROM l)
SELECT chr, start, end_ AS "end", center, n AS experiment_insertions, b AS background_insertions, s AS reference_insertions, round(n * 1.0 / te, 6) AS fraction_experiment, round(n * 100000.0 / te, 6) AS tph_experiment, round(b * 1.0 / tb, 6) AS fraction_background,
  round(b * 100000.0 / tb, 6) AS tph_background, round(n * 100000.0 / te - b * 100000.0 / tb, 6) AS tph_background_subtracted, kind AS lambda_type, round(lam, 6) AS "lambda", round(held, 6) AS lambda_reference_insertions,
  round(CASE WHEN tb >= te THEN {psf("n + 0.2", "held + 0.2")} ELSE {psf("n * (tb * 1.0 / te) + 0.2", "held + 0.2")} END, 6) AS pvalue FROM v""")
def maccs_max_rate(t):
    found = peaks.call_peaks(t.ins, t.sites, t.bg, method="MACCS_old")
    return rounded(found, "fraction_experiment", "tph_experiment", "fraction_background", "tph_background", "tph_background_subtracted", "lambda", "lambda_reference_insertions", "pvalue")


@query()
def blockify_block_counts(t):
    return peaks.block_counts(peaks.blocks(t.ins), t.ins, "n")


@query()
def segmentation_summary(t):
    return rounded(peaks.segmentation_summary(peaks.segments(t.ins)), "prior", "fitness")


@query()
def blockify(t):
    return peaks.call_peaks(t.ins, t.sites, method="Blockify", pvalue_cutoff=1e-4)


NUMBERED = ", res AS (SELECT *, row_number() OVER (ORDER BY CAST(substr(chr, 4) AS INT), chr, start, end_) - 1 AS o FROM result), se AS (SELECT chr, start + 4 AS start FROM sites)"
EDIT = CHR + TESTED + fdr_sql("tr", "p", "adj", 0.0001) + NUMBERED
EDIT_BG = CHR + BG + fdr_sql("tr", "p", "adj", 1.0) + NUMBERED
TWO = "SELECT chr, min(start) AS start, max(end_) AS end_ FROM res WHERE o IN (1, 2) GROUP BY chr"
HALVES = "SELECT chr, start, CAST(7000 AS BIGINT) AS end_ FROM res WHERE o = 1 UNION ALL SELECT chr, CAST(7050 AS BIGINT) AS start, end_ FROM res WHERE o = 1"


def edit_sql(bounds: str, columns: str, blocks: bool = False) -> str:
    """Edited bounds: counts (n, s, b), totals around them or of the chromosome (wn, ws, wb), expectations (xs, xb), tails (p, pb) and the nearest peak's adjusted p (adj)."""
    of = {"n": "ins", "s": "bg" if blocks else "se", "b": "bg"}
    counts = ", ".join(f"{rc(x, 'p.start - 4', 'p.end_')} AS {k}, " + (f"(SELECT count(*) FROM {x} x WHERE x.chr = p.chr)" if blocks else rc(x, "p.start - 4 - 50000 + 1", "p.end_ + 50000")) + f" AS w{k}" for k, x in of.items())
    tail = lambda k: f"CASE WHEN greatest(w{k}, wn) = 0 THEN NULL WHEN w{k} >= wn THEN {psf('n + 0.2', f'{k} * (wn * 1.0 / w{k}) + 0.2')} ELSE {psf(f'n * (w{k} * 1.0 / wn) + 0.2', f'{k} + 0.2')} END"
    return f""", bd AS ({bounds}), e1 AS (SELECT p.*, {counts} FROM bd p), e2 AS (SELECT *, wn * s * 1.0 / nullif(ws, 0) AS xs, wn * b * 1.0 / nullif(wb, 0) AS xb, {tail("s")} AS p, {tail("b")} AS pb FROM e1),
e3 AS (SELECT e2.*, r.adj, row_number() OVER (PARTITION BY e2.start ORDER BY abs(r.p - e2.p), r.p) AS rk FROM e2 CROSS JOIN res r),
md AS (SELECT d.start, median(i.start) AS center FROM bd d JOIN ins i ON i.chr = d.chr AND i.start >= d.start - 4 AND i.start <= d.end_ GROUP BY 1), tt AS (SELECT (SELECT count(*) FROM ins) AS te, (SELECT count(*) FROM bg) AS tb)
SELECT e.chr, e.start, e.end_ AS "end", {columns}, round(adj, 6) AS pvalue_adj{"_reference" if "pvalue_reference" in columns else ""} FROM e3 e LEFT JOIN md ON md.start = e.start CROSS JOIN tt WHERE rk = 1"""


ONE_TEST = "n AS experiment_insertions, s AS reference_insertions, round(xs, 6) AS expected_insertions, round(p, 6) AS pvalue"
TWO_TESTS = "n AS experiment_insertions, b AS background_insertions, s AS reference_insertions, round(pb, 6) AS pvalue_background, round(p, 6) AS pvalue_reference"
SHARES = "center, round(n * 1.0 / te, 6) AS fraction_experiment, round(n * 100000000.0 / te, 4) AS tph_experiment"
EDIT_ROUNDED = ("expected_insertions", "expected_background", "expected_reference", "pvalue", "pvalue_adj", "pvalue_background", "pvalue_reference", "pvalue_adj_reference", "fraction_experiment", "fraction_background")


def edited(df: DataFrame) -> DataFrame:
    df = rounded(df, *[c for c in EDIT_ROUNDED if c in df.columns])
    return rounded(df, *[c for c in df.columns if c.startswith("tph_")], digits=4)


class Counted:
    """Insertions, sites and background by position, each counted when first asked for: peaks are called and edited on the same."""

    def __init__(self, t: Fixtures):
        self.t = t

    def __getattr__(self, name: str) -> DataFrame:
        self.__dict__[name] = intervals.counted(getattr(self.t, name))
        return self.__dict__[name]


def called_with_background(t) -> DataFrame:
    return peaks.call_islands(t.ins, t.sites, t.bg, pvalue_cutoff_bg=0.1, pvalue_cutoff_sites=0.001, pvalue_adj_cutoff=1.0)


@query(INT_ISLANDS + EDIT + edit_sql(TWO, ONE_TEST))
def combine_peaks(t):
    t = Counted(t)
    return edited(peaks.combine_peaks(peaks.call_peaks(t.ins, t.sites), 1, t.ins, t.sites))


@query(INT_ISLANDS + EDIT_BG + edit_sql(TWO, TWO_TESTS + ", round(xb, 6) AS expected_background, round(xs, 6) AS expected_reference"))
def combine_peaks_bg(t):
    t = Counted(t)
    return edited(peaks.combine_peaks(called_with_background(t), 1, t.ins, t.sites, t.bg))


@query(INT_ISLANDS + EDIT + edit_sql(TWO, f"{SHARES}, {ONE_TEST}"))
def combine_peaks_maccs(t):
    t = Counted(t)
    return edited(peaks.combine_peaks(peaks.call_peaks(t.ins, t.sites), 1, t.ins, t.sites, method="MACCs"))


@query(INT_ISLANDS + EDIT_BG + edit_sql(TWO, f"{SHARES}, {TWO_TESTS}, round(b * 1.0 / tb, 6) AS fraction_background, round(b * 100000000.0 / tb, 4) AS tph_background, round(n * 100000000.0 / te - b * 100000000.0 / tb, 4) AS tph_background_subtracted"))
def combine_peaks_maccs_bg(t):
    t = Counted(t)
    return edited(peaks.combine_peaks(called_with_background(t), 1, t.ins, t.sites, t.bg, "MACCs"))


@query(INT_ISLANDS + EDIT + edit_sql(HALVES, ONE_TEST))
def separate_peaks(t):
    t = Counted(t)
    return edited(peaks.separate_peaks(peaks.call_peaks(t.ins, t.sites), 1, 7000, 7050, t.ins, t.sites))


@query(INT_ISLANDS + EDIT + edit_sql(HALVES, ONE_TEST, blocks=True))
def separate_peaks_blocks_bg(t):
    t = Counted(t)
    return edited(peaks.separate_peaks(peaks.call_peaks(t.ins, t.sites), 1, 7000, 7050, t.ins, t.sites, t.bg, "Blockify"))


@query(INT_ISLANDS + CHR + TESTED + fdr_sql("tr", "p", "adj", 1.0) + '\nSELECT chr, start, end_ AS "end", round(p, 6) AS pvalue, round(adj, 6) AS pvalue_adj FROM result')
def fdr_genome(t):
    found = peaks.call_islands(t.ins, t.sites, pvalue_adj_cutoff=1.0).select("chr", "start", "end", "pvalue")
    return rounded(stats.adjusted_genome(found, "pvalue", "pvalue_adj", schema.GENOME["mm10"]), "pvalue", "pvalue_adj")


# --- matrix and ranking -----------------------------------------------------------------------------------------------
MATRIX = """,
own AS (SELECT q.chr, q.start, arg_min(concat_ws('_', p.chr, p.start, p.end_), p.start) AS var_id FROM (SELECT DISTINCT chr, start FROM ins) q JOIN islands p ON p.chr = q.chr AND q.start >= p.start - 3 AND q.start <= p.end_ GROUP BY q.chr, q.start),
x AS (SELECT i.barcode AS obs_id, own.var_id, count(*) AS value FROM ins i JOIN own ON own.chr = i.chr AND own.start = i.start GROUP BY 1, 2)"""
M = INT_ISLANDS + MATRIX


def count_matrix_of(t) -> matrix.CountMatrix:
    m = matrix.make_matrix(t.ins, intervals.kept(peaks.islands(t.ins)), t.obs.select("barcode", "cluster"), check=False)
    return replace(m, x=intervals.kept(m.x), obs=intervals.kept(m.obs))


@query(M + "\nSELECT obs_id, var_id, value FROM x")
def count_matrix(t):
    return count_matrix_of(t).x.select("obs_id", "var_id", "value")


@query(M + "\nSELECT concat_ws('_', p.chr, p.start, p.end_) AS var_id FROM islands p LEFT JOIN (SELECT var_id, sum(value) AS s FROM x GROUP BY 1) y ON y.var_id = concat_ws('_', p.chr, p.start, p.end_) WHERE coalesce(s, 0) >= 12")
def filter_peaks_min_counts(t):
    return matrix.filter_peaks(count_matrix_of(t), min_counts=12).var.select("var_id")


@query(M + "\nSELECT var_id, count(*) AS cells FROM x GROUP BY var_id HAVING count(*) >= 8")
def filter_peaks_min_cells(t):
    return matrix.filter_peaks(count_matrix_of(t), min_cells=8).x.groupBy("var_id").agg(F.count(F.lit(1)).alias("cells"))


INSERTIONS = M + ", g AS (SELECT cluster, count(*) AS n FROM obs GROUP BY 1), s AS (SELECT cluster, count(*) AS s FROM x JOIN obs ON barcode = obs_id GROUP BY 1) SELECT g.cluster AS \"group\", round({}, 6) AS value FROM g LEFT JOIN s ON s.cluster = g.cluster"


@query(INSERTIONS.format("log2(coalesce(s, 0) * 1.0 / n + 1)"))
def insertions_per_group(t):
    return rounded(matrix.insertions_by_group(count_matrix_of(t)), "value")


@query(INSERTIONS.format("CAST(coalesce(s, 0) AS DOUBLE)"))
def insertions_per_group_sum(t):
    return rounded(matrix.insertions_by_group(count_matrix_of(t), method="suminsertions"), "value")


@query(INSERTIONS.format("coalesce(s, 0) * 1.0 / n"))
def insertions_per_group_avg(t):
    return rounded(matrix.insertions_by_group(count_matrix_of(t), method="Avginsertions"), "value")


@query(INSERTIONS.format("log2(coalesce(s, 0) + 1)"))
def insertions_per_group_logsum(t):
    return rounded(matrix.insertions_by_group(count_matrix_of(t), method="logsuminsertions"), "value")


def lc(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


FISHER = f"list_sum(list_transform(range(CAST(n1 AS BIGINT), CAST(least(n1 + n2, t1) AS BIGINT) + 1), lambda i: exp({lc('t1', 'i')} + {lc('t2', '(n1 + n2 - i)')} - {lc('(t1 + t2)', '(n1 + n2)')})))"
BINOM = f"CASE WHEN n1 + n2 = 0 THEN 1.0 ELSE list_sum(list_transform(range(CAST(n1 AS BIGINT), CAST(n1 + n2 AS BIGINT) + 1), lambda i: exp({lc('(n1 + n2)', 'i')} + i * ln(t1 / (t1 + t2)) + (n1 + n2 - i) * ln(1 - t1 / (t1 + t2))))) END"
BINOM2 = f"CASE WHEN n2 = 0 THEN CASE WHEN n1 = 0 THEN 1.0 ELSE 0.0 END WHEN n2 = t2 THEN 1.0 ELSE list_sum(list_transform(range(CAST(n1 AS BIGINT), CAST(t1 AS BIGINT) + 1), lambda i: exp({lc('t1', 'i')} + i * ln(n2 / t2) + (t1 - i) * ln(1 - n2 / t2)))) END"


def rank_sql(number: str, total: str, test: str, where: str = "") -> str:
    return f""",
e AS (SELECT cluster AS g, var_id, {number} AS n1 FROM x JOIN obs ON barcode = obs_id GROUP BY 1, 2), a AS (SELECT var_id, sum(n1) AS s FROM e GROUP BY 1), v AS (SELECT concat_ws('_', chr, start, end_) AS var_id FROM islands),
z AS ({total}), grid AS (SELECT z.g, v.var_id, CAST(coalesce(e.n1, 0) AS DOUBLE) AS n1, CAST(coalesce(a.s, 0) - coalesce(e.n1, 0) AS DOUBLE) AS n2, CAST(z.t AS DOUBLE) AS t1, CAST((SELECT sum(t) FROM z) - z.t AS DOUBLE) AS t2
  FROM z CROSS JOIN v LEFT JOIN e ON e.g = z.g AND e.var_id = v.var_id LEFT JOIN a ON a.var_id = v.var_id),
p AS (SELECT *, least(1.0, {test}) AS p, log2((n1 / t1 + 1e-6) / (n2 / t2 + 1e-6)) AS lfc FROM grid),
q AS (SELECT *, p * count(*) OVER (PARTITION BY g) / row_number() OVER (PARTITION BY g ORDER BY p) AS raw_ FROM p), adj AS (SELECT *, least(1.0, min(raw_) OVER (PARTITION BY g ORDER BY p DESC)) AS adj FROM q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY g ORDER BY round(adj, 9), var_id) AS INTEGER) AS rank FROM adj)
SELECT g AS "group", rank, var_id AS name, round(p, 6) AS pvalue, round(adj, 6) AS pvalue_adj, round(lfc, 6) AS logfoldchange, CAST(n1 AS BIGINT) AS number, CAST(n2 AS BIGINT) AS number_rest, CAST(t1 AS BIGINT) AS total, CAST(t2 AS BIGINT) AS total_rest FROM r {where}"""


CELLS = "SELECT cluster AS g, count(*) AS t FROM obs GROUP BY 1"
HELD = "SELECT cluster AS g, sum(value) AS t FROM x JOIN obs ON barcode = obs_id GROUP BY 1"


def ranked(t, **options) -> DataFrame:
    return rounded(matrix.rank_peak_groups(count_matrix_of(t), "cluster", **options), "pvalue", "pvalue_adj", "logfoldchange")


@query(M + rank_sql("count(*)", CELLS, FISHER))
def rank_groups_fisher(t):
    return ranked(t)


@query(M + rank_sql("sum(value)", CELLS, BINOM))
def rank_groups_binomtest(t):
    return ranked(t, method="binomtest")


@query(M + rank_sql("count(*)", CELLS, BINOM2))
def rank_groups_binomtest2(t):
    return ranked(t, method="binomtest2")


@query(M + rank_sql("sum(value)", HELD, FISHER))
def rank_groups_by_sample(t):
    return ranked(t, by="sample", alternative="greater")


LOG_TABLE = f"({lc('t1', '{i}')} + {lc('t2', '(n1 + n2 - {i})')} - {lc('(t1 + t2)', '(n1 + n2)')})"
FISHER2 = f"list_sum(list_transform(list_filter(range(CAST(greatest(0, n1 + n2 - t2) AS BIGINT), CAST(least(n1 + n2, t1) AS BIGINT) + 1), lambda i: {LOG_TABLE.format(i='i')} <= {LOG_TABLE.format(i='n1')} + 1e-7), lambda i: exp({LOG_TABLE.format(i='i')})))"


@query(M + rank_sql("sum(value)", HELD, FISHER2))
def rank_groups_by_sample_two_sided(t):
    return ranked(t, by="sample")


@query(M + rank_sql("sum(value)", HELD, FISHER2).replace("cluster AS g", "barcode AS g"))
def rank_groups_by_obs(t):
    return rounded(matrix.rank_peak_groups(count_matrix_of(t), None, by="group"), "pvalue", "pvalue_adj", "logfoldchange")


AGAINST = {"a AS (SELECT var_id, sum(n1) AS s FROM e GROUP BY 1)": "a AS (SELECT var_id, n1 AS s FROM e WHERE g = 'k1')", "coalesce(a.s, 0) - coalesce(e.n1, 0)": "coalesce(a.s, 0)", "(SELECT sum(t) FROM z) - z.t": "(SELECT t FROM z WHERE g = 'k1')"}


def against_k1(sql: str) -> str:
    for a, b in AGAINST.items():
        sql = sql.replace(a, b)
    return sql


@query(M + against_k1(rank_sql("count(*)", CELLS, FISHER)))
def rank_groups_reference(t):
    return ranked(t, reference="k1")


@query(M + rank_sql("count(*)", CELLS, FISHER, "WHERE rank <= 10"))
def rank_groups_top_k(t):
    return ranked(t, n_peaks=10)


@query(M + rank_sql("count(*)", CELLS, FISHER, "WHERE p <= 0.2 AND lfc >= 0.5 AND lfc <= 5"))
def rank_peak_groups_df(t):
    found = matrix.filter_ranking(matrix.rank_peak_groups(count_matrix_of(t), "cluster"), pval_cutoff=0.2, logfc_min=0.5, logfc_max=5)
    return rounded(found, "pvalue", "pvalue_adj", "logfoldchange")


@query(M + f""",
e AS (SELECT cluster AS g, var_id, count(*) AS n FROM x JOIN obs ON barcode = obs_id GROUP BY 1, 2), v AS (SELECT concat_ws('_', chr, start, end_) AS var_id FROM islands),
d AS (SELECT v.var_id, CAST(coalesce(a.n, 0) AS DOUBLE) AS n1, CAST(coalesce(b.n, 0) AS DOUBLE) AS n2, CAST((SELECT count(*) FROM obs WHERE cluster = 'k0') AS DOUBLE) AS t1, CAST((SELECT count(*) FROM obs WHERE cluster = 'k1') AS DOUBLE) AS t2
  FROM v LEFT JOIN e a ON a.g = 'k0' AND a.var_id = v.var_id LEFT JOIN e b ON b.g = 'k1' AND b.var_id = v.var_id)
SELECT var_id AS name, CAST(n1 AS BIGINT) AS number, CAST(n2 AS BIGINT) AS number_rest, CAST(t1 AS BIGINT) AS total, CAST(t2 AS BIGINT) AS total_rest, round(least(1.0, {FISHER}), 6) AS pvalue FROM d""")
def diff_two_groups(t):
    return rounded(matrix.difference_of_groups(count_matrix_of(t), "cluster", "k0", "k1"), "pvalue")


@query(M + f""",
e AS (SELECT cluster AS g, var_id, sum(value) AS n FROM x JOIN obs ON barcode = obs_id GROUP BY 1, 2), h AS (SELECT g, sum(n) AS t FROM e GROUP BY 1), v AS (SELECT concat_ws('_', chr, start, end_) AS var_id FROM islands),
d AS (SELECT v.var_id, CAST(coalesce(a.n, 0) AS DOUBLE) AS n1, CAST(coalesce(b.n, 0) AS DOUBLE) AS n2, CAST((SELECT t FROM h WHERE g = 'k0') AS DOUBLE) AS t1, CAST((SELECT t FROM h WHERE g = 'k1') AS DOUBLE) AS t2
  FROM v LEFT JOIN e a ON a.g = 'k0' AND a.var_id = v.var_id LEFT JOIN e b ON b.g = 'k1' AND b.var_id = v.var_id)
SELECT var_id AS name, CAST(n1 AS BIGINT) AS number, CAST(n2 AS BIGINT) AS number_rest, CAST(t1 AS BIGINT) AS total, CAST(t2 AS BIGINT) AS total_rest, round(least(1.0, {FISHER2}), 6) AS pvalue FROM d""")
def diff_two_groups_by_sample(t):
    return rounded(matrix.difference_of_groups(count_matrix_of(t), "cluster", "k0", "k1", by="sample", alternative="two-sided"), "pvalue")


@query("""\n, r AS (SELECT grp, gene, pvalue, pvalue * count(*) OVER (PARTITION BY grp) / row_number() OVER (PARTITION BY grp ORDER BY pvalue) AS raw_ FROM rna)
SELECT grp AS "group", gene, round(pvalue, 6) AS pvalue, round(least(1.0, min(raw_) OVER (PARTITION BY grp ORDER BY pvalue DESC)), 6) AS pvalue_adj FROM r""")
def fdr_bh(t):
    return rounded(stats.adjusted(t.rna.select("group", "gene", "pvalue"), "pvalue", "pvalue_adj", ["group"]), "pvalue", "pvalue_adj")


# --- integration ------------------------------------------------------------------------------------------------------
PAIR = KNN + """,
nr AS (SELECT concat_ws('_', chr, start, end_) AS name, unnest([{'r': 1, 'g': gene1, 'd': distance1}, {'r': 2, 'g': gene2, 'd': distance2}]) AS s FROM ann),
near AS (SELECT name, s.g AS gene, arg_min(s.d, s.r) AS distance FROM nr WHERE s.g IS NOT NULL GROUP BY 1, 2)"""


@query(M + PAIR + rank_sql("count(*)", CELLS, FISHER).rpartition("\nSELECT g AS")[0] + """
SELECT r.g AS "group", r.var_id AS name, near.gene, near.distance, round(r.lfc, 6) AS logfoldchange_cc, round(r.p, 6) AS pvalue_cc, rna.score AS score_rna, rna.pvalue AS pvalue_rna
FROM r JOIN near ON near.name = r.var_id JOIN rna ON rna.grp = r.g AND rna.gene = near.gene WHERE r.p <= 0.3 AND abs(r.lfc) >= 0.2 AND rna.pvalue <= 0.04 AND rna.pvalue_adj <= 0.5 AND abs(rna.score) >= 3 AND abs(near.distance) <= 200000""")
def pair_genes_sc(t):
    found = integrate.pair_peak_gene(matrix.rank_peak_groups(count_matrix_of(t), "cluster"), intervals.nearest_genes(peaks.islands(t.ins), t.genes), t.rna, 0.3, None, 0.04, 0.5, 0.2, 3, 200000)
    return rounded(found.select("group", "name", "gene", "distance", "logfoldchange_cc", "pvalue_cc", "score_rna", "pvalue_rna"), "logfoldchange_cc", "pvalue_cc")


@query(M + PAIR + rank_sql("count(*)", CELLS, FISHER).rpartition("\nSELECT g AS")[0] + """
SELECT r.var_id AS name, near.gene, near.distance, round(r.lfc, 6) AS logfoldchange_cc, rna.score AS score_rna FROM r JOIN near ON near.name = r.var_id JOIN rna ON rna.grp = 'k2' AND rna.gene = near.gene
WHERE r.g = 'k0' AND r.p <= 0.3 AND abs(r.lfc) >= 0.2 AND rna.pvalue <= 0.04 AND abs(rna.score) >= 3""")
def pair_genes_bulk(t):
    rank = matrix.rank_peak_groups(count_matrix_of(t), "cluster", groups="k0")
    found = integrate.pair_peak_gene(rank, intervals.nearest_genes(peaks.islands(t.ins), t.genes), t.rna.where("group = 'k2'"), 0.3, None, 0.04, None, 0.2, 3, by_group=False)
    return rounded(found.select("name", "gene", "distance", "logfoldchange_cc", "score_rna"), "logfoldchange_cc")


HITS = ", hits AS (SELECT p.chr, p.start, p.end_, w.trait, count(*) AS n FROM islands p JOIN gwas w ON concat('chr', w.chr_id) = p.chr AND w.chr_pos >= p.start AND w.chr_pos <= p.end_ GROUP BY 1, 2, 3, 4)"


@query(INT_ISLANDS + HITS + """
SELECT p.chr, p.start, p.end_ AS "end", coalesce(g.gwas, '') AS gwas FROM islands p LEFT JOIN (SELECT chr, start, end_, string_agg(trait, '; ' ORDER BY trait) AS gwas FROM hits GROUP BY 1, 2, 3) g ON g.chr = p.chr AND g.start = p.start AND g.end_ = p.end_""")
def gwas_traits(t):
    return integrate.gwas_traits(peaks.islands(t.ins), t.gwas, "").select("chr", "start", "end", "gwas")


GWAS = M + HITS + ", cells AS (SELECT h.trait, {} AS g, CAST(sum(x.value * h.n) AS BIGINT) AS value FROM x JOIN obs ON barcode = obs_id JOIN hits h ON concat_ws('_', h.chr, h.start, h.end_) = x.var_id GROUP BY 1, 2), tot AS (SELECT trait, sum(value) AS t FROM cells GROUP BY 1)"


@query(GWAS.format("cluster") + '\nSELECT c.trait, c.g AS "group", c.value FROM cells c JOIN tot ON tot.trait = c.trait WHERE t > 100')
def gwas_cluster_matrix(t):
    return integrate.gwas_matrix(count_matrix_of(t), t.gwas, "cluster").select("trait", "group", "value")


@query(GWAS.format("obs_id") + '\nSELECT c.trait, c.g AS "group", c.value FROM cells c JOIN tot ON tot.trait = c.trait WHERE t > 100')
def gwas_sample_matrix(t):
    return integrate.gwas_matrix(count_matrix_of(t), t.gwas).select("trait", "group", "value")


SHARES_OF = ', z AS ({sizes}), y AS (SELECT c.trait, c.g, c.value, c.value * 1.0 / n AS v FROM cells c JOIN tot ON tot.trait = c.trait JOIN z ON z.g = c.g WHERE t > 100), w AS (SELECT trait, sum(v) AS w, sum(value) AS total FROM y GROUP BY 1)'
CLUSTER_SIZES, SAMPLE_SIZES = "SELECT cluster AS g, count(*) AS n FROM obs GROUP BY 1", "SELECT obs_id AS g, sum(value) AS n FROM x GROUP BY 1"
SHARED = '\nSELECT y.trait, y.g AS "group", round(v / w, 6) AS share, CAST(total AS BIGINT) AS total FROM y JOIN w ON w.trait = y.trait'


def cluster_shares(t) -> DataFrame:
    m = count_matrix_of(t)
    sizes = m.obs.groupBy(F.col("cluster").alias("group")).agg(F.count(F.lit(1)).alias("size"))
    return integrate.gwas_shares(integrate.gwas_matrix(m, t.gwas, "cluster"), sizes)


@query(GWAS.format("cluster") + SHARES_OF.format(sizes=CLUSTER_SIZES) + SHARED)
def gwas_shares(t):
    return rounded(cluster_shares(t), "share")


@query(GWAS.format("obs_id") + SHARES_OF.format(sizes=SAMPLE_SIZES) + SHARED)
def gwas_sample_shares(t):
    m = count_matrix_of(t)
    sizes = m.x.groupBy(F.col("obs_id").alias("group")).agg(F.sum("value").alias("size"))
    return rounded(integrate.gwas_shares(integrate.gwas_matrix(m, t.gwas), sizes), "share")


@query(GWAS.format("cluster") + SHARES_OF.format(sizes=CLUSTER_SIZES) + """
SELECT w.trait, q.g AS "group", round(coalesce(v / w, 0), 6) AS share, CAST(total AS BIGINT) AS total FROM w CROSS JOIN (SELECT DISTINCT g FROM y) q LEFT JOIN y ON y.trait = w.trait AND y.g = q.g""")
def gwas_table(t):
    table = integrate.gwas_table(cluster_shares(t)).select("trait", "total", F.explode("shares").alias("s"))
    return rounded(table.select("trait", F.col("s.column").alias("group"), F.col("s.value").alias("share"), "total"), "share")


@query("""\n, g AS (SELECT upper(gene) AS g, count(DISTINCT chr) AS n, min(chr) AS c, min(start) AS s, max(end_) AS e FROM genes GROUP BY 1)
SELECT r.gene, c AS chr_new, s AS start_new, e AS end_new FROM (SELECT DISTINCT gene FROM rna) r LEFT JOIN g ON g.g = upper(r.gene) AND g.n = 1""")
def find_location(t):
    return integrate.find_location(t.rna.select("gene").distinct(), t.genes)


@query("\nSELECT gene AS motif, pvalue, pvalue_adj AS qvalue FROM rna a WHERE grp = 'k0' AND pvalue < 0.03 AND pvalue_adj < 0.05 AND gene NOT IN (SELECT gene FROM rna WHERE grp = 'k1' AND pvalue < 0.03 AND pvalue_adj < 0.05)")
def motif_diff(t):
    one, two = (t.rna.where(F.col("group") == g).select(F.col("gene").alias("motif"), "pvalue", F.col("pvalue_adj").alias("qvalue")) for g in ("k0", "k1"))
    return integrate.motif_difference(one, two, 0.03).select("motif", "pvalue", "qvalue")


LIFT = """,
j AS (SELECT p.chr, p.start, p.end_, c.dst_chr, c.strand, c.dst_start, c.src_start, c.src_end, greatest(p.start, c.src_start) AS up, least(p.end_, c.src_end - 1) AS dn FROM islands p JOIN chain c ON c.src_chr = p.chr AND c.src_start <= p.end_ AND c.src_end > p.start),
a AS (SELECT chr, start, end_, arg_min({'c': dst_chr, 'x': CASE WHEN strand = '-' THEN dst_start + src_end - 1 - up ELSE dst_start + up - src_start END}, up) AS a FROM j WHERE up < end_ GROUP BY 1, 2, 3),
b AS (SELECT chr, start, end_, arg_max({'c': dst_chr, 'x': CASE WHEN strand = '-' THEN dst_start + src_end - 1 - dn ELSE dst_start + dn - src_start END}, dn) AS b FROM j WHERE dn > start GROUP BY 1, 2, 3),
lf AS (SELECT a.chr, a.start, a.end_, a.a.c AS c, least(a.a.x, b.b.x) AS lo, greatest(a.a.x, b.b.x) AS hi FROM a JOIN b ON a.chr = b.chr AND a.start = b.start AND a.end_ = b.end_ WHERE a.a.c = b.b.c AND 10 * (a.end_ - a.start) > greatest(a.a.x, b.b.x) - least(a.a.x, b.b.x))"""


@query(INT_ISLANDS + LIFT + '\nSELECT p.chr, p.start, p.end_ AS "end", c AS chr_lift, lo AS start_lift, hi AS end_lift FROM islands p LEFT JOIN lf ON lf.chr = p.chr AND lf.start = p.start AND lf.end_ = p.end_')
def liftover(t):
    return integrate.liftover(peaks.islands(t.ins).drop("n"), t.chain)


@query(INT_ISLANDS + PAIR + LIFT + """, g AS (SELECT upper(gene) AS g, count(DISTINCT chr) AS n, min(chr) AS cc, min(start) AS s, max(end_) AS e FROM genes GROUP BY 1)
SELECT near.name, near.gene, lf.c AS chr_lift, lf.lo AS start_lift, lf.hi AS end_lift, g.cc AS chr_new, g.s AS start_new, g.e AS end_new FROM near LEFT JOIN lf ON concat_ws('_', lf.chr, lf.start, lf.end_) = near.name LEFT JOIN g ON g.g = upper(near.gene) AND g.n = 1""")
def result_mapping(t):
    pairs = integrate.gene_pairs(intervals.nearest_genes(peaks.islands(t.ins), t.genes)).select("name", "gene")
    return integrate.result_mapping(pairs, t.chain, t.genes).select("name", "gene", "chr_lift", "start_lift", "end_lift", "chr_new", "start_new", "end_new")


@query()
def footprint(t):
    return integrate.footprint(peaks.islands(t.ins), t.ins, min_insertions=15)


# --- views ------------------------------------------------------------------------------------------------------------
@query(M + rank_sql("count(*)", CELLS, FISHER).rpartition("\nSELECT g AS")[0] + """, y AS (SELECT g, var_id, lfc, -log10(greatest(p, 1e-300)) AS y FROM r)
SELECT g AS "group", var_id AS name, round(lfc, 6) AS x, round(y, 6) AS y, CASE WHEN y >= 0.5 AND lfc <= -0.5 THEN 'left' WHEN y > 0.5 AND lfc > 0.5 THEN 'right' ELSE 'none' END AS side FROM y""")
def volcano_classes(t):
    return rounded(views.volcano_classes(matrix.rank_peak_groups(count_matrix_of(t), "cluster"), None, 0.5, 0.5), "x", "y")


def bulk_rna(t) -> DataFrame:
    return t.rna.select(F.col("group").alias("sample"), "gene", "value")


@query(M + KNN + """,
s AS (SELECT cluster AS g, var_id, sum(value) AS v FROM x JOIN obs ON barcode = obs_id GROUP BY 1, 2), w AS (SELECT var_id, sum(v) AS w FROM s GROUP BY 1), tp AS (SELECT gene, max(ln(value + 1)) AS t FROM rna GROUP BY 1),
h AS (SELECT w.var_id AS name, w.w, gene1, gene2, t1.t AS t1, t2.t AS t2 FROM w JOIN ann ON concat_ws('_', ann.chr, ann.start, ann.end_) = w.var_id LEFT JOIN tp t1 ON t1.gene = gene1 LEFT JOIN tp t2 ON t2.gene = gene2 WHERE coalesce(t1.t, 0) > 0 OR coalesce(t2.t, 0) > 0),
cs AS (SELECT DISTINCT cluster AS g FROM obs), rs AS (SELECT DISTINCT grp AS g FROM rna)
SELECT name, 'peak' AS panel, cs.g AS "column", round(coalesce(s.v, 0) * 1.0 / w, 6) AS value FROM h CROSS JOIN cs LEFT JOIN s ON s.g = cs.g AND s.var_id = name
UNION ALL SELECT name, 'gene1', rs.g, round(coalesce(ln(r.value + 1) / t1, 0), 6) FROM h CROSS JOIN rs LEFT JOIN rna r ON r.grp = rs.g AND r.gene = gene1
UNION ALL SELECT name, 'gene2', rs.g, round(coalesce(ln(r.value + 1) / t2, 0), 6) FROM h CROSS JOIN rs LEFT JOIN rna r ON r.grp = rs.g AND r.gene = gene2""")
def heatmap_matrix(t):
    wide = views.heatmap(count_matrix_of(t), "cluster", intervals.nearest_genes(peaks.islands(t.ins), t.genes), bulk_rna(t))
    panel = lambda column, name: F.transform(column, lambda c: F.struct(F.lit(name).alias("panel"), c["column"].alias("column"), c["value"].alias("value")))
    cells = F.explode(F.concat(panel("shares", "peak"), panel("expression1", "gene1"), panel("expression2", "gene2")))
    return rounded(wide.select("name", cells.alias("c")).select("name", "c.panel", "c.column", "c.value"), "value")


@query(M + ", s AS (SELECT obs_id, sum(value) AS t FROM x GROUP BY 1), l AS (SELECT x.obs_id, var_id, log2(value * 1.0 / t + 1) AS v FROM x JOIN s ON s.obs_id = x.obs_id) SELECT obs_id, var_id AS name, round(v / sum(v) OVER (PARTITION BY var_id), 6) AS value FROM l")
def heatmap_cc(t):
    return rounded(views.heatmap_cc(count_matrix_of(t), normalize_cc=True), "value")


def dots_sql(group: str = "{0}", whole: bool = False) -> str:
    """group: the name of a sample's group; whole: the peaks' values have one row for each group."""
    return f""",
chosen AS (SELECT var_id FROM x GROUP BY 1 HAVING sum(value) >= 30), gp AS (SELECT concat_ws('_', chr, start, end_) AS name, unnest([{{'panel': 'gene1', 'gene': gene1}}, {{'panel': 'gene2', 'gene': gene2}}]) AS s FROM ann), has AS (SELECT DISTINCT name FROM gp WHERE s.gene IN (SELECT gene FROM rna) AND name IN (SELECT var_id FROM chosen)),
rw AS (SELECT name, s.panel AS panel, s.gene AS gene FROM gp WHERE name IN (SELECT name FROM has)), cm AS (SELECT DISTINCT cluster AS s, {group.format("cluster")} AS g FROM obs), rm AS (SELECT DISTINCT grp AS s, {group.format("grp")} AS g FROM rna), cz AS (SELECT g, {"1" if whole else "count(*)"} AS n FROM cm GROUP BY g), rz AS (SELECT g, count(*) AS n FROM rm GROUP BY g),
pv AS (SELECT m.g, var_id, sum(value) AS v FROM x JOIN obs ON barcode = obs_id JOIN cm m ON m.s = cluster GROUP BY 1, 2), gv AS (SELECT m.g, gene, sum(log2(value + 1)) AS v FROM rna JOIN rm m ON m.s = grp GROUP BY 1, 2),
dots AS (SELECT cz.g, has.name, 'peak' AS panel, '' AS gene, log2(coalesce(pv.v, 0) * 1.0 / n + 1) AS v FROM has CROSS JOIN cz LEFT JOIN pv ON pv.g = cz.g AND pv.var_id = has.name UNION ALL SELECT rz.g, rw.name, panel, rw.gene, coalesce(gv.v, 0) / n FROM rw CROSS JOIN rz LEFT JOIN gv ON gv.g = rz.g AND gv.gene = rw.gene)
SELECT g AS "group", name, panel, gene, round(coalesce(v / nullif(max(v) OVER (PARTITION BY panel), 0), 0), 6) AS dot FROM dots"""


PARITY = "concat('g', CAST(CAST(substr({0}, 2) AS INT) % 2 AS STRING))"


def bulk_dots(t, by: str, **groups) -> DataFrame:
    m = count_matrix_of(t)
    names = m.x.groupBy(F.col("var_id").alias("name")).agg(F.sum("value").alias("s")).where("s >= 30").select("name")
    values = m.x.join(m.obs, "obs_id").groupBy(F.expr(by).alias("sample"), F.col("var_id").alias("name")).agg(F.sum("value").alias("value"))
    return rounded(views.dotplot_bulk(values, intervals.nearest_genes(peaks.islands(t.ins), t.genes), bulk_rna(t), names, **groups), "dot")


def parities(samples: DataFrame) -> DataFrame:
    """sample, group: the samples, by their number's parity."""
    return samples.toDF("sample").distinct().withColumn("group", F.expr(PARITY.format("sample")))


@query(M + KNN + dots_sql())
def dotplot_bulk(t):
    return bulk_dots(t, "cluster")


@query(M + KNN + dots_sql(PARITY))
def dotplot_bulk_replicates(t):
    return bulk_dots(t, "cluster", value_groups=parities(t.obs.select("cluster")), rna_groups=parities(t.rna.select("group")))


@query(M + KNN + dots_sql(PARITY, whole=True))
def dotplot_bulk_groups(t):
    return bulk_dots(t, PARITY.format("cluster"), rna_groups=parities(t.rna.select("group")))


@query(M + """,
z AS (SELECT cluster AS g, count(*) AS n FROM obs GROUP BY 1), s AS (SELECT cluster AS g, var_id, sum(value) AS s FROM x JOIN obs ON barcode = obs_id GROUP BY 1, 2),
v AS (SELECT z.g, k.var_id, log2(coalesce(s.s, 0) * 1.0 / n + 1) AS v FROM (SELECT DISTINCT var_id FROM x) k CROSS JOIN z LEFT JOIN s ON s.g = z.g AND s.var_id = k.var_id)
SELECT g AS "group", var_id AS name, round(coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0), 6) AS dot FROM v WINDOW w AS (PARTITION BY var_id)""")
def dotplot_sc(t):
    return rounded(views.dotplot_sc(count_matrix_of(t), "cluster"), "dot")


@query(INT_ISLANDS + ', l AS (SELECT chr, max(end_) + 10000 AS length FROM islands GROUP BY 1)\nSELECT p.chr, start, end_ AS "end", round(ln(n + 1), 6) AS height, length FROM islands p JOIN l ON l.chr = p.chr')
def whole_genome_track(t):
    return rounded(views.whole_genome_track(peaks.islands(t.ins).withColumnRenamed("n", "experiment_insertions")), "height")


SIGNAL = INT_ISLANDS + """,
b AS (SELECT chr, start, end_, unnest(range(0, 10)) AS bin FROM islands), c AS (SELECT *, start - 1000 + (end_ + 1000 - (start - 1000)) / 10.0 * bin AS lo, start - 1000 + (end_ + 1000 - (start - 1000)) / 10.0 * (bin + 1) AS hi FROM b),
sm AS (SELECT c.chr, c.start, c.end_, c.bin, sum(s.value * CAST(least(hi, s.end_) - greatest(lo, s.start) AS DOUBLE)) / sum(CAST(least(hi, s.end_) - greatest(lo, s.start) AS DOUBLE)) AS value FROM c JOIN signal s ON s.chr = c.chr AND s.start < c.hi AND s.end_ > c.lo GROUP BY 1, 2, 3, 4)"""


@query(SIGNAL + '\nSELECT chr, start, end_ AS "end", CAST(bin AS INTEGER) AS bin, round(value, 6) AS value FROM sm')
def signal_matrix(t):
    return rounded(views.signal_matrix(peaks.islands(t.ins), t.signal, nbins=10), "value")


BAND = "round(list_sort(list(value))[CAST(least(floor(count(*) * {}), count(*) - 1) AS INTEGER) + 1], 6)"


@query(SIGNAL + f"\nSELECT CAST(bin AS INTEGER) AS bin, round(avg(value), 6) AS mean, {BAND.format(0.025)} AS low, {BAND.format(0.975)} AS high FROM sm GROUP BY 1")
def signal_profile(t):
    return rounded(views.signal_profile(views.signal_matrix(peaks.islands(t.ins), t.signal, nbins=10)), "mean", "low", "high")


def area_sql(where: str = "TRUE") -> str:
    """The insertions, their density, peaks and genes of an area."""
    return f""", held AS (SELECT * FROM ins WHERE chr = 'chr3' AND end_ >= 500000 AND start <= 900000 AND {where})
SELECT 'insertions' AS panel, start AS at, round(ln(reads + 1), 6) AS height FROM held
UNION ALL SELECT 'density', CAST(floor((start - 500000) / 8000) AS BIGINT), CAST(count(*) AS DOUBLE) FROM held WHERE start >= 500000 AND start < 900000 GROUP BY 2
UNION ALL SELECT 'peaks', start, CAST(end_ AS DOUBLE) FROM islands WHERE chr = 'chr3' AND end_ >= 500000 AND start <= 900000
UNION ALL SELECT 'genes', start, CAST(end_ AS DOUBLE) FROM genes WHERE chr = 'chr3' AND end_ >= 500000 AND start <= 900000"""


HEIGHTS = {"insertions": ("start", "height"), "density": ("bin", "n"), "peaks": ("start", "end"), "genes": ("start", "end"), "background": ("start", "end"), "background_density": ("bin", "height")}


def area_rows(parts: dict[str, DataFrame]) -> DataFrame:
    one = lambda k: parts[k].select(F.lit(k).alias("panel"), F.col(HEIGHTS[k][0]).cast("long").alias("at"), F.round(F.col(HEIGHTS[k][1]).cast("double"), 6).alias("height"))
    return intervals.union_all([one(k) for k in parts])


@query(INT_ISLANDS + area_sql() + """
UNION ALL SELECT 'background', start, CAST(start + 4 AS DOUBLE) FROM bg WHERE chr = 'chr3' AND start >= 500000 AND start + 4 <= 900000
UNION ALL SELECT 'background_density', CAST(floor((start - 500000) / 8000) AS BIGINT), round(ln(count(*) + 1), 6) FROM bg WHERE chr = 'chr3' AND start >= 500000 AND start + 4 <= 900000 GROUP BY 2""")
def draw_area(t):
    background = t.bg.withColumn("end", F.col("start") + 4)
    return area_rows(views.draw_area(peaks.islands(t.ins), t.ins, t.genes, "chr3", 500000, 900000, background=background))


# --- several modalities -----------------------------------------------------------------------------------------------------
def two_modalities(t) -> matrix.MultiModal:
    """Insertions, and invented expression, over shared samples."""
    cc = count_matrix_of(t)
    x = t.ins.groupBy(F.col("barcode").alias("obs_id"), F.expr("concat('GENE', CAST(start % 300 AS STRING))").alias("var_id")).agg(F.sum("reads").alias("value"))
    rna = matrix.CountMatrix(x, cc.obs.select("obs_id"), x.select("var_id").distinct())
    return matrix.MultiModal({"CC": cc, "RNA": rna}, cc.obs.select("obs_id", F.col("cluster").alias("RNA:cluster")))


@query(M + rank_sql("count(*)", CELLS, FISHER).replace("ORDER BY round(adj, 9)", "ORDER BY round(p, 9)"))
def rank_groups_mu(t):
    return rounded(matrix.rank_peak_groups_mu(two_modalities(t), "RNA:cluster"), "pvalue", "pvalue_adj", "logfoldchange")


@query(INSERTIONS.format("log2(coalesce(s, 0) * 1.0 / n + 1)"))
def insertions_per_group_mu(t):
    return rounded(matrix.insertions_by_group_mu(two_modalities(t), "cluster", "logavginsertions"), "value")


@query(SQL["pair_genes_sc"].removeprefix(f"WITH {CTES}"))
def pair_genes_mu(t):
    mm = two_modalities(t)
    found = integrate.pair_peak_gene_mu(mm, matrix.rank_peak_groups_mu(mm, "RNA:cluster"), intervals.nearest_genes(peaks.islands(t.ins), t.genes), t.rna, "RNA:cluster",
                                        pvalue_cutoff_cc=0.3, pvalue_adj_cutoff_cc=None, pvalue_cutoff_rna=0.04, pvalue_adj_cutoff_rna=0.5, lfc_cutoff=0.2, score_cutoff=3, distance_cutoff=200000)
    return rounded(found.select("group", "name", "gene", "distance", "logfoldchange_cc", "pvalue_cc", "score_rna", "pvalue_rna"), "logfoldchange_cc", "pvalue_cc")


@query(M + PAIR + """,
rx AS (SELECT barcode AS obs_id, concat('GENE', CAST(start % 300 AS STRING)) AS var_id, sum(reads) AS value FROM ins GROUP BY 1, 2), pr AS (SELECT name, gene FROM near WHERE gene IN (SELECT var_id FROM rx)),
z AS (SELECT cluster AS g, count(*) AS n FROM obs GROUP BY 1), s AS (SELECT 'peak' AS kind, cluster AS g, var_id, sum(value) AS s FROM x JOIN obs ON barcode = obs_id GROUP BY 1, 2, 3 UNION ALL SELECT 'gene', cluster, var_id, sum(value) FROM rx JOIN obs ON barcode = obs_id GROUP BY 1, 2, 3),
f AS (SELECT DISTINCT 'peak' AS kind, name FROM pr UNION ALL SELECT DISTINCT 'gene', gene FROM pr),
v AS (SELECT z.g, f.kind, f.name, CASE WHEN f.kind = 'peak' THEN log2(coalesce(s.s, 0) * 1.0 / n + 1) ELSE coalesce(s.s, 0) * 1.0 / n END AS v FROM f CROSS JOIN z LEFT JOIN s ON s.kind = f.kind AND s.g = z.g AND s.var_id = f.name)
SELECT g AS "group", name, round(coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0), 6) AS dot, kind FROM v WINDOW w AS (PARTITION BY kind, name)""")
def dotplot_sc_mu(t):
    mm = two_modalities(t)
    pairs = integrate.gene_pairs(intervals.nearest_genes(peaks.islands(t.ins), t.genes)).join(mm.parts["RNA"].var.select(F.col("var_id").alias("gene")), "gene", "left_semi")
    return rounded(views.dotplot_sc_mu(mm, "RNA:cluster", pairs.select("name", "gene")), "dot")


@query(INT_ISLANDS + area_sql("barcode IN (SELECT barcode FROM obs WHERE cluster = 'k1')"))
def draw_area_mu(t):
    return area_rows(views.draw_area_mu(two_modalities(t), peaks.islands(t.ins), t.ins, t.genes, "chr3", 500000, 900000, "RNA:cluster", "k1"))


# --- time ---------------------------------------------------------------------------------------------------------------
@query(""", e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, i""")
def event_sessions(t):
    return streaming.sessions(t.spark.read.parquet(f"{t.sf_dir}/events.parquet"))
