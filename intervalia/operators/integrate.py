"""Peaks with genes, traits, other genomes and motifs; footprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import kept, range_join
from .matrix import CountMatrix, MultiModal, dense_rows, modality, peak_name


def gene_pairs(annotation: DataFrame) -> DataFrame:
    """name, gene, distance: both nearest genes of each peak; if they have one name, the nearer's distance."""
    both = F.expr("stack(2, 1, gene1, distance1, 2, gene2, distance2) as (_r, gene, distance)")
    rows = annotation.select(peak_name().alias("name"), both).where("gene is not null")
    return rows.groupBy("name", "gene").agg(F.min_by("distance", "_r").alias("distance"))


def within(c, cutoff):
    return F.lit(True) if cutoff is None else c <= cutoff


def pair_peak_gene(ranking: DataFrame, annotation: DataFrame, expression: DataFrame, pvalue_cutoff_cc: float | None = None, pvalue_adj_cutoff_cc: float | None = 0.01, pvalue_cutoff_rna: float | None = None, pvalue_adj_cutoff_rna: float | None = 0.01,
                   lfc_cutoff: float | None = 3, score_cutoff: float | None = 3, distance_cutoff: float | None = None, by_group: bool = True) -> DataFrame:
    """Peaks of a ranking whose nearest genes are differentially expressed in the same group.

    expression: group (if by_group), gene, pvalue, pvalue_adj, score (of single cells, or the log fold change of bulk samples)."""
    peaks = ranking.where(within(F.col("pvalue"), pvalue_cutoff_cc) & within(F.col("pvalue_adj"), pvalue_adj_cutoff_cc))
    peaks = peaks if lfc_cutoff is None else peaks.where(F.abs("logfoldchange") >= lfc_cutoff)
    peaks = peaks.select("group", "name", F.col("logfoldchange").alias("logfoldchange_cc"), F.col("pvalue").alias("pvalue_cc"), F.col("pvalue_adj").alias("pvalue_adj_cc"))
    rna = expression.where(within(F.col("pvalue"), pvalue_cutoff_rna) & within(F.col("pvalue_adj"), pvalue_adj_cutoff_rna))
    rna = rna if score_cutoff is None else rna.where(F.abs("score") >= score_cutoff)
    keys = ["group", "gene"] if by_group else ["gene"]
    rna = rna.select(*keys, F.col("score").alias("score_rna"), F.col("pvalue").alias("pvalue_rna"), F.col("pvalue_adj").alias("pvalue_adj_rna"))
    near = gene_pairs(annotation)
    near = near if distance_cutoff is None else near.where(F.abs("distance") <= distance_cutoff)
    return peaks.join(near, "name").join(rna, keys)


def trait_hits(peaks: DataFrame, gwas: DataFrame) -> DataFrame:
    """chr, start, end, trait, n: trait positions in each peak."""
    points = gwas.select(F.concat(F.lit("chr"), "chr_id").alias("chr"), F.col("chr_pos").alias("start"), "trait").where("start is not null")
    held = range_join(peaks.select("chr", "start", "end").distinct(), points, F.col("start"), F.col("end"))
    return held.groupBy("chr", "start", "end", F.col("_point.trait").alias("trait")).agg(F.count(F.lit(1)).alias("n"))


def gwas_traits(peaks: DataFrame, gwas: DataFrame, missing: str | None = None) -> DataFrame:
    """peaks with gwas: the distinct traits inside, sorted, joined by '; '."""
    found = trait_hits(peaks, gwas).groupBy("chr", "start", "end").agg(F.array_join(F.array_sort(F.collect_set("trait")), "; ").alias("gwas"))
    out = peaks.join(found, ["chr", "start", "end"], "left")
    return out if missing is None else out.fillna(missing, ["gwas"])


def gwas_matrix(m: CountMatrix, gwas: DataFrame, groupby: str | None = None, number: int = 100) -> DataFrame:
    """trait, group, value: insertions of a group's samples (or of each sample) in peaks, times the trait's positions there; traits over `number` in all."""
    hits = trait_hits(m.var, gwas).withColumn("var_id", peak_name()).select("var_id", "trait", "n")
    group = F.col("obs_id" if groupby is None else groupby)
    grouped = m.x.join(m.obs.select("obs_id", group.alias("group")), "obs_id").groupBy("group", "var_id").agg(F.sum("value").alias("v"))
    cells = grouped.join(hits, "var_id").groupBy("trait", "group").agg(F.sum(F.col("v") * F.col("n")).alias("value"))
    big = cells.groupBy("trait").agg(F.sum("value").alias("_t")).where(F.col("_t") > number)
    return cells.join(big.select("trait"), "trait", "left_semi")


def gwas_shares(matrix: DataFrame, sizes: DataFrame) -> DataFrame:
    """trait, group, share, total: the value divided by the group's size (group, size), over the sum of these of the trait; total: the trait's undivided values."""
    per = matrix.join(sizes, "group").withColumn("_v", F.col("value") / F.col("size"))
    whole = per.groupBy("trait").agg(F.sum("_v").alias("_w"), F.sum("value").alias("total"))
    return per.join(whole, "trait").select("trait", "group", (F.col("_v") / F.col("_w")).alias("share"), "total")


def gwas_table(shares: DataFrame) -> DataFrame:
    """trait, total, shares array<struct<column, value>>: one row a trait, those with the largest shares, group after group, first."""
    totals = shares.select("trait", "total").distinct()
    return dense_rows(shares, "trait", "group", "share").join(totals, "trait").select("trait", "total", F.col("cells").alias("shares")).orderBy(F.desc("shares"), "trait")


def pair_peak_gene_mu(mm: MultiModal, ranking: DataFrame, annotation: DataFrame, expression: DataFrame, groupby: str, part: str = "CC", **options) -> DataFrame:
    """pair_peak_gene in the groups of the shared attribute."""
    groups = modality(mm, part).obs.select(F.col(f"`{groupby}`").alias("group")).distinct()
    return pair_peak_gene(ranking.join(groups, "group", "left_semi"), annotation, expression, **options)


def find_location(names: DataFrame, genes: DataFrame, column: str = "gene") -> DataFrame:
    """names with chr, start, end of each gene (by its upper-cased name) that lies on one chromosome; else null."""
    g = genes.groupBy(F.upper("gene").alias("_g")).agg(F.countDistinct("chr").alias("_n"), F.min("chr").alias("chr_new"), F.min("start").alias("start_new"), F.max("end").alias("end_new")).where("_n = 1").drop("_n")
    return names.join(g, F.upper(F.col(column)) == F.col("_g"), "left").drop("_g")


def motif_difference(one: DataFrame, two: DataFrame, pvalue_cutoff: float = 0.05, qvalue_cutoff: float = 0.05) -> DataFrame:
    """Significant motifs of the first result that are not significant in the second."""
    ok = (F.col("pvalue") < pvalue_cutoff) & (F.col("qvalue") < qvalue_cutoff)
    return one.where(ok).join(two.where(ok).select("motif"), "motif", "left_anti")


def liftover(peaks: DataFrame, chain: DataFrame, tolerance: int = 10) -> DataFrame:
    """peaks with chr_lift, start_lift, end_lift. chain: blocks src_chr, src_start, src_end (half open), dst_chr, dst_start, strand.

    The first base of a peak that maps, from either side, is the nearest base of an overlapping block, so no base is tried by itself. Accepted if both
    ends land on one chromosome and the new length is under tolerance times the old."""
    p = peaks.select("chr", "start", "end").distinct()
    width = 100_000
    binned = p.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    blocks = chain.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("src_start") / width), F.floor(F.col("src_end") / width))))
    j = binned.join(blocks, (binned["chr"] == blocks["src_chr"]) & (binned["_bin"] == blocks["_bin"]) & (F.col("src_start") <= F.col("end")) & (F.col("src_end") > F.col("start")))
    to = lambda x: F.when(F.col("strand") == "-", F.col("dst_start") + (F.col("src_end") - 1 - x)).otherwise(F.col("dst_start") + (x - F.col("src_start")))
    up, down = F.greatest("start", "src_start"), F.least(F.col("end"), F.col("src_end") - 1)
    down_ok = F.when(down > F.col("start"), F.struct(F.negative(down).alias("o"), F.col("dst_chr").alias("c"), to(down).alias("x")))
    ends = j.groupBy("chr", "start", "end").agg(F.min(F.when(up < F.col("end"), F.struct(up.alias("o"), F.col("dst_chr").alias("c"), to(up).alias("x")))).alias("_a"), F.min(down_ok).alias("_b"))
    lo, hi = F.least("_a.x", "_b.x"), F.greatest("_a.x", "_b.x")
    ok = (F.col("_a.c") == F.col("_b.c")) & (tolerance * (F.col("end") - F.col("start")) > hi - lo)
    found = ends.where(ok).select("chr", "start", "end", F.col("_a.c").alias("chr_lift"), lo.alias("start_lift"), hi.alias("end_lift"))
    return peaks.join(found, ["chr", "start", "end"], "left")


def result_mapping(pairs: DataFrame, chain: DataFrame, genes: DataFrame, tolerance: int = 10) -> DataFrame:
    """Lifted peaks and located genes of a pair table (name, gene). A chromosome's own name may hold underscores: the last two parts are the bounds."""
    parts = F.split("name", "_")
    n = F.size(parts)
    df = pairs.withColumns({"chr": F.array_join(F.slice(parts, 1, n - 2), "_"), "start": F.element_at(parts, n - 1).cast("long"), "end": F.element_at(parts, n).cast("long")})
    return find_location(liftover(df, chain, tolerance), genes).drop("chr", "start", "end")


def middle(x: np.ndarray, cum: np.ndarray, q: float) -> float:
    """The quantile, between neighbours, of sorted values that stand as often as the steps of cum."""
    at = (cum[-1] - 1) * q
    low, high = x[np.searchsorted(cum, [int(at), min(int(at) + 1, cum[-1] - 1)], "right")]
    return low + (high - low) * (at - int(at))


def two_normals(x: np.ndarray, rounds: int = 200, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of a mixture of two normals, by expectation maximisation from the quartiles, of values that stand once or `counts` times."""
    order = np.argsort(x, kind="stable")
    x = np.asarray(x, float)[order]
    times = np.ones(len(x)) if counts is None else np.asarray(counts, float)[order]
    cum = np.cumsum(times)
    mean = np.array([middle(x, cum, q) for q in (0.25, 0.75)])
    centre = (times * x).sum() / cum[-1]
    sd = np.full(2, max(np.sqrt((times * (x - centre) ** 2).sum() / cum[-1]), 1e-3))
    weight = np.full(2, 0.5)
    for _ in range(rounds):
        logp = np.log(weight) - np.log(sd) - 0.5 * ((x[:, None] - mean) / sd) ** 2
        r = np.exp(logp - logp.max(axis=1, keepdims=True))
        r *= (times / r.sum(axis=1))[:, None]
        n = r.sum(axis=0) + 1e-12
        new = (r * x[:, None]).sum(axis=0) / n
        sd = np.sqrt((r * (x[:, None] - new) ** 2).sum(axis=0) / n + 1e-6)
        weight = n / n.sum()
        done = np.abs(new - mean).max() < 1e-9
        mean = new
        if done:
            break
    return mean, sd


def footprint(peaks: DataFrame, qbed: DataFrame, fixed_number: float = 50, compress_number: float = 0, min_insertions: int = 15, delete_unfound: bool = False) -> DataFrame:
    """peaks with foot_start, foot_end: between the two modes of the insertions of a peak, less `compress` deviations on each side, if at least fixed_number wide; else the peak's bounds, or null."""
    peaks = kept(peaks)
    # Equal insertions are one row with a count: a peak brings no more rows than it has positions.
    spots = qbed.where(F.col("end").isNotNull()).groupBy("chr", "start", "end").agg(F.count(F.lit(1)).alias("n"))
    held = range_join(peaks.select("chr", "start", "end").distinct(), spots, F.col("start"), F.col("end")).where(F.col("_point.end") <= F.col("end"))
    rows = held.select("chr", "start", "end", F.col("_point.start").alias("at"), F.col("_point.n").alias("n"))
    names = ["chr", "start", "end", "foot_start", "foot_end"]

    def fit(rows: pa.Table) -> pa.Table:
        at, n = (rows.column(c).to_numpy() for c in ("at", "n"))
        out = []
        if n.sum() >= min_insertions:
            mean, sd = two_normals(at, counts=n)
            lo, hi = np.argsort(mean)
            x1, x2 = mean[lo] + sd[lo] * compress_number, mean[hi] - sd[hi] * compress_number
            if x2 - x1 >= fixed_number:
                out.append((*(rows.column(c)[0].as_py() for c in names[:3]), int(x1), int(x2 + 1)))
        return pa.table([pa.array([r[j] for r in out], pa.int64() if j else pa.string()) for j in range(5)], names=names)

    found = rows.groupBy("chr", "start", "end").applyInArrow(fit, "chr string, start long, end long, foot_start long, foot_end long")
    out = peaks.join(found, ["chr", "start", "end"], "left")
    return out if delete_unfound else out.withColumns({"foot_start": F.coalesce("foot_start", "start"), "foot_end": F.coalesce("foot_end", "end")})
