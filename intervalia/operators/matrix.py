"""Sparse matrices of samples by peaks, as rows (obs_id, var_id, value) beside the tables of both sides; differential tests and ranking."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..sources import schema as S
from .intervals import range_join


@dataclass(frozen=True)
class CountMatrix:
    """x: obs_id, var_id, value (entries that are not zero); obs: obs_id and attributes; var: var_id and attributes."""

    x: DataFrame
    obs: DataFrame
    var: DataFrame


@dataclass(frozen=True)
class MultiModal:
    """Matrices by modality over shared samples."""

    parts: dict[str, CountMatrix]
    obs: DataFrame


def modality(mm: MultiModal, part: str) -> CountMatrix:
    """One matrix with the shared attributes; samples that the shared table lacks are left out."""
    m = mm.parts[part]
    obs = mm.obs.join(m.obs.select("obs_id"), "obs_id", "left_semi")
    return replace(m, obs=obs, x=m.x.join(obs.select("obs_id"), "obs_id", "left_semi"))


def insertions_by_group_mu(mm: MultiModal, groupby: str, method: str = "logAvginsertions", peak: str | None = None, part: str = "CC", of: str = "RNA") -> DataFrame:
    """insertions_by_group over the shared attribute `of:groupby`; the method's name in any case."""
    named = {n.lower(): n for n in ("suminsertions", "Avginsertions", "logsuminsertions", "logAvginsertions")}
    return insertions_by_group(modality(mm, part), f"`{of}:{groupby}`", named.get(method.lower(), method), peak)


def rank_peak_groups_mu(mm: MultiModal, groupby: str, part: str = "CC", rankby: str = "pvalues", **options) -> DataFrame:
    """rank_peak_groups by a shared attribute, cells compared."""
    return rank_peak_groups(modality(mm, part), f"`{groupby}`", by="cell", rankby=rankby, **options)


def dense_rows(cells: DataFrame, key: str, column: str, value: str, columns: DataFrame | None = None) -> DataFrame:
    """key, cells array<struct<column, value>>: one row of a matrix for each key, its columns (those of `columns`, else of the cells) in order, 0 where there is no cell."""
    every = (cells if columns is None else columns).agg(F.array_sort(F.collect_set(column)).alias("_c"))
    rows = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(column, F.col(value).cast("double")))).alias("_m"))
    at = lambda c: F.struct(c.alias("column"), F.coalesce(F.element_at("_m", c), F.lit(0.0)).alias("value"))
    return rows.crossJoin(F.broadcast(every)).select(key, F.transform("_c", at).alias("cells"))


def peak_name(prefix: str = ""):
    return F.concat_ws("_", *[F.col(prefix + c) for c in ("chr", "start", "end")])


def make_matrix(qbed: DataFrame, peaks: DataFrame, barcodes: DataFrame, half_width: int = 3, check: bool = True) -> CountMatrix:
    """Counts of insertions by barcode and peak. A position belongs to the first peak, in the peaks' order, that holds it; positions are matched once, whatever their number of insertions."""
    codes = barcodes.select(F.col(barcodes.columns[0]).alias("obs_id"), *barcodes.columns[1:]).dropDuplicates(["obs_id"])
    if check and qbed.join(codes, qbed["barcode"] == codes["obs_id"], "left_anti").limit(1).count():
        raise KeyError("insertions with a barcode that is not in the list")
    var = peaks.dropDuplicates(["chr", "start", "end"]).withColumn("var_id", peak_name()).withColumn("var_key", S.chromosome_key(F.col("chr")))
    owner = range_join(var.select("chr", "start", "end", "var_id"), qbed.select("chr", "start").distinct(), F.col("start") - half_width, F.col("end"))
    owner = owner.groupBy(F.col("_point.chr").alias("chr"), F.col("_point.start").alias("start")).agg(F.min(F.struct(owner["start"], owner["end"], "var_id")).alias("_o"))
    owner = owner.select("chr", "start", F.col("_o.var_id").alias("var_id"))
    x = qbed.join(owner, ["chr", "start"]).groupBy(F.col("barcode").alias("obs_id"), "var_id").agg(F.count(F.lit(1)).alias("value"))
    return CountMatrix(x, codes, var)


def filter_peaks(m: CountMatrix, min_counts: int | None = None, min_cells: int | None = None, max_counts: int | None = None, max_cells: int | None = None) -> CountMatrix:
    """Peaks by exactly one bound on their insertions or samples; a peak without entries counts 0."""
    given = [(k, v) for k, v in (("min_counts", min_counts), ("min_cells", min_cells), ("max_counts", max_counts), ("max_cells", max_cells)) if v is not None]
    if len(given) != 1:
        raise ValueError("give exactly one of min_counts, min_cells, max_counts, max_cells")
    (kind, bound), = given
    sums = m.x.groupBy("var_id").agg((F.sum("value") if "counts" in kind else F.count(F.lit(1))).alias("_s"))
    value = F.coalesce("_s", F.lit(0))
    kept = m.var.join(sums, "var_id", "left").where(value >= bound if kind.startswith("min") else value <= bound).drop("_s")
    return replace(m, var=kept, x=m.x.join(kept.select("var_id"), "var_id", "left_semi"))


def filter_obs(m: CountMatrix, other: DataFrame) -> CountMatrix:
    """Samples that the other table (obs_id) has; an error if it has samples that m lacks."""
    if other.join(m.obs, "obs_id", "left_anti").limit(1).count():
        raise ValueError("the other table has samples that the matrix lacks")
    return replace(m, obs=m.obs.join(other.select("obs_id"), "obs_id", "left_semi"), x=m.x.join(other.select("obs_id"), "obs_id", "left_semi"))


def insertions_by_group(m: CountMatrix, groupby: str = "cluster", method: str = "logAvginsertions", peak: str | None = None) -> DataFrame:
    """group, value: samples' entries of a group that are not zero, summed or averaged over its samples, and as log2(v + 1)."""
    if method not in ("suminsertions", "Avginsertions", "logsuminsertions", "logAvginsertions"):
        raise ValueError(f"unknown method {method}")
    x = m.x if peak is None else m.x.where(F.col("var_id") == peak)
    sizes = m.obs.groupBy(F.col(groupby).alias("group")).agg(F.count(F.lit(1)).alias("_n"))
    sums = x.where("value <> 0").join(m.obs.select("obs_id", F.col(groupby).alias("group")), "obs_id").groupBy("group").agg(F.count(F.lit(1)).alias("_s"))
    v = F.coalesce("_s", F.lit(0)) / (F.col("_n") if "Avg" in method else F.lit(1))
    return sizes.join(sums, "group", "left").select("group", (F.log2(v + 1) if method.startswith("log") else v.cast("double")).alias("value"))


def with_group_insertions(obs: DataFrame, values: DataFrame, groupby: str, name: str) -> DataFrame:
    return obs.join(values.select(F.col("group").alias(groupby), F.col("value").alias(name)), groupby, "left")


def group_totals(m: CountMatrix, groupby: str | None, count: str, total: str, reference: str | None = None) -> DataFrame:
    """group, var_id, number, number_rest, total, total_rest for every group and peak, in one pass: what is outside a group is the whole less the group, or the reference group.

    count: sum or nnz of a peak's entries; total: cells of a group, or its insertions. groupby None: each sample is a group."""
    label = F.col("obs_id" if groupby is None else groupby)
    obs = m.obs.select("obs_id", label.alias("group"))
    entries = m.x.join(obs, "obs_id").groupBy("group", "var_id").agg((F.sum("value") if count == "sum" else F.count(F.when(F.col("value") != 0, 1))).alias("number"))
    whole = entries.groupBy("var_id").agg(F.sum("number").alias("_all")) if reference is None else entries.where(F.col("group") == reference).select("var_id", F.col("number").alias("_all"))
    if total == "cells":
        sizes = obs.groupBy("group").agg(F.count(F.lit(1)).alias("total"))
    else:
        held = m.x.join(obs, "obs_id").groupBy("group").agg(F.sum("value").alias("total"))
        sizes = obs.select("group").distinct().join(held, "group", "left").fillna(0, ["total"])
    every = (sizes if reference is None else sizes.where(F.col("group") == reference)).agg(F.sum("total").alias("_every"))
    grid = sizes.join(F.broadcast(every)).join(m.var.select("var_id").join(whole, "var_id", "left").fillna(0, ["_all"]))
    df = grid.join(entries, ["group", "var_id"], "left").fillna(0, ["number"])
    own = lambda c: F.col(c) if reference is None else F.lit(0)
    return df.select("group", "var_id", "number", (F.col("_all") - own("number")).alias("number_rest"), "total", (F.col("_every") - own("total")).alias("total_rest"))


RANK_BY = {"pvalues": F.asc, "pvalues_adj": F.asc, "logfoldchanges": F.desc}
COLUMN = {"pvalues": "pvalue", "pvalues_adj": "pvalue_adj", "logfoldchanges": "logfoldchange"}


def rank_peak_groups(m: CountMatrix, groupby: str | None, by: str = "cell", method: str = "fisher_exact", alternative: str | None = None, groups: list[str] | str | None = None, n_peaks: int | None = None, rankby: str = "pvalues_adj", reference: str | None = None) -> DataFrame:
    """group, rank, name, pvalue, pvalue_adj, logfoldchange, number, number_rest, total, total_rest. by: cell, sample or group. Each group is compared with all others, or with the reference group. Ties go by name."""
    if by not in ("cell", "sample", "group") or rankby not in RANK_BY:
        raise ValueError(f"unknown by {by} or rankby {rankby}")
    alternative = alternative or ("greater" if by == "cell" else "two-sided")
    count = "sum" if by != "cell" or method == "binomtest" else "nnz"
    df = group_totals(m, None if by == "group" else groupby, count, "cells" if by == "cell" else "insertions", None if reference == "rest" else reference)
    if groups is not None and groups != "all":
        df = df.where(F.col("group").isin([groups] if isinstance(groups, str) else groups))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)) + 1e-6
    df = df.withColumn("pvalue", stats.difference_test(method, alternative)("number", "number_rest", "total", "total_rest"))
    df = df.withColumn("logfoldchange", F.log2(share(F.col("number"), F.col("total")) / share(F.col("number_rest"), F.col("total_rest"))))
    df = stats.adjusted(df, "pvalue", "pvalue_adj", ["group"])
    # Rounded, so that equal tests tie whatever order their terms were added in.
    order = Window.partitionBy("group").orderBy(RANK_BY[rankby](F.round(COLUMN[rankby], 9)), "var_id")
    df = df.withColumn("rank", F.row_number().over(order))
    df = df if n_peaks is None else df.where(F.col("rank") <= n_peaks)
    return df.select("group", "rank", F.col("var_id").alias("name"), "pvalue", "pvalue_adj", "logfoldchange", "number", "number_rest", "total", "total_rest")


def filter_ranking(df: DataFrame, group: list[str] | None = None, pval_cutoff: float | None = None, pval_adj_cutoff: float | None = None, logfc_min: float | None = None, logfc_max: float | None = None) -> DataFrame:
    for test in (group is not None and F.col("group").isin(group), pval_cutoff is not None and F.col("pvalue") <= pval_cutoff, pval_adj_cutoff is not None and F.col("pvalue_adj") <= pval_adj_cutoff, logfc_min is not None and F.col("logfoldchange") >= logfc_min, logfc_max is not None and F.col("logfoldchange") <= logfc_max):
        df = df if test is False else df.where(test)
    return df


def difference_of_groups(m: CountMatrix, groupby: str, name1: str, name2: str | None = None, peak: str | None = None, method: str = "fisher_exact", alternative: str = "greater", by: str = "cell") -> DataFrame:
    """name, pvalue of one group against another, or against all others."""
    count = "nnz" if by == "cell" and method != "binomtest" else "sum"
    df = group_totals(m, groupby, count, "cells" if by == "cell" else "insertions")
    df = df if peak is None else df.where(F.col("var_id") == peak)
    one = df.where(F.col("group") == name1)
    if name2 is not None:
        two = df.where(F.col("group") == name2).select("var_id", F.col("number").alias("number_rest"), F.col("total").alias("total_rest"))
        one = one.drop("number_rest", "total_rest").join(two, "var_id")
    return one.select(F.col("var_id").alias("name"), "number", "number_rest", "total", "total_rest", stats.difference_test(method, alternative)("number", "number_rest", "total", "total_rest").alias("pvalue"))
