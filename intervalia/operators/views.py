"""The tables behind plots: areas, genome tracks, signals, volcano classes, heat maps, dot plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import histogram, overlap_area, union_all
from .matrix import CountMatrix, MultiModal, dense_rows, modality, peak_name


def draw_area(peaks: DataFrame, qbed: DataFrame, genes: DataFrame, chrom: str, start: int, end: int, extend: int = 0, bins: int = 50, background: DataFrame | None = None, barcodes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of a region: insertions with height log(reads + 1), density, peaks, genes; of the background, whose density is log(count + 1)."""
    if barcodes is not None:
        qbed = qbed.join(barcodes.select("barcode"), "barcode", "left_semi")
    height = F.log(F.col("reads") + 1)
    inside = overlap_area(qbed, chrom, start, end, extend)
    out = {"insertions": inside.withColumn("height", height), "density": histogram(inside, start - extend, end + extend, bins), "peaks": overlap_area(peaks, chrom, start, end, extend), "genes": overlap_area(genes, chrom, start, end, extend)}
    if background is not None:
        held = overlap_area(background, chrom, start, end, extend, contained=True)
        out |= {"background": held, "background_density": histogram(held, start - extend, end + extend, bins).withColumn("height", F.log(F.col("n") + 1))}
    return out


def whole_genome_track(peaks: DataFrame, lengths: DataFrame | None = None, added: int = 10_000) -> DataFrame:
    """chr, start, end, height log(insertions + 1), length of the chromosome (known, or the last end and some more)."""
    if lengths is None:
        lengths = peaks.groupBy("chr").agg((F.max("end") + added).alias("length"))
    return peaks.join(F.broadcast(lengths), "chr").select("chr", "start", "end", F.log(F.col("experiment_insertions") + 1).alias("height"), "length")


STATISTICS = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_pop}


def signal_matrix(peaks: DataFrame, signal: DataFrame, before: int = 1000, after: int = 1000, nbins: int = 100, kind: str = "mean") -> DataFrame:
    """chr, start, end, bin, value: the signal (chr, start, end, value; half open) around each peak in nbins equal bins; means are weighted by length."""
    if kind not in STATISTICS:
        raise ValueError(f"unknown statistic {kind}")
    span = (F.col("end") + after - (F.col("start") - before)) / nbins
    p = peaks.select("chr", "start", "end").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))))
    p = p.withColumns({"_lo": F.col("start") - before + span * F.col("bin"), "_hi": F.col("start") - before + span * (F.col("bin") + 1)})
    w = 10_000
    p = p.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") / w), F.floor(F.col("_hi") / w))))
    s = signal.select(F.col("chr").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), "value").withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / w), F.floor(F.col("_e") / w))))
    j = p.join(s, (F.col("chr") == F.col("_c")) & (F.col("_bin") == F.col("_b")) & (F.col("_s") < F.col("_hi")) & (F.col("_e") > F.col("_lo")))
    # A pair may meet in two bins of the join; it counts in the first it can meet in.
    j = j.where(F.col("_bin") == F.greatest(F.floor(F.col("_lo") / w), F.floor(F.col("_s") / w)))
    length = F.least("_hi", "_e") - F.greatest("_lo", "_s")
    value = F.sum(F.col("value") * length) / F.sum(length) if kind == "mean" else STATISTICS[kind]("value")
    return j.groupBy("chr", "start", "end", "bin").agg(value.alias("value"))


def signal_profile(matrix: DataFrame, alpha: float = 0.05) -> DataFrame:
    """bin, mean, low, high: mean over peaks that have a value, and order statistics."""
    at = lambda q: F.get(F.array_sort(F.collect_list("value")), F.least((F.count("value") * q).cast("int"), F.count("value").cast("int") - 1))
    return matrix.groupBy("bin").agg(F.avg("value").alias("mean"), at(alpha / 2).alias("low"), at(1 - alpha / 2).alias("high"))


def signal_heatmap(matrix: DataFrame) -> DataFrame:
    """matrix with row_mean and the row's place, the largest first."""
    rows = matrix.groupBy("chr", "start", "end").agg(F.avg("value").alias("row_mean"))
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("row_mean"), "chr", "start")))
    return matrix.join(rows, ["chr", "start", "end"])


def volcano_classes(ranking: DataFrame, group: str | None = None, pvalue_cutoff: float = 2, lfc_cutoff: float = 1) -> DataFrame:
    """group, name, x, y, side: left if y >= the cutoff and x <= -lfc; right if both are over; else none."""
    df = ranking if group is None else ranking.where(F.col("group") == group)
    y = -F.log10(F.greatest("pvalue", F.lit(1e-300)))
    side = F.when((F.col("y") >= pvalue_cutoff) & (F.col("x") <= -lfc_cutoff), "left").when((F.col("y") > pvalue_cutoff) & (F.col("x") > lfc_cutoff), "right").otherwise("none")
    return df.select("group", "name", F.col("logfoldchange").alias("x"), y.alias("y")).withColumn("side", side)


def heatmap(m: CountMatrix, groupby: str | None, annotation: DataFrame, rna: DataFrame, log: bool = True, first_by: str | None = None) -> DataFrame:
    """name, gene1, gene2, shares, expression1, expression2, each array<struct<column, value>>, ordered by the shares, then by name.

    shares: of a peak's insertions by group (or sample); a peak without insertions has none and is left out. expression: of a nearest gene by sample, as log(x + 1), over
    the gene's maximum; 0 where it is not measured. Peaks whose genes are 0 in all samples are left out. rna: sample, gene, value; of repeated rows the first by the column
    first_by counts, else the largest."""
    label = F.col("obs_id" if groupby is None else groupby)
    obs = m.obs.select("obs_id", label.alias("column"))
    sums = m.x.join(obs, "obs_id").groupBy("column", F.col("var_id").alias("name")).agg(F.sum("value").alias("v"))
    whole = sums.groupBy("name").agg(F.sum("v").alias("w")).where("w > 0")
    shares = dense_rows(sums.join(whole, "name").withColumn("v", F.col("v") / F.col("w")), "name", "column", "v", obs).withColumnRenamed("cells", "shares")
    e = rna.groupBy("sample", "gene").agg((F.max("value") if first_by is None else F.min_by("value", first_by)).alias("v"))
    e = e.withColumn("v", F.log(F.col("v") + 1) if log else F.col("v"))
    top = e.groupBy("gene").agg(F.max("v").alias("t"))
    scaled = dense_rows(e.join(top, "gene").withColumn("v", F.coalesce(F.try_divide("v", "t"), F.lit(0.0))), "gene", "sample", "v").join(top, "gene")
    samples = e.agg(F.transform(F.array_sort(F.collect_set("sample")), lambda c: F.struct(c.alias("column"), F.lit(0.0).alias("value"))).alias("_none"))
    out = shares.join(annotation.select(peak_name().alias("name"), "gene1", "gene2"), "name").crossJoin(F.broadcast(samples))
    for k in ("1", "2"):
        out = out.join(scaled.select(F.col("gene").alias(f"gene{k}"), F.col("cells").alias(f"_e{k}"), F.col("t").alias(f"_t{k}")), f"gene{k}", "left")
    out = out.where((F.coalesce("_t1", F.lit(0.0)) > 0) | (F.coalesce("_t2", F.lit(0.0)) > 0))
    return out.select("name", "gene1", "gene2", "shares", F.coalesce("_e1", "_none").alias("expression1"), F.coalesce("_e2", "_none").alias("expression2")).orderBy("shares", "name")


def heatmap_cc(m: CountMatrix, normalize_cc: bool = False) -> DataFrame:
    """obs_id, name, value: log2(x + 1), x the entry or its share of the sample's insertions, over the peak's sum. Entries that are not there are 0."""
    x = m.x.withColumn("v", F.col("value").cast("double"))
    if normalize_cc:
        x = m.x.join(m.x.groupBy("obs_id").agg(F.sum("value").alias("_t")), "obs_id").withColumn("v", F.col("value") / F.col("_t"))
    x = x.select("obs_id", F.col("var_id").alias("name"), F.log2(F.col("v") + 1).alias("v"))
    whole = x.groupBy("name").agg(F.sum("v").alias("_w"))
    return x.join(whole, "name").select("obs_id", "name", (F.col("v") / F.col("_w")).alias("value"))


def dotplot_bulk(values: DataFrame, annotation: DataFrame, rna: DataFrame, names: DataFrame | list[str], value_groups: DataFrame | None = None, rna_groups: DataFrame | None = None) -> DataFrame:
    """group, name, panel (peak, gene1, gene2), gene, dot: chosen peaks of which a nearest gene is measured, and both genes, over the panel's maximum.

    values: sample, name, value; rna: sample, gene, value. Without groups each sample stands for itself. With them (sample, group) a peak is log2(mean + 1) over the group's
    samples and a gene the mean of log2(x + 1); values that hold one row for each group need rna_groups only. What is not there is 0. names: a list, or a table with name."""
    chosen = lambda df: df.where(F.col("name").isin(names)) if isinstance(names, list) else df.join(names.select("name"), "name", "left_semi")
    itself = lambda df: df.select("sample", F.col("sample").alias("group")).distinct()
    of_values, of_rna = (itself(df) if g is None else g for df, g in ((values, value_groups), (rna, rna_groups)))
    size = lambda g: g.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    near = chosen(annotation.select(peak_name().alias("name"), F.expr("stack(2, 'gene1', gene1, 'gene2', gene2) as (panel, gene)")))
    near = near.join(near.join(rna.select("gene"), "gene", "left_semi").select("name"), "name", "left_semi")
    held = values.join(of_values, "sample").groupBy("group", "name").agg(F.sum("value").alias("s"))
    dots = near.select("name").distinct().crossJoin(size(of_values)).join(held, ["group", "name"], "left")
    dots = dots.select("group", "name", F.lit("peak").alias("panel"), F.lit("").alias("gene"), F.log2(F.coalesce("s", F.lit(0)) / F.col("n") + 1).alias("v"))
    level = rna.join(of_rna, "sample").groupBy("group", "gene").agg(F.sum(F.log2(F.col("value") + 1)).alias("s"))
    genes = near.crossJoin(size(of_rna)).join(level, ["group", "gene"], "left").select("group", "name", "panel", "gene", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("v"))
    both = dots.unionByName(genes)
    top = both.groupBy("panel").agg(F.max("v").alias("_top"))
    # Three panels: the side has three rows.
    return both.join(F.broadcast(top), "panel").select("group", "name", "panel", "gene", F.coalesce(F.try_divide("v", "_top"), F.lit(0.0)).alias("dot"))


def group_dots(m: CountMatrix, groupby: str, names: DataFrame | None = None, log: bool = True) -> DataFrame:
    """group, name, dot: log2(mean + 1), or the mean, over all samples of the group, scaled to 0..1 for each name. Zeros are in no table: the mean is the sum over the group's size."""
    obs = m.obs.select("obs_id", F.col(groupby).alias("group"))
    x = m.x if names is None else m.x.join(names.select(F.col("name").alias("var_id")), "var_id", "left_semi")
    sizes = obs.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    sums = x.join(obs, "obs_id").groupBy("group", F.col("var_id").alias("name")).agg(F.sum("value").alias("s"))
    mean = F.coalesce("s", F.lit(0)) / F.col("n")
    grid = (sums.select("name") if names is None else names.select("name")).distinct()
    v = grid.crossJoin(sizes).join(sums, ["group", "name"], "left").select("group", "name", (F.log2(mean + 1) if log else mean).alias("v"))
    w = Window.partitionBy("name")
    low, high = F.min("v").over(w), F.max("v").over(w)
    return v.withColumn("dot", F.coalesce(F.try_divide(F.col("v") - low, high - low), F.lit(0.0))).drop("v")


def dotplot_sc(m: CountMatrix, groupby: str, rna: CountMatrix | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """group, name, dot of all peaks; with pairs (name, gene) also kind: of the pairs' peaks, and of their genes in rna by their mean."""
    if pairs is None:
        return group_dots(m, groupby)
    found = [group_dots(m, groupby, pairs).withColumn("kind", F.lit("peak"))]
    if rna is not None:
        found.append(group_dots(rna, groupby, pairs.select(F.col("gene").alias("name")), log=False).withColumn("kind", F.lit("gene")))
    return union_all(found)


def dotplot_sc_mu(mm: MultiModal, groupby: str, pairs: DataFrame, part: str = "CC", of: str = "RNA") -> DataFrame:
    """dotplot_sc over the shared attribute."""
    return dotplot_sc(modality(mm, part), f"`{groupby}`", modality(mm, of), pairs)


def draw_area_mu(mm: MultiModal, peaks: DataFrame, qbed: DataFrame, genes: DataFrame, chrom: str, start: int, end: int, key: str, name: str, part: str = "CC", **options) -> dict[str, DataFrame]:
    """draw_area of the insertions of one group of samples."""
    barcodes = modality(mm, part).obs.where(F.col(f"`{key}`") == name).select(F.col("obs_id").alias("barcode"))
    return draw_area(peaks, qbed, genes, chrom, start, end, barcodes=barcodes, **options)
