"""Interval algebra: range counts, range joins, overlaps, merging, nearest intervals. Coordinates are inclusive at both ends."""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import schema as S

BIN = 100_000


def kept(df: DataFrame) -> DataFrame:
    """df, computed once: written to the shared checkpoint folder where one is set, else held by the executors."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.localCheckpoint()
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def times(points: DataFrame) -> Column:
    """The aggregate that counts points: rows, or what counted() made of them."""
    return F.coalesce(F.sum("_held"), F.lit(0)) if "_held" in points.columns else F.count(F.lit(1))


def counted(points: DataFrame) -> DataFrame:
    """chr, start, _held: the positions of points with their number of rows, computed once. What counts points by position takes either; a genome has fewer positions than a library has reads."""
    return points if "_held" in points.columns else kept(points.groupBy("chr", "start").agg(F.count(F.lit(1)).alias("_held")))


def range_count(queries: DataFrame, points: DataFrame, ranges: dict[str, tuple[Column, Column]], bin_size: int = BIN) -> DataFrame:
    """queries with one more column for each entry of ranges: the points (chr, start) of their chromosome with lo <= start <= hi.

    Counts are differences of cumulative counts. A cumulative count is the points of all earlier bins plus those of the own bin up to
    the position, so that the sort unit is one bin of one chromosome, not a chromosome; the sums over bins are a small table.
    Positions are counted before the shuffle, so wide ranges cost no more than narrow ones. Repeated query rows come back as often as they stand; a null bound or chromosome counts nothing.
    """
    keys = queries.columns
    packed = queries.select(F.struct(*keys).alias("_q"), "chr", *[F.when(r[0].isNotNull() & r[1].isNotNull(), c.cast("double")).alias(f"_{n}_{k}") for n, r in ranges.items() for k, c in zip(("lo", "hi"), r, strict=True)])
    ends = [F.struct(F.lit(n).alias("name"), F.col(f"_{n}_{k}").alias("at"), F.lit(o).alias("ord"), F.lit(s).cast("bigint").alias("sign")) for n in ranges for k, o, s in (("lo", 0, -1), ("hi", 2, 1))]
    # One more entry for each row, near its bounds, counts how often equal rows stand.
    place = F.coalesce(*[F.col(f"_{n}_{k}") for n in ranges for k in ("lo", "hi")], F.lit(0.0))
    ends.append(F.struct(F.lit("").alias("name"), place.alias("at"), F.lit(2).alias("ord"), F.lit(0).cast("bigint").alias("sign")))
    asked = packed.select("_q", "chr", F.explode(F.array(*ends)).alias("e")).select("_q", "chr", "e.*").where("at is not null")
    bins = lambda c: F.floor(c / bin_size).cast("bigint")
    counted = points.groupBy("chr", F.col("start").cast("double").alias("at")).agg(times(points).alias("n")).withColumn("_bin", bins(F.col("at")))
    # The bins of a chromosome, with one before and one after, are a small table made from the points alone: queries pass through the plan once.
    per_bin = counted.groupBy("chr", "_bin").agg(F.sum("n").alias("_s"))
    ends_of = counted.groupBy("chr").agg((F.min("_bin") - 1).alias("_first"), (F.max("_bin") + 1).alias("_last"))
    grid = ends_of.select("chr", F.explode(F.sequence("_first", "_last")).alias("_bin")).join(per_bin, ["chr", "_bin"], "left")
    before = grid.select("chr", "_bin", F.coalesce(F.sum("_s").over(Window.partitionBy("chr").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    empty = packed.schema["_q"].dataType
    rows = counted.select(F.lit(None).cast(empty).alias("_q"), "chr", F.lit(None).cast("string").alias("name"), "at", F.lit(1).alias("ord"), F.lit(0).cast("bigint").alias("sign"), "_bin", "n")
    asked = asked.join(F.broadcast(ends_of), "chr", "left").withColumn("_bin", F.coalesce(F.greatest(F.least(bins(F.col("at")), "_last"), "_first"), F.lit(0))).drop("_first", "_last")
    rows = rows.unionByName(asked.withColumn("n", F.lit(0).cast("bigint")))
    inside = Window.partitionBy("chr", "_bin").orderBy("at", "ord").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = rows.withColumn("_c", F.sum("n").over(inside)).where("name is not null").join(before, ["chr", "_bin"], "left")
    value = F.col("sign") * (F.col("_c") + F.coalesce("_before", F.lit(0)))
    sums = cumulative.groupBy("_q").agg(F.count_if(F.col("name") == "").alias("_times"), *[F.greatest(F.sum(F.when(F.col("name") == n, value)), F.lit(0)).alias(n) for n in ranges])
    counts = [F.floor(F.col(n) / F.col("_times")).cast("bigint").alias(n) for n in ranges]
    return sums.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_q.*", *counts)


def range_join(intervals: DataFrame, points: DataFrame, lo: Column, hi: Column, width: int = 5_000) -> DataFrame:
    """Pairs of an interval row and a point row (chr, start) with lo <= start <= hi: an equi-join on bins, each point in one bin, then the bounds."""
    left = intervals.withColumns({"_lo": lo, "_hi": hi}).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width)))) if "_lo" not in intervals.columns else intervals
    right = points.select(F.col("chr").alias("_chr"), F.col("start").alias("_pos"), F.struct("*").alias("_point"), F.floor(F.col("start") / width).alias("_bin"))
    return left.join(right, (left["chr"] == right["_chr"]) & (left["_bin"] == right["_bin"]) & F.col("_pos").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi", "_bin", "_chr", "_pos")


def overlap_area(df: DataFrame, chrom: str, start: int, end: int, extend: int = 0, contained: bool = False) -> DataFrame:
    """Intervals of a region: overlapping it, or contained in it."""
    inside = (F.col("start") >= start - extend) & (F.col("end") <= end + extend) if contained else (F.col("end") >= start - extend) & (F.col("start") <= end + extend)
    return df.where((F.col("chr") == chrom) & inside)


def histogram(points: DataFrame, lo: int, hi: int, bins: int) -> DataFrame:
    """bin, n over equal widths of int((hi - lo) / bins), by start."""
    width = max(1, (hi - lo) // bins)
    return points.where(F.col("start").between(lo, hi - 1)).groupBy(F.floor((F.col("start") - lo) / width).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge_intervals(df: DataFrame) -> DataFrame:
    """chr, start, end, n: maximal runs of intervals that overlap or touch. Equal intervals are counted first: the order along a chromosome leaves no ties."""
    w = Window.partitionBy("chr").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.groupBy("chr", "start", "end").agg(F.count(F.lit(1)).alias("_n")).withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    runs = flagged.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("chr", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("_n").alias("n")).drop("_run")


def nearest_genes(peaks: DataFrame, genes: DataFrame, k: int = 2, limit: int = 500_000) -> DataFrame:
    """chr, start, end and refseq, gene, direction, distance of the k nearest genes, numbered from 1; null where a chromosome has fewer.

    The distance is 0 for an overlap, else the gap plus one, negative upstream. Ties go by gene start, end and refseq; genes without bounds are near nothing, and a gene ends where it starts or after. Up to
    `limit` rows the genes are sent to all tasks, sorted by chromosome, and searched there by bisection, without a shuffle of pairs; a larger table is dealt by bins of a chromosome and searched in each.
    """
    unique = kept(peaks.select("chr", "start", "end").distinct())
    g = genes.where(F.col("chr").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull())
    g = g.select(F.col("chr").alias("_chr"), F.col("start").cast("bigint").alias("gs"), F.col("end").cast("bigint").alias("ge"), "refseq", "gene", F.col("strand").alias("direction"))
    return _searched(unique, g.collect(), k) if g.count() <= limit else _binned(unique, g, k)


class GeneIndex:
    """The genes of one chromosome, by start and by end."""

    def __init__(self, genes: list[tuple]):
        """(start, end, refseq, gene, direction) each."""
        self.genes = sorted(genes, key=self.order)
        self.starts = [g[0] for g in self.genes]
        # The first gene whose running largest end reaches a position is the first that ends there or after it.
        self.reach = list(accumulate((g[1] for g in self.genes), max))
        self.by_end = sorted(reversed(self.genes), key=lambda g: g[1])
        self.ends = [g[1] for g in self.by_end]

    @staticmethod
    def order(g: tuple) -> tuple:
        return g[0], g[1], *((x is not None, x or "") for x in g[2:])

    def nearest(self, start: int, end: int, k: int) -> list[tuple]:
        """(distance, gene) of the k nearest."""
        return self.least(self.held(start, end, k) + self.after(end, k), k)

    def least(self, found: list[tuple], k: int) -> list[tuple]:
        return sorted(found, key=lambda x: (abs(x[0]), self.order(x[1])))[:k]

    def held(self, start: int, end: int, k: int) -> list[tuple]:
        """The first k that overlap, and the k nearest before."""
        found, i = [], bisect_left(self.reach, start)
        while i < len(self.genes) and self.starts[i] <= end and len(found) < k:
            if self.genes[i][1] >= start:
                found.append((0, self.genes[i]))
            i += 1
        before = bisect_left(self.ends, start)
        return found + [(g[1] - start - 1, g) for g in self.by_end[max(0, before - k) : before] if g[0] <= end]

    def after(self, end: int, k: int) -> list[tuple]:
        first = bisect_right(self.starts, end)
        return [(g[0] - end + 1, g) for g in self.genes[first : first + k]]


def _searched(unique: DataFrame, genes: list, k: int) -> DataFrame:
    by: dict[str, list[tuple]] = {}
    for g in genes:
        by.setdefault(g["_chr"], []).append((g.gs, g.ge, g.refseq, g.gene, g.direction))
    shared = unique.sparkSession.sparkContext.broadcast(by)
    names = [(f"{n}{i + 1}", t) for i in range(k) for n, t in (("refseq", "string"), ("gene", "string"), ("direction", "string"), ("distance", "bigint"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, GeneIndex] = {}
        for batch in batches:
            rows = []
            for c, start, end in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c not in index:
                    index[c] = GeneIndex(shared.value.get(c, []))
                found = index[c].nearest(start, end, k) if start is not None and end is not None else []
                row = [x for d, g in found for x in (*g[2:], d)]
                rows.append(row + [None] * (len(names) - len(row)))
            made = [pa.array([r[j] for r in rows], pa.int64() if t == "bigint" else pa.string()) for j, (_, t) in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["chr", "start", "end", *(n for n, _ in names)])

    return unique.mapInArrow(run, T.StructType([*unique.schema.fields, *(T.StructField(n, T.LongType() if t == "bigint" else T.StringType()) for n, t in names)]))


GENE = ("gs", "ge", "refseq", "gene", "direction")


def _binned(unique: DataFrame, genes: DataFrame, k: int, width: int = BIN) -> DataFrame:
    """nearest_genes of a large table: a bin of a chromosome searches the genes that start or end in it, the first k that cover it, the first k of the bins after it and the last k of those before.

    No pair of a peak and a gene is made, and no task holds a chromosome's genes. A peak asks the bin of its start, and that of its end for the genes after it. Of genes with equal bounds k are enough."""
    at = lambda c: F.floor(F.col(c) / width).cast("bigint")
    best = lambda df, *by, order: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
    g = best(genes, "_chr", "gs", "ge", order=GENE[2:]).withColumns({"_sb": at("gs"), "_eb": at("ge")})
    asked = unique.where(F.col("start").isNotNull() & F.col("end").isNotNull()).withColumn("_bin", F.explode(F.array_distinct(F.array(at("start"), at("end")))))
    kind = lambda df, n, b: df.select("_chr", F.col(b).alias("_bin"), F.lit(n).alias("_kind"), *GENE)
    none = [F.lit(0).cast("bigint").alias(c) for c in GENE[:2]] + [F.lit(None).cast("string").alias(c) for c in GENE[2:]]
    wanted = asked.select(F.col("chr").alias("_chr"), "_bin", F.lit(0).alias("_kind"), *none).distinct()
    ends = union_all([kind(best(g, "_chr", "_sb", order=GENE), 1, "_sb"), kind(best(g, "_chr", "_eb", order=(F.desc("ge"), *GENE)), 2, "_eb"), wanted])
    fields = T.StructType([T.StructField("_chr", T.StringType()), T.StructField("_bin", T.LongType()), *(T.StructField(c, T.LongType() if c in GENE[:2] else T.StringType()) for c in GENE)])

    def carry(rows: pa.Table) -> pa.Table:
        """For each bin that is asked: the first k genes of the later bins, the last k of the earlier ones. A chromosome has at most its length over the width of bins."""
        bins: dict[int, dict[int, list[tuple]]] = {}
        for b, of, *gene in zip(*(rows.column(c).to_pylist() for c in ("_bin", "_kind", *GENE)), strict=True):
            bins.setdefault(b, {}).setdefault(of, []).append(tuple(gene))
        out = []
        for of, order in ((1, sorted(bins, reverse=True)), (2, sorted(bins))):
            kept: list[tuple] = []
            for b in order:
                out += [(b, *x) for x in kept] if 0 in bins[b] else []
                key = GeneIndex.order if of == 1 else lambda x: (-x[1], GeneIndex.order(x))
                kept = sorted(kept + bins[b].get(of, []), key=key)[:k]
        chrom = rows.column("_chr")[0].as_py()
        return pa.table([pa.array([chrom] * len(out), pa.string()), *(pa.array([r[j] for r in out], pa.int64() if j < 3 else pa.string()) for j in range(6))], names=fields.names)

    covered = g.where("_eb > _sb + 1").withColumn("_bin", F.explode(F.sequence(F.col("_sb") + 1, F.col("_eb") - 1)))
    names = ["_chr", "_bin", *GENE]
    near = union_all([g.withColumn("_bin", F.col("_sb")).select(names), g.where("_eb <> _sb").withColumn("_bin", F.col("_eb")).select(names), best(covered, "_chr", "_bin", order=GENE).select(names), ends.groupBy("_chr").applyInArrow(carry, fields)])
    hit = T.StructType([T.StructField("chr", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("start", "end", "distance")), *fields.fields[2:]])

    def run(genes: pa.Table, peaks: pa.Table) -> pa.Table:
        index = GeneIndex(list(zip(*(genes.column(c).to_pylist() for c in GENE), strict=True)) if peaks.num_rows else [])
        out = []
        for c, start, end, b in zip(*(peaks.column(c).to_pylist() for c in ("chr", "start", "end", "_bin")), strict=True):
            found = index.held(start, end, k) if start // width == b else []
            found += index.after(end, k) if end // width == b else []
            out += [(c, start, end, d, *x) for d, x in index.least(found, k)]
        return pa.table([pa.array([r[j] for r in out], pa.int64() if 0 < j < 6 else pa.string()) for j in range(9)], names=hit.names)

    hits = near.groupBy("_chr", "_bin").cogroup(asked.groupBy("chr", "_bin")).applyInArrow(run, hit)
    # A peak over several bins has up to 2k.
    both = hits.select("chr", "start", "end", F.struct(F.abs("distance").alias("far"), *GENE, "distance").alias("_near")).unionByName(unique, allowMissingColumns=True)
    of = both.groupBy("chr", "start", "end").agg(F.slice(F.array_sort(F.collect_list("_near")), 1, k).alias("_best"))
    return of.select("chr", "start", "end", *[F.get("_best", F.lit(i))[c].alias(f"{c}{i + 1}") for i in range(k) for c in ("refseq", "gene", "direction", "distance")])


def clean_qbed(qbed: DataFrame, chroms: list[str] | None = None, min_reads: int | None = None) -> DataFrame:
    """Rows of the chromosomes (all known ones if none are named) with over min_reads reads; the filter reaches the scan."""
    df = qbed.where(F.col("chr").isin(S.CHROMOSOMES if chroms is None else chroms))
    return df if min_reads is None else df.where(F.col("reads") > min_reads)


def combine_annotation(peaks: DataFrame, annotation: DataFrame) -> DataFrame:
    """peaks with the annotation's columns; both must have the same intervals."""
    keys = ["chr", "start", "end"]
    peaks, annotation = kept(peaks), kept(annotation)
    a, b = peaks.select(*keys), annotation.select(*keys)
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise ValueError("peaks and annotation have different intervals")
    return peaks.join(annotation, keys)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
