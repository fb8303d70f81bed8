"""Peak callers: islands of insertions, sliding windows, change-point blocks; editing of called peaks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..sources import schema as S
from .intervals import counted, kept, range_count, range_join, times, union_all

TPH = 100_000_000
#: Chunks of a chromosome that are walked in one call.
LOT = 64


def positions(points: DataFrame) -> DataFrame:
    return points.groupBy("chr", "start").agg(times(points).alias("n"))


def islands(points: DataFrame, maxbetween: int = 2000, minnum: int = 0, min_insertions: int = 5, minlen: int = 0, extend: int = 200) -> DataFrame:
    """chr, start, end, n. An island ends after a position whose gap is over maxbetween, or whose next position is sparse (at most minnum) and either a third of
    maxbetween away from the one after it or followed by a sparse one."""
    w = Window.partitionBy("chr").orderBy("start")
    pos = positions(points)
    gap = F.coalesce(F.lead("start").over(w) - F.col("start"), F.lit(maxbetween + 1))
    next_gap = F.coalesce(F.lead("start", 2).over(w) - F.lead("start").over(w), F.lit(maxbetween + 1))
    c1, c2 = F.coalesce(F.lead("n").over(w), F.lit(0)), F.coalesce(F.lead("n", 2).over(w), F.lit(0))
    ends = (gap > maxbetween) | ((c1 <= minnum) & ((next_gap > maxbetween / 3) | (c2 <= minnum)))
    marked = pos.withColumn("_end", ends.cast("int"))
    island = F.coalesce(F.sum("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = marked.withColumn("_i", island).groupBy("chr", "_i").agg(F.min("start").alias("_a"), F.max("start").alias("_b"), F.sum("n").alias("n"))
    runs = runs.where((F.col("n") >= min_insertions) & (F.col("_b") - F.col("_a") >= minlen))
    return runs.select("chr", F.greatest(F.col("_a") - extend, F.lit(0)).alias("start"), (F.col("_b") + 4 + extend).alias("end"), "n")


def totals(df: DataFrame, points: DataFrame, name: str) -> DataFrame:
    """df with the number of points on its chromosome. Chromosomes are few."""
    return df.join(F.broadcast(points.groupBy("chr").agg(times(points).alias(name))), "chr", "left").fillna(0, [name])


def tail(method: str, n: Column, rate: Column, pseudo: float, whole: Column) -> Column:
    """P of n or more beyond the expectation `rate`, by Poisson, or by the binomial on `whole` trials."""
    if method == "poisson":
        return stats.poisson_sf(n, rate)
    if method == "binomial":
        return stats.binomial_sf(n + pseudo, whole, rate / whole)
    raise ValueError(f"unknown test {method}")


def trimmed(df: DataFrame) -> DataFrame:
    """Starts moved to the end of the peak before, where they overlap."""
    return df.withColumn("start", F.greatest("start", F.coalesce(F.lag("end").over(Window.partitionBy("chr").orderBy("start")), F.col("start"))))


def call_islands(exp: DataFrame, sites: DataFrame, background: DataFrame | None = None, reference: str = "mm10", pvalue_cutoff: float = 1e-4, pvalue_cutoff_bg: float = 1e-4, pvalue_cutoff_sites: float = 1e-5,
                 pvalue_adj_cutoff: float | None = None, maxbetween: int = 2000, minnum: int = 0, min_insertions: int = 5, minlen: int = 0, extend: int = 200, lam_win_size: int | None = None,
                 pseudocounts: float = 0.2, test_method: str = "poisson", half_width: int | None = None) -> DataFrame:
    """Peaks from islands, tested against the reference sites and, if given, the background."""
    h = S.HALF_WIDTH[reference] if half_width is None else half_width
    exp, sites, background = (df if df is None else counted(df) for df in (exp, sites, background))
    found = islands(exp, maxbetween, minnum, min_insertions, minlen, extend)
    near = (F.col("start") - h, F.col("end"))
    df = range_count(found, sites, {"reference_insertions": near})
    if minnum:
        df = range_count(df, exp, {"_n": near}).withColumn("n", F.col("_n")).drop("_n")
    df = totals(totals(df, exp, "_exp"), sites, "_sites")
    if lam_win_size:
        wide = (F.col("start") - lam_win_size / 2 + 1 - h, F.col("end") + lam_win_size / 2)
        df = range_count(range_count(df, exp, {"_we": wide}), sites, {"_ws": wide})
        scale = F.when(F.col("_ws") > 0, F.col("_we") / F.col("_ws"))
    else:
        scale = F.when(F.col("_sites") > 0, F.col("_exp") / F.col("_sites"))
    rate = F.col("reference_insertions") * scale + pseudocounts
    p = tail(test_method, F.col("n"), rate, pseudocounts, F.col("_exp"))
    names = ["chr", "start", "end", F.col("n").alias("experiment_insertions")]
    if background is None:
        df = df.withColumns({"expected_insertions": rate, "pvalue": p}).where(F.col("pvalue") <= pvalue_cutoff)
        out = trimmed(df.select(*names, "reference_insertions", "expected_insertions", "pvalue"))
        return _with_fdr(out, "pvalue", "pvalue_adj", reference, pvalue_cutoff if pvalue_adj_cutoff is None else pvalue_adj_cutoff)
    df = totals(range_count(df, background, {"background_insertions": near}), background, "_bg")
    if lam_win_size:
        df = range_count(df, background, {"_wb": wide})
        expected = F.when(F.col("_wb") > 0, F.col("background_insertions") * F.col("_we") / F.col("_wb") + pseudocounts).otherwise(0.0)
        pb = stats.cumulative_poisson(F.col("n"), F.col("background_insertions"), F.col("_we"), F.col("_wb"), pseudocounts)
    else:
        expected = F.when(F.col("_bg") > 0, F.col("background_insertions") * F.col("_exp") / F.col("_bg") + pseudocounts).otherwise(0.0)
        pb = stats.cumulative_poisson(F.col("n"), F.col("background_insertions"), F.col("_exp"), F.col("_bg"), pseudocounts)
    df = df.withColumns({"expected_background": expected, "expected_reference": rate, "pvalue_background": pb, "pvalue_reference": p})
    df = df.where((F.col("pvalue_background") <= pvalue_cutoff_bg) & (F.col("pvalue_reference") <= pvalue_cutoff_sites))
    out = trimmed(df.select(*names, "background_insertions", "reference_insertions", "expected_background", "expected_reference", "pvalue_background", "pvalue_reference"))
    return _with_fdr(out, "pvalue_reference", "pvalue_adj_reference", reference, pvalue_cutoff_sites if pvalue_adj_cutoff is None else pvalue_adj_cutoff)


def _with_fdr(df: DataFrame, p: str, out: str, reference: str, cutoff: float) -> DataFrame:
    return stats.adjusted_genome(df, p, out, S.GENOME[reference]).where(F.col(out) <= cutoff)


def candidate_windows(exp: DataFrame, window: int, step: int, h: int, min_insertions: int = 1, origin: int | None = None) -> DataFrame:
    """chr, k, start, n: windows of the chromosome's grid (from its least position, or from `origin`) with enough insertions. Each position proposes the windows that hold it; no empty window is made."""
    pos = positions(exp)
    least = F.broadcast(pos.groupBy("chr").agg(F.min("start").alias("_o")))
    p = pos.join(least, "chr") if origin is None else pos.withColumn("_o", F.lit(origin).cast("bigint"))
    first = F.greatest(F.ceil((F.col("start") - F.col("_o") - window + 1) / step), F.lit(0))
    last = F.floor((F.col("start") - F.col("_o") + h) / step)
    grid = p.where(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    found = grid.groupBy("chr", "k", "_o").agg(F.sum("n").alias("n")).where(F.col("n") >= min_insertions)
    return found.select("chr", "k", (F.col("_o") + F.col("k") * step).alias("start"), "n")


def window_statistics(exp: DataFrame, sites: DataFrame, background: DataFrame | None, window: int, step: int, h: int, lam: int | None, pseudo: float, min_insertions: int, test_method: str = "poisson") -> DataFrame:
    """chr, k, start, n, reference_insertions, pvalue (and background_insertions, pvalue_background) of the candidate windows."""
    df = candidate_windows(exp, window, step, h, min_insertions)
    near = (F.col("start") - h, F.col("start") + window - 1)
    df = totals(totals(range_count(df, sites, {"reference_insertions": near}), exp, "_exp"), sites, "_sites")
    if lam:
        wide = (F.col("start") - lam // 2 + 1 - h, F.col("start") + window + lam // 2 - 1)
        df = range_count(range_count(df, exp, {"_we": wide}), sites, {"_ws": wide})
        scale = F.col("_we") / (F.greatest(F.col("_ws"), F.lit(1)) if background is None else F.when(F.col("_ws") > 0, F.col("_ws")))
    else:
        scale = F.when(F.col("_sites") > 0, F.col("_exp") / F.col("_sites"))
    held = F.greatest(F.col("reference_insertions"), F.lit(1)) if background is None else F.col("reference_insertions")
    df = df.withColumn("pvalue", tail(test_method, F.col("n") + pseudo, held * scale + pseudo, 0.0, F.col("_exp")))
    if background is None:
        return df.select("chr", "k", "start", "n", "reference_insertions", "pvalue")
    df = totals(range_count(df, background, {"background_insertions": near}), background, "_bg")
    pb = stats.cumulative_poisson(F.col("n"), F.col("background_insertions"), F.col("_exp"), F.greatest(F.col("_bg"), F.lit(1)), pseudo)
    df = df.withColumn("pvalue_background", F.when(F.col("background_insertions") == 0, 0.0).otherwise(pb))
    return df.select("chr", "k", "start", "n", "reference_insertions", "pvalue", "background_insertions", "pvalue_background")


def walk(keys: np.ndarray, starts: np.ndarray, at: np.ndarray, origin: int, window: int, step: int, h: int, extend: int, last: int) -> list[tuple[int, int, float]]:
    """Bounds and centres of the peaks of one chunk, from its significant windows (number and start) and sorted insertions.

    An open peak looks at the first window past its end: significant, it grows by it; else it closes, its bounds become those of its insertions, and windows up to its new end are passed over."""
    known, out, blocked, after = set(keys.tolist()), [], -math.inf, -1
    for k, s in zip(keys.tolist(), starts.tolist(), strict=True):
        if s <= blocked or k <= after:
            continue
        end = s + window - 1
        while (nxt := (end - origin) // step + 1) in known:
            end = origin + nxt * step + window - 1
        held = at[np.searchsorted(at, s - h) : np.searchsorted(at, end, "right")]
        blocked, after = held[-1] + last + extend, nxt
        out.append((max(int(held[0]) - extend, 0), int(blocked), float(np.median(held))))
    return out


def window_peaks(exp: DataFrame, significant: DataFrame, window: int, step: int, h: int, extend: int, last: int) -> DataFrame:
    """chr, start, end, center. Chromosomes are cut at gaps that no open peak crosses; each chunk is walked by itself, on the chromosome's grid."""
    w = Window.partitionBy("chr").orderBy("start")
    pos = positions(exp)
    least = F.broadcast(pos.groupBy("chr").agg(F.min("start").alias("_o")))
    cut = F.when(F.col("start") - F.lag("start").over(w) > 3 * window + 2 * step + extend + 2 * h + last, 1).otherwise(0)
    chunks = pos.withColumn("_cut", cut).withColumn("_chunk", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # A window belongs to the chunk of its first insertion.
    owner = range_join(significant.select("chr", "k", "start"), chunks, F.col("start") - h, F.col("start") + window - 1)
    owner = owner.groupBy("chr", "k", "start").agg(F.min("_point._chunk").alias("_chunk")).join(least, "chr")

    def run(places: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        names, out = ["chr", "start", "end", "center"], []
        if not len(found) or not len(places):
            return pd.DataFrame(columns=names)
        found, places = found.sort_values(["_chunk", "k"]), places.sort_values(["_chunk", "start"])
        k, start, of = (found[c].to_numpy() for c in ("k", "start", "_chunk"))
        at, n, held = (places[c].to_numpy() for c in ("start", "n", "_chunk"))
        for c in np.unique(of):
            f, p = (slice(*np.searchsorted(x, [c, c + 1])) for x in (of, held))
            out += walk(k[f], start[f], np.repeat(at[p], n[p]), int(found["_o"].iloc[0]), window, step, h, extend, last)
        return pd.DataFrame([(found["chr"].iloc[0], *x) for x in out], columns=names)

    # A call for each chunk would cost more than its walk: a call takes LOT neighbours.
    lot = lambda df: df.groupBy("chr", F.floor(F.col("_chunk") / LOT))
    return lot(chunks).cogroup(lot(owner)).applyInPandas(run, "chr string, start long, end long, center double")


def call_windows(exp: DataFrame, sites: DataFrame, background: DataFrame | None = None, reference: str = "mm10", pvalue_cutoff: float = 1e-4, pvalue_cutoff_bg: float = 1e-3, pvalue_cutoff_sites: float = 1e-5, pvalue_adj_cutoff: float | None = None,
                 min_insertions: int = 5, extend: int = 200, window_size: int = 1500, step_size: int = 500, lam_win_size: int | None = None, pseudocounts: float = 0.2, test_method: str = "poisson") -> DataFrame:
    """Peaks from sliding windows: significant windows are merged, bounded by their outer insertions, counted and tested again."""
    h = S.HALF_WIDTH[reference]
    exp, sites, background = (df if df is None else counted(df) for df in (exp, sites, background))
    cut = pvalue_cutoff if background is None else pvalue_cutoff_sites
    stat = window_statistics(exp, sites, background, window_size, step_size, h, lam_win_size, pseudocounts, min_insertions, test_method)
    ok = F.col("pvalue") <= cut
    if background is not None:
        ok &= F.col("pvalue_background") <= pvalue_cutoff_bg
    df = kept(window_peaks(exp, stat.where(ok), window_size, step_size, h, extend, h if background is None else 3))
    near = (F.col("start") - h, F.col("end"))
    df = range_count(range_count(df, exp, {"experiment_insertions": near}), sites, {"reference_insertions": near})
    df = totals(totals(df, exp, "_exp"), sites, "_sites")
    if lam_win_size:
        wide = (F.col("center") - lam_win_size / 2, F.col("center") + lam_win_size / 2) if background is None else (F.col("start") - lam_win_size // 2 + 1, F.col("end") + lam_win_size // 2 - 1)
        df = range_count(range_count(df, exp, {"_we": wide}), sites, {"_ws": wide})
        scale = F.col("_we") / F.greatest(F.col("_ws"), F.lit(1))
    else:
        scale = F.when(F.col("_sites") > 0, F.col("_exp") / F.col("_sites"))
    held = F.greatest(F.col("reference_insertions"), F.lit(1)) if background is None else F.col("reference_insertions")
    rate = held * scale + pseudocounts
    p = tail(test_method, F.col("experiment_insertions") + pseudocounts, rate, 0.0, F.col("_exp"))
    whole = row_count(exp) or 1
    fraction = {"fraction_experiment": F.col("experiment_insertions") / whole, "tph_experiment": F.col("experiment_insertions") * TPH / whole}
    final = pvalue_cutoff if pvalue_adj_cutoff is None else pvalue_adj_cutoff
    if background is None:
        df = df.withColumns({"pvalue": p, "expected_insertions": rate} | fraction).where(F.col("pvalue") <= pvalue_cutoff)
        out = df.select("chr", "start", "end", "center", "pvalue", "experiment_insertions", "reference_insertions", "fraction_experiment", "tph_experiment", "expected_insertions")
        return _with_fdr(out, "pvalue", "pvalue_adj", reference, final)
    df = totals(range_count(df, background, {"background_insertions": near}), background, "_bg")
    of = row_count(background) or 1
    pb = F.when(F.col("background_insertions") == 0, 0.0).otherwise(stats.cumulative_poisson(F.col("experiment_insertions"), F.col("background_insertions"), F.col("_exp"), F.greatest(F.col("_bg"), F.lit(1)), pseudocounts))
    df = df.withColumns({"pvalue_reference": p, "pvalue_background": pb, "fraction_background": F.col("background_insertions") / of, "tph_background": F.col("background_insertions") * TPH / of} | fraction)
    df = df.withColumn("tph_background_subtracted", F.col("tph_experiment") - F.col("tph_background"))
    df = df.where((F.col("pvalue_reference") <= pvalue_cutoff_sites) & (F.col("pvalue_background") <= pvalue_cutoff_bg))
    out = df.select("chr", "start", "end", "center", "experiment_insertions", "background_insertions", "reference_insertions", "pvalue_reference", "pvalue_background", "fraction_experiment", "tph_experiment", "fraction_background", "tph_background", "tph_background_subtracted")
    return _with_fdr(out, "pvalue_reference", "pvalue_adj_reference", reference, pvalue_cutoff_sites if pvalue_adj_cutoff is None else pvalue_adj_cutoff)


def with_center(df: DataFrame, exp: DataFrame, h: int) -> DataFrame:
    """df with the median position of each interval's insertions, null where there are none. Positions carry their counts, so an interval brings no more rows than its width."""
    held = range_join(df.select("chr", "start", "end").distinct(), positions(exp), F.col("start") - h, F.col("end"))
    middle = held.groupBy("chr", "start", "end").agg(F.percentile(F.col("_point.start"), 0.5, F.col("_point.n")).alias("center"))
    return df.join(middle, ["chr", "start", "end"], "left")


def row_count(points: DataFrame) -> int:
    return points.agg(times(points)).first()[0]


OLD_TPH = 100_000
#: Name, and the reach below and above the centre, of the local rates.
LOCAL_RATES = {"1k": (499, 500), "5k": (2499, 2500), "10k": (4999, 5000)}


def call_windows_max_rate(exp: DataFrame, sites: DataFrame, background: DataFrame, reference: str = "mm10", pvalue_cutoff: float = 1e-4, window_size: int = 1500, step_size: int = 500, pseudocounts: float = 0.2) -> DataFrame:
    """The older window caller: windows on a grid from 0 with two insertions or more are tested against the background; neighbouring significant ones make a peak.

    A peak's rate for each site is the largest of its own and three local ones around its centre, libraries scaled by their genome-wide totals. Peaks keep the windows' bounds; their p is reported, no peak is
    dropped for it. A chromosome's significant windows are sorted in one task: the grid holds at most its length over step_size of them, whatever the number of insertions.
    """
    if background is None:
        raise ValueError("this caller needs a background")
    exp, sites, background = counted(exp), counted(sites), counted(background)
    h, whole, of = S.HALF_WIDTH[reference], row_count(exp), row_count(background)
    windows = range_count(candidate_windows(exp, window_size, step_size, h, 2, 0), background, {"b": (F.col("start") - h, F.col("start") + window_size - 1)})
    significant = windows.where(stats.cumulative_poisson(F.col("n"), F.col("b"), F.lit(whole), F.lit(of), pseudocounts) <= pvalue_cutoff)
    run = F.col("k") - F.row_number().over(Window.partitionBy("chr").orderBy("k"))
    df = significant.withColumn("_run", run).groupBy("chr", "_run").agg(F.min("start").alias("start"), (F.max("start") + window_size - 1).alias("end")).drop("_run")
    near = (F.col("start") - h, F.col("end"))
    df = with_center(range_count(df, exp, {"experiment_insertions": near}), exp, h)
    around = {name: (F.col("center") - lo - h, F.col("center") + hi) for name, (lo, hi) in LOCAL_RATES.items()}
    for points, name, prefix in ((background, "background_insertions", "_b"), (sites, "reference_insertions", "_s")):
        df = range_count(df, points, {name: near} | {prefix + x: r for x, r in around.items()})
    # The larger library is scaled down.
    scale = whole / of if of >= whole else 1.0
    held = F.greatest(F.col("reference_insertions"), F.lit(1))
    rates = [F.col("background_insertions") * scale / held, *[F.col(f"_b{x}") * scale / F.greatest(F.col(f"_s{x}"), F.lit(1)) for x in LOCAL_RATES]]
    names = F.array(*map(F.lit, ("bg", *LOCAL_RATES)))
    df = df.withColumns({"lambda": F.greatest(*rates), "_rates": F.array(*rates)}).withColumn("lambda_type", F.get(names, (F.array_position("_rates", F.col("lambda")) - 1).cast("int")))
    tested = F.col("experiment_insertions") * (1.0 if of >= whole else of / whole) + pseudocounts
    columns = {"lambda_reference_insertions": F.col("lambda") * held}
    for name, total in (("experiment", whole), ("background", of)):
        n = F.col(f"{name}_insertions")
        columns |= {f"fraction_{name}": F.try_divide(n, F.lit(total)), f"tph_{name}": F.try_divide(n * OLD_TPH, F.lit(total))}
    df = df.withColumns(columns).withColumns({"tph_background_subtracted": F.col("tph_experiment") - F.col("tph_background"), "pvalue": stats.poisson_sf(tested, F.col("lambda_reference_insertions") + pseudocounts)})
    return df.select("chr", "start", "end", "center", "experiment_insertions", "background_insertions", "reference_insertions", "fraction_experiment", "tph_experiment", "fraction_background", "tph_background", "tph_background_subtracted", "lambda_type", "lambda", "lambda_reference_insertions", "pvalue")


def prior(p0: float, n: int, ncp_prior: float | None = None, gamma: float | None = None) -> float:
    """Cost of a block: given, or from gamma, or from the false-positive rate p0."""
    if ncp_prior is not None:
        return ncp_prior
    return -math.log(gamma) if gamma is not None else 4 - math.log(73.53 * p0 * n**-0.478)


def segment(x: np.ndarray, ncp: float, prune: bool = True) -> np.ndarray:
    return segmented(x, ncp, prune)[0]


def segmented(x: np.ndarray, ncp: float, prune: bool = True, counts: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Edges, and the sum, of the blocks of sorted positions with the best sum of N (ln N - ln T) - ncp. Without pruning: all splits; with it: only those that can still win. Repeats are allowed, unless their counts are given."""
    t, counts = np.unique(np.asarray(x, float), return_counts=True) if counts is None else (np.asarray(x, float), counts)
    if len(t) < 2:
        return (np.array([t[0], t[0]]) if len(t) else np.zeros(0)), math.nan
    edges = np.concatenate([t[:1], (t[1:] + t[:-1]) / 2, t[-1:]])
    cum = np.concatenate([[0], np.cumsum(counts)])
    best, last = np.zeros(len(t) + 1), np.zeros(len(t), int)
    active = np.zeros(1, int)
    for r in range(len(t)):
        active = np.append(active, r) if r else active
        n, width = cum[r + 1] - cum[active], edges[r + 1] - edges[active]
        fit = best[active] + n * (np.log(n) - np.log(np.maximum(width, 1e-300))) - ncp
        k = int(np.argmax(fit))
        best[r + 1], last[r] = fit[k], active[k]
        if prune:
            # A start whose value without its next prior is under the best so far cannot win later.
            active = active[fit + ncp >= best[r + 1]]
    cuts, r = [len(t)], len(t)
    while r > 0:
        r = last[r - 1]
        cuts.append(r)
    return edges[np.array(cuts[::-1])], float(best[-1])


def segments(points: DataFrame, p0: float = 0.05, ncp_prior: float | None = None, gamma: float | None = None, prune: bool = True) -> DataFrame:
    """chr, start, end of change-point blocks, with the chromosome's prior and fitness (null if it has one position), one grouped task a chromosome: the recursion over positions is sequential.

    A task holds the chromosome's distinct positions with their counts, not its insertions."""
    if not 0 <= p0 <= 1 or (ncp_prior is not None and ncp_prior < 0):
        raise ValueError("p0 must be in 0..1 and the prior not negative")
    end = F.col("end") if "end" in points.columns else F.col("start")
    at = points.groupBy("chr", F.floor((F.col("start") + end) / 2).cast("long").alias("at")).agg(times(points).alias("n"))

    def run(rows: pa.Table) -> pa.Table:
        x, n = (rows.column(c).to_numpy() for c in ("at", "n"))
        order = np.argsort(x)
        cost = prior(p0, int(n.sum()), ncp_prior, gamma)
        edges, fitness = segmented(x[order], cost, prune, n[order])
        e = np.floor(edges).astype(int)
        return pa.table({"chr": [rows.column("chr")[0].as_py()] * (len(e) - 1), "start": e[:-1], "end": e[1:], "prior": np.full(len(e) - 1, cost), "fitness": pa.array(np.full(len(e) - 1, fitness), from_pandas=True)})

    return at.groupBy("chr").applyInArrow(run, "chr string, start long, end long, prior double, fitness double")


def blocks(points: DataFrame, p0: float = 0.05, ncp_prior: float | None = None, gamma: float | None = None, prune: bool = True) -> DataFrame:
    return segments(points, p0, ncp_prior, gamma, prune).select("chr", "start", "end")


def segmentation_summary(found: DataFrame) -> DataFrame:
    """chr, prior, n_blocks, fitness of segments(), and a row without chr for the totals."""
    one = found.groupBy("chr").agg(F.first("prior").alias("prior"), F.count(F.lit(1)).alias("n_blocks"), F.first("fitness").alias("fitness"))
    return one.unionByName(one.agg(F.sum("prior").alias("prior"), F.sum("n_blocks").alias("n_blocks"), F.sum("fitness").alias("fitness")).withColumn("chr", F.lit(None).cast("string")))


def block_counts(blocks_: DataFrame, points: DataFrame, name: str) -> DataFrame:
    """Points of each block: half open, closed at the chromosome's last block."""
    last = F.max("end").over(Window.partitionBy("chr"))
    marked = blocks_.withColumn("_hi", F.when(F.col("end") == last, F.col("end")).otherwise(F.col("end") - 1))
    return range_count(marked, points, {name: (F.col("start"), F.col("_hi"))}).drop("_hi")


def call_blocks(exp: DataFrame, other: DataFrame, reference: str = "mm10", pvalue_cutoff: float = 1e-4, pvalue_adj_cutoff: float | None = None, pseudocounts: float = 0.2, min_length: int | None = None, max_length: int | None = None,
                block_source: Callable[[DataFrame], DataFrame] = blocks) -> DataFrame:
    """Peaks from blocks that hold more insertions than expected from sites or background: runs of significant blocks are merged and tested again."""
    def tested(df: DataFrame) -> DataFrame:
        df = totals(totals(df, exp, "_exp"), other, "_of")
        rate = F.col("reference_insertions") * F.col("_exp") / F.greatest(F.col("_of"), F.lit(1)) + pseudocounts
        return df.withColumns({"expected_insertions": rate, "pvalue": stats.poisson_sf(F.col("experiment_insertions") - 1, rate)}).drop("_exp", "_of")

    b = kept(block_source(exp))
    exp, other = counted(exp), counted(other)
    df = tested(block_counts(block_counts(b, exp, "experiment_insertions"), other, "reference_insertions")).withColumn("_sig", F.col("pvalue") <= pvalue_cutoff)
    w = Window.partitionBy("chr").orderBy("start")
    run = F.sum((~F.col("_sig")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    merged = df.withColumn("_run", run).where("_sig").groupBy("chr", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("experiment_insertions").alias("experiment_insertions"), F.sum("reference_insertions").alias("reference_insertions")).drop("_run")
    out = tested(merged).where(F.col("pvalue") <= pvalue_cutoff)
    width = F.col("end") - F.col("start")
    out = out.where(F.lit(True) if min_length is None else width >= min_length).where(F.lit(True) if max_length is None else width <= max_length)
    return _with_fdr(out.select("chr", "start", "end", "experiment_insertions", "reference_insertions", "expected_insertions", "pvalue"), "pvalue", "pvalue_adj", reference, pvalue_cutoff if pvalue_adj_cutoff is None else pvalue_adj_cutoff)


CALLERS = {"CCcaller": call_islands, "MACCs": call_windows, "MACCS_old": call_windows_max_rate, "Blockify": call_blocks}


def call_peaks(exp: DataFrame, sites: DataFrame, background: DataFrame | None = None, method: str = "CCcaller", record: bool = True, save: str | None = None, **options) -> DataFrame:
    """The façade: method by name, with or without background. record=False keeps the three columns of the interval; save writes them."""
    if method not in CALLERS:
        raise ValueError(f"unknown method {method}; known: {sorted(CALLERS)}")
    for k in ("extend", "maxbetween", "min_insertions", "window_size", "step_size", "minlen", "minnum"):
        if k in options and (not isinstance(options[k], int) or options[k] < 0):
            raise ValueError(f"{k} must be a whole number, not negative")
    for k in options:
        if k.startswith("pvalue") and options[k] is not None and not 0 <= options[k] <= 1:
            raise ValueError(f"{k} must be in 0..1")
    out = call_blocks(exp, sites if background is None else background, **options) if method == "Blockify" else CALLERS[method](exp, sites, background, **options)
    out = out if record else out.select("chr", "start", "end")
    if save:
        from ..sources.io import save_bed

        save_bed(out.select("chr", "start", "end"), save)
    return out


def with_ordinal(peaks: DataFrame) -> DataFrame:
    """peak_ord from 0, in the order of chromosome key and start."""
    return peaks.withColumn("peak_ord", F.row_number().over(Window.orderBy(S.chromosome_key(F.col("chr")), "chr", "start", "end")) - 1)


def edit_columns(method: str, background: bool) -> list[str]:
    """Columns of an edited peak, as the callers name them."""
    if method == "Blockify" or (method == "CCcaller" and not background):
        return ["chr", "start", "end", "experiment_insertions", "reference_insertions", "expected_insertions", "pvalue", "pvalue_adj"]
    if method == "CCcaller":
        return ["chr", "start", "end", "experiment_insertions", "background_insertions", "reference_insertions", "expected_background", "expected_reference", "pvalue_background", "pvalue_reference", "pvalue_adj_reference"]
    if method != "MACCs":
        raise ValueError(f"peaks of {method} can't be edited; known: CCcaller, MACCs, Blockify")
    if not background:
        return ["chr", "start", "end", "center", "pvalue", "experiment_insertions", "reference_insertions", "fraction_experiment", "tph_experiment", "expected_insertions", "pvalue_adj"]
    return ["chr", "start", "end", "center", "experiment_insertions", "background_insertions", "reference_insertions", "pvalue_reference", "pvalue_background", "fraction_experiment", "tph_experiment", "fraction_background", "tph_background", "tph_background_subtracted", "pvalue_adj_reference"]


def retested(bounds: DataFrame, peaks: DataFrame, exp: DataFrame, sites: DataFrame, background: DataFrame | None = None, method: str = "CCcaller", reference: str = "mm10", test_method: str = "poisson", lam_win_size: int | None = 100_000, pseudocounts: float = 0.2) -> DataFrame:
    """Counts, expectations and p of new bounds (chr, start, end), by the method that called the peaks; the adjusted p is that of the peak whose p is nearest.

    A site counts by its end (its start and the site's width, where the table has no end). Totals are of a window of lam_win_size around the bounds, or of the chromosome (None, and always for blocks)."""
    out = edit_columns(method, background is not None)
    if test_method not in ("poisson", "binomial"):
        raise ValueError(f"unknown test {test_method}")
    h = S.EDIT_HALF_WIDTH[reference]
    exp, background = counted(exp), background if background is None else counted(background)
    other = counted(sites.select("chr", (F.col("end") if "end" in sites.columns else F.col("start") + h).alias("start"), *(c for c in ("_held",) if c in sites.columns)))
    tables = {"reference": other if background is None or method != "Blockify" else background}
    if background is not None and method != "Blockify":
        tables["background"] = background
    near, half = (F.col("start") - h, F.col("end")), (lam_win_size or 0) / 2
    wide = (F.col("start") - h - half + 1, F.col("end") + half)
    df = kept(bounds.select("chr", "start", "end"))
    for name, points in ({"experiment": exp} | tables).items():
        if lam_win_size and method != "Blockify":
            df = range_count(df, points, {f"{name}_insertions": near, f"_{name}": wide})
        else:
            df = totals(range_count(df, points, {f"{name}_insertions": near}), points, f"_{name}")
    n, whole = F.col("experiment_insertions"), F.col("_experiment")
    for name in tables:
        c, of = F.col(f"{name}_insertions"), F.col(f"_{name}")
        p = stats.cumulative_poisson(n, c, whole, of, pseudocounts) if test_method == "poisson" else stats.binomial_sf(n + pseudocounts, whole, F.try_divide(c + pseudocounts, of))
        df = df.withColumns({f"expected_{name}": F.try_divide(whole * c, of), f"pvalue_{name}": p})
    if len(tables) == 1:
        df = df.withColumnsRenamed({"expected_reference": "expected_insertions", "pvalue_reference": "pvalue"})
    if method == "MACCs":
        df = with_center(df, exp, h)
        for name, points in (("experiment", exp), ("background", background)):
            if points is not None:
                share = F.try_divide(F.col(f"{name}_insertions"), F.lit(row_count(points)))
                df = df.withColumns({f"fraction_{name}": share, f"tph_{name}": share * TPH})
        if background is not None:
            df = df.withColumn("tph_background_subtracted", F.col("tph_experiment") - F.col("tph_background"))
    tested, adjusted = ("pvalue", "pvalue_adj") if len(tables) == 1 else ("pvalue_reference", "pvalue_adj_reference")
    df = kept(df)
    # One or two edited peaks meet the peak table's (p, adjusted p): the few are sent, the table stays.
    met = peaks.select(F.col(tested).alias("_p"), F.col(adjusted).alias("_adj")).join(F.broadcast(df.select("chr", "start", F.col(tested).alias("_mine"))))
    nearest = met.groupBy("chr", "start").agg(F.min_by("_adj", F.struct(F.abs(F.col("_p") - F.col("_mine")), F.col("_p"))).alias(adjusted))
    return df.join(nearest, ["chr", "start"], "left").select(*out)


def combine_peaks(peaks: DataFrame, index: int, exp: DataFrame, sites: DataFrame, background: DataFrame | None = None, method: str = "CCcaller", return_whole: bool = False, cutoffs: dict[str, float] | None = None, **options) -> DataFrame:
    """Peaks index and index + 1 as one, counted and tested again by the method that called them. cutoffs: largest value by column of p; options: as of `retested`. Peaks without counts are joined only."""
    peaks = kept(peaks)
    ranked = with_ordinal(peaks)
    two = ranked.where(F.col("peak_ord").isin(index, index + 1))
    seen = two.agg(F.count(F.lit(1)), F.countDistinct("chr")).first()
    if tuple(seen) != (2, 1):
        raise ValueError("there are no two such neighbours on one chromosome")
    bounds = two.groupBy("chr").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return _edited(ranked, [index, index + 1], _tested(bounds, peaks, exp, sites, background, method, options), cutoffs, return_whole)


def separate_peaks(peaks: DataFrame, index: int, middle_start: int, middle_end: int, exp: DataFrame, sites: DataFrame, background: DataFrame | None = None, method: str = "CCcaller", return_whole: bool = False, cutoffs: dict[str, float] | None = None, **options) -> DataFrame:
    """Peak index as two: up to middle_start, and from middle_end. The rest as of `combine_peaks`; each half stays if it passes the cut-offs."""
    peaks = kept(peaks)
    ranked = with_ordinal(peaks)
    halves = ranked.where(F.col("peak_ord") == index).select("chr", F.explode(F.array(F.struct("start", F.lit(middle_start).cast("long").alias("end")), F.struct(F.lit(middle_end).cast("long").alias("start"), "end"))).alias("h")).select("chr", "h.*")
    return _edited(ranked, [index], _tested(halves, peaks, exp, sites, background, method, options), cutoffs, return_whole)


def _tested(bounds: DataFrame, peaks: DataFrame, exp: DataFrame, sites: DataFrame, background: DataFrame | None, method: str, options: dict) -> DataFrame:
    return retested(bounds, peaks, exp, sites, background, method, **options) if len(peaks.columns) > 3 else bounds.select("chr", "start", "end")


def _edited(ranked: DataFrame, gone: list[int], new: DataFrame, cutoffs: dict[str, float] | None, whole: bool) -> DataFrame:
    for name, cutoff in (cutoffs or {}).items():
        new = new.where(F.col(name) <= cutoff)
    return union_all([ranked.where(~F.col("peak_ord").isin(gone)).drop("peak_ord"), new]) if whole else new


COPIES = 65_536


def down_sample(points: DataFrame, number: int = 10_000_000, seed: int = 1) -> DataFrame:
    """Exactly `number` rows (or all), uniformly by a seeded hash of the row and its place among equal ones, sorted by chr and start.

    Equal rows are counted before the shuffle and numbered in pieces of COPIES, so that a row that stands very often is spread over tasks. The cut is found from two histograms of the hash's
    leading bits (65,536 buckets each); only the rows of the last bucket are put in order."""
    names = points.columns
    counted = points.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    pieces = counted.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPIES).cast("bigint")))).repartition(*names, "_piece")
    first = F.col("_piece") * COPIES
    rows = pieces.withColumn("_copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("_n")) - 1)))
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(seed), *names, "_copy")).select(*names, "_copy", "_hash")
    chosen, inside, left = None, F.lit(True), number
    for bits in (48, 32):
        bucket = F.shiftrightunsigned("_hash", bits).bitwiseAND(F.lit(65_535))
        sizes = sorted(map(tuple, rows.where(inside).groupBy(bucket.alias("b")).agg(F.count(F.lit(1))).collect()))
        cut, below = None, 0
        for b, n in sizes:
            if below + n > left:
                cut = b
                break
            below += n
        full = inside if cut is None else inside & (bucket < cut)
        chosen, left = full if chosen is None else chosen | full, left - below
        if cut is None or not left:
            inside = F.lit(False)
            break
        inside = inside & (bucket == cut)
    rest = rows.where(inside).orderBy("_hash", *names, "_copy").limit(left)
    order = [c for c in ("chr", "start") if c in names]
    out = rows.where(chosen).unionByName(rest).select(*names)
    return out.orderBy(*order) if order else out
