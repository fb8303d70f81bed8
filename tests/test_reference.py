"""Operators against hand-made cases, brute force and literal loops; every query with SQL against DuckDB."""

import math
import random
from fractions import Fraction
from math import comb

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from intervalia.functions import stats
from intervalia.operators import integrate, intervals, matrix, peaks, views
from intervalia.plans.queries import QUERIES, SQL
from intervalia.sources import io, schema
from intervalia.streaming import sessions

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def points(spark, places, chrom="chr1"):
    return spark.createDataFrame([(chrom, int(p)) for p in places] or [("none", 0)], "chr string, start long")


def tidy(v):
    return None if v is None else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["clean_qbed", "ccaller_nobg", "ccaller_bg", "range_count", "range_count_wide", "merge_intervals", "annotate_knn2", "signal_profile", "read_qbed", "read_reference_sites", "read_barcodes", "read_rna", "read_gwas", "read_motifs", "read_bedgraph", "combine_peaks", "combine_peaks_bg", "combine_peaks_maccs_bg", "separate_peaks", "separate_peaks_blocks_bg", "maccs_max_rate", "count_matrix", "rank_groups_fisher", "rank_groups_by_sample_two_sided", "gwas_traits", "liftover", "maccs_window_stats", "dotplot_sc", "gwas_table", "gwas_sample_shares", "heatmap_matrix", "heatmap_cc", "dotplot_bulk", "dotplot_bulk_replicates", "dotplot_bulk_groups", "draw_area", "rank_groups_mu", "rank_groups_reference", "insertions_per_group_mu", "pair_genes_mu", "dotplot_sc_mu", "draw_area_mu", "event_sessions"])
def test_query_in_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = con.execute(SQL[name])
    columns = [d[0] for d in got.description]
    want = sorted((tuple(tidy(r[columns.index(c)]) for c in sorted(columns)) for r in got.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(columns) and want
    assert sorted((tuple(tidy(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr) == want


def test_islands_by_hand(spark):
    got = peaks.islands(points(spark, [100, 150, 150, 900, 3500, 3600, 3600, 3700, 9000]), 1000, 0, 2, 0, 10).orderBy("start").collect()
    assert [tuple(r) for r in got] == [("chr1", 90, 914, 4), ("chr1", 3490, 3714, 4)]


def literal_islands(places, maxbetween, minnum, least):
    pos = sorted(set(places))
    count = [places.count(p) for p in pos]
    out, first, total = [], 0, 0
    for i, p in enumerate(pos):
        total += count[i]
        gap = pos[i + 1] - p if i + 1 < len(pos) else maxbetween + 1
        gap2 = pos[i + 2] - pos[i + 1] if i + 2 < len(pos) else maxbetween + 1
        c1 = count[i + 1] if i + 1 < len(pos) else 0
        c2 = count[i + 2] if i + 2 < len(pos) else 0
        if gap > maxbetween or (c1 <= minnum and (gap2 > maxbetween / 3 or c2 <= minnum)):
            if total >= least:
                out.append((max(pos[first] - 5, 0), p + 4 + 5, total))
            first, total = i + 1, 0
    return out


@pytest.mark.parametrize("minnum", [0, 1, 2])
def test_islands_random(spark, minnum):
    rnd = random.Random(minnum)
    places = [rnd.randint(1, 6000) for _ in range(250)]
    got = sorted(tuple(r)[1:] for r in peaks.islands(points(spark, places), 60, minnum, 3, 0, 5).collect())
    assert got == literal_islands(places, 60, minnum, 3)


def test_range_counts(spark):
    rnd = random.Random(1)
    places = [rnd.randint(0, 900_000) for _ in range(400)] + [100_000] * 5
    asked = [("chr1", rnd.randint(-200_000, 1_200_000), rnd.randint(0, 400_000)) for _ in range(150)] + [("chr9", 5, 10), ("chr1", 97, 110)]
    q = spark.createDataFrame([(c, a, a + w) for c, a, w in asked], "chr string, start long, end long").distinct()
    got = intervals.range_count(q, points(spark, places), {"n": (F.col("start") - 2.5, F.col("end")), "m": (F.col("start"), F.col("end") + 70_000)}).collect()
    assert len(got) == q.count()
    for r in got:
        mine = places if r.chr == "chr1" else []
        assert r.n == sum(r.start - 2.5 <= p <= r.end for p in mine) and r.m == sum(r.start <= p <= r.end + 70_000 for p in mine)
    joined = intervals.range_join(q, points(spark, places), F.col("start"), F.col("end")).groupBy("start", "end").count().collect()
    assert {(r["start"], r["end"]): r["count"] for r in joined} == {(a, a + w): n for c, a, w in asked if c == "chr1" and (n := sum(a <= p <= a + w for p in places))}


def test_tails(spark):
    cases = [(3, 0.7, 0.005753457592299616), (10, 4.2, 0.004068803040170765), (5, 1.2, 0.0015002250982298904), (0, 0.2, 0.18126924692201818)]
    df = spark.createDataFrame([(float(k), m) for k, m, _ in cases] + [(1000.0, 900.0), (-1.0, 2.0), (2.0, None)], "k double, m double")
    got = [r[0] for r in df.select(stats.poisson_sf(F.col("k"), F.col("m"))).collect()]
    assert all(math.isclose(a, c[2], abs_tol=1e-12) for a, c in zip(got, cases, strict=False))
    exact = 1 - sum(math.exp(i * math.log(900) - 900 - math.lgamma(i + 1)) for i in range(1001))
    assert math.isclose(got[4], exact, rel_tol=1e-6) and got[5] == 1.0 and got[6] is None
    cum = spark.range(1).select(*[stats.cumulative_poisson(F.lit(6.0), F.lit(3.0), F.lit(a), F.lit(b), 0.2) for a, b in ((100.0, 200.0), (200.0, 100.0))]).first()
    assert math.isclose(cum[0], 0.00187507714947277, abs_tol=1e-12) and math.isclose(cum[1], 0.397480275594443, abs_tol=1e-12)


def test_exact_tests():
    assert math.isclose(stats.fisher_test(8, 2, 20, 25), 0.013220150486174309, rel_tol=1e-9) and math.isclose(stats.fisher_test(8, 2, 20, 25, True), 0.014244779984995527, rel_tol=1e-9)
    assert math.isclose(stats.fisher_test(0, 5, 10, 10), 1.0) and math.isclose(stats.fisher_test(0, 5, 10, 10, True), 0.032507739938080496, rel_tol=1e-9)
    assert math.isclose(stats.binomial_test(8, 10, 20 / 45), 0.025204820801307697, rel_tol=1e-9) and math.isclose(stats.binomial_test(8, 10, 20 / 45, True), 0.02800557469856594, rel_tol=1e-9)
    exact = sum(Fraction(comb(20, i)) * Fraction(2, 25) ** i * Fraction(23, 25) ** (20 - i) for i in range(8, 21))
    assert math.isclose(stats.binomial_test(8, 20, 2 / 25), float(exact), rel_tol=1e-9) and stats.binomial_test(0, 0, 0.5) == 1.0


def test_adjusted(spark):
    df = spark.createDataFrame([(p, 0, 500) for p in (0.01, 0.04, 0.03, 0.5)], "p double, start long, end long")
    assert sorted(round(r.a, 7) for r in stats.adjusted(df, "p", "a", []).collect()) == [0.04, 0.0533333, 0.0533333, 0.5]
    df = spark.createDataFrame([(p, 0, 500) for p in (1e-8, 1e-6, 2e-6, 1e-3)], "p double, start long, end long")
    got = sorted(r.a for r in stats.adjusted_genome(df, "p", "a", schema.GENOME["sacCer3"]).collect())
    assert np.allclose(got, [0.00024314, 0.012157, 24314 * 2e-6 / 3, 1.0])


def test_trim_merge_bedgraph(spark):
    p = spark.createDataFrame([("c", 0, 100), ("c", 90, 180), ("c", 170, 260)], "chr string, start long, end long")
    assert sorted(r.start for r in peaks.trimmed(p).collect()) == [0, 100, 180]
    assert [tuple(r) for r in intervals.merge_intervals(p).collect()] == [("c", 0, 260, 3)]
    assert sorted(tuple(r)[1:] for r in io.bedgraph(points(spark, [5, 5, 9])).collect()) == [(5, 9, 2), (9, 13, 1)]


def test_first_owner(spark):
    q = spark.createDataFrame([("chr1", s, "b") for s in (150, 198, 200, 201, 250)], "chr string, start long, barcode string")
    p = spark.createDataFrame([("chr1", 100, 200), ("chr1", 200, 300)], "chr string, start long, end long")
    codes = spark.createDataFrame([("b",), ("z",)], "barcode string")
    m = matrix.make_matrix(q, p, codes)
    assert {r.var_id: r.value for r in m.x.collect()} == {"chr1_100_200": 3, "chr1_200_300": 2} and m.obs.count() == 2
    with pytest.raises(KeyError):
        matrix.make_matrix(q, p, codes.where("barcode = 'z'"))
    assert matrix.filter_peaks(m, min_counts=3).var.count() == 1 and matrix.filter_peaks(m, max_counts=0).var.count() == 0
    with pytest.raises(ValueError):
        matrix.filter_peaks(m)


@pytest.mark.parametrize("seed", range(20))
def test_pruned_segmentation(seed):
    rnd = np.random.default_rng(seed)
    x = np.concatenate([rnd.integers(0, 10_000, 40), rnd.integers(3000, 3200, rnd.integers(0, 60))])
    ncp = peaks.prior(0.05, len(x))
    assert np.array_equal(peaks.segment(x, ncp), peaks.segment(x, ncp, prune=False))


def literal_walk(significant, at, origin, top, window, step, h, extend, last):
    """Window by window."""
    out, open_, end, start, k = [], False, -math.inf, None, 0
    while (s := origin + k * step) <= top:
        if end >= s:
            k += 1
            continue
        if k in significant:
            start, open_, end = (start if open_ else s), True, s + window - 1
        elif open_:
            held = [a for a in at if start - h <= a <= end]
            out.append((max(min(held) - extend, 0), max(held) + last + extend, float(np.median(held))))
            open_, end = False, max(held) + last + extend
        k += 1
    return out


@pytest.mark.parametrize("seed", range(8))
def test_window_walk(spark, seed):
    rnd = random.Random(seed)
    window, step, h, extend = rnd.choice([(100, 50, 3, 20), (100, 100, 3, 0), (125, 60, 0, 50), (60, 50, 3, 200)])
    at = sorted(rnd.randint(500, 500 + rnd.choice([3000, 30000])) for _ in range(120))
    windows = {k for k in range((at[-1] - at[0] + h) // step + 1) if sum(at[0] + k * step - h <= a <= at[0] + k * step + window - 1 for a in at) >= 2 and rnd.random() < 0.7}
    want = literal_walk(windows, at, at[0], at[-1] + 10 * (window + step + extend + 10), window, step, h, extend, h)
    sig = spark.createDataFrame([("chr1", k, at[0] + k * step) for k in windows] or [("x", 0, 0)], "chr string, k long, start long")
    got = sorted(tuple(r)[1:] for r in peaks.window_peaks(points(spark, at), sig, window, step, h, extend, h).collect())
    assert got == sorted(want)


def test_callers_run(spark):
    exp = points(spark, [1000 + 13 * k for k in range(30)] + [60_000, 90_000]).unionByName(points(spark, [5000 + k for k in range(20)], "chr2"))
    sites = points(spark, range(0, 100_000, 500)).unionByName(points(spark, range(0, 50_000, 500), "chr2"))
    bg = points(spark, range(0, 100_000, 3000))
    for method in peaks.CALLERS:
        for background in (None, bg):
            if method == "MACCS_old" and background is None:
                continue
            got = peaks.call_peaks(exp, sites, background, method)
            rows = got.collect()
            assert rows and all(r.start < r.end for r in rows), method
    assert peaks.call_peaks(exp, sites, record=False).columns == ["chr", "start", "end"]
    with pytest.raises(ValueError):
        peaks.call_peaks(exp, sites, method="none")
    with pytest.raises(ValueError):
        peaks.call_peaks(exp, sites, pvalue_cutoff=2.0)
    assert peaks.call_peaks(exp, sites, test_method="binomial").count() > 0


def test_liftover_bounds(spark):
    chain = spark.createDataFrame([("chr1", 0, 100, "chr2", 1000, "+"), ("chr1", 200, 301, "chr2", 1899, "+"), ("chr1", 500, 600, "chr3", 0, "-")], "src_chr string, src_start long, src_end long, dst_chr string, dst_start long, strand string")
    p = spark.createDataFrame([("chr1", 99, 200), ("chr1", 510, 520), ("chr1", 99, 300), ("chr1", 110, 150)], "chr string, start long, end long")
    got = {(r.start, r.end): (r.chr_lift, r.start_lift, r.end_lift) for r in integrate.liftover(p, chain).collect()}
    assert got == {(99, 200): ("chr2", 1099, 1899), (510, 520): ("chr3", 79, 89), (99, 300): ("chr2", 1099, 1999), (110, 150): (None, None, None)}


def test_pairs_locations_footprints(spark):
    ann = spark.createDataFrame([("c", 1, 9, "G", 5, "G", 900), ("c", 20, 30, "A", 1, "B", -7)], "chr string, start long, end long, gene1 string, distance1 long, gene2 string, distance2 long")
    assert sorted(tuple(r) for r in integrate.gene_pairs(ann).collect()) == [("c_1_9", "G", 5), ("c_20_30", "A", 1), ("c_20_30", "B", -7)]
    rnd = np.random.default_rng(2)
    at = np.concatenate([rnd.normal(300, 8, 40), rnd.normal(600, 8, 40)]).astype(int)
    qbed = spark.createDataFrame([("c", int(a), int(a) + 1) for a in at], "chr string, start long, end long")
    p = spark.createDataFrame([("c", 200, 700), ("c", 5000, 6000)], "chr string, start long, end long")
    got = {r.start: (r.foot_start, r.foot_end) for r in integrate.footprint(p, qbed).collect()}
    assert abs(got[200][0] - 300) < 8 and abs(got[200][1] - 600) < 8 and got[5000] == (5000, 6000)
    assert {r.start: r.foot_start for r in integrate.footprint(p, qbed, delete_unfound=True).collect()}[5000] is None


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr1\nACGT\nTTGA\n")
    assert io.fasta_slice(spark, str(tmp_path / "a.fa"), 3, 6).first().sequence == "GTTT"
    (tmp_path / "q.qbed").write_text("chr1\t5\t6\t2\t+\tb\n")
    q = io.read_qbed(spark, str(tmp_path / "q.qbed"))
    assert tuple(q.first()) == ("chr1", 5, 6, 2, "+", "b")
    io.save_qbed(q, str(tmp_path / "out"))
    assert io.read_qbed(spark, str(tmp_path / "out")).count() == 1
    (tmp_path / "g").write_text("4\t100\t3\n")
    assert tuple(io.read_gnashy(spark, str(tmp_path / "g")).first()) == ("chrIV", 100, 101, 3)
    (tmp_path / "r.csv").write_text("gene,s1,s2\nA,1,2\n")
    assert sorted(tuple(r) for r in io.read_rna(spark, str(tmp_path / "r.csv")).collect()) == [("A", "s1", 1.0), ("A", "s2", 2.0)]
    named = schema.to_reference_names(q)
    assert named.columns[:2] == ["Chr", "Start"] and schema.adapt(named).columns == q.columns
    with pytest.raises(ValueError):
        io.ReferenceCatalog(spark, {}).get("sites", "hg38")


def test_down_sample(spark):
    df = points(spark, [1, 1, 1, 2, 3])
    assert peaks.down_sample(df, 3).count() == 3 and peaks.down_sample(df, 99).count() == 5 and peaks.down_sample(df, 0).count() == 0
    hot = points(spark, [7] * 70_000 + list(range(100, 2100)))
    got = [tuple(r) for r in peaks.down_sample(hot, 9_000).collect()]
    assert got == sorted(got) and len(got) == 9_000 and len({p for _, p in got if p != 7}) == sum(p != 7 for _, p in got)
    # A uniform sample: about 250 of the 2,000 rows that stand once.
    assert 180 < sum(p != 7 for _, p in got) < 320


def test_profile_and_area(spark):
    s = spark.createDataFrame([("c", i * 10, i * 10 + 10, float(i)) for i in range(40)], "chr string, start long, end long, value double")
    p = spark.createDataFrame([("c", 100, 200)], "chr string, start long, end long")
    m = views.signal_matrix(p, s, 50, 50, 4)
    assert [round(r.value, 6) for r in m.orderBy("bin").collect()] == [7.0, 12.0, 17.0, 22.0]
    assert views.signal_profile(m).count() == 4 and views.signal_heatmap(m).count() == 4


def test_streaming_sessions(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").limit(200)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sessions.window_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM counts").collect())) == sorted(map(tuple, sessions.window_counts(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()))


def test_range_count_of_repeated_rows(spark):
    points = spark.createDataFrame([("a", 12), ("a", 15), ("b", 3)], "chr string, start bigint")
    asked = spark.createDataFrame([("a", 10, 20), ("a", 10, 20), ("a", 13, 20), (None, 1, 2), ("a", None, 20), ("c", 1, 9)], "chr string, start bigint, end bigint")
    got = intervals.range_count(asked, points, {"n": (F.col("start"), F.col("end"))}).collect()
    want = [("a", 10, 20, 2), ("a", 10, 20, 2), ("a", 13, 20, 1), (None, 1, 2, 0), ("a", None, 20, 0), ("c", 1, 9, 0)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_nearest_genes_by_hand(spark, seed):
    rnd = random.Random(seed)
    genes = [(s, s + rnd.choice([0, 3, 40, 400]), f"r{rnd.randint(0, 5)}", f"g{i}", "+") for i, s in enumerate(rnd.choices(range(300), k=40))]
    index = intervals.GeneIndex(genes)
    for _ in range(300):
        a = rnd.randint(0, 350)
        b = a + rnd.choice([0, 5, 60])
        far = [((g[0] - b + 1 if g[0] > b else g[1] - a - 1 if g[1] < a else 0), g) for g in genes]
        want = sorted(far, key=lambda x: (abs(x[0]), x[1]))
        for k in (1, 2, 5):
            assert index.nearest(a, b, k) == want[:k]


def test_heatmap_order_and_first_rows(spark):
    obs = spark.createDataFrame([("a", "g1"), ("b", "g2")], "obs_id string, cluster string")
    x = spark.createDataFrame([("a", "p_1_2", 3), ("b", "p_1_2", 1), ("b", "p_5_6", 2), ("a", "p_8_9", 1)], "obs_id string, var_id string, value long")
    m = matrix.CountMatrix(x, obs, x.select("var_id").distinct())
    near = spark.createDataFrame([("p", 1, 2, "A", "B"), ("p", 5, 6, "A", None), ("p", 8, 9, "C", "D")], "chr string, start long, end long, gene1 string, gene2 string")
    rna = spark.createDataFrame([("s1", "A", 4.0, 2), ("s1", "A", 1.0, 1), ("s2", "A", 3.0, 1), ("s1", "C", 0.0, 1)], "sample string, gene string, value double, place int")
    rows = views.heatmap(m, "cluster", near, rna, log=False, first_by="place").collect()
    # The third peak's genes are 0 or not measured; the order is by the first group's share.
    assert [r.name for r in rows] == ["p_5_6", "p_1_2"]
    assert [[c.value for c in r.shares] for r in rows] == [[0.0, 1.0], [0.75, 0.25]]
    assert [[c.value for c in r.expression1] for r in rows] == [[1 / 3, 1.0]] * 2 and [[c.value for c in r.expression2] for r in rows] == [[0.0, 0.0]] * 2


def test_gwas_table_order(spark):
    shares = spark.createDataFrame([("t1", "a", 0.25, 4), ("t1", "b", 0.75, 4), ("t2", "a", 1.0, 7), ("t3", "b", 1.0, 5)], "trait string, group string, share double, total long")
    rows = integrate.gwas_table(shares).collect()
    assert [(r.trait, r.total, [c.value for c in r.shares]) for r in rows] == [("t2", 7, [1.0, 0.0]), ("t1", 4, [0.25, 0.75]), ("t3", 5, [0.0, 1.0])]


def test_segmentation_summary(spark):
    rnd = random.Random(4)
    places = sorted(rnd.randrange(3000) for _ in range(40)) + sorted(rnd.randrange(5000, 5200) for _ in range(60))
    rows = {r.chr: r for r in peaks.segmentation_summary(peaks.segments(points(spark, places), ncp_prior=2.0)).collect()}
    t, n = np.unique(places, return_counts=True)
    edges = [float(t[0]), *((t[1:] + t[:-1]) / 2), float(t[-1])]
    cum = [0, *np.cumsum(n)]
    best = [(0.0, 0)]
    for r in range(1, len(t) + 1):
        best.append(max((best[k][0] + (cum[r] - cum[k]) * (math.log(cum[r] - cum[k]) - math.log(edges[r] - edges[k])) - 2.0, best[k][1] + 1) for k in range(r)))
    assert rows["chr1"].n_blocks == best[-1][1] and math.isclose(rows["chr1"].fitness, best[-1][0]) and rows["chr1"].prior == 2.0
    assert rows[None].n_blocks == rows["chr1"].n_blocks


def test_data_sets(spark, tmp_path):
    q = spark.createDataFrame([("chr1", 5, 9, 2, "+", "b")], schema.QBED)
    io.save_qbed(q, str(tmp_path / "SP1_Cre" / "SP1_P10"))
    registry = io.DatasetRegistry(spark, str(tmp_path))
    assert registry.get("SP1_Cre", "SP1_P10").collect() == q.collect()
    with pytest.raises(ValueError):
        registry.get("SP1_Cre", "nothing")
    assert intervals.clean_qbed(q.union(spark.createDataFrame([("chrUn", 5, 9, 2, "+", "b")], schema.QBED))).count() == 1


def test_exact_tests_against_fractions():
    rnd = random.Random(8)
    for _ in range(300):
        t1, t2 = rnd.randrange(1, 30), rnd.randrange(1, 30)
        n1, n2 = rnd.randrange(t1 + 1), rnd.randrange(t2 + 1)
        mass = {i: Fraction(comb(t1, i) * comb(t2, n1 + n2 - i), comb(t1 + t2, n1 + n2)) for i in range(max(0, n1 + n2 - t2), min(n1 + n2, t1) + 1)}
        assert math.isclose(stats.fisher_test(n1, n2, t1, t2), sum(m for i, m in mass.items() if i >= n1), rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(stats.fisher_test(n1, n2, t1, t2, True), sum(m for m in mass.values() if m <= mass[n1]), rel_tol=1e-9)
        n, p = rnd.randrange(1, 40), Fraction(rnd.randrange(1, 20), 20)
        k, mass = rnd.randrange(n + 1), [comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        assert math.isclose(stats.binomial_test(k, n, float(p)), sum(mass[k:]), rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(stats.binomial_test(k, n, float(p), True), sum(m for m in mass if m <= mass[k]), rel_tol=1e-9)


def test_exact_tests_of_large_counts():
    # Half of ten million, give or take: the tails meet, and no list of outcomes is made.
    assert math.isclose(stats.binomial_test(5_000_000, 10_000_000, 0.5), 0.5 + math.exp(stats.log_choose(10_000_000, 5_000_000) - 10_000_000 * math.log(2)) / 2, rel_tol=1e-6)
    assert stats.binomial_test(5_000_000, 10_000_000, 0.5, True) == 1.0
    assert 0 < stats.fisher_test(3000, 2500, 10_000_000, 10_000_000) < 1e-10


@pytest.mark.parametrize("k", [1, 2, 3])
def test_nearest_genes_of_a_large_table(spark, k):
    # Over the limit: long genes, peaks over several bins, empty bins, equal rows, chromosomes without genes.
    rnd = random.Random(k)
    place = lambda: rnd.choice([rnd.randrange(3000), 5000 + rnd.randrange(200), 90_000 + rnd.randrange(500)])
    genes = [("a", s, s + rnd.choice([0, 20, 90, 700, 2500]), rnd.choice([None, "r1", "r2"]), f"g{rnd.randrange(9)}", "+") for s in (place() for _ in range(120))]
    genes += genes[:5] * 3 + [("b", 7, 9, "r", "g", "-"), ("c", None, 4, "r", "g", "-"), (None, 1, 4, "r", "g", "-")]
    asked = {("a", s, s + rnd.choice([0, 10, 99, 100, 350, 9000])) for s in (rnd.choice([place(), rnd.randrange(100_000)]) for _ in range(400))} | {("b", 1, 2), ("b", 100_000, 100_001), ("c", 1, 2), ("d", 1, 2), ("a", None, 3), (None, 1, 2)}
    g = spark.createDataFrame(genes, "chr string, start long, end long, refseq string, gene string, strand string")
    p = spark.createDataFrame(sorted(asked, key=str), "chr string, start long, end long")
    few = {tuple(r)[:3]: tuple(r)[3:] for r in intervals.nearest_genes(p, g, k).collect()}
    large = g.where("start is not null and chr is not null").select(F.col("chr").alias("_chr"), F.col("start").alias("gs"), F.col("end").alias("ge"), "refseq", "gene", F.col("strand").alias("direction"))
    for df in (intervals.nearest_genes(p, g, k, limit=10), intervals._binned(p, large, k, 100)):
        rows = [tuple(r) for r in df.collect()]
        assert {r[:3]: r[3:] for r in rows} == few and len(rows) == len(asked)
    order = lambda x: (abs(x[0]), x[1], x[2], *((v is not None, v or "") for v in x[3:]))
    for (c, a, b), got in few.items():
        far = [] if a is None or c is None else [((s - b + 1 if s > b else e - a - 1 if e < a else 0), s, e, r, n, d) for of, s, e, r, n, d in genes if of == c and s is not None]
        want = [x for f in sorted(far, key=order)[:k] for x in (*f[3:], f[0])]
        assert got == (*want, *[None] * (4 * k - len(want)))


def test_merged_intervals_that_repeat(spark):
    rnd = random.Random(12)
    rows = [("a", s, s + rnd.choice([3, 9, 60])) for s in rnd.choices(range(0, 3000, 25), k=60)] * 4
    rnd.shuffle(rows)
    want = []
    for c, a, b in sorted(rows):
        if want and a <= want[-1][2]:
            want[-1] = (c, want[-1][1], max(want[-1][2], b), want[-1][3] + 1)
        else:
            want.append((c, a, b, 1))
    assert sorted(tuple(r) for r in intervals.merge_intervals(spark.createDataFrame(rows, "chr string, start long, end long")).collect()) == want


def test_blocks_of_counted_positions(spark):
    rnd = np.random.default_rng(5)
    places = np.concatenate([rnd.integers(0, 4000, 50), rnd.integers(900, 960, 90)])
    t, n = np.unique(places, return_counts=True)
    edges, best = peaks.segmented(places, 3.0)
    same, value = peaks.segmented(t, 3.0, counts=n)
    assert np.array_equal(edges, same) and value == best
    got, counted = (sorted(tuple(r) for r in peaks.segments(df).collect()) for df in (points(spark, places), intervals.counted(points(spark, places))))
    assert got == counted and [r[1] for r in got] == np.floor(peaks.segment(places, peaks.prior(0.05, len(places)))).astype(int)[:-1].tolist()
    assert [tuple(r) for r in peaks.segments(points(spark, [7, 7])).select("start", "end", "fitness").collect()] == [(7, 7, None)]


@pytest.mark.parametrize("seed", range(3))
def test_two_normals_of_counted_values(seed):
    rnd = np.random.default_rng(seed)
    x = np.concatenate([rnd.normal(300, 20, 90), rnd.normal(500, 30, 60)]).astype(int)
    t, n = np.unique(x, return_counts=True)
    assert all(math.isclose(integrate.middle(t, np.cumsum(n), q), np.quantile(x, q)) for q in (0, 0.1, 0.25, 0.5, 0.75, 1))
    assert np.allclose(integrate.two_normals(t, counts=n), integrate.two_normals(x), rtol=1e-7)


def test_tails_of_large_counts(spark):
    cases = [(3e9, 5.0), (5e8, 40_000.0), (3.0, 40_000.0), (40_600.0, 40_000.0), (520.0, 500.5), (520.0, 499.5)]
    got = [r[0] for r in spark.createDataFrame(cases, "k double, m double").select(stats.poisson_sf(F.col("k"), F.col("m"))).collect()]
    exact = lambda k, m: 1 - math.fsum(math.exp(i * math.log(m) - m - math.lgamma(i + 1)) for i in range(int(k) + 1))
    assert got[0] == 0.0 and got[1] < 1e-12 and got[2] == 1.0 and all(math.isclose(g, exact(*c), abs_tol=1e-9) for g, c in zip(got[3:], cases[3:], strict=True))


def test_callers_read_each_table_once(spark):
    exp = points(spark, [1000 + 13 * k for k in range(30)] * 3 + [60_000, 90_000] + list(range(70_000, 70_400, 5)))
    sites, bg = points(spark, range(0, 100_000, 500)), points(spark, range(0, 100_000, 3000))
    seen = [spark.sparkContext.accumulator(0) for _ in range(3)]

    def watched(df, acc):
        def run(batches):
            for batch in batches:
                acc.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    for method, background in (("CCcaller", None), ("CCcaller", bg), ("MACCs", None), ("MACCs", bg), ("MACCS_old", bg)):
        before = [a.value for a in seen]
        tables = [df if df is None else watched(df, a) for df, a in zip((exp, sites, background), seen, strict=True)]
        got = sorted(map(tuple, peaks.call_peaks(*tables, method).collect()))
        read = [a.value - b for a, b in zip(seen, before, strict=True)]
        assert got and read == [exp.count(), sites.count(), background.count() if background is not None else 0], method
        assert got == sorted(map(tuple, peaks.call_peaks(*[df if df is None else intervals.counted(df) for df in (exp, sites, background)], method).collect()))
