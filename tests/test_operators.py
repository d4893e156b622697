"""Hand-computed cases, brute-force checks, and independence of partitioning and skew."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dipscan.config import ScreenConfig, SearchConfig, Selection, VetConfig, resolve_bitmask
from dipscan.functions import expr as X
from dipscan.functions import special as N
from dipscan.operators import catalog as C
from dipscan.operators import joins as J
from dipscan.operators import search as H
from dipscan.operators import sequence as S
from dipscan.operators import stats as A
from dipscan.operators import studies as Y
from dipscan.operators import vetting as T
from dipscan.sources import cadences as Q
from dipscan.sources import tables as B

DAY_US = 86_400_000_000


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def curve(spark, t, flux, err=2e-4, tic=1, sector=None):
    t = np.asarray(t, float)
    pdf = pd.DataFrame({
        "tic_id": np.full(t.size, tic, "int64"),
        "sector": np.full(t.size, 1, "int32") if sector is None else sector,
        "t_us": np.round(t * DAY_US).astype("int64"), "t": t, "flux": flux,
        "flux_err": np.full(t.size, err),
    })
    return spark.createDataFrame(pdf)


def test_fold_and_epochs(spark):
    rows = spark.createDataFrame([(x,) for x in (10.0, 10.4, 12.0, 13.9, 14.1)], "t double")
    got = rows.select(X.fold(F.col("t"), F.lit(2.0), F.lit(10.0)).alias("f"), X.epoch_index(F.col("t"), F.lit(2.0), F.lit(10.0)).alias("e"))
    values = got.collect()
    assert [v.f for v in values] == pytest.approx([0, 0.4, 0, -0.1, 0.1])
    assert [v.e for v in values] == [0, 0, 1, 2, 2]


def test_special_functions(spark):
    for x in (-30.0, -5.0, -1.0, 0.0, 0.5, 3.0):
        row = one(spark, N.log_ndtr(F.lit(x)).alias("l"))
        if x > -20:
            assert row.l == pytest.approx(math.log(0.5 * math.erfc(-x / math.sqrt(2))), rel=1e-6, abs=1e-7)
        back = one(spark, N.ndtri_exp(F.lit(row.l)).alias("x")).x
        assert back == pytest.approx(x, rel=1e-5, abs=1e-5)
    for dof, x, want in ((1, 3.841458821, 0.05), (2, 5.991464547, 0.05), (3, 7.814727903, 0.05), (8, 15.50731306, 0.05)):
        assert one(spark, N.chi2_sf(F.lit(x), F.lit(dof)).alias("p")).p == pytest.approx(want, rel=1e-5)


def test_thresholds_and_durations(spark):
    row = one(spark, H.trial_threshold(F.lit(1e6), 0.01).alias("t"), X.central_duration(F.lit(365.25), 1.0).alias("d"))
    assert row.t == pytest.approx(6.07, abs=0.01)
    assert row.d * 24 == pytest.approx(13.0, abs=0.1)
    grid = H.duration_list(SearchConfig())
    assert grid[0] == pytest.approx(0.5 / 24) and grid[-1] <= 0.5 and len(grid) == 18


def test_parsers(spark):
    row = one(
        spark, X.parse_sectors(F.lit("1-3, 20,2")).alias("s"), X.parse_tic_id(F.lit(" tic 123 ")).alias("t"),
        X.to_float(F.lit("nan")).alias("n"), X.symmetric_error(F.lit("0.1"), F.lit("-0.3")).alias("e"),
        X.btjd_from_any(F.lit(2458500.5)).alias("b"), X.year_of(F.lit(27)).alias("y"),
        X.choose_sectors(F.array(F.lit(5), F.lit(1), F.lit(9)), 2).alias("c"),
    )
    assert row.s == [1, 2, 3, 20] and row.t == 123 and row.n is None
    assert row.e == pytest.approx(0.2) and row.b == pytest.approx(1500.5) and row.y == 3 and row.c == [5, 9]
    with pytest.raises(ValueError):
        resolve_bitmask("nonsense")
    assert resolve_bitmask("hard") == 24319


def test_quantiles_on_a_hot_key(spark):
    rng = np.random.default_rng(0)
    n = 60_000
    key = np.where(rng.uniform(size=n) < 0.4, 0, rng.integers(1, 300, n))
    v = np.where(rng.uniform(size=n) < 0.01, 1e6, rng.standard_normal(n)).round(3)
    df = spark.createDataFrame(pd.DataFrame({"k": key, "v": v}))
    probs = {"q1": 0.1, "q5": 0.5, "q9": 0.99}
    want = pd.DataFrame({"k": key, "v": v}).groupby("k")["v"].quantile([0.1, 0.5, 0.99]).unstack()
    for partitions in (1, 7):
        got = A.quantiles(df.repartition(partitions), ["k"], F.col("v"), probs, bounded=False, accuracy=500)
        got = got.toPandas().set_index("k").sort_index()
        for name, p in probs.items():
            assert np.allclose(got[name], want[p])
    bounded = A.quantiles(df, ["k"], F.col("v"), probs, bounded=True).toPandas().set_index("k").sort_index()
    assert np.allclose(bounded["q5"], want[0.5])


def test_segments_with_gaps(spark):
    t = np.concatenate([np.arange(0, 10, 0.01), np.arange(20, 30, 0.01)])
    segs = S.segments(curve(spark, t, np.ones(t.size)), ["tic_id"], 0.5).orderBy("segment").collect()
    assert [(round(s.seg_start, 6), round(s.seg_end, 6), s.seg_n) for s in segs] == [(0, 9.99, 1000), (20, 29.99, 1000)]


def test_running_median_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(4)
    t = np.arange(0, 5, 0.01)
    y = rng.standard_normal(t.size)
    got = S.running_median(curve(spark, t, y), ["tic_id"], 0.25).orderBy("t").toPandas()["trend"].to_numpy()
    padded = np.pad(y, 12, mode="edge")
    want = np.median(np.lib.stride_tricks.sliding_window_view(padded, 25), axis=1)
    assert np.allclose(got, want)


def test_outliers_leave_dips_alone(spark):
    rng = np.random.default_rng(5)
    t = np.arange(0, 4, 0.01)
    y = 1 + 1e-4 * rng.standard_normal(t.size)
    y[100:112] -= 0.01
    y[[50, 200, 333]] += 0.01
    flags = S.find_outliers(curve(spark, t, y), ["tic_id", "sector"]).orderBy("t").toPandas()["outlier"].to_numpy()
    assert set(np.flatnonzero(flags)) >= {50, 200, 333}
    assert not flags[100:112].any() and flags.sum() < 8


def test_suppression_matches_the_sequential_rule(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 200), "at": rng.uniform(0, 50, 200), "r": rng.uniform(0.1, 2, 200), "s": rng.uniform(size=200)})
    want = []
    for _, g in pdf.groupby("k"):
        kept = []
        for row in g.sort_values("s", ascending=False).itertuples():
            if all(abs(row.at - o.at) >= max(row.r, o.r) for o in kept):
                kept.append(row)
        want += [round(o.s, 12) for o in kept]
    df = spark.createDataFrame(pdf)
    got = S.suppress(df, ["k"], "at", F.col("r"), "s").toPandas()["s"].round(12)
    assert sorted(got) == sorted(want)


def test_dump_runs(spark):
    rows = spark.createDataFrame(
        [(1, 1, int(x * DAY_US), x, 32) for x in (1.0, 1.002, 1.004, 4.0, 4.002)], "tic_id long, sector int, t_us long, t double, quality int")
    assert sorted(round(x.dump_t, 6) for x in Q.momentum_dumps(rows).collect()) == [1.002, 4.001]


def test_edge_dip_is_found_and_covered_dip_is_not(spark):
    t = np.concatenate([np.arange(0, 12, 1 / 144), np.arange(14, 26, 1 / 144)])
    y = 1 + 3e-4 * np.random.default_rng(7).standard_normal(t.size)
    y[(t > 11.9) | ((t > 5) & (t < 5.2))] -= 0.003
    y[t >= 14] = 1 + 3e-4 * np.random.default_rng(8).standard_normal((t >= 14).sum())
    lc = curve(spark, t, y, 3e-4)
    cfg = SearchConfig(min_duration=0.1, max_duration=0.3, duration_ratio=1.5)
    found = H.edge_events(lc, A.curve_stats(lc), cfg).collect()
    assert found and all(abs(e.time - 11.95) < 0.3 for e in found)


def test_known_objects_near_resonance_are_not_matched(spark):
    known = spark.createDataFrame([(1, "TOI", 7, 5.66048, 1461.0, "CP")], "ord int, kind string, tic_id long, period double, t0 double, disposition string")
    cands = spark.createDataFrame(
        [(1, 7, 5.6605, 1463.8, 0.1), (2, 7, 11.38, 1463.1, 0.1), (3, 7, 5.66048 * 2, 1461.0, 0.1), (4, 8, 5.66048, 1461.0, 0.1)],
        "cand_id long, tic_id long, period double, t0 double, duration double")
    got = {m.cand_id: m.ratio for m in C.match_known(cands, known).collect()}
    assert got == {1: 1.0, 3: 2.0}


def test_relations_need_the_phase(spark):
    rows = [(1, 1, 5.0, 100.0, 0.1), (1, 2, 10.0, 105.0, 0.1), (2, 1, 5.0, 100.0, 0.1), (2, 2, 2.5, 102.5, 0.1), (3, 1, 5.0, 100.0, 0.1), (3, 2, 10.0, 107.3, 0.1)]
    df = spark.createDataFrame(rows, "tic_id long, iteration int, period double, t0 double, duration double")
    assert {(x.tic_id, x.harmonic_of) for x in H.harmonic_relations(df).collect()} == {(1, 1), (2, 1)}
    eclipse = spark.createDataFrame(
        [(1, 1, 4.0, 10.0, 0.1, [10.0, 14.0]), (1, 2, 4.0, 12.0, 0.1, [12.0, 16.0])],
        "tic_id long, iteration int, period double, t0 double, duration double, transit_times array<double>")
    got = H.same_period_relations(eclipse).collect()
    assert [(x.secondary_of, round(x.phase_offset, 6)) for x in got] == [(1, 0.5)]


def planet(spark, depth_odd=0.002, depth_even=0.002, secondary=0.0):
    t = np.arange(0, 27, 2 / 1440)
    y = 1 + 3e-4 * np.random.default_rng(9).standard_normal(t.size)
    e = np.round((t - 1.5) / 2.2)
    x = t - 1.5 - e * 2.2
    y -= np.where(np.abs(x) < 0.06, np.where(e % 2 == 1, depth_odd, depth_even), 0.0)
    half = (t - 1.5 - 1.1 + 1.1) % 2.2 - 1.1
    y -= np.where(np.abs(half) < 0.06, secondary, 0.0)
    lc = curve(spark, t, y, 3e-4)
    cands = spark.createDataFrame([(1, 1, 2.2, 1.5, 0.12, 0.04, 8.0, 5700.0)], "cand_id long, tic_id long, period double, t0 double, duration double, rp_rs double, a_rs double, teff double")
    return lc, cands, A.curve_stats(lc)


def test_vetting_statuses(spark):
    cfg = VetConfig()
    lc, cands, curves = planet(spark)
    noise = T.noise_properties(lc, cands, curves)
    assert T.odd_even_test(lc, cands, curves, noise, cfg).first().status == "pass"
    assert T.secondary_eclipse_test(lc, cands, curves, noise, cfg).first().status == "pass"
    assert T.coverage_test(cands, T.transit_coverage(lc, cands, curves), cfg).first().status == "pass"
    shape = T.shape_test(lc, cands, curves, cfg).first()
    assert shape.status == "pass" and shape.statistic < 0.3
    lc, cands, curves = planet(spark, 0.004, 0.002)
    noise = T.noise_properties(lc, cands, curves)
    assert T.odd_even_test(lc, cands, curves, noise, cfg).first().status == "fail"
    lc, cands, curves = planet(spark, secondary=0.0015)
    noise = T.noise_properties(lc, cands, curves)
    assert T.secondary_eclipse_test(lc, cands, curves, noise, cfg).first().status == "fail"


def test_verdicts(spark):
    rows = [(1, "shape", "pass"), (1, "rotation", "n/a"), (2, "shape", "warn"), (3, "shape", "fail"), (4, "density", "n/a")]
    df = spark.createDataFrame([(*x, 1.0) for x in rows], "cand_id long, name string, status string, statistic double")
    got = {x.cand_id: x.verdict for x in T.decide(df).collect()}
    assert got == {1: "planet candidate (passes all tests)", 2: "planet candidate (with caveats)", 3: "likely false positive", 4: "planet candidate (with caveats)"}


def test_screening_tiers(spark):
    sql = ("cand_id long, tic_id long, period double, t0 double, duration double, snr double, sde double, n_transits int, verdict string, tests array<struct<name:string,status:string>>,"
           " chunks struct<n_transits:int,n_chunks:int,chunked_by:string,snr_without_strongest:double,strongest:string,p_value:double>")
    good = (5, 2, "sector", 8.0, "sector 1", 0.5)
    base = [7.0, 1.0, 0.1, 15.0, 12.0, 5, "planet candidate (passes all tests)", [("shape", "pass")], good]
    rows = [(1, 1, *base), (2, 2, *base[:3], 8.0, *base[4:]), (3, 3, *base[:6], "likely false positive", [("shape", "fail")], good), (4, 4, *base), (5, 5, *base[:8], None)]
    entries = spark.createDataFrame(rows, sql)
    known = spark.createDataFrame([(1, "TOI", 4, 7.01, 3.0, "PC")], "ord int, kind string, tic_id long, period double, t0 double, disposition string")
    out = {x.cand_id: x for x in C.screen(entries, C.match_known(entries, known), ScreenConfig()).collect()}
    assert {k: v.tier for k, v in out.items()} == {1: "prospect", 2: "review", 3: "rejected", 4: "known", 5: "review"}
    assert [(r.code, r.value) for r in out[2].reasons] == [("low_snr", 8.0)]
    assert [(r.code, r.detail) for r in out[3].reasons] == [("failed_vetting", "shape")]
    ranked = C.rank_candidates(spark.createDataFrame([(k, v.tier, v.snr) for k, v in out.items()], "cand_id long, tier string, snr double"))
    assert [x.cand_id for x in ranked.orderBy("rank").collect()] == [1, 5, 2, 4, 3]


def test_selection_limits(spark):
    stars = spark.createDataFrame([(1, 9.0, 5000.0, "DWARF"), (2, None, 5000.0, "DWARF"), (3, 9.0, None, "DWARF"), (4, 9.0, 5000.0, "GIANT")], "tic_id long, tmag double, teff double, lumclass string")
    kept = stars.where(C.accepts(Selection(teff_min=4000.0))).collect()
    assert [x.tic_id for x in kept] == [1]


def test_injection_grid_and_partitions(spark):
    star = spark.createDataFrame([(1, 1.0, 1.0, 0.0)], "tic_id long, radius double, mass double, t_min double")
    a = Y.draw_injections(star, Y.log_edges(0.5, 20, 8), Y.log_edges(0.7, 8, 8), 32)
    b = Y.draw_injections(star.repartition(5), Y.log_edges(0.5, 20, 8), Y.log_edges(0.7, 8, 8), 32).repartition(3)
    assert a.count() == 2048
    assert a.exceptAll(b.select(*a.columns)).count() == 0
    cells = a.groupBy("radius_bin", "period_bin").agg(F.min("period").alias("lo"), F.max("period").alias("hi")).collect()
    edges = Y.log_edges(0.5, 20, 8)
    assert all(edges[c.period_bin] <= c.lo and c.hi <= edges[c.period_bin + 1] for c in cells)


def test_injection_match(spark):
    rows = [(2.0, 1.0, 0.1, 2.0, 5.0), (2.0, 1.0, 0.1, 4.0, 3.0), (2.0, 1.0, 0.1, 1.0, 2.0), (2.0, 1.0, 0.1, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "period double, t0 double, duration double, found_period double, found_t0 double")
    assert [x.match for x in Y.match_injection(df).collect()] == ["exact", "alias", "alias", "none"]


def test_many_targets_equal_each_alone(spark):
    t = np.arange(0, 20, 1 / 48)
    parts = [curve(spark, t, 1 - 0.01 * (((t - 1) % p) < 0.15), 1e-3, tic=i) for i, p in enumerate((2.3, 3.1))]
    cfg = SearchConfig(min_duration=0.1, max_duration=0.2, frequency_oversample=1.0)

    def search(lc):
        grid = H.bands(A.extent(lc).select("tic_id", "baseline"), cfg)
        return H.bls(lc, grid, cfg).select("tic_id", "band", "k", F.round("power", 6).alias("power"))

    together = search(parts[0].unionByName(parts[1]).repartition(6))
    alone = search(parts[0]).unionByName(search(parts[1]))
    assert together.exceptAll(alone).count() == 0 and alone.exceptAll(together).count() == 0


def test_near_and_nearest_events(spark):
    rng = np.random.default_rng(10)
    t, ev = np.sort(rng.uniform(0, 30, 500)), np.sort(rng.uniform(-2, 33, 12))
    lc = curve(spark, t, np.ones(500))
    events = spark.createDataFrame([(1, float(x), 0.7) for x in ev], "tic_id long, time double, half double")
    want = np.abs(t[:, None] - ev[None, :])
    assert J.near(lc, events).count() == (want < 0.7).sum()
    assert J.drop_near(lc, events).count() == (want.min(axis=1) >= 0.7).sum()
    got = J.nearest_event(lc, events.select("tic_id", F.col("time").alias("t"))).orderBy("t").toPandas()["distance"]
    assert np.allclose(got, want.min(axis=1))


def test_target_lists_round_trip(spark, tmp_path):
    plain = tmp_path / "ids.txt"
    plain.write_text("TIC 5\n7 # comment\n# nothing\n")
    assert sorted(x.tic_id for x in B.read_targets(spark, str(plain)).collect()) == [5, 7]
    targets = spark.createDataFrame([(3, 9.5, None, 0.8, [1, 2])], "tic_id long, tmag double, teff double, radius double, sectors array<int>")
    B.write_targets(targets, str(tmp_path / "targets"))
    back = B.read_targets(spark, str(tmp_path / "targets")).first()
    assert (back.tic_id, back.tmag, back.teff, back.sectors) == (3, 9.5, None, [1, 2])


def test_truncated_report_counts_as_unreadable(spark, tmp_path):
    folder = tmp_path / "reports"
    folder.mkdir()
    (folder / "a.json").write_text('{"tic_id": 1, "x": 2.0}\n{"tic_id": 2, "x": \n')
    rows = B.read_reports(spark, str(folder), spark.createDataFrame([], "tic_id long, x double").schema)
    assert rows.where("unreadable").count() == 1 and rows.where("NOT unreadable").first().tic_id == 1


def test_stream_takes_each_row_once(spark, tmp_path):
    from dipscan.streaming.ingest import arriving, ingest

    t = np.arange(0, 3, 0.1)
    lc = curve(spark, t, np.ones(t.size))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    lc.write.parquet(source)
    lc.write.mode("append").parquet(source)  # delivered twice

    stream = arriving(spark, source, lc.schema)
    ingest(stream, str(tmp_path / "cp"), out)
    assert spark.read.parquet(out).count() == t.size
    lc.union(curve(spark, t, np.ones(t.size), tic=2)).write.mode("append").parquet(source)
    ingest(stream, str(tmp_path / "cp"), out)
    assert spark.read.parquet(out).count() == 2 * t.size


def test_open_groups_have_the_same_quantiles_and_no_arrays(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    groups = {
        1: [2.0] * 20_000, 2: rng.normal(size=30_000).tolist(), 3: [5.0], 4: [1.0, 9.0], 5: [1.0, 2.0, 4.0, 8.0, 16.0],
        6: [0.0] * 9_999 + [1.0] * 10_001, 7: rng.integers(0, 3, 25_000).astype(float).tolist(),
    }
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k int, x double")
    probs = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 0.99, "e": 1.0}
    out = A.quantiles(df, ["k"], df["x"], probs, bounded=False)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        want = np.quantile(groups[r.k], list(probs.values()))
        assert r.n == len(groups[r.k])
        np.testing.assert_allclose([r.a, r.b, r.c, r.d, r.e], want, rtol=0, atol=1e-12)


def test_more_classes_than_a_hundred(spark):
    rows = [(c, c * 10 + k, float(c * 10 + k)) for c in range(120) for k in range(3)] + [(119, 0, 5000.0)]
    objects = spark.createDataFrame(rows, "class int, tic_id long, toi double").selectExpr(
        "*", "5D AS period", "9D AS tmag", "2000D AS depth_ppm", "1D AS t0", "2D AS duration_hours"
    )
    sectors = objects.selectExpr("tic_id", "array(1, 2) AS sectors").distinct()
    out = C.first_per_class(objects, sectors, 2, 1, 3).collect()
    assert {r["class"] for r in out} == set(range(120)) and len({r.tic_id for r in out}) == len(out) == 240


def test_last_pass_wins_among_edge_events(spark):
    from dipscan.plans.search_run import distinct_events

    rows = [(1, 1, 3.00004, 0.2, 9.0, 9.0), (1, 2, 3.00001, 0.1, 1.0, 1.0), (1, 1, 7.0, 0.3, 2.0, 2.0)]
    events = spark.createDataFrame(rows, "tic_id long, pass int, time double, duration double, depth double, snr double")
    assert sorted((r.time, r.depth) for r in distinct_events(events).collect()) == [(3.00001, 1.0), (7.0, 2.0)]
