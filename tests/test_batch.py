"""A batch from cadences to tables: outcomes, repeats, and a clean candidate's tests."""

import numpy as np
import pytest

from dipscan.config import DetrendConfig, SearchConfig
from dipscan.plans import batch
from dipscan.sources import cadences as C
from dipscan.sources import tables as S

SEARCH = SearchConfig(min_period=2.0, max_period=5.0, min_duration=0.15, max_duration=0.3, frequency_oversample=1.5,
                      bin_minutes=30.0, max_signals=1, sde_threshold=4.0)


def curve(tic, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(0, 26.0, 1 / 48) + 1.0
    flux = 1 + 3e-4 * rng.normal(size=t.size)
    if tic == 7:
        flux[np.abs((t - 2.0 + 1.65) % 3.3 - 1.65) < 0.1] -= 0.01
    return [(tic, 1, int(round(x * 86_400_000_000)), float(x), float(y), 3e-4) for x, y in zip(t, flux, strict=True)]


@pytest.fixture(scope="module")
def raw(spark):
    rows = curve(7, 1) + curve(8, 2) + curve(9, 3)[:20]
    return spark.createDataFrame(rows, "tic_id long, sector int, t_us long, t double, flux double, flux_err double")


def test_outcomes_tables_and_repeats(spark, raw, tmp_path):
    folder = str(tmp_path / "batch")
    targets = spark.createDataFrame([(7,), (8,), (9,), (10,)], "tic_id long")
    rho = 1.41 * 0.35
    samples = spark.createDataFrame(
        [(7, 1, float(rho * (1 + 0.05 * np.sin(k))), 0.2, 0.1) for k in range(200)], "tic_id long, iteration int, rho double, b double, rp_rs double"
    )
    stellar = spark.createDataFrame([(7, rho, 0.1, 1.0, 5800.0)], "tic_id long, rho_cat double, rho_cat_err double, radius double, teff double")
    options = {"search": SEARCH, "detrending": DetrendConfig(window_length=2.0), "samples": samples, "stellar": stellar}
    got = {r.tic_id: r.status for r in batch.run_batch(targets, raw, folder, **options).collect()}
    assert got == {7: "searched", 8: "searched", 9: "no data", 10: "no data"}
    assert batch.run_batch(targets, raw, folder, **options).collect() == []
    stars, candidates = batch.write_tables(spark, folder)
    stars = {r.tic_id: r for r in stars.collect()}
    assert set(stars) == {7, 8, 9, 10}
    assert stars[7].top_period == pytest.approx(3.3, rel=2e-3) and stars[7].n_candidates == 1
    rows = candidates.collect()
    assert [r.tic_id for r in rows] == [7]
    tests = {x.name: x.status for x in rows[0].tests}
    assert tests["density"] != "n/a" and tests["radius"] != "n/a"


def test_store_adds_missing_sectors(spark, raw, tmp_path):
    one = raw.where("tic_id = 7").selectExpr("*", "0 AS quality")
    both = one.union(one.selectExpr("tic_id", "2 AS sector", "t_us + 3000000000000 AS t_us", "t + 34.72D AS t", "flux", "flux_err", "quality"))
    path = str(tmp_path / "store")
    assert {r.sector for r in C.store_missing(one, path).select("sector").distinct().collect()} == {1}
    again = C.store_missing(both, path)
    assert {r.sector: r["count"] for r in again.groupBy("sector").count().collect()}.keys() == {1, 2}
    before = again.count()
    assert C.store_missing(both, path).count() == before


def test_scans_turn_nan_into_null(spark, tmp_path):
    spark.createDataFrame([(1, float("nan")), (2, 1.5)], "tic_id long, flux double").write.parquet(f"{tmp_path}/raw")
    assert sorted(map(tuple, C.scan(spark, f"{tmp_path}/raw").collect())) == [(1, None), (2, 1.5)]


def test_results_keep_their_types(spark, tmp_path):
    columns = [f.name for f in S.RESULTS.fields]
    values = {"index": 3, "period": 2.5, "recovered": True, "match": "exact", "depth": None}
    row = spark.createDataFrame([tuple(values.get(c) for c in columns)], S.RESULTS)
    S.append_results(row, f"{tmp_path}/results")
    back = S.read_results(spark, f"{tmp_path}/results").collect()[0]
    assert (back["index"], back.period, back.recovered, back.match, back.b) == (3, 2.5, True, "exact", None)
