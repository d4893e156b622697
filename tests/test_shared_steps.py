"""Steps that many queries share: candidates of observed stars, value buckets."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from dipscan.operators import pixels, quiet, search, stats
from dipscan.plans import views as V

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_candidates_are_listed_once(spark):
    """The candidates are kept, so a query that uses them often doesn't read the catalog each time."""
    got = V.cands(spark, FOLDER)
    assert not any(name in f for f in got.inputFiles() for name in ("lineitem", "orders", "events"))
    base = V.planted(spark, FOLDER)
    listed = V.signals(spark, FOLDER).join(base.select("tic_id"), "tic_id", "left_semi").select(*base.columns)
    assert sorted(got.collect()) == sorted(base.unionByName(listed).collect())


def test_buckets_by_stretches(spark, monkeypatch):
    """A value's bucket is the number of bounds up to it, however the bounds are cut."""
    rng = np.random.default_rng(4)
    rows = [(k, float(v)) for k, n in ((1, 900), (2, 40)) for v in rng.integers(0, 300, n)] + [(1, None), (1, -5.0), (2, 1e9)]
    df = spark.createDataFrame(rows, "k int, v double")
    for stretch in (quiet.STRETCH, 1, 7):
        monkeypatch.setattr(quiet, "STRETCH", stretch)
        index = quiet.ValueIndex(df, "v", "k", 200)
        grid = {r.k: np.array(r._grid_v) for r in index.grid.collect()}
        assert max(map(len, grid.values())) > 100
        for r in index.placed(df).collect():
            assert r.v_bucket == (0 if r.v is None else np.searchsorted(grid[r.k], r.v, side="right"))


def test_open_groups_are_read_once(spark, monkeypatch):
    """Quantiles of open groups: the rows are derived once, and the sketch's size on disk is known to the join."""
    rng = np.random.default_rng(9)
    values = {1: rng.normal(size=5000).round(2), 2: rng.normal(size=7)}
    df = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x], "k int, v double")
    labels, write = [], stats.materialize
    monkeypatch.setattr(stats, "materialize", lambda df, label: labels.append(label) or write(df, label))
    probs = {"low": 0.0, "mid": 0.5, "p99": 0.99, "high": 1.0}
    got = stats.quantiles(df, ["k"], F.col("v"), probs, bounded=False)
    assert labels == ["ranked", "sketch"]
    for r in got.collect():
        x = values[r.k]
        assert r.n == len(x)
        assert [r[c] for c in probs] == pytest.approx([np.quantile(x, p) for p in probs.values()], abs=1e-12)


def test_harmonics_meet_once(spark, monkeypatch):
    """The longer period meets the shorter one, in either order: ten copies of a signal, not nineteen; as all pairs say."""
    rng = np.random.default_rng(2)
    asked, pairs = [], search.ratio_pairs
    monkeypatch.setattr(search, "ratio_pairs", lambda a, b, ratios, *more: asked.append(ratios) or pairs(a, b, ratios, *more))
    base = rng.uniform(0.5, 3.0, 8)
    rows = [(int(i % 3), i, float(base[i % 8] * f), float(rng.uniform(0, 2)), 0.4)
            for i, f in enumerate(rng.choice([1.0, 2.0, 0.5, 3.0, 7.001, 10.0, 1.001, 0.1], 120))]
    got = {(r.tic_id, r.iteration): r.harmonic_of for r in search.harmonic_relations(
        spark.createDataFrame(rows, "tic_id int, iteration int, period double, t0 double, duration double")).collect()}
    assert len(asked[0]) == 10
    want = {}
    for tic, i, p, t, d in rows:
        for tic2, j, q, u, e in rows:
            if tic != tic2 or j >= i:
                continue
            low = min(p, q)
            near = any(1 <= np.rint(x) <= 10 and abs(x - np.rint(x)) < 0.002 * np.rint(x) for x in (p / q, 1.0 / (p / q)))
            if near and abs((t - u + low / 2) % low - low / 2) < max(d, e):
                want[tic, i] = min(want.get((tic, i), j), j)
    assert got == want and len(want) > 10


def test_a_small_cone_search_is_spread(spark):
    """Few bytes make many pairs: the targets are spread over all tasks however small their table."""
    stars = spark.range(300).coalesce(1).selectExpr(
        "id AS tic_id", "id % 20 / 2.0D AS ra", "id % 7 / 2.0D AS dec", "10.0D AS tmag", "CAST(NULL AS DOUBLE) AS pmra", "CAST(NULL AS DOUBLE) AS pmdec")
    targets = stars.withColumnRenamed("tic_id", "target_id").withColumn("t", F.lit(1500.0))
    got = pixels.cone_search(targets, stars, 7200.0)
    rows = stars.collect()
    want = {(a.tic_id, b.tic_id) for a in rows for b in rows
            if np.hypot(((b.ra - a.ra + 180) % 360 - 180) * np.cos(np.radians(a.dec)) * 3600, (b.dec - a.dec) * 3600) <= 7200.0}
    assert {(r.target_id, r.tic_id) for r in got.collect()} == want
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_refined_peaks_are_kept_first(spark):
    """Conditions on a peak's trial arrays are met by the peaks, not by the curve's rows they were derived from."""
    t = np.arange(0, 20, 0.02)
    flux = 1 - 0.01 * (np.abs((t - 1.0 + 1.5) % 3.0 - 1.5) < 0.1) + 1e-4 * np.sin(100 * t)
    lc = spark.createDataFrame([(1, 1, float(x), int(x * 86_400_000_000), float(y), 1e-3) for x, y in zip(t, flux, strict=True)],
                               "tic_id long, sector int, t double, t_us long, flux double, flux_err double")
    peaks = lc.select("tic_id").distinct().selectExpr(
        "tic_id", "tic_id AS cand_id", "3.003D * tic_id AS period", "0.18D AS duration", "0.001D AS grid_step")
    out = search.refine(lc, peaks, search.SearchConfig(), stats.curve_stats(lc))
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    met = [lines[i + 1] for i, line in enumerate(lines) if "Filter" in line and "array_min" in line]
    assert met and all("parquet" in line for line in met)
    assert out.first().period == pytest.approx(3.0, abs=0.01)  # six dips of 0.2 days tell no better
