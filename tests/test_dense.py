"""Curves with many rows per day: work grows with the rows, results stay those of the plain way."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dipscan.operators import kernels as K
from dipscan.operators import sequence as S
from dipscan.operators import windows


def test_interpolation_looks_at_each_row_once(spark):
    """No frame from a row to its partition's end; rows at the same time as a defined one take its value."""
    t = np.repeat(np.arange(0, 4000, 4), 2) * 1_000_000
    v = np.where(np.arange(t.size) % 2 == 0, t / 1e6, np.nan)
    v[:2], v[-4:], v[500:520] = np.nan, np.nan, np.nan
    pdf = pd.DataFrame({"k": 1, "t_us": t, "v": v}).sample(frac=1, random_state=1)
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    out = S.lerp(df, ["k"], "v", "w")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan
    got = out.toPandas()
    np.testing.assert_allclose(got["w"], np.clip(got["t_us"] / 1e6, 4, 4 * 997), rtol=1e-12)


def curve(kind, n, rng):
    t = np.sort(rng.integers(0, 3 * n, n))
    y = 1 + 1e-4 * (np.round(rng.exponential(50, n), 2) - 50)
    if kind == "outliers":
        y[rng.integers(0, n, 20)] += rng.normal(0, 10, 20)
        y[5] = 1e6
    elif kind == "trend":
        y += 0.05 * np.sin(t / 1500)
    elif kind == "ties":
        y = np.round(y, 3)
    elif kind == "flat":
        y[: n // 2] = 1.0
    return t, y


@pytest.mark.parametrize("method", [m for m in K.METHODS if m != "hodges"])
@pytest.mark.parametrize("kind", ["plain", "outliers", "trend", "ties", "flat"])
def test_dense_windows_are_as_the_plain_way(monkeypatch, method, kind):
    """Windows of hundreds of rows: no pass over each window's rows, the same estimates."""
    t, y = curve(kind, 3000, np.random.default_rng(4))
    monkeypatch.setattr(K, "DENSE", 10**9, raising=False)
    want = K.sliding_location(t[::3], t, y, 900, method, K.TUNING.get(method, 0.0), 3)
    monkeypatch.setattr(K, "DENSE", 256, raising=False)
    calls, plain = [], K._location
    monkeypatch.setattr(K, "_location", lambda *a: calls.append(a[0].shape[0]) or plain(*a))
    got = K.sliding_location(t[::3], t, y, 900, method, K.TUNING.get(method, 0.0), 3)
    np.testing.assert_allclose(got, want, rtol=0, atol=1e-11 if kind == "outliers" else 3e-15)
    if kind != "flat":
        assert not calls


def test_wide_running_median(spark, monkeypatch):
    """A window of more rows than a block: the block widens with it, each row goes to three blocks at most."""
    rng = np.random.default_rng(6)
    n = 3000
    y = rng.normal(size=n)
    pdf = pd.DataFrame({"k": 1, "t": np.arange(n) / 1000.0, "t_us": np.arange(n) * 86_400_000, "flux": y})
    monkeypatch.setattr(S, "BLOCK_ROWS", 64)
    sizes = []
    monkeypatch.setattr(S, "spread", lambda df, *keys: sizes.append(df.count()) or df)
    out = S.running_median(spark.createDataFrame(pdf), ["k"], 0.7).toPandas().sort_values("t_us")
    assert sizes[0] <= 3 * n
    padded = np.r_[np.full(350, y[0]), y, np.full(350, y[-1])]
    want = [np.median(padded[i : i + 701]) for i in range(n)]
    np.testing.assert_array_equal(out["trend"], want)


def clipped_by_hand(t, y, size, cfg):
    """Flags of one gapless curve: median of neighbors, interpolation, robust scatter, until nothing changes."""
    out, passes = np.zeros(y.size, bool), 0
    while True:
        v = y[~out]
        padded = np.r_[np.full(size // 2, v[0]), v, np.full(size // 2, v[-1])]
        trend = np.interp(t, t[~out], [np.median(padded[i : i + size]) for i in range(v.size)])
        resid = y - trend
        mad = np.median(np.abs(resid[~out] - np.median(resid[~out])))
        new = resid > cfg.sigma_upper * 1.4826 * mad
        if cfg.sigma_lower is not None:
            new |= resid < -cfg.sigma_lower * 1.4826 * mad
        passes += 1
        if (new == out).all():
            return out, passes
        out = new


def test_settled_curves_leave_the_clipping(spark, monkeypatch):
    """A pass meets only curves whose flags still change; all flags are those of each curve clipped by itself."""
    rng = np.random.default_rng(3)
    cfg = S.CleaningConfig(clip_window=0.02)
    t = np.arange(400)
    frames, want, passes = [], {}, {}
    for k, tail in enumerate((0, 40, 80, 160)):
        y = 1 + 1e-3 * rng.normal(size=t.size).clip(-2, 2)
        y[rng.choice(t.size, tail, replace=False)] += 0.001 * rng.exponential(3.0, tail)
        want[k], passes[k] = clipped_by_hand(t, y, 29, cfg)
        frames.append(pd.DataFrame({"tic_id": k, "sector": 1, "t": t / 1440.0, "t_us": t * 60_000_000, "flux": y}))
    assert passes[0] == 1 and len(set(passes.values())) > 2
    met, write = {}, S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, label: met.setdefault(label, write(df, label)))
    got = S.find_outliers(spark.createDataFrame(pd.concat(frames)), config=cfg).toPandas().sort_values(["tic_id", "t"])
    assert len(got) == 4 * t.size
    for k, flags in want.items():
        np.testing.assert_array_equal(got["outlier"][got["tic_id"] == k], flags)
    for i in range(max(passes.values())):
        assert {r.tic_id for r in met[f"clip-fit-{i}"].select("tic_id").distinct().collect()} == {k for k, n in passes.items() if n > i}


def test_flags_that_go_round_end(spark):
    """Flags that alternate end the loop with the fewer of the two; passes that are counted run as they are told."""
    cfg = S.CleaningConfig(clip_window=15 / 1440)
    t = np.arange(100)
    y = np.round(1 + 1e-3 * np.random.default_rng(384).exponential(1.0, 100), 4)
    seen = [np.zeros(100, bool)]
    for _ in range(40):
        kept = y[~seen[-1]]
        padded = np.r_[np.full(7, kept[0]), kept, np.full(7, kept[-1])]
        resid = y - np.interp(t, t[~seen[-1]], [np.median(padded[i : i + 15]) for i in range(kept.size)])
        off = resid[~seen[-1]]
        seen.append(resid > 4 * 1.4826 * np.median(np.abs(off - np.median(off))))
    a, b = seen[-2:]
    assert (seen[-3] == b).all() and a.sum() != b.sum()
    flux = spark.createDataFrame(pd.DataFrame({"tic_id": 1, "sector": 1, "t": t / 1440.0, "t_us": t * 60_000_000, "flux": y}))
    got = S.find_outliers(flux, config=cfg).orderBy("t").toPandas()["outlier"]
    np.testing.assert_array_equal(got, min(a, b, key=np.sum))
    two = S.find_outliers(flux, config=cfg, passes=2).orderBy("t").toPandas()["outlier"]
    np.testing.assert_array_equal(two, seen[2])


@pytest.mark.parametrize("kind", ["plain", "outliers", "trend", "ties", "flat"])
def test_dense_hodges_is_as_all_pairs(monkeypatch, kind):
    """Neighboring windows are settled together, to the same numbers, and none goes row by row."""
    t, y = curve(kind, 3000, np.random.default_rng(4))
    t = t + np.where(t > 6000, 5000, 0)
    at = t[::40]
    monkeypatch.setattr(K, "DENSE", 10**9)
    want = K.sliding_location(at, t, y, 900, "hodges", 0.0, 3)
    monkeypatch.setattr(K, "DENSE", 256)
    calls, plain = [], K._location
    monkeypatch.setattr(K, "_location", lambda *a: calls.append(a[0].shape[0]) or plain(*a))
    np.testing.assert_array_equal(K.sliding_location(t, t, y, 900, "hodges", 0.0, 3)[::40], want)
    assert not calls


def plain_hodges(y, lo, hi):
    out = []
    for a, b in zip(lo, hi, strict=True):
        x = y[a:b]
        i, j = np.triu_indices(x.size)
        sums = np.sort(x[i] + x[j])
        out.append(0.25 * (sums[(sums.size + 1) // 2 - 1] + sums[sums.size // 2]))
    return np.array(out)


@pytest.mark.parametrize("kind", ["distinct", "ties", "one", "steps"])
@pytest.mark.parametrize("limits", [(8, 256, 1 << 21, 1 << 15), (0, 0, 1 << 21, 1 << 15), (1, 1, 300, 16)])
def test_hodges_counts_for_all_windows(monkeypatch, kind, limits):
    """Windows of all lengths, some apart and some the same, with many listed sums or none: as sorting all sums of each."""
    rng = np.random.default_rng(8)
    y = {"distinct": rng.normal(size=700), "ties": rng.integers(0, 9, 700) / 7, "one": np.full(700, 0.3),
         "steps": np.round(rng.normal(size=700), 1) + 3 * (np.arange(700) > 300)}[kind]
    lo = np.sort(rng.integers(0, 560, 300))
    hi = np.maximum.accumulate(lo + rng.integers(1, 140, 300))
    for name, value in zip(("PAIRS_PER_ROW", "PAIRS_PER_WINDOW", "MOST_PAIRS", "COARSE"), limits, strict=True):
        monkeypatch.setattr(windows, name, value)
    np.testing.assert_array_equal(windows.hodges(y, lo, hi), plain_hodges(y, lo, hi))


def test_hodges_windows_go_together(monkeypatch):
    """As many windows as one has rows meet a bound at once, and few pairs are listed for each."""
    rng = np.random.default_rng(2)
    y = rng.exponential(size=9000)
    lo = np.arange(5000)
    together, listed = [], []
    count, pairs = windows._Run.count, windows._pairs
    monkeypatch.setattr(windows._Run, "count", lambda run, bound, a, b: together.append(b - a) or count(run, bound, a, b))
    monkeypatch.setattr(windows, "_pairs", lambda a, n: listed.append(n.sum()) or pairs(a, n))
    got = windows.hodges(y, lo, lo + 4000)
    assert max(together) == 4000 and sum(together) < 60 * lo.size and sum(listed) < 1000 * lo.size
    np.testing.assert_array_equal(got[::1250], plain_hodges(y, lo[::1250], lo[::1250] + 4000))
