"""Scatter away from dips by searches: the numbers of looking at every row, and no row met by a candidate."""

import numpy as np
import pandas as pd
import pytest

from dipscan.operators import search as H
from dipscan.operators import vetting as T
from dipscan.operators.dipless import Curve
from dipscan.operators.stats import curve_stats


def by_rows(t_us, flux, p, t0, d, phases, closed, reach=1.0):
    t = t_us / 86400e6
    keep = np.ones(t.size, bool)
    for phase in phases:
        x = t - (t0 + phase * p if phase else t0) + 0.5 * p
        off = np.abs(x - p * np.floor(x / p) - 0.5 * p)
        keep &= (off > reach * d) if closed else (off >= reach * d)
    t, f, step = t[keep], flux[keep], np.median(np.diff(t_us[keep])) / 86400e6
    sigma = 1.4826 * np.median(np.abs(f - np.median(f)))
    j = np.floor((t - t[0]) / d).astype(int)
    n, total = np.bincount(j), np.bincount(j, f - flux.mean())
    some = (n >= 0.5 * max(d / step, 1)) & (n > 0)
    means = total[some] / n[some]
    return sigma, 1.4826 * np.median(np.abs(means - np.median(means))) if means.size >= 3 else np.nan


def draw(n, digits, count, seed=3):
    rng = np.random.default_rng(seed)
    t_us = np.sort(rng.integers(0, 30 * 86400 * 10**6, n))
    t_us[5:9] = t_us[5]
    flux = np.round(1 + 0.005 * rng.random(n), digits)
    p, d = 0.5 + rng.integers(0, 400, count) / 20, np.sort(0.05 + rng.integers(0, 11, count) / 100)
    t0 = rng.integers(1, 1001, count) / 50
    t0[:20] = t_us[rng.integers(0, n, 20)] / 86400e6 + d[:20]  # rows at the very border
    return t_us, flux, p, t0, d


@pytest.mark.parametrize("digits", [12, 6, 2])
@pytest.mark.parametrize(("phases", "closed", "reach"), [((0.0,), False, 1.0), ((0.0, 0.5), True, 1.0), ((0.0,), True, 0.5)])
def test_scatter_is_that_of_the_rows_left(digits, phases, closed, reach):
    t_us, flux, p, t0, d = draw(4000, digits, 80)
    curve = Curve(t_us, t_us / 86400e6, flux, True)
    settled, _, sigma, binned = curve.scatter(p, t0, d, phases, closed, True, 100, reach)
    assert settled.sum() > 70
    for i in np.flatnonzero(settled):
        want = by_rows(t_us, flux, p[i], t0[i], d[i], phases, closed, reach)
        np.testing.assert_allclose((sigma[i], binned[i]), want, rtol=0, atol=1e-13)


def frames(spark):
    t_us, flux, p, t0, d = draw(4000, 6, 60)
    lc = spark.createDataFrame(pd.DataFrame({"tic_id": 1, "sector": 1, "t_us": t_us, "t": t_us / 86400e6, "flux": flux}))
    table = pd.DataFrame({"cand_id": np.arange(60), "tic_id": 1, "period": p, "t0": t0, "duration": d, "depth": 0.01, "n_transits": 3})
    return lc, spark.createDataFrame(table[2.002 * table.duration < table.period]), (t_us, flux, p, t0, d)


def refuse(*_args, **_kwargs):
    raise AssertionError("a candidate met its rows")


def test_red_noise_meets_no_rows(spark, monkeypatch):
    lc, cands, (t_us, flux, p, t0, d) = frames(spark)
    monkeypatch.setattr(H, "QuietCurves", refuse)
    got = H.red_noise_snr(lc, cands).toPandas()
    assert len(got) == cands.count()
    for r in got.itertuples():
        i = r.cand_id
        _, binned = by_rows(t_us, flux, p[i], t0[i], d[i], (0.0,), False)
        assert r.snr == pytest.approx(0.01 / (binned / 3**0.5), rel=1e-9)


def test_rows_are_met_where_curves_are_too_long(spark, monkeypatch):
    from dipscan.operators import dipless

    lc, cands, _ = frames(spark)
    want = H.red_noise_snr(lc, cands).toPandas().set_index("cand_id")["snr"].sort_index()
    monkeypatch.setattr(dipless, "CURVE_ROWS", 100)
    got = H.red_noise_snr(lc, cands).toPandas().set_index("cand_id")["snr"].sort_index()
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_noise_meets_no_rows(spark, monkeypatch):
    """Where dips at both phases leave under 100 rows, those outside the dip count: by the same searches."""
    lc, cands, (t_us, flux, p, t0, d) = frames(spark)
    p[-1], d[-1] = 0.5, 0.15
    last = pd.DataFrame([(59, 1, 0.5, t0[-1], 0.15, 0.01, 3)], columns=cands.columns)
    cands = cands.where("cand_id < 59").unionByName(spark.createDataFrame(last))
    monkeypatch.setattr(T, "QuietCurves", refuse)
    got = T.noise_properties(lc, cands, curve_stats(lc)).toPandas().set_index("cand_id")
    assert len(got) == cands.count()
    for i in got.index:
        rule = ((0.0,), True, 0.5) if i == 59 else ((0.0, 0.5), True)
        assert got.loc[i, "sigma"] == pytest.approx(by_rows(t_us, flux, p[i], t0[i], d[i], *rule)[0], rel=1e-12)


def test_no_candidate_is_settled():
    t_us, flux, p, t0, d = draw(40, 6, 30)
    settled, few, *_ = Curve(t_us, t_us / 86400e6, flux, True).scatter(p, t0, d, (0.0,), True, True, 100)
    assert few.all() and not settled.any()


@pytest.mark.parametrize("digits", [12, 5, 2])
@pytest.mark.parametrize("shares", [(1 / 256, 1 / 32), (1 / 4000, 1 / 40), (0.49,)])
def test_bands_give_what_all_places_give(monkeypatch, digits, shares):
    """Answers are looked for in narrow bands of values first; those beyond them meet all places."""
    from dipscan.operators import dipless

    t_us, flux, p, t0, d = draw(20000, digits, 80, seed=5)
    flux[(t_us // 86400e6) % 4 == 1] -= 0.001  # some candidates take most of these
    monkeypatch.setattr(dipless, "BANDS", shares)
    monkeypatch.setattr(dipless, "BAND_ROWS", 1 << 60)
    whole = Curve(t_us, t_us / 86400e6, flux, True).scatter(p, t0, d, (0.0, 0.5), True, True, 100)
    met = []
    monkeypatch.setattr(dipless, "BAND_ROWS", 1 << 13)
    rows = dipless._Band.rows
    monkeypatch.setattr(dipless._Band, "rows", lambda band, *part: met.append(band) or rows(band, *part))
    for listed in (256, 0):
        monkeypatch.setattr(dipless, "LISTED", listed)
        banded = Curve(t_us, t_us / 86400e6, flux, True).scatter(p, t0, d, (0.0, 0.5), True, True, 100)
        for a, b in zip(banded, whole, strict=True):
            np.testing.assert_array_equal(a, b)
    assert met
    for i in np.flatnonzero(whole[0])[::9]:
        np.testing.assert_allclose((whole[2][i], whole[3][i]), by_rows(t_us, flux, p[i], t0[i], d[i], (0.0, 0.5), True), rtol=0, atol=1e-13)


def test_candidates_of_one_duration_share_their_bins(monkeypatch):
    """Bin edges are looked up once for candidates with one first row and duration, not for each candidate."""
    t_us, flux, p, t0, d = draw(4000, 12, 80)
    curve, asked = Curve(t_us, t_us / 86400e6, flux, True), []
    edges = Curve._edges
    monkeypatch.setattr(Curve, "_edges", lambda self, x0, *more: asked.append(x0.size) or edges(self, x0, *more))
    settled, *_ = curve.scatter(p, t0, d, (0.0,), False, False, 0)
    assert settled.sum() > 70 and sum(asked) < 40
