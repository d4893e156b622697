"""The in-task helpers against brute force."""

import numpy as np
import pytest

from dipscan.operators import kernels as K


def test_box_power_matches_brute_force():
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 20, 150))
    y = 1 + 0.01 * rng.standard_normal(150)
    err = rng.uniform(0.005, 0.02, 150)
    periods, durations, over = np.array([1.7, 3.3, 6.1]), np.array([0.2, 0.31]), 4
    got = K.box_power(t, y, err, periods, durations, over)
    w, step = 1 / err**2, 0.2 / over
    for i, p in enumerate(periods):
        n = int(np.ceil(p / step))
        cell = np.minimum((((t - t[0]) % p) / step).astype(int), n - 1)
        best = 0.0
        for span in np.rint(durations / step).astype(int):
            for first in range(n):
                inside = ((cell - first) % n) < span
                if 0 < inside.sum() < t.size:
                    a, b = w[inside], w[~inside]
                    depth = (b * y[~inside]).sum() / b.sum() - (a * y[inside]).sum() / a.sum()
                    if depth > 0:
                        best = max(best, 0.5 * depth**2 / (1 / a.sum() + 1 / b.sum()))
        assert got["power"][i] == pytest.approx(best, rel=1e-9)


def test_box_power_finds_a_planted_dip():
    t = np.arange(0, 27, 1 / 144)
    y = np.where((t - 1.0) % 3.3 < 0.12, 0.998, 1.0)
    periods = np.exp(np.linspace(np.log(1.0), np.log(8.0), 3000))
    out = K.box_power(t, y, np.full(t.size, 2e-4), periods, np.array([0.1, 0.12, 0.15]), 10)
    best = out["power"].argmax()
    assert periods[best] == pytest.approx(3.3, rel=1e-3)
    assert out["depth"][best] == pytest.approx(0.002, rel=0.15)


@pytest.mark.parametrize("method", K.METHODS)
def test_sliding_location_of_a_constant(method):
    t = np.arange(0, 5000, 10)
    y = np.full(t.size, 1.25)
    out = K.sliding_location(t, t, y, 200, method, K.TUNING.get(method, 0.0), 5)
    assert np.allclose(out, 1.25)


def test_biweight_ignores_outliers():
    rng = np.random.default_rng(2)
    t = np.arange(1000)
    y = 1 + 1e-3 * rng.standard_normal(1000)
    y[::25] = 3.0
    out = K.sliding_location(t, t, y, 100, "biweight", 5.0, 10)
    assert np.abs(out - 1).max() < 1e-3


def test_sine_power_of_a_sinusoid_is_one():
    t = np.sort(np.random.default_rng(3).uniform(0, 10, 300))
    power, amplitude = K.sine_power(t, 1 + 0.02 * np.sin(2 * np.pi * t / 1.6), np.array([1 / 1.6, 0.9]))
    assert power[0] == pytest.approx(1.0, abs=1e-9)
    assert amplitude[0] == pytest.approx(0.02, rel=1e-6)
    assert power[1] < 0.5


def test_trapezoid_fit_recovers_its_shape():
    x = np.linspace(-0.2, 0.2, 120)
    y = 1 - 0.01 * K.trapezoid_shape(x - 0.004, 0.12, 0.3)
    got = K.fit_trapezoid(x, y, np.full(x.size, 5.0), 0.1)
    assert got["t14"] == pytest.approx(0.12, rel=0.02)
    assert got["ingress_fraction"] == pytest.approx(0.3, abs=0.03)
    assert got["tc"] == pytest.approx(0.004, abs=5e-4)


def test_shift_fit_recovers_a_late_dip():
    dt = np.linspace(-0.15, 0.15, 200)
    f = 1 - 0.01 * K.trapezoid_shape(dt - 0.007, 0.1, 0.2)
    one = [np.array([x]) for x in (dt.size, 0.1, 0.01, 0.2)]
    (shift,), (err,) = K.fit_shifts(dt, f, np.full(dt.size, 1e8), *one)
    assert shift == pytest.approx(0.007, abs=1e-4)
    assert err > 0


@pytest.mark.parametrize("digits", [12, 3, 0])
def test_hodges_matches_all_pairs(digits):
    """Also with many ties, empty windows, one value and values around zero."""
    rng = np.random.default_rng(digits)
    n = np.r_[0, 1, 2, 3, rng.integers(4, 60, 40)]
    rows = np.full((n.size, 60), np.inf)
    for i, k in enumerate(n):
        rows[i, :k] = np.sort(np.round(rng.standard_normal(k), digits))
    rows[5, : n[5]] = 0.25
    got = K._hodges(rows, n)
    assert np.isnan(got[0])
    for i, k in enumerate(n[1:], 1):
        a, b = np.triu_indices(k)
        assert got[i] == np.median(0.5 * (rows[i, a] + rows[i, b]))


def test_hodges_of_a_long_window():
    x = np.sort(np.random.default_rng(2).standard_normal((3, 1501)), axis=1)
    got = K._hodges(x, np.full(3, 1501))
    a, b = np.triu_indices(1501)
    assert got.tolist() == [np.median(0.5 * (r[a] + r[b])) for r in x]


def test_fourier_power_equals_direct_sums():
    rng = np.random.default_rng(4)
    t = np.sort(np.r_[rng.uniform(0, 9, 700), rng.uniform(17, 25, 500)])
    y = 0.01 * np.sin(2 * np.pi * t / 0.11) + 0.004 * rng.standard_normal(t.size)
    rel, base, shortest = t - t[0], t[-1] - t[0], 0.05
    n_cells = int(np.ceil(10 * base / (shortest / 2)))
    width = 10 * base / n_cells
    cell = np.floor(rel / width).astype(int)
    d = (rel - (cell + 0.5) * width) / (0.5 * width)
    cells, back = np.unique(cell, return_inverse=True)
    yc = y - y.mean()
    moments = np.stack([np.bincount(back, yc * d**k) for k in range(K.ORDERS[0])], axis=1)
    plain = np.stack([np.bincount(back, d**k) for k in range(K.ORDERS[1])], axis=1)
    grid = (1 / 0.6, 1 / (10 * base), 1 + int(round((1 / shortest - 1 / 0.6) * 10 * base)))
    power, amplitude = K.fourier_power(cells, moments, plain, width, n_cells, grid, t.size, yc.var())
    slow = K.sine_power(t, y, grid[0] + grid[1] * np.arange(grid[2]))
    assert np.abs(power - slow[0]).max() < 1e-7
    assert amplitude == pytest.approx(slow[1], rel=1e-6, abs=1e-9)
    assert 1 / (grid[0] + grid[1] * power.argmax()) == pytest.approx(0.11, rel=1e-3)


def test_shifts_of_many_dips_match_a_fine_grid():
    rng = np.random.default_rng(6)
    n, true = np.array([60, 5, 90, 40]), np.array([0.021, 0.0, -0.034, 0.008])
    duration, depth, ingress = np.array([0.2, 0.2, 0.3, 0.1]), np.full(4, 0.01), np.array([0.3, 0.3, 0.6, 0.2])
    dt = [np.sort(rng.uniform(-1.5, 1.5, k)) * d for k, d in zip(n, duration, strict=True)]
    f = [
        1 - d * K.trapezoid_shape(x - s, w, i) + 3e-4 * rng.standard_normal(x.size)
        for x, s, w, d, i in zip(dt, true, duration, depth, ingress, strict=True)
    ]
    weight = np.full(n.sum(), 1 / 3e-4**2)
    got, err = K.fit_shifts(np.concatenate(dt), np.concatenate(f), weight, np.cumsum(n), duration, depth, ingress)
    assert np.isnan(err[1]) and np.isfinite(err[[0, 2, 3]]).all()
    for k in (0, 2, 3):
        def cost(shift, k=k):
            m = 1 - depth[k] * K.trapezoid_shape(dt[k] - shift, duration[k], ingress[k])
            level = (f[k] * m).sum() / (m * m).sum()
            return ((f[k] - level * m) ** 2).sum()

        fine = np.linspace(-duration[k] / 2, duration[k] / 2, 20001)
        best = min(map(cost, fine))
        assert cost(got[k]) <= best * (1 + 1e-6)
        assert abs(got[k] - true[k]) < 5 * err[k]
