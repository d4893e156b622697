"""NumPy helpers that run inside Spark tasks on one bounded block of rows."""

from __future__ import annotations

import numpy as np

from .windows import Ranked, locations

# Usual tuning constants of the sliding estimators.
TUNING = {
    "biweight": 5.0,
    "hampelfilt": 3.0,
    "huber_psi": 1.5,
    "welsch": 2.11,
    "andrewsinewave": 1.339,
    "tau": 4.5,
    "trim_mean": 0.1,
    "winsorize": 0.1,
}
METHODS = (*TUNING, "mean", "median", "hodges")
#: Orders of the cell moments of values and of plain counts: beyond them, terms of the series are under 1e-9
#: where a cell is at most half the shortest period (pi/2 and, for twice the frequency, pi to a half cell).
ORDERS = (16, 22)


#: Windows of more rows than this, on average, are not looked at one by one.
DENSE = 256
#: Cells of one group of windows that are.
WINDOW_CELLS = 1 << 21


def centered_median(values: np.ndarray, size: int) -> np.ndarray:
    """Medians of every window of ``size`` (odd) consecutive values."""
    if size > DENSE:
        first = np.arange(values.size - size + 1)
        return Ranked(values).kth(first, first + size, np.full(first.size, size // 2))
    view = np.lib.stride_tricks.sliding_window_view(values, size)
    return np.median(view, axis=1)


def _middle(ordered: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of each row's first ``n`` sorted entries."""
    rows = np.arange(len(n))
    return 0.5 * (ordered[rows, np.maximum(n - 1, 0) // 2] + ordered[rows, np.maximum(n, 1) // 2])


def sliding_location(
    at: np.ndarray, t: np.ndarray, y: np.ndarray, half: int, method: str, cval: float, passes: int
) -> np.ndarray:
    """Location of ``y`` within ``half`` of each time in ``at``; NaN where a window is empty."""
    out = np.full(at.size, np.nan)
    lo = np.searchsorted(t, at - half, side="left")
    hi = np.searchsorted(t, at + half, side="right")
    todo = np.flatnonzero(hi > lo)
    dense = todo.size and (hi - lo)[todo].mean() > DENSE
    if dense and np.isfinite(y).all():
        # rows of the same window share its estimate
        first = np.r_[True, (np.diff(lo[todo]) > 0) | (np.diff(hi[todo]) > 0)]
        once, which = todo[first], np.cumsum(first) - 1
        out[todo] = locations(y, lo[once], hi[once], method, cval, passes)[which]
        todo = todo[np.isnan(out[todo])]
    start = 0
    while start < todo.size:
        widest = np.maximum.accumulate((hi - lo)[todo[start : start + 512]])
        fit = int((widest * np.arange(1, widest.size + 1) <= WINDOW_CELLS).sum())
        part = todo[start : start + max(fit, 1)]
        n = hi[part] - lo[part]
        pos = lo[part, None] + np.arange(n.max())
        inside = pos < hi[part, None]
        v = np.where(inside, y[np.minimum(pos, t.size - 1)], np.nan)
        out[part] = _location(v, inside, n, method, cval, passes)
        start += part.size
    return out


def _location(
    v: np.ndarray, inside: np.ndarray, n: np.ndarray, method: str, c: float, passes: int
) -> np.ndarray:
    filled = np.where(inside, v, 0.0)
    if method == "mean":
        return filled.sum(axis=1) / np.maximum(n, 1)
    ordered = np.sort(np.where(inside, v, np.inf), axis=1)
    med = np.where(n > 0, _middle(ordered, n), 0.0)
    if method == "median":
        return med
    rows, place = np.arange(n.size), np.arange(v.shape[1])
    if method in ("trim_mean", "winsorize"):
        cut = (c * n).astype(int)
        core = (place >= cut[:, None]) & (place < (n - cut)[:, None])
        if method == "trim_mean":
            return np.where(core, ordered, 0.0).sum(axis=1) / np.maximum(core.sum(axis=1), 1)
        low = ordered[rows, cut][:, None]
        high = ordered[rows, np.maximum(n - 1 - cut, 0)][:, None]
        return np.where(inside, np.clip(v, low, high), 0.0).sum(axis=1) / np.maximum(n, 1)
    if method == "hodges":
        return _hodges(ordered, n)
    mad = _middle(np.sort(np.where(inside, np.abs(v - med[:, None]), np.inf), axis=1), n)
    if method == "hampelfilt":
        far = np.abs(v - med[:, None]) > c * 1.4826 * mad[:, None]
        kept = np.where(far, med[:, None], v)
        return np.where(inside, kept, 0.0).sum(axis=1) / np.maximum(n, 1)
    scale = mad if method in ("biweight", "tau") else 1.4826 * mad
    safe = np.where(scale > 0, scale, 1.0)
    centre, todo = med.copy(), rows
    for _ in range(1 if method == "tau" else passes):
        ins, at, s = inside[todo], centre[todo], safe[todo]
        u = np.where(ins, (v[todo] - at[:, None]) / (c * s[:, None]), np.inf)
        if method in ("biweight", "tau"):
            w = np.where(np.abs(u) < 1, (1 - np.minimum(u * u, 1.0)) ** 2, 0.0)
        elif method == "huber_psi":
            w = np.where(ins, 1.0 / np.maximum(np.abs(u), 1.0), 0.0)
        elif method == "welsch":
            w = np.where(ins, np.exp(-np.minimum(u * u, 700.0)), 0.0)
        else:  # Andrews' sine
            w = np.where(np.abs(u) <= np.pi, np.sinc(np.minimum(np.abs(u), np.pi) / np.pi), 0.0)
        total = w.sum(axis=1)
        step = (w * filled[todo]).sum(axis=1) / np.where(total > 0, total, 1.0)
        moved = np.where((scale[todo] > 0) & (total > 0), step, at)
        centre[todo] = moved
        todo = todo[np.abs(moved - at) > 1e-9 * s]  # each row stops by itself
        if not todo.size:
            break
    return centre


def _hodges(ordered: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of the means of all pairs (a value with itself included) of each row's first ``n``.

    Sums ``x[i] + x[j]``, i <= j, rise along both axes, so the pairs up to a bound are counted by one
    binary search per ``i``. The bracket around the wanted rank is halved for all rows at once; its ends
    are always sums of the row, and searches stay within what the bracket leaves of each ``i``.
    """
    out = np.full(n.size, np.nan)
    at = np.flatnonzero(n > 0)
    place = np.arange(ordered.shape[1])

    def pair(x: np.ndarray, j: np.ndarray) -> np.ndarray:
        return x + np.take_along_axis(x, np.clip(j, 0, place.size - 1), axis=1)

    x, size = ordered[at], n[at, None]
    start = np.minimum(place, size)
    total = (size * (size + 1) // 2)[:, 0]
    rank = (total + 1) // 2
    below, above = start.copy(), np.where(place < size, size, start)  # first partner beyond each end
    high = 2.0 * np.take_along_axis(x, size - 1, axis=1)[:, 0]
    while at.size:
        low = np.where(below < above, pair(x, below), np.inf).min(axis=1)
        done = low >= high
        if done.any():
            upto = (above - start)[done].sum(axis=1)
            beyond = np.where(above[done] < size[done], pair(x[done], above[done]), np.inf).min(axis=1)
            upper = np.where((total[done] % 2 == 0) & (upto == rank[done]), beyond, high[done])
            out[at[done]] = 0.25 * (high[done] + upper)
            left = ~done
            at, x, size, start, below, above = (a[left] for a in (at, x, size, start, below, above))
            total, rank, low, high = (a[left] for a in (total, rank, low, high))
            continue
        mid = low + 0.5 * (high - low)
        mid = np.where(mid < high, mid, low)
        lo, hi = below.copy(), above.copy()
        while (active := lo < hi).any():
            j = (lo + hi) >> 1
            within = pair(x, j) <= mid[:, None]
            lo = np.where(active & within, j + 1, lo)
            hi = np.where(active & ~within, j, hi)
        enough = (lo - start).sum(axis=1) >= rank
        top = np.where(lo > start, pair(x, lo - 1), -np.inf).max(axis=1)
        high = np.where(enough, top, high)
        above = np.where(enough[:, None], lo, above)
        below = np.where(enough[:, None], below, lo)
    return out


def box_power(
    t: np.ndarray,
    y: np.ndarray,
    err: np.ndarray,
    periods: np.ndarray,
    durations: np.ndarray,
    oversample: int,
    standard: bool = True,
) -> dict[str, np.ndarray]:
    """Best box of any duration and phase at every trial period.

    Phase is cut into bins a fraction of the shortest duration wide; box sums come from
    running totals over the bins, with the first ones repeated so that boxes wrap.
    """
    names = ("power", "depth", "depth_err", "duration", "t0", "depth_snr")
    out = {k: np.zeros(periods.size) for k in names}
    if not t.size or not periods.size:
        return out
    t_ref = t.min()
    w = 1.0 / err**2
    total = w.sum()
    centred = w * (y - (w * y).sum() / total)  # sums to zero, so a box is its own contrast
    step = durations.min() / oversample
    spans = np.maximum(np.rint(durations / step).astype(int), 1)
    longest = int(spans.max())
    bins = np.ceil(periods / step).astype(int)
    rel = t - t_ref
    start = 0
    while start < periods.size:  # groups small enough for a processor's cache
        size = max(1, int(CACHE_CELLS // (bins[start] + longest + t.size // 8)))
        part = slice(start, start + size)
        p, nb = periods[part], bins[part]
        sums = _running_sums(rel, (w, centred), p, nb, step, longest)
        power, first, span, bw, by = _best_boxes(*sums, nb, spans, total, standard)
        found = power > 0
        bw = np.where(found, bw, 0.5 * total)
        depth = np.where(found, -by * total / (bw * (total - bw)), 0.0)
        depth_err = np.sqrt(1.0 / bw + 1.0 / (total - bw))
        middle = (first + 0.5 * span) * step
        values = (
            0.5 * power, depth, depth_err, span * step,
            t_ref + middle - p * np.floor(middle / p), depth / depth_err,
        )
        for name, value in zip(names, values, strict=True):
            out[name][part] = value
        start += size
    return out


CACHE_CELLS = 100_000


def _running_sums(
    rel: np.ndarray, weights: tuple[np.ndarray, ...], p: np.ndarray, nb: np.ndarray, step: float, extra: int
) -> list[np.ndarray]:
    """Running totals of each weight over the phase bins of every period, wrapped by ``extra``."""
    width = int(nb.max()) + extra + 1
    cell = rel / p[:, None]
    np.floor(cell, out=cell)
    cell *= -p[:, None]
    cell += rel
    cell /= step
    flat = cell.astype(np.int64)
    np.minimum(flat, (nb - 1)[:, None], out=flat)
    flat += (np.arange(p.size) * width)[:, None]
    flat = flat.ravel()
    out = []
    for each in weights:
        grid = np.bincount(flat, np.broadcast_to(each, (p.size, each.size)).ravel(), p.size * width)
        grid = grid.reshape(p.size, width)
        for r, n in enumerate(nb):
            grid[r, n : n + extra] = grid[r, :extra]
        running = np.zeros((p.size, width + 1))
        np.cumsum(grid, axis=1, out=running[:, 1:])
        out.append(running)
    return out


def _best_boxes(
    cw: np.ndarray, cy: np.ndarray, nb: np.ndarray, spans: np.ndarray, total: float, standard: bool
) -> tuple[np.ndarray, ...]:
    """Per period: twice the log-likelihood of the best box, its first bin, span and sums."""
    rows, most, least = np.arange(nb.size), int(nb.max()), int(nb.min())
    beyond = np.arange(least, most)[None, :] >= nb[:, None]
    best, first, width = np.zeros(nb.size), np.zeros(nb.size, int), np.ones(nb.size, int)
    dip, inside, gain = (np.empty((nb.size, most)) for _ in range(3))
    floor = 1e-9 * total * total  # boxes holding next to nothing, or everything, gain nothing
    for span in spans:
        np.subtract(cy[:, span : span + most], cy[:, :most], out=dip)
        np.subtract(cw[:, span : span + most], cw[:, :most], out=inside)
        np.minimum(dip, 0.0, out=dip)  # brightenings do not count
        np.multiply(dip, dip, out=dip)
        np.subtract(total, inside, out=gain)
        if not standard:
            np.multiply(gain, gain, out=gain)
            np.divide(gain, total, out=gain)
        np.multiply(gain, inside, out=gain)
        np.maximum(gain, floor, out=gain)
        np.divide(dip, gain, out=gain)
        if beyond.size:
            gain[:, least:][beyond] = 0.0
        at = gain.argmax(axis=1)
        top = gain[rows, at] * total
        better = top > best
        best[better], first[better], width[better] = top[better], at[better], span
    bw = cw[rows, first + width] - cw[rows, first]
    by = cy[rows, first + width] - cy[rows, first]
    return best, first, width, bw, by


def sine_power(t: np.ndarray, y: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of the variance a sinusoid with a free mean explains, and its semi-amplitude."""
    power, amplitude = np.zeros(freq.size), np.zeros(freq.size)
    rel, yc = t - t.min(), y - y.mean()
    yy = (yc * yc).mean()
    group = max(1, int(2e6 // max(t.size, 1)))
    for start in range(0, freq.size, group):
        part = slice(start, start + group)
        angle = 2 * np.pi * freq[part, None] * rel
        c, s = np.cos(angle), np.sin(angle)
        mc, ms = c.mean(axis=1), s.mean(axis=1)
        c2 = (c * c).mean(axis=1)
        cc, ss = c2 - mc * mc, 1.0 - c2 - ms * ms
        cs = (c * s).mean(axis=1) - mc * ms
        qc, qs = c @ yc / t.size, s @ yc / t.size
        det = cc * ss - cs * cs
        det = np.where(np.abs(det) > 1e-15, det, np.inf)
        if yy > 0:
            power[part] = (ss * qc**2 + cc * qs**2 - 2 * cs * qc * qs) / (yy * det)
        amplitude[part] = np.hypot((qc * ss - qs * cs) / det, (qs * cc - qc * cs) / det)
    return power, amplitude


def fourier_power(
    cell: np.ndarray, moments: np.ndarray, plain: np.ndarray, width: float, n_cells: int,
    freq: tuple[float, float, int], n: float, yy: float,
) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`sine_power`, from moments of the rows about the middles of their time cells.

    ``moments[:, k]`` and ``plain[:, k]`` sum y d^k and d^k, d running from -1 to 1 over a cell of
    ``width``. Within a cell exp(iwt) is its power series, so each order is one FFT over the cells.
    ``freq``: first, step and number; ``n_cells`` * ``width`` is 1 / step.
    """
    first, step, count = freq
    at, steps = np.arange(count), cell.astype(float)

    def transform(sums: np.ndarray, times: int) -> np.ndarray:
        """Sum of value exp(2 pi i f t) over all rows at ``times`` each frequency."""
        f = times * (first + step * at)
        turn = np.exp(2j * np.pi * ((times * first * width * steps) % 1.0))
        half, out, factor = 1j * np.pi * f * width, np.zeros(count, complex), np.ones(count, complex)
        for k in range(sums.shape[1]):
            grid = np.zeros(n_cells, complex)
            grid[cell] = sums[:, k] * turn
            out += factor * (np.fft.ifft(grid) * n_cells)[(times * at) % n_cells]
            factor = factor * half / (k + 1)
        return out * np.exp(half)

    q, one, two = transform(moments, 1) / n, transform(plain, 1) / n, transform(plain, 2) / n
    mc, ms = one.real, one.imag
    cc, ss = 0.5 * (1 + two.real) - mc * mc, 0.5 * (1 - two.real) - ms * ms
    cs = 0.5 * two.imag - mc * ms
    det = cc * ss - cs * cs
    det = np.where(np.abs(det) > 1e-12, det, np.inf)
    power = (ss * q.real**2 + cc * q.imag**2 - 2 * cs * q.real * q.imag) / det
    amplitude = np.hypot(q.real * ss - q.imag * cs, q.imag * cc - q.real * cs) / np.abs(det)
    return (power / yy if yy > 0 else np.zeros(count)), amplitude


def trapezoid_shape(x: np.ndarray, total: np.ndarray, ingress: np.ndarray) -> np.ndarray:
    """Unit-depth trapezoid at distances ``x`` from its middle."""
    half = 0.5 * total
    tau = np.maximum(0.5 * ingress * total, 1e-9)
    return np.clip((half - np.abs(x)) / tau, 0.0, 1.0)


def fit_trapezoid(
    x: np.ndarray, y: np.ndarray, n: np.ndarray, duration: float
) -> dict[str, float]:
    """Best trapezoid through weighted bins: a grid refined around its minimum.

    The depth is linear, so the grid spans only the middle, the duration and the ingress
    fraction; each of the refinements shrinks it threefold.
    """
    low = np.array([-duration / 4, 0.3 * duration, 0.01])
    high = np.array([duration / 4, 2.5 * duration, 1.0])
    box = [low.copy(), high.copy()]
    best = (np.inf, 0.0, np.zeros(3))
    drop = 1.0 - y
    for step in range(9):
        axes = [np.linspace(a, b, 9 if step else 13) for a, b in zip(*box, strict=True)]
        grid = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)
        s = trapezoid_shape(x - grid[:, :1], grid[:, 1:2], grid[:, 2:])
        ss = (n * s * s).sum(axis=1)
        depth = np.clip((n * s * drop).sum(axis=1) / np.where(ss > 0, ss, 1.0), 0.0, 1.0)
        cost = (n * (drop - depth[:, None] * s) ** 2).sum(axis=1)
        i = int(cost.argmin())
        if cost[i] < best[0]:
            best = (float(cost[i]), float(depth[i]), grid[i])
        reach = (box[1] - box[0]) / 4
        box = [np.maximum(best[2] - reach, low), np.minimum(best[2] + reach, high)]
    p = np.array([best[2][0], best[1], best[2][1], best[2][2]])
    jac = []
    for k in range(4):
        h = 1e-4 * max(abs(p[k]), 1e-3 * duration)
        a, b = p.copy(), p.copy()
        a[k] -= h
        b[k] += h
        m = [q[1] * trapezoid_shape(x - q[0], q[2], q[3]) for q in (a, b)]
        jac.append(np.sqrt(n) * (m[1] - m[0]) / (2 * h))
    info = np.array(jac) @ np.array(jac).T
    try:
        var = np.linalg.inv(info)[3, 3] * best[0] / max(x.size - 4, 1)
    except np.linalg.LinAlgError:
        var = np.nan
    err = float(np.sqrt(var)) if var >= 0 else np.nan
    return {"tc": p[0], "fit_depth": p[1], "t14": p[2], "ingress_fraction": p[3], "ingress_err": err}


def fit_shifts(
    dt: np.ndarray, f: np.ndarray, w: np.ndarray, ends: np.ndarray,
    duration: np.ndarray, depth: np.ndarray, ingress: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Per dip the shift of its fixed trapezoid (with a free level) that fits best, and its error (or NaN).

    Rows of dip i are those up to ``ends[i]``; every trial shift is tried on all dips at once.
    """
    starts = np.r_[0, ends[:-1]]
    n = ends - starts
    dip = np.repeat(np.arange(n.size), n)
    shape = [x[dip] for x in (duration, ingress, depth)]

    def chi2(shift: np.ndarray) -> np.ndarray:
        m = 1.0 - shape[2] * trapezoid_shape(dt - shift[dip], shape[0], shape[1])
        level = np.add.reduceat(w * f * m, starts) / np.add.reduceat(w * m * m, starts)
        return np.add.reduceat(w * (f - level[dip] * m) ** 2, starts)

    centre, reach = np.zeros(n.size), 0.5 * duration
    for _ in range(4):
        best, cost = centre, np.full(n.size, np.inf)
        for step in np.linspace(-1.0, 1.0, 81):
            trial = np.clip(centre + step * reach, -0.5 * duration, 0.5 * duration)
            now = chi2(trial)
            best, cost = np.where(now < cost, trial, best), np.minimum(now, cost)
        centre, reach = best, reach / 20
    h = duration / 200
    left, middle, right = chi2(centre - h), chi2(centre), chi2(centre + h)
    curvature = (left - 2 * middle + right) / h**2
    usable = (curvature > 0) & (n >= 10)
    spread = np.sqrt(np.maximum(1.0, middle / np.maximum(n - 2, 1)))
    return centre, np.where(usable, np.sqrt(2 / np.where(usable, curvature, 1.0)) * spread, np.nan)

