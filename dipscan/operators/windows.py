"""Location estimates of many overlapping windows of one block, without a pass over each window's rows.

A block's values are kept by the bits of their places in value order (:class:`Ranked`), so an order statistic
of any window takes as many steps as the places have bits. Weighted means use cells of the value axis: within a
cell a smooth weight is its polynomial through a few points (to rounding), so a window's rows in that cell
are as many sums, differences of running ones. A cell that a weight's kink cuts is summed up to the kink.
"""

from __future__ import annotations

import numpy as np

#: Points per cell and width of a cell in reaches: what they leave of the weights is near rounding.
CELLS = {"biweight": (6, 0.5), "tau": (6, 0.5), "andrewsinewave": (12, 0.5), "huber_psi": (14, 0.25), "welsch": (14, 0.5)}
MOST_CELLS = 4096
CHUNK = 4096
#: Windows that go together at most; pairs listed for them, per row and rank wanted, and at most.
MOST_WINDOWS, PAIRS_PER_ROW, PAIRS_PER_WINDOW, MOST_PAIRS = 1 << 17, 8, 256, 1 << 21
#: Share of a window's rows that windows may lie apart.
GAP = 4
#: Distinct sums up to which bounds are taken from them, and sums looked through together.
FEW_SUMS, COARSE = 4096, 1 << 15


class Ranked:
    """Values in time order, ready for order statistics of windows [lo, hi)."""

    def __init__(self, y: np.ndarray, cell: np.ndarray | None = None):
        """``cell``: number of each value's cell, rising with the value."""
        self.y = y
        self.values, place = np.unique(y, return_inverse=True)
        self.low_bits = max(1, int(self.values.size - 1).bit_length())
        code = place.astype(np.int64)
        self.code_of = np.arange(self.values.size)
        bits = self.low_bits
        if cell is not None:  # a code is the cell, then the place among the cell's values
            cells, number = np.unique(cell, return_inverse=True)
            of_value = np.empty(self.values.size, np.int64)
            of_value[place] = number
            first = np.searchsorted(of_value, np.arange(cells.size))
            inside = np.arange(self.values.size) - first[of_value]
            self.low_bits = max(1, int(inside.max() + 1).bit_length())
            bits = self.low_bits + max(1, int(cells.size - 1).bit_length())
            self.code_of = (of_value << self.low_bits) | inside
            self.cells, self.of_value = cells, of_value
            self.ends = np.r_[first, self.values.size]
            code = self.code_of[place]
        self.levels, self.orders = [], []
        for bit in reversed(range(bits)):
            one = (code >> bit) & 1 == 1
            zeros = np.zeros(y.size + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)]).astype(np.int32)
            code = code[order]
            self.levels.append(zeros)
            self.orders.append(order)

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank ``k`` (from 0) of every window."""
        code = np.zeros(lo.size, np.int64)
        for zeros in self.levels:
            a, b = zeros[lo], zeros[hi]
            right = k >= b - a
            k = np.where(right, k - (b - a), k)
            lo, hi = np.where(right, zeros[-1] + lo - a, a), np.where(right, zeros[-1] + hi - b, b)
            code = 2 * code + right
        return self.values[np.searchsorted(self.code_of, code)]

    def below(
        self, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, weights: np.ndarray, within_cell: bool = False
    ) -> np.ndarray:
        """Sums of the rows' ``weights`` (rows, columns) over each window's values under place ``place``.

        ``within_cell``: only over those of the cell that holds the value at ``place - 1``.
        """
        out = np.zeros((lo.size, weights.shape[1]))
        # one beyond the last value below, so that a place at the end needs no value of its own
        code = np.where(place > 0, self.code_of[np.maximum(place - 1, 0)] + 1, 0)
        if not within_cell:
            whole = code >> len(self.levels) > 0
        else:
            whole = code >> self.low_bits != self.code_of[np.maximum(place - 1, 0)] >> self.low_bits
        some = (place > 0) & ~whole
        if not within_cell and whole.any():
            running = np.zeros((self.y.size + 1, weights.shape[1]))
            np.cumsum(weights, axis=0, out=running[1:])
            out[whole] = running[hi[whole]] - running[lo[whole]]
        for level, (zeros, order) in enumerate(zip(self.levels, self.orders, strict=True)):
            bit = len(self.levels) - 1 - level
            right = (code >> bit) & 1 == 1
            a, b = zeros[lo], zeros[hi]
            if not within_cell or bit < self.low_bits:
                add = np.flatnonzero(right & some & (b > a))
                if add.size:
                    running = np.zeros((zeros[-1] + 1, weights.shape[1]))
                    np.cumsum(weights[order[: zeros[-1]]], axis=0, out=running[1:])
                    out[add] += running[b[add]] - running[a[add]]
            lo, hi = np.where(right, zeros[-1] + lo - a, a), np.where(right, zeros[-1] + hi - b, b)
            weights = weights[order]
        return out

    def median(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        n = hi - lo
        return 0.5 * (self.kth(lo, hi, (n - 1) // 2) + self.kth(lo, hi, n // 2))

    def mad(self, lo: np.ndarray, hi: np.ndarray, med: np.ndarray) -> np.ndarray:
        """Median distance from ``med``: the values next to it are a run of ranks, found by halving."""
        n = hi - lo
        k = (n + 1) // 2
        a, b = np.zeros_like(n), n - k
        while (a < b).any():
            mid = (a + b) // 2
            active = a < b
            left, right = self.kth(lo, hi, mid), self.kth(lo, hi, np.minimum(mid + k, n - 1))
            go = active & (med - left > right - med)
            a, b = np.where(go, mid + 1, a), np.where(active & ~go, mid, b)
        near = np.maximum(med - self.kth(lo, hi, a), self.kth(lo, hi, a + k - 1) - med)
        before = np.where(a > 0, med - self.kth(lo, hi, np.maximum(a - 1, 0)), np.inf)
        after = np.where(a + k < n, self.kth(lo, hi, np.minimum(a + k, n - 1)) - med, np.inf)
        return np.where(n % 2 == 1, near, 0.5 * (near + np.minimum(before, after)))


def _sums(ranked: Ranked, lo: np.ndarray, hi: np.ndarray, bounds: list[np.ndarray], shift: float) -> list[np.ndarray]:
    """Per bound (a place) the number and the sum of the windows' values under it, less ``shift`` each."""
    weights = np.stack([np.ones(ranked.y.size), ranked.y - shift], axis=1)
    out = ranked.below(np.tile(lo, len(bounds)), np.tile(hi, len(bounds)), np.concatenate(bounds), weights)
    return np.split(out, len(bounds))


class _Run:
    """Neighboring windows, rising in both ends, and counts of pair sums for all of them at once."""

    def __init__(self, y: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.lo, self.hi = lo - lo[0], hi - lo[0]
        self.values, place = np.unique(y[lo[0] : hi[-1]], return_inverse=True)
        self.place = place.astype(np.int32)
        rows = np.arange(place.size)
        self.first, self.last = (np.searchsorted(x, rows, side="right") for x in (self.hi, self.lo))  # windows that hold a row
        self.levels, code = [], self.place
        for bit in reversed(range(max(1, int(self.values.size - 1).bit_length()))):
            one = (code >> bit) & 1 == 1
            zeros = np.zeros(code.size + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append(zeros)
            code = np.concatenate([code[~one], code[one]])

    def _under(self, lo: np.ndarray, hi: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many of the rows [lo, hi) hold values before ``place``."""
        whole = place >> len(self.levels) > 0
        out = np.where(whole, hi - lo, 0)
        place = np.where(whole, 0, place)
        for level, zeros in enumerate(self.levels):
            a, b = zeros[lo], zeros[hi]
            right = (place >> (len(self.levels) - 1 - level)) & 1 == 1
            out += np.where(right, b - a, 0)
            lo, hi = np.where(right, zeros[-1] + lo - a, a), np.where(right, zeros[-1] + hi - b, b)
        return out

    def count(self, bound: float, a: int, b: int) -> np.ndarray:
        """Per window of [a, b) the pairs (a row with itself included) whose sum is at most ``bound``.

        The first window's by a search per value; from window to window the rows that come and go bring and take theirs.
        """
        lo, hi = self.lo[a:b], self.hi[a:b]
        times = np.bincount(self.place[lo[0] : hi[-1]], minlength=self.values.size)
        held = np.flatnonzero(times)
        values, times = self.values[held], np.bincount(self.place[lo[0] : hi[0]], minlength=self.values.size)[held]
        among = _partners(values, values, bound)
        whole = (np.r_[0, np.cumsum(times)][among] @ times + times[values + values <= bound].sum()) // 2
        partners = np.zeros(self.values.size, np.int64)
        partners[held] = np.r_[held, self.values.size][among]
        new, old = np.arange(hi[0], hi[-1]), np.arange(lo[0], lo[-1])
        begin, end = np.minimum(self.lo[self.first[new]], new + 1), np.maximum(self.hi[self.last[old] - 1], old)
        n = self._under(np.r_[begin, old], np.r_[new + 1, end], partners[self.place[np.r_[new, old]]])
        came, went = (np.r_[0, np.cumsum(x)] for x in (n[: new.size], n[new.size :]))
        return whole + came[hi - hi[0]] - went[lo - lo[0]]


def _partners(values: np.ndarray, x: np.ndarray, bound: float) -> np.ndarray:
    """How many of the distinct sorted ``values`` make a sum of at most ``bound`` with each ``x``, as sums round."""
    k = np.searchsorted(values, bound - x, side="right")
    if not values.size or not np.isfinite(bound):
        return k
    while (more := (k < values.size) & (x + values[np.minimum(k, values.size - 1)] <= bound)).any():
        k += more
    while (less := (k > 0) & (x + values[np.maximum(k - 1, 0)] > bound)).any():
        k -= less
    return k


def _spans(x: np.ndarray, y: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Per sorted ``x`` its partners from itself on, as places in it, with a sum above ``low`` and up to ``high``. ``y``: distinct ``x``."""
    ends = np.r_[np.searchsorted(x, y), x.size]
    a, b = (ends[_partners(y, y, bound)][np.searchsorted(y, x)] for bound in (low, high))
    a = np.maximum(a, np.arange(x.size))
    return a, np.maximum(b - a, 0)


def _pairs(a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.repeat(np.arange(n.size), n)
    return i, np.arange(i.size) + np.repeat(a - (np.cumsum(n) - n), n)


def _ranked_sums(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Per query w the sum of rank ``need`` among those with ``start`` <= w < ``stop``; ``sums`` rise."""
    g, step = need.size, max(64, int(sums.size**0.5))
    coarse = sums.size > 4 * COARSE
    if coarse:
        step = COARSE
    block = np.arange(sums.size) // step
    blocks = block[-1] + 1
    change = [np.bincount(block * (g + 1) + w, minlength=blocks * (g + 1)) for w in (start, stop)]
    held = (change[0] - change[1]).reshape(blocks, g + 1)[:, :g].cumsum(axis=1).cumsum(axis=0)
    at = (held < need).sum(axis=0)
    w = np.arange(g)
    left = need - np.where(at > 0, held[np.maximum(at - 1, 0), w], 0)
    if coarse:
        out = np.empty(g)
        for k in np.unique(at):
            part, some = slice(k * step, (k + 1) * step), np.flatnonzero(at == k)
            a, b = (np.searchsorted(some, x[part]) for x in (start, stop))
            kept = a < b
            out[some] = _ranked_sums(sums[part][kept], a[kept], b[kept], left[some])
        return out
    place = at[:, None] * step + np.arange(step)
    inside, place = place < sums.size, np.minimum(place, sums.size - 1)
    inside &= (start[place] <= w[:, None]) & (w[:, None] < stop[place])
    return sums[place[w, (inside.cumsum(axis=1) >= left[:, None]).argmax(axis=1)]]


def _pair_medians(y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The windows' medians of pair means."""
    run, n = _Run(y, lo, hi), hi - lo
    pairs = n * (n + 1) // 2
    even = np.flatnonzero(pairs % 2 == 0)
    # the middle ranks wanted (from 1) and their windows
    window, rank = np.r_[np.arange(n.size), even], np.r_[(pairs + 1) // 2, pairs[even] // 2 + 1]
    found = np.empty(rank.size)
    todo = [(np.argsort(window, kind="stable"), -np.inf, 2.0 * run.values[-1], np.zeros(rank.size, np.int64))]
    while todo:
        some, low, high, base = todo.pop()  # sums above low, up to high; ``base`` of a window's are up to low
        # windows far apart go on by themselves: counts run through what lies between
        gaps = np.flatnonzero(np.diff(window[some]) > n[window[some[0]]] // GAP + 64)
        if gaps.size:
            todo.extend((x, low, high, y) for x, y in zip(np.split(some, gaps + 1), np.split(base, gaps + 1), strict=True))
            continue
        a, b = window[some[0]], window[some[-1]] + 1
        first = run.lo[a]
        place = run.place[first : run.hi[b - 1]]
        times = np.bincount(place, minlength=run.values.size)
        held = np.flatnonzero(times)
        values, times = run.values[held], times[held]
        begin, many = _spans(values, values, low, high)
        upto = np.r_[0, np.cumsum(times)]
        total = int((times * (upto[begin + many] - upto[begin])).sum())
        steps = None
        if many.sum() <= FEW_SUMS:
            i, j = _pairs(begin, many)
            steps = np.unique(values[i] + values[j])
            if steps.size == 1:
                found[some] = steps[0]
                continue
        per_row = PAIRS_PER_ROW if steps is None else 3  # few sums are soon told apart by counts
        if total <= min(max(per_row * place.size, PAIRS_PER_WINDOW * some.size), MOST_PAIRS):
            order = np.argsort(place, kind="stable")
            ordered = run.values[place[order]]
            i, j = _pairs(*_spans(ordered, values, low, high))
            sums, i, j = ordered[i] + ordered[j], first + order[i], first + order[j]
            # queries whose window holds both rows
            ends = np.r_[np.searchsorted(window[some], np.arange(a, b)), some.size]
            start, stop = (ends[np.clip(x - a, 0, b - a)] for x in (run.first[np.maximum(i, j)], run.last[np.minimum(i, j)]))
            kept = np.flatnonzero(start < stop)
            kept = kept[np.argsort(sums[kept], kind="stable")]
            found[some] = _ranked_sums(sums[kept], start[kept], stop[kept], rank[some] - base)
            continue
        if steps is not None:
            mid = steps[(steps.size - 1) // 2]
        else:
            least = max(low, 2.0 * values[0])
            mid = least + 0.5 * (high - least)
            if not low < mid < high:
                found[some] = high
                continue
        upto_mid = run.count(mid, a, b)[window[some] - a]
        left = upto_mid >= rank[some]
        if left.any():
            todo.append((some[left], low, mid, base[left]))
        if not left.all():
            todo.append((some[~left], mid, high, upto_mid[~left]))
    first, then = found[: lo.size], found[: lo.size].copy()
    then[even] = found[lo.size :]
    return 0.25 * (first + then)


def hodges(y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Median of the means of all pairs (a value with itself included) of every window.

    Windows rise in both ends. As many as a window has rows go together: a bound on the pair sums is counted for all of
    them at once, a step of the values' bits for every row that comes or goes. Windows part at the bounds until few pairs
    are left between two of them; only those are listed, with the windows that hold them.
    """
    out, start = np.empty(lo.size), 0
    while start < lo.size:
        part = slice(start, start + min(max(int(hi[start] - lo[start]), 512), MOST_WINDOWS))
        out[part] = _pair_medians(y, lo[part], hi[part])
        start = part.stop
    return out


def locations(y: np.ndarray, lo: np.ndarray, hi: np.ndarray, method: str, c: float, passes: int) -> np.ndarray:
    """The estimate of every window [lo, hi) (none empty) of ``y``; NaN where the plain way has to do it."""
    n, shift = hi - lo, float(np.median(y))
    if method == "hodges":
        return hodges(y, lo, hi)
    if method == "mean":
        running = np.r_[0.0, np.cumsum(y - shift)]
        return shift + (running[hi] - running[lo]) / n
    ranked = Ranked(y)
    if method == "median":
        return ranked.median(lo, hi)
    if method in ("trim_mean", "winsorize"):
        cut = (c * n).astype(int)
        low, high = ranked.kth(lo, hi, cut), ranked.kth(lo, hi, n - 1 - cut)
        a, b = (np.searchsorted(ranked.values, v) for v in (low, high))
        under, over = _sums(ranked, lo, hi, [a, b], shift)
        low, high = low - shift, high - shift
        core = over[:, 1] - under[:, 1]
        if method == "trim_mean":
            core += (n - cut - over[:, 0]) * high - (cut - under[:, 0]) * low
            return shift + core / (n - 2 * cut)
        return shift + (core + low * under[:, 0] + high * (n - over[:, 0])) / n
    med = ranked.median(lo, hi)
    mad = ranked.mad(lo, hi, med)
    if method == "hampelfilt":
        reach = c * 1.4826 * mad

        def far(place: np.ndarray) -> np.ndarray:
            return np.abs(ranked.values[np.clip(place, 0, ranked.values.size - 1)] - med) > reach

        a = np.searchsorted(ranked.values, med - reach, side="left")
        b = np.searchsorted(ranked.values, med + reach, side="right")
        # as the plain way rounds the distance of a value at the reach itself
        a = np.where(far(a) & (a < ranked.values.size), a + 1, np.where((a > 0) & ~far(a - 1), a - 1, a))
        b = np.where((b > 0) & far(b - 1), b - 1, np.where((b < ranked.values.size) & ~far(b), b + 1, b))
        under, over = _sums(ranked, lo, hi, [a, b], shift)
        kept, total = (over - under).T
        return shift + (total + (n - kept) * (med - shift)) / n
    scale = mad if method in ("biweight", "tau") else 1.4826 * mad
    return _reweighted(y, lo, hi, method, c, 1 if method == "tau" else passes, med, scale)


def _inside(method: str, u: np.ndarray) -> np.ndarray:
    if method in ("biweight", "tau"):
        return (1 - u * u) ** 2
    if method == "welsch":
        return np.exp(-np.minimum(u * u, 700.0))
    if method == "andrewsinewave":
        return np.sinc(u / np.pi)
    return np.ones_like(u)


def _reweighted(
    y: np.ndarray, lo: np.ndarray, hi: np.ndarray, method: str, c: float, passes: int, centre: np.ndarray, scale: np.ndarray
) -> np.ndarray:
    out = np.where(scale > 0, np.nan, centre)  # a window without scatter keeps its median
    unit = c * scale
    reach = unit * {"andrewsinewave": np.pi, "welsch": 1.0}.get(method, 1.0)
    kinked, (count, share) = method != "welsch", CELLS[method]
    if not (scale > 0).any():
        return out
    smallest = max(reach[scale > 0].min(), 0.1 * np.median(reach[scale > 0]))
    width, base = share * smallest, float(np.median(y))
    fits = np.flatnonzero((scale > 0) & (reach >= smallest))
    cell = np.floor((y - base) / width)
    if np.abs(cell).max() > 2**40 or (ranked := Ranked(y, cell.astype(np.int64))).cells.size > MOST_CELLS:
        return out  # values too far out for their windows
    cells, ends = ranked.cells, ranked.ends
    # each row as weights of its cell's Chebyshev points, from -1 to 1 over the cell
    angle = (np.arange(count) + 0.5) * np.pi / count
    points = np.cos(angle)
    gap = (2 * ((y - base) / width - cell) - 1)[:, None] - points
    hit = gap == 0
    weights = (-1.0) ** np.arange(count) * np.sin(angle) / np.where(hit, 1.0, gap)
    weights /= weights.sum(axis=1, keepdims=True)
    weights[hit.any(axis=1)] = hit[hit.any(axis=1)]
    nodes = base + width * (cells[:, None] + 0.5 * (points + 1))
    number = np.searchsorted(cells, cell)
    order = np.argsort(number, kind="stable")
    rows = np.split(order, np.searchsorted(number[order], np.arange(1, cells.size)))
    running = [np.vstack([np.zeros(count), np.cumsum(weights[each], axis=0)]) for each in rows]
    now, todo = centre.copy(), fits
    for _ in range(passes):
        places, under = [], []
        if kinked:  # sums of the cells that kinks cut, up to the kinks
            places = [np.searchsorted(ranked.values, now[todo] + side * reach[todo]) for side in (-1, 1)]
            under = ranked.below(np.tile(lo[todo], 2), np.tile(hi[todo], 2), np.concatenate(places), weights, True)
            under = np.split(under, 2)
        kept = []
        for start in range(0, todo.size, CHUNK):
            part = slice(start, start + CHUNK)
            some = todo[part]
            at, size = now[some], unit[some]
            limit = {"huber_psi": np.inf, "welsch": 27.0 * size.max()}.get(method, reach[some].max())
            total, moment = np.zeros(some.size), np.zeros(some.size)
            for k in np.flatnonzero((nodes[:, 0] + width >= at.min() - limit) & (nodes[:, 0] - width <= at.max() + limit)):
                w = running[k][np.searchsorted(rows[k], hi[some])] - running[k][np.searchsorted(rows[k], lo[some])]
                d = nodes[k] - at[:, None]
                u = d / size[:, None]
                f = _inside(method, u)
                if kinked:
                    outer = 1.0 / np.maximum(np.abs(u), 0.5) if method == "huber_psi" else np.zeros_like(u)
                    low, high = (p[part] for p in places)
                    within = (ends[k] >= low) & (ends[k + 1] <= high)
                    inner, f = f, np.where(within[:, None], f, outer)
                f *= w
                for side, place in enumerate(p[part] for p in places):
                    cut = np.flatnonzero((ends[k] < place) & (place < ends[k + 1]))
                    first, then = (outer, inner) if side == 0 else (inner, outer)
                    f[cut] = under[side][part][cut] * first[cut] + (w[cut] - under[side][part][cut]) * then[cut]
                total += f.sum(axis=1)
                moment += (f * d).sum(axis=1)
            step = np.where(total > 0, moment / np.where(total > 0, total, 1.0), 0.0)
            now[some] = at + step
            kept.append(some[np.abs(step) > 1e-9 * scale[some]])  # each window stops by itself
        todo = np.concatenate(kept) if kept else todo[:0]
        if not todo.size:
            break
    out[fits] = now[fits]
    return out
