"""Scatter of a curve away from each of very many candidates' dips, by searches in the curve's indexes.

:mod:`.quiet` lets every candidate meet the rows inside its dips. Here a curve of bounded length stands beside a
share of its candidates: the rows a candidate leaves are a few stretches between its dips, and order statistics of
them take one step per bit of the values' places and stretch. Candidates of longer curves, odd ones and those whose
answer needs another rule come back with ``settled`` false and are left to :mod:`.quiet`.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import finite
from ..session import materialize
from .stats import MAD_SCALE

#: Rows of a curve that may stand beside candidates, and candidates of one share.
CURVE_ROWS, SHARE = 1 << 22, 1 << 20
#: Bins of the candidates looked at together.
GROUP_BINS = 1 << 19
#: Rows from which on a curve has bands, and the shares of its rows in a band on either side of where answers are expected.
BAND_ROWS, BANDS = 1 << 13, (1 / 256, 1 / 32)
#: Distinct values, and entries, up to which a band lists the running counts of each.
LISTED, LISTED_ENTRIES = 256, 1 << 22
DAY_US = 86_400_000_000.0


class _Places:
    """Values in time order: counts and ranks over several stretches of rows per candidate."""

    def __init__(self, y: np.ndarray, listed: bool = False):
        self.values, place = np.unique(y, return_inverse=True)
        self.listed = None
        if listed and self.values.size <= LISTED and y.size * self.values.size <= LISTED_ENTRIES:
            self.listed = np.zeros((y.size + 1, self.values.size + 1), np.int32)  # rows up to here with values before each
            np.cumsum(place.ravel()[:, None] < np.arange(1, self.values.size + 1), axis=0, dtype=np.int32, out=self.listed[1:, 1:])
        bits = max(1, int(self.values.size - 1).bit_length())
        code = place.astype(np.int32)
        self.levels = []
        for bit in reversed(range(bits)):
            one = (code >> bit) & 1 == 1
            zeros = np.zeros(y.size + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append(zeros)
            code = np.concatenate([code[~one], code[one]])

    def kth(self, lo: np.ndarray, hi: np.ndarray, starts: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Per candidate the value of rank ``k`` (from 0) in its stretches [lo, hi), which begin at ``starts``."""
        many = np.diff(np.r_[starts, lo.size])
        code, k = np.zeros(k.size, np.int64), k.copy()
        for zeros in self.levels:
            a, b = zeros[lo], zeros[hi]
            left = np.add.reduceat(b - a, starts, dtype=np.int64)
            right = k >= left
            k -= np.where(right, left, 0)
            turn = np.repeat(right, many)
            lo, hi = np.where(turn, zeros[-1] + lo - a, a), np.where(turn, zeros[-1] + hi - b, b)
            code = 2 * code + right
        return self.values[np.minimum(code, self.values.size - 1)]

    def under(self, lo: np.ndarray, hi: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Per candidate the rows of its stretches whose value stands before ``place``."""
        many, bits = np.diff(np.r_[starts, lo.size]), len(self.levels)
        whole = place >= 1 << bits
        out = np.where(whole, np.add.reduceat(hi - lo, starts, dtype=np.int64), 0)
        for level, zeros in enumerate(self.levels):
            a, b = zeros[lo], zeros[hi]
            right = (place >> (bits - 1 - level)) & 1 == 1
            out += np.where(right & ~whole, np.add.reduceat(b - a, starts, dtype=np.int64), 0)
            turn = np.repeat(right, many)
            lo, hi = np.where(turn, zeros[-1] + lo - a, a), np.where(turn, zeros[-1] + hi - b, b)
        return out


class _Left:
    """What each candidate's stretches leave of a column's rows."""

    def __init__(self, places: _Places, lo: np.ndarray, hi: np.ndarray, starts: np.ndarray):
        self.places, self.part, self.size = places, (lo, hi, starts), starts.size
        self.upto = None
        if places.listed is not None:
            self.upto = np.add.reduceat(places.listed[hi] - places.listed[lo], starts, axis=0)

    def _stretches(self, some: np.ndarray):
        if some.size == self.size:
            return self.part
        mine = np.zeros(self.size, bool)
        mine[some] = True
        return _of(mine, *self.part)

    def kth(self, some: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank ``k`` (from 0) of the candidates ``some``, in order."""
        if self.upto is None:
            return self.places.kth(*self._stretches(some), k)
        return self.places.values[np.minimum((self.upto[some, 1:] <= k[:, None]).sum(axis=1), self.places.values.size - 1)]

    def under(self, some: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The rows of the candidates ``some`` whose value stands before ``place``."""
        return self.places.under(*self._stretches(some), place) if self.upto is None else self.upto[some, place].astype(np.int64)

    def middle(self, rank: np.ndarray, even: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per candidate the value of ``rank``, and the next one where ``even``."""
        low = self.kth(np.arange(self.size), rank)
        high = low.copy()
        if even.any():
            high[even] = self.kth(np.flatnonzero(even), rank[even] + 1)
        return low, high

    def deviation(
        self, ordered: np.ndarray, n: np.ndarray, m: np.ndarray, rank: np.ndarray, even: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Distance of ``rank`` from ``m``, and the next one where ``even``. ``ordered``: the column's values, sorted; where their distances lead is tried first."""
        v = self.places.values

        def ends(distance: np.ndarray, of: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.searchsorted(of, centre - distance, side="left"), np.searchsorted(of, centre + distance, side="right")

        def whole_curve(want: np.ndarray) -> np.ndarray:
            """The distance within which ``want`` of all rows lie, nearly."""
            want = np.clip(np.rint(want).astype(np.int64), 1, ordered.size)
            split = np.searchsorted(ordered, m)
            a, b = np.maximum(want - (ordered.size - split), 0), np.minimum(want, split)
            while (a < b).any():  # as many of them on the left
                mid = (a + b) // 2
                more = (a < b) & (m - ordered[np.maximum(split - 1 - mid, 0)] < ordered[np.minimum(split + want - mid, ordered.size) - 1] - m)
                a, b = np.where(more, mid + 1, a), np.where(more, b, np.minimum(b, mid))
            left = np.where(a > 0, m - ordered[np.maximum(split - a, 0)], 0.0)
            right = np.where(want > a, ordered[np.minimum(split + want - a, ordered.size) - 1] - m, 0.0)
            return np.maximum(left, right)

        # values at places [left_in, right_in) are near enough to be under the rank, [left_out, right_out) reach it
        left_in = right_in = np.searchsorted(v, m)
        left_out, right_out = np.zeros(n.size, np.int64), np.full(n.size, v.size)

        def tried(todo: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            """Their rows less the rank wanted, after the bounds have moved."""
            nonlocal left_in, right_in, left_out, right_out
            left = np.clip(left, left_out[todo], left_in[todo])
            right = np.clip(right, right_in[todo], right_out[todo])
            over = self.under(todo, right) - self.under(todo, left) - rank[todo]
            inner, outer = todo[over <= 0], todo[over > 0]
            left_in, right_in, left_out, right_out = (x.copy() for x in (left_in, right_in, left_out, right_out))
            left_in[inner], right_in[inner] = left[over <= 0], right[over <= 0]
            left_out[outer], right_out[outer] = left[over > 0], right[over > 0]
            return over

        every = np.arange(n.size)
        share, off = ordered.size / n, np.zeros(n.size)
        slack = 2.0 + 0.25 * np.sqrt(np.maximum(ordered.size - n, 0))
        for step in (0, -1, 1):
            if step == 0:
                off = tried(every, *ends(whole_curve((rank + 1) * share), v, m))
            else:
                tried(every, *ends(whole_curve((rank + 1 - off + step * slack) * share), v, m))
        out = np.full(n.size, np.nan)
        todo = every
        while todo.size:
            rights, lefts = (right_out - right_in)[todo], (left_in - left_out)[todo]
            r = right_in[todo] + np.maximum(rights // 2, 1) - 1
            le = left_in[todo] - np.maximum(lefts // 2, 1)
            beyond_r = np.where(rights > 0, v[np.minimum(r, v.size - 1)] - m[todo], np.inf)
            beyond_l = np.where(lefts > 0, m[todo] - v[np.maximum(le, 0)], np.inf)
            one = (rights <= 1) & (lefts <= 1)
            done = one & ((rights + lefts <= 1) | (beyond_r == beyond_l))
            out[todo[done]] = np.minimum(beyond_r, beyond_l)[done]
            by_right = np.where(one, beyond_r < beyond_l, rights >= lefts)
            near = np.where(by_right, beyond_r, beyond_l)
            left, right = ends(near, v, m[todo])
            # the value itself is within, and at its side nothing beyond it
            right = np.where(by_right, r + 1, np.where(one, right_in[todo], right))
            left = np.where(by_right, np.where(one, left_in[todo], left), le)
            todo, left, right = todo[~done], left[~done], right[~done]
            if todo.size:
                tried(todo, left, right)
        after = out.copy()
        if even.any():
            # the rank after it: another value at this distance, or the next one out on either side
            some = np.flatnonzero(even)
            n, m, a, b = (x[some] for x in (n, m, left_out, right_out))
            below, upto = self.under(some, a), self.under(some, b)
            least = self.kth(some, np.maximum(below - 1, 0))
            most = self.kth(some, np.minimum(upto, n - 1))
            then = np.minimum(np.where(below > 0, m - least, np.inf), np.where(upto < n, most - m, np.inf))
            after[even] = np.where(upto - below > rank[even] + 1, out[even], then)
        return out, after


def _of(some: np.ndarray, lo: np.ndarray, hi: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of ``some`` candidates, and where each one's begin."""
    if some.all():
        return lo, hi, starts
    many = np.diff(np.r_[starts, lo.size])
    kept = np.repeat(some, many)
    return lo[kept], hi[kept], np.r_[0, np.cumsum(many[some])[:-1]]


class _Band:
    """The few rows with values in one span or two, apart, and counts of those under the one or between the two."""

    def __init__(self, y: np.ndarray, *spans: tuple[float, float]):
        self.spans = spans
        inside = np.logical_or.reduce([(y >= a) & (y <= b) for a, b in spans])
        counted = y < spans[0][0] if len(spans) == 1 else (y > spans[0][1]) & (y < spans[1][0])
        self.upto = np.zeros((y.size + 1, 2), np.int32)
        np.cumsum(np.stack([counted, inside], axis=1), axis=0, dtype=np.int32, out=self.upto[1:])
        self.places, self.ordered = _Places(y[inside], listed=True), np.sort(y[inside])

    def rows(self, lo: np.ndarray, hi: np.ndarray, starts: np.ndarray):
        """Per candidate the rows counted and those of the band; the stretches as the band's rows."""
        first, last = self.upto[lo], self.upto[hi]
        counted, inside = np.add.reduceat(last - first, starts, axis=0, dtype=np.int64).T
        return counted, inside, first[:, 1], last[:, 1]


class _Middles:
    """Medians, and median distances from them, of the rows candidates leave. Most lie in narrow bands; the others meet all places."""

    def __init__(self, y: np.ndarray, distances: bool):
        self.places, self.ordered = _Places(y), np.sort(y)
        self.near, self.far = [], []
        if y.size < BAND_ROWS:
            return
        centre = self.ordered[y.size // 2]
        reach = np.median(np.abs(y - centre)) if distances else 0.0
        for share in BANDS:
            self.near.append(_Band(y, self._span(centre, share)))
            if distances and reach > 0:
                low, high = self._span(centre - reach, share), self._span(centre + reach, share)
                if low[1] < high[0]:
                    self.far.append(_Band(y, low, high))

    def _span(self, value: float, share: float) -> tuple[float, float]:
        at, last = np.searchsorted(self.ordered, value), self.ordered.size - 1
        wide = int(share * self.ordered.size)
        return self.ordered[min(max(at - wide, 0), last)], self.ordered[min(at + wide, last)]

    def median(self, lo: np.ndarray, hi: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two values in the middle of ``n``, of all rows in each candidate's stretches."""
        rank, even = (n - 1) // 2, n % 2 == 0
        low, high, todo = np.zeros(n.size, self.ordered.dtype), np.zeros(n.size, self.ordered.dtype), np.arange(n.size)
        part = (lo, hi, starts)
        for band in self.near:
            counted, inside, first, last = band.rows(*part)
            k, e = rank[todo] - counted, even[todo]
            here = (k >= 0) & (k + e < inside)
            if here.any():
                low[todo[here]], high[todo[here]] = _Left(band.places, *_of(here, first, last, part[2])).middle(k[here], e[here])
            todo, part = todo[~here], _of(~here, *part)
            if not todo.size:
                return low, high
        low[todo], high[todo] = _Left(self.places, *part).middle(rank[todo], even[todo])
        return low, high

    def deviation(self, lo: np.ndarray, hi: np.ndarray, starts: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The median distance from ``m`` of each candidate's ``n`` rows."""
        rank, even = (n - 1) // 2, n % 2 == 0
        out, after, todo = np.zeros(n.size), np.zeros(n.size), np.arange(n.size)
        part = (lo, hi, starts)
        for band in self.far:
            counted, inside, first, last = band.rows(*part)
            k, e = rank[todo] - counted, even[todo]
            here = (k >= 0) & (k + e < inside)
            if here.any():
                some = todo[here]
                left = _Left(band.places, *_of(here, first, last, part[2]))
                a, b = left.deviation(band.ordered, inside[here], m[some], k[here], e[here])
                # rows between the spans are no farther and rows beyond them no nearer than this
                (low, inner), (outer, high) = band.spans
                sure = (a >= np.maximum(m[some] - inner, outer - m[some])) & (b <= np.minimum(m[some] - low, high - m[some]))
                out[some], after[some] = a, b
                here[here] = sure
            todo, part = todo[~here], _of(~here, *part)
            if not todo.size:
                return out + 0.5 * (after - out)
        out[todo], after[todo] = _Left(self.places, *part).deviation(self.ordered, n[todo], m[todo], rank[todo], even[todo])
        return out + 0.5 * (after - out)


class Curve:
    """One curve's rows in time, indexed once for any number of candidates."""

    def __init__(self, t_us: np.ndarray, t: np.ndarray, flux: np.ndarray, values: bool):
        order = np.lexsort((flux, t_us))
        self.t_us, self.t = t_us[order], t[order]
        flux = flux[order]
        level = flux.mean()
        self.total = np.r_[0.0, np.cumsum(flux - level)]
        self.steps = _Middles(np.r_[0, np.diff(self.t_us)], distances=False)
        self.flux = _Middles(flux, distances=True) if values else None

    def dips(self, p: np.ndarray, t0: np.ndarray, d: np.ndarray, phases: Sequence[float], closed: bool):
        """Candidate, first and past-last row of every dip that holds rows, in order, without overlaps."""
        who, a, b = [], [], []
        for phase in phases:
            mid = t0 + phase * p if phase else t0
            first = np.ceil((self.t[0] - 1.001 * d - mid) / p).astype(np.int64)
            last = np.floor((self.t[-1] + 1.001 * d - mid) / p).astype(np.int64)
            n = np.maximum(last - first + 1, 0)
            i = np.repeat(np.arange(p.size), n)
            time = mid[i] + p[i] * (first[i] + np.arange(i.size) - np.repeat(np.cumsum(n) - n, n))
            who.append(i)
            for sign, out in ((-1, a), (1, b)):
                out.append(self._edge(time, sign, p[i], mid[i], d[i], closed))
        who, a, b = (np.concatenate(x) for x in (who, a, b))
        some = b > a
        who, a, b = who[some], a[some], b[some]
        order = np.lexsort((b, a, who))
        who, a, b = who[order], a[order], b[order]
        if len(phases) > 1:  # dips that touch or overlap are one
            first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (a[1:] > b[:-1])][: who.size])
            who, a, b = who[first], a[first], np.maximum.reduceat(b, first) if first.size else b
        return who, a, b

    def _edge(
        self, time: np.ndarray, sign: int, p: np.ndarray, t0: np.ndarray, d: np.ndarray, closed: bool
    ) -> np.ndarray:
        """Where rows begin (sign -1) or cease (1) to be inside the dip at ``time``, as the fold rounds."""
        n, t = self.t.size, self.t
        at = np.searchsorted(t, time + sign * d)

        def near(k: np.ndarray) -> np.ndarray:
            return (k >= 0) & (k < n) & (np.abs(t[np.clip(k, 0, n - 1)] - time) < 0.5 * p)

        def inside(k: np.ndarray) -> np.ndarray:
            x = t[np.clip(k, 0, n - 1)] - t0 + 0.5 * p
            off = np.abs(x - p * np.floor(x / p) - 0.5 * p)
            return (off <= d) if closed else (off < d)

        # a time may lie within a hair of the border: it goes to either side, with all its rows
        before = at - 1
        back = near(before) & ((inside(before) if sign < 0 else ~inside(before)) & (sign * (t[np.clip(before, 0, n - 1)] - time) > 0))
        on = near(at) & ((inside(at) if sign > 0 else ~inside(at)) & (sign * (t[np.clip(at, 0, n - 1)] - time) > 0))
        out = at.copy()
        out[back] = np.searchsorted(t, t[before[back]], side="left")
        out[on] = np.searchsorted(t, t[at[on]], side="right")
        return out

    def _kept(self, who: np.ndarray, a: np.ndarray, b: np.ndarray, size: int):
        """The stretches between the dips: starts of each candidate's, [lo, hi)."""
        n = np.bincount(who, minlength=size)
        starts = np.r_[0, np.cumsum(n + 1)[:-1]]
        after = np.arange(who.size) + who  # a candidate's k-th dip ends its k-th stretch
        lo, hi = np.zeros(who.size + size, np.int64), np.full(who.size + size, self.t.size)
        hi[after], lo[after + 1] = a, b
        return starts, lo, hi

    def _edges(self, x0: np.ndarray, d: np.ndarray, many: np.ndarray, width: int) -> np.ndarray:
        """The first row of each bin of ``d`` days from ``x0`` on, as the quotient rounds; beyond the last bin the end."""
        n, j = self.t.size, np.arange(width)
        edge = np.searchsorted(self.t, x0[:, None] + j * d[:, None])
        for _ in range(4):
            here, before = (self.t[np.clip(edge - s, 0, n - 1)] for s in (0, 1))
            early = (edge < n) & (np.floor((here - x0[:, None]) / d[:, None]) < j)
            late = (edge > 0) & (np.floor((before - x0[:, None]) / d[:, None]) >= j)
            if not (early.any() or late.any()):
                break
            edge = np.where(early, np.searchsorted(self.t, here, side="right"), edge)
            edge = np.where(late & ~early, np.searchsorted(self.t, before, side="left"), edge)
        return np.where(j >= many[:, None], n, edge)

    def scatter(self, p, t0, d, phases, closed, values, least, reach=1.0, min_fraction=0.5):
        """Per candidate: settled, too few rows, sigma of the rows left (NaN unless ``values``), that of their means over a duration."""
        size, n_rows = p.size, self.t.size
        who, a, b = self.dips(p, t0, reach * d, phases, closed)
        starts, lo, hi = self._kept(who, a, b, size)
        n = np.add.reduceat(hi - lo, starts)
        few = n < least
        settled = n >= max(least, 2)
        sigma, binned = np.full(size, np.nan), np.full(size, np.nan)
        # steps inside stretches; those over a dip must be no shorter than the middle one found without them
        lo1 = np.minimum(lo + 1, hi)
        inner = np.add.reduceat(hi - lo1, starts)
        steps = n - 1
        settled &= inner > steps // 2
        half = np.where(settled, steps, 1)
        some = _of(settled, lo1, hi, starts)
        short, high = np.zeros(size, np.int64), np.zeros(size, np.int64)
        if settled.any():
            short[settled], high[settled] = self.steps.median(*some, half[settled])
        spacing = short + 0.5 * (high - short)
        within = (a > 0) & (b < n_rows)
        over = np.full(size, np.inf)
        np.minimum.at(over, who[within], self.t_us[b[within]] - self.t_us[a[within] - 1])
        settled &= over >= high
        good = np.flatnonzero(settled)
        if values and good.size:
            part = _of(settled, lo, hi, starts)
            low, top = self.flux.median(*part, n[good])
            sigma[good] = MAD_SCALE * self.flux.deviation(*part, n[good], low + 0.5 * (top - low))
        # bins from the first row left
        first = np.zeros(size, np.int64)
        while (touch := (a == first[who]) & (b > a)).any():
            first[who[touch]] = b[touch]
        x0 = self.t[np.minimum(first, n_rows - 1)]
        many = np.where(settled, np.floor((self.t[-1] - x0) / d).astype(np.int64) + 1, 0)
        width = int(many.max(initial=1)) + 1
        # candidates with one first row and duration share their bins
        kind, like = np.unique(np.stack([np.where(settled, first, -1), d.view(np.int64)]), axis=1, return_index=True, return_inverse=True)[1:]
        like = like.ravel()
        edge = self._edges(x0[kind], d[kind], many[kind], width)
        # rows and sums of the bins, less those in the dips
        shape, count, total = (size, width - 1), np.diff(edge, axis=1)[like], np.diff(self.total[edge], axis=1)[like]
        mine = np.flatnonzero(settled[who] & (b > first[who]))
        i, a, b = who[mine], a[mine], b[mine]
        bin_a, bin_b = (np.floor((self.t[k] - x0[i]) / d[i]).astype(np.int64) for k in (a, b - 1))
        each = bin_b - bin_a + 1
        dip = np.repeat(np.arange(i.size), each)
        j = np.arange(dip.size) - np.repeat(np.cumsum(each) - each - bin_a, each)
        low, high = np.maximum(a[dip], edge[like[i[dip]], j]), np.minimum(b[dip], edge[like[i[dip]], j + 1])
        cell = i[dip] * (width - 1) + j
        count = count - np.bincount(cell, high - low, minlength=size * (width - 1)).reshape(shape)
        total = total - np.bincount(cell, self.total[high] - self.total[low], minlength=size * (width - 1)).reshape(shape)
        # no step, no expected number: one row is enough, as in quiet.py
        need = min_fraction * np.maximum(np.where(spacing > 0, d / (np.where(spacing > 0, spacing, 1.0) / DAY_US), 1.0), 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where((count >= need[:, None]) & (count > 0), total / count, np.inf)
        k = np.isfinite(mean).sum(axis=1)
        centre = _row_medians(mean, k)
        spread = _row_medians(np.abs(mean - centre[:, None]), k)
        binned = np.where(settled & (k >= 3), MAD_SCALE * spread, np.nan)
        return settled, few, sigma, binned


def _row_medians(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Medians of the ``n`` finite entries of each row; the others are infinite. 0 where there are none."""
    ordered, rows = np.sort(x, axis=1), np.arange(n.size)
    low, high = (ordered[rows, np.maximum(k, 0)] for k in ((n - 1) // 2, np.minimum(n // 2, x.shape[1] - 1)))
    with np.errstate(invalid="ignore"):
        return np.where(n > 0, low + 0.5 * (high - low), 0.0)


def scatters(
    lc: DataFrame, cands: DataFrame, ids: Sequence[str], phases: Sequence[float], closed: bool, values: bool, least: int,
    reach: float = 1.0,
) -> DataFrame:
    """``ids``, ``settled``, ``few``, ``sigma`` and ``binned`` (NULL where undefined) of the candidates of bounded curves.

    Rows within ``reach`` durations of a dip at any of ``phases`` are out (at the very border: if ``closed``). ``least``: rows
    that must be left; ``few`` says they are not. Every share of a curve's candidates gets the curve; a share holds up to SHARE candidates.
    """
    rows = lc.select("tic_id", "t_us", "t", "flux").where(finite(F.col("t"), F.col("flux")))
    plain = finite(F.col("period"), F.col("t0"), F.col("duration")) & (F.col("duration") > 0) & (2.002 * F.col("duration") < F.col("period"))
    info = cands.select(*dict.fromkeys([*ids, "tic_id", "period", "t0", "duration"])).where(plain)
    bounded = rows.groupBy("tic_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= CURVE_ROWS)
    held = info.groupBy("tic_id").agg(F.count(F.lit(1)).alias("_m")).join(bounded, "tic_id")
    held = materialize(held.select("tic_id", "_m"), "held")
    total = held.agg(F.sum("_m")).first()[0] or 1
    # every share brings its curve and indexes it: no more of them than keep all places for tasks busy
    parts = max(8 * lc.sparkSession.sparkContext.defaultParallelism, ceil(total / SHARE))
    shares = held.select("tic_id", F.ceil(F.col("_m") * parts / F.lit(total)).alias("_shares"))
    left = rows.join(shares, "tic_id").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1))).drop("_shares")
    right = info.join(shares, "tic_id").withColumn("_share", F.pmod(F.xxhash64(*ids), F.col("_shares"))).drop("_shares")
    schema = T.StructType([
        *[info.schema[c] for c in ids], T.StructField("settled", T.BooleanType()), T.StructField("few", T.BooleanType()),
        T.StructField("sigma", T.DoubleType()), T.StructField("binned", T.DoubleType()),
    ])
    names = list(ids)

    def evaluate(curve: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("duration", ignore_index=True)
        out = some[names].assign(settled=False, few=False, sigma=np.nan, binned=np.nan)
        if len(some) and len(curve) > 1:
            index = Curve(curve["t_us"].to_numpy(), curve["t"].to_numpy(), curve["flux"].to_numpy(float), values)
            p, t0, d = (some[c].to_numpy(float) for c in ("period", "t0", "duration"))
            long, results, start = index.t[-1] - index.t[0], [], 0
            while start < p.size:
                stop = start + max(1, int(GROUP_BINS // (2 + long / d[start])))
                part = slice(start, stop)
                results.append(index.scatter(p[part], t0[part], d[part], phases, closed, values, least, reach))
                start = stop
            for name, parts_of in zip(("settled", "few", "sigma", "binned"), zip(*results, strict=True), strict=True):
                out[name] = np.concatenate(parts_of)
        return out

    found = left.groupBy("tic_id", "_share").cogroup(right.groupBy("tic_id", "_share")).applyInPandas(evaluate, schema)
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("sigma", "binned")})
