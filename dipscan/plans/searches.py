"""Search queries: grids, single dips, box power, spectra, peaks, relations, sinusoids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SearchConfig
from ..operators import search as H
from ..operators import sequence as S
from ..operators import stats as A
from ..operators.detrend import DetrendConfig, detrend, flat_curve
from . import search_run as SR
from . import views as V
from .curves import CADENCE, FOLD, gapped, r, rs
from .registry import query
from .views import with_views

#: A grid coarse enough for the independent engine to repeat in full.
COARSE = SearchConfig(
    min_duration=0.1, max_duration=0.3, frequency_oversample=1.0, bin_minutes=30.0,
    bls_oversample=3, bands_per_decade=3,
)
EXTENT = "SELECT tic_id, min(t) AS t_min, max(t) AS t_max, max(t) - min(t) AS baseline, count(*) AS n FROM lc GROUP BY 1"


def baselines(spark, d):
    return A.extent(V.lc(spark, d)).select("tic_id", "baseline")


def search_grid(spark, d, config):
    return H.bands(baselines(spark, d), config)


# ---- grids
@query("duration_grid", with_views("lc", """
SELECT tic_id, i, round(0.5D / 24.0D * pow(1.2D, i), 12) AS duration FROM (SELECT DISTINCT tic_id FROM lc)
CROSS JOIN (SELECT unnest(range(18)) AS i)"""))
def duration_grid(spark, d):
    grid = F.array(*[F.lit(x) for x in H.duration_list(SearchConfig())])
    rows = V.lc(spark, d).select("tic_id").distinct().select("tic_id", F.posexplode(grid).alias("i", "duration"))
    return rows.select("tic_id", F.col("i").cast("long").alias("i"), r("duration", 12).alias("duration"))


def _band_sql(c: SearchConfig) -> dict[str, str]:
    """The banded grid in SQL, for a density-less search."""
    n_dur = len(H.duration_list(c))
    a_rs = "pow(6.6743e-11D * {rho} * 1409.8200988D * pow({p} * 86400.0D, 2) / (3.0D * pi()), 1.0D / 3.0D)"
    from ..config import RHO_SUN

    def central(p: str, rho: float) -> str:
        a = a_rs.format(rho=f"{rho}D", p=p).replace("1409.8200988D", f"{RHO_SUN!r}D")
        return f"({p} / pi() * asin(least(1.0D / {a}, 1.0D)))"

    base = c.bin_minutes / 1440.0
    return {
        "ext": EXTENT,
        "edges": f"""SELECT tic_id, baseline, band, nb,
  {c.min_period}D * pow(0.5D * baseline / {c.min_period}D, band / nb::DOUBLE) AS lo,
  CASE WHEN band = nb - 1 THEN 0.5D * baseline ELSE {c.min_period}D * pow(0.5D * baseline / {c.min_period}D, (band + 1) / nb::DOUBLE) END AS hi
  FROM (SELECT *, unnest(range(nb)) AS band FROM (SELECT *, greatest(1, CAST(ceil(log10(0.5D * baseline / {c.min_period}D) * {c.bands_per_decade}) AS INT)) AS nb FROM ext))""",
        "durs": f"""SELECT e.*, d.duration FROM edges e JOIN (SELECT {c.min_duration!r}D * pow({c.duration_ratio}D, unnest(range({n_dur}))) AS duration) d
  ON d.duration < 0.25D * lo
  AND d.duration >= greatest({c.min_duration!r}D, 0.3D * {central('lo', c.rho_max)}) / {c.duration_ratio}D
  AND d.duration <= least({c.max_duration!r}D, 1.2D * {central('hi', c.rho_min)}, 0.25D * lo) * (1 + 1e-9D)""",
        "grid": f"""SELECT tic_id, baseline, band, lo, hi, band = nb - 1 AS last, d_min, d_max, n_dur, ln_mean, n_steps,
  CASE WHEN band = nb - 1 THEN n_steps + 1 ELSE n_steps END AS n_trials,
  CASE WHEN {6 * base!r}D <= d_min / 3.0D THEN 6 WHEN {3 * base!r}D <= d_min / 3.0D THEN 3 WHEN {2 * base!r}D <= d_min / 3.0D THEN 2 ELSE 1 END AS factor
  FROM (SELECT tic_id, baseline, band, nb, lo, hi, min(duration) AS d_min, max(duration) AS d_max, count(*) AS n_dur, avg(ln(duration)) AS ln_mean,
    greatest(2, CAST(ceil(ln(hi / lo) / (min(duration) / ({c.frequency_oversample}D * baseline))) AS INT)) AS n_steps
    FROM durs GROUP BY tic_id, baseline, band, nb, lo, hi)""",
        "trials": "SELECT tic_id, band, k, exp(ln(lo) + (ln(hi) - ln(lo)) * (k / n_steps::DOUBLE)) AS period, d_min FROM (SELECT *, unnest(range(n_trials)) AS k FROM grid)",
    }


FULL = SearchConfig()


@query("period_bands", with_views("lc", """
SELECT tic_id, band, round(lo, 9) AS lo, round(hi, 9) AS hi, last, n_dur, round(d_min, 9) AS d_min, round(d_max, 9) AS d_max,
  n_trials, factor FROM grid""", **_band_sql(FULL)))
def period_bands(spark, d):
    g = search_grid(spark, d, FULL)
    return g.select("tic_id", "band", r("lo").alias("lo"), r("hi").alias("hi"), "last", F.size("durations").alias("n_dur"),
                    r(F.array_min("durations")).alias("d_min"), r(F.array_max("durations")).alias("d_max"),
                    "n_trials", "factor")


@query("trial_periods", with_views("lc", "SELECT tic_id, band, k, round(period, 9) AS period FROM trials", **_band_sql(FULL)))
def trial_periods(spark, d):
    return H.trial_periods(search_grid(spark, d, FULL)).withColumn("period", r("period"))


@query("effective_trials", with_views("lc", """
SELECT tic_id, round(n_eff, 2) AS n_eff, round(greatest(7.0D, sqrt(2.0D * ln(greatest(n_eff, 1.0D) / 0.01D))), 6) AS snr_threshold
FROM (SELECT tic_id, greatest(1.0D, sum(baseline / exp(ln_mean) * ln(top / lo) * (sqrt(lo * top) / exp(ln_mean)) * (1.0D + ln(d_max / d_min) / ln(2.0D)))) AS n_eff
  FROM (SELECT *, exp(ln(lo) + (ln(hi) - ln(lo)) * ((n_trials - 1) / n_steps::DOUBLE)) AS top FROM grid) GROUP BY tic_id)""",
    **_band_sql(FULL)))
def effective_trials(spark, d):
    out = H.detection_thresholds(search_grid(spark, d, FULL), FULL)
    return out.select("tic_id", r("n_eff", 2).alias("n_eff"), r("snr_threshold", 6).alias("snr_threshold"))


# ---- box power
@query("bls_power", with_views("lc", """
SELECT tic_id, band, k, round(period, 9) AS period, round(0.5D * max(gain), 6) AS power
FROM (SELECT b.*, CASE WHEN wy < 0 AND w > 1e-9D * tot AND tot - w > 1e-9D * tot THEN wy * wy / (w * (tot - w)) * tot ELSE 0.0D END AS gain
  FROM boxes b) GROUP BY tic_id, band, k, period""",
    **_band_sql(COARSE),
    pts="""SELECT tic_id, factor, avg(t) AS t, sum(flux / (flux_err * flux_err)) / sum(1.0D / (flux_err * flux_err)) AS y, sum(1.0D / (flux_err * flux_err)) AS w
      FROM lc JOIN (SELECT DISTINCT tic_id, factor FROM grid) USING (tic_id) JOIN (SELECT tic_id, t_min FROM ext) USING (tic_id)
      GROUP BY tic_id, factor, floor((t - t_min) / (factor * (30.0D / 1440.0D)))""",
    ref="SELECT tic_id, factor, min(t) AS t_ref, sum(w * y) / sum(w) AS mu, sum(w) AS tot FROM pts GROUP BY 1, 2",
    cells="""SELECT tr.tic_id, tr.band, tr.k, tr.period, tot, CAST(least(floor((t - t_ref - tr.period * floor((t - t_ref) / tr.period)) / (d_min / 3)), ceil(tr.period / (d_min / 3)) - 1) AS INT) AS c,
      sum(w) AS w, sum(w * (y - mu)) AS wy
      FROM (SELECT trials.*, factor FROM trials JOIN grid USING (tic_id, band)) tr JOIN pts USING (tic_id, factor) JOIN ref USING (tic_id, factor) GROUP BY ALL""",
    wrapped="""SELECT * FROM cells UNION ALL SELECT tic_id, band, k, period, tot, CAST(c + ceil(period / (d_min / 3)) AS INT), w, wy
      FROM cells JOIN (SELECT tic_id, band, d_min, max(CAST(round_even(duration / (d_min / 3), 0) AS INT)) AS widest FROM durs JOIN grid USING (tic_id, band) GROUP BY 1, 2, 3) USING (tic_id, band)
      WHERE c < widest""",
    starts="SELECT tic_id, band, k, period, tot, unnest(range(n)) AS c FROM (SELECT trials.*, tot, CAST(ceil(period / (trials.d_min / 3)) AS INT) AS n FROM trials JOIN grid USING (tic_id, band) JOIN ref USING (tic_id, factor))",
    spans="SELECT DISTINCT tic_id, band, CAST(round_even(duration / (d_min / 3), 0) AS INT) AS span FROM durs JOIN grid USING (tic_id, band)",
    boxes="""SELECT s.tic_id, s.band, s.k, s.period, s.tot, spans.span, s.c, sum(q.w) AS w, sum(q.wy) AS wy
      FROM starts s JOIN spans USING (tic_id, band) JOIN wrapped q ON q.tic_id = s.tic_id AND q.band = s.band AND q.k = s.k AND q.c >= s.c AND q.c < s.c + span GROUP BY ALL"""))
def bls_power(spark, d):
    lc = V.lc(spark, d)
    out = H.bls(lc, search_grid(spark, d, COARSE), COARSE)
    return out.select("tic_id", "band", "k", r("period").alias("period"), r("power", 6).alias("power"))


@query("top_dip_per_target")
def top_dip_per_target(spark, d):
    """Which targets show a periodic dip, and at what period: the best peak of each spectrum."""
    lc = V.lc(spark, d)
    curves = A.curve_stats(lc)
    power = H.bls(lc, H.bands(curves.select("tic_id", "baseline"), COARSE), COARSE)
    power = SR.materialize(power, "power")
    spectrum = H.sde_spectrum(H.eligible_trials(lc, power, curves))
    best = spectrum.where("eligible").groupBy("tic_id").agg(
        F.max(F.struct("sde", "period", "duration", "t0", "depth", "power")).alias("b")
    )
    return best.select("tic_id", "b.*")


ELIGIBLE = """
SELECT cand_id AS k, tic_id, period <= safe OR coalesce(n, 0) >= 2 AS eligible
FROM cands JOIN info USING (tic_id) LEFT JOIN hits USING (tic_id, cand_id)"""
ELIGIBLE_STEPS = dict(
    cad=CADENCE, ext=EXTENT,
    info="""SELECT tic_id, t_min, t_max, cadence, (baseline - dmax) / 2.0D AS safe FROM ext JOIN cad USING (tic_id)
      JOIN (SELECT tic_id, max(duration) AS dmax FROM cands GROUP BY 1) USING (tic_id)""",
    cells="SELECT tic_id, CAST(floor((t - t_min) / cadence) AS BIGINT) AS cell, count(*) AS c FROM lc JOIN info USING (tic_id) GROUP BY 1, 2",
    spots="""SELECT cand_id, tic_id, duration, cadence, CAST(trunc(greatest((m - duration / 2.0D - t_min) / cadence, 0.0D)) AS BIGINT) AS lo,
      CAST(trunc(greatest((m + duration / 2.0D - t_min) / cadence, 0.0D)) AS BIGINT) AS hi
      FROM (SELECT *, t0 + e * period AS m FROM (SELECT *, unnest(range(CAST(ceil((t_min - t0) / period) AS BIGINT), CAST(floor((t_max - t0) / period) AS BIGINT) + 1)) AS e
        FROM cands JOIN info USING (tic_id)))""",
    hits="""SELECT tic_id, cand_id, count(*) FILTER (c >= 0.5D * duration / cadence) AS n FROM (
      SELECT s.tic_id, cand_id, duration, cadence, s.lo, s.hi, coalesce(sum(c), 0) AS c FROM spots s
      LEFT JOIN cells ON cells.tic_id = s.tic_id AND cell >= lo AND cell < hi GROUP BY ALL) GROUP BY 1, 2""",
)


@query("eligible_trials", with_views("lc cands", ELIGIBLE, **ELIGIBLE_STEPS))
def eligible_trials(spark, d):
    lc = V.lc(spark, d)
    trials = V.cands(spark, d).select("tic_id", F.lit(0).alias("band"), F.col("cand_id").alias("k"), "period", "t0", "duration")
    return H.eligible_trials(lc, trials, A.curve_stats(lc), max_gap=5.0).select("tic_id", "k", "eligible")


@query("eligible_of_every_signal", with_views("lc signals", ELIGIBLE, cands=V.EVERY_SIGNAL, **ELIGIBLE_STEPS))
def eligible_of_every_signal(spark, d):
    lc = V.lc(spark, d)
    trials = V.every_signal(spark, d).select("tic_id", F.lit(0).alias("band"), F.col("cand_id").alias("k"), "period", "t0", "duration")
    return H.eligible_trials(lc, trials, A.curve_stats(lc), max_gap=5.0).select("tic_id", "k", "eligible")


@query("sde_spectrum", with_views("signals", """
SELECT cand_id, tic_id, round((resid - m) / CASE WHEN s > 0 THEN s ELSE 1.0D END, 6) AS sde FROM (
  SELECT *, avg(CASE WHEN ref OR n < 10 THEN resid END) OVER (PARTITION BY tic_id) AS m,
    stddev_pop(CASE WHEN ref OR n < 10 THEN resid END) OVER (PARTITION BY tic_id) AS s
  FROM (SELECT p.*, s0 - CASE WHEN n < 10 THEN 0.0D WHEN coalesce(len(kx), 0) < 2 THEN flat
      WHEN pos_ = 0 THEN ky[1] WHEN pos_ = len(kx) THEN ky[pos_]
      ELSE ky[pos_] + (ky[pos_ + 1] - ky[pos_]) * (lp - kx[pos_]) / (kx[pos_ + 1] - kx[pos_]) END AS resid
    FROM placed p))""",
    base="""SELECT cand_id, tic_id, n_transits >= 2 AS eligible, sqrt(2.0D * snr) AS s0, log10(period) AS lp FROM signals""",
    info="""SELECT *, (nref < 10 OR eligible) AS ref,
      CASE WHEN hi = lo THEN 0 ELSE least(greatest(floor((lp - lo) / ((hi - lo) / greatest(3.0D, round_even((hi - lo) * 5, 0)))), 0), greatest(3.0D, round_even((hi - lo) * 5, 0)) - 1) END AS bin
      FROM (SELECT *, count(*) OVER (PARTITION BY tic_id) AS n, count(*) FILTER (eligible) OVER (PARTITION BY tic_id) AS nref,
        min(lp) OVER (PARTITION BY tic_id) AS lo, max(lp) OVER (PARTITION BY tic_id) AS hi FROM base)""",
    knots="""SELECT tic_id, list(x ORDER BY x) AS kx, list(y ORDER BY x) AS ky FROM (SELECT tic_id, bin, median(lp) AS x, median(s0) AS y
      FROM info WHERE ref GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY 1""",
    placed="""SELECT info.*, kx, ky, flat, len(list_filter(kx, lambda x: x <= lp)) AS pos_ FROM info LEFT JOIN knots USING (tic_id)
      LEFT JOIN (SELECT tic_id, median(s0) AS flat FROM info WHERE ref GROUP BY 1) USING (tic_id)"""))
def sde_spectrum(spark, d):
    rows = V.signals(spark, d).select("cand_id", "tic_id", "period", F.col("snr").alias("power"),
                                      (F.col("n_transits") >= 2).alias("eligible"))
    return H.sde_spectrum(rows, 5).select("cand_id", "tic_id", r("sde", 6).alias("sde"))


@query("harmonic_family", with_views("signals", """
SELECT p.tic_id, p.period, max(p.power) AS power, coalesce((max({'a': s.power, 'b': s.period}) FILTER (s.power IS NOT NULL)).b, p.period) AS best_period,
  coalesce((max({'a': s.power, 'b': s.period}) FILTER (s.power IS NOT NULL)).a, max(p.power)) AS best_power
FROM peaks p CROSS JOIN (SELECT unnest([3.0D, 2.0D, 0.5D, 1.0D / 3.0D]) AS ratio) LEFT JOIN spec s
  ON s.tic_id = p.tic_id AND s.period >= p.period / ratio * (1.0D - 0.003D) AND s.period < p.period / ratio * (1.0D + 0.003D) AND s.power > 1.2D * p.power
GROUP BY p.tic_id, p.period""",
    spec="SELECT tic_id, period, snr AS power FROM signals",
    peaks="SELECT tic_id, period, power FROM (SELECT *, row_number() OVER (PARTITION BY tic_id ORDER BY power, period) AS rn FROM spec) WHERE rn = 1"))
def harmonic_family(spark, d):
    spec = V.signals(spark, d).select("tic_id", "period", F.col("snr").alias("power"))
    peaks = spec.groupBy("tic_id").agg(F.min(F.struct("power", "period")).alias("m")).select("tic_id", "m.period", "m.power")
    return H.harmonic_family(peaks, spec)


def _greedy(rows: str, period: str) -> str:
    """Recursive SQL: the first of each star's list (by ``rk``) stays and drops those within a percent of it."""
    return f"""SELECT tic_id, unnest(kept) AS rk FROM (WITH RECURSIVE g AS (
      SELECT tic_id, list({{'rk': rk, 'p': {period}}} ORDER BY rk) AS todo, []::BIGINT[] AS kept FROM {rows} GROUP BY tic_id
      UNION ALL SELECT tic_id, list_filter(todo[2:], lambda x: NOT abs(x.p - todo[1].p) < 0.01D * todo[1].p), list_append(kept, todo[1].rk)
      FROM g WHERE len(todo) > 0)
      SELECT tic_id, kept FROM g WHERE len(todo) = 0)"""


@query("peak_examination", with_views("signals", """
SELECT tic_id, CAST(row_number() OVER (PARTITION BY tic_id ORDER BY sde DESC, period, top_period) AS INTEGER) AS rank, top_period, period
FROM fam JOIN once USING (tic_id, rk)""",
    elig="SELECT tic_id, period, snr AS power, sde, row_number() OVER (PARTITION BY tic_id ORDER BY sde DESC, period DESC) AS rk FROM signals WHERE n_transits >= 2",
    first=_greedy("elig", "period"),
    tops="SELECT tic_id, period, any_value(power) AS power, any_value(sde) AS sde FROM elig JOIN first USING (tic_id, rk) GROUP BY 1, 2",
    best="""SELECT p.tic_id, p.period, max({'a': s.snr, 'b': s.period}) AS m FROM tops p CROSS JOIN (SELECT unnest([3.0D, 2.0D, 0.5D, 1.0D / 3.0D]) AS ratio) JOIN signals s
      ON s.tic_id = p.tic_id AND s.period >= p.period / ratio * (1.0D - 0.003D) AND s.period < p.period / ratio * (1.0D + 0.003D) AND s.snr > 1.2D * p.power GROUP BY 1, 2""",
    fam="""SELECT tic_id, tops.period AS top_period, coalesce(m.b, tops.period) AS period, sde,
      row_number() OVER (PARTITION BY tic_id ORDER BY sde DESC, coalesce(m.b, tops.period) DESC, tops.period DESC) AS rk FROM tops LEFT JOIN best USING (tic_id, period)""",
    once=_greedy("fam", "period")))
def peak_examination(spark, d):
    """Every star's candidates taken as its spectrum, in the order they deserve a look."""
    rows = V.signals(spark, d).select("tic_id", "period", "t0", "duration", "depth", F.col("snr").alias("power"), "sde",
                                      (F.col("n_transits") >= 2).alias("eligible"))
    return H.examine_peaks(rows).select("tic_id", "rank", "top_period", "period")


# ---- single dips
EVENT_STEPS = dict(
    cad=CADENCE, ext=EXTENT,
    lev="SELECT tic_id, median(flux) AS lev FROM lc GROUP BY 1",
    scad="""SELECT tic_id, sector, median(dt) / 86400000000.0D AS cadence FROM (SELECT tic_id, sector,
      t_us - lag(t_us) OVER (PARTITION BY tic_id, sector ORDER BY t_us) AS dt FROM lc) WHERE dt IS NOT NULL GROUP BY 1, 2""",
    ds="SELECT unnest([0.15D, 0.3D]) AS duration",
    means="""SELECT tic_id, sector, duration, avg(flux) AS m, count(*) AS c FROM lc CROSS JOIN ds
      JOIN (SELECT tic_id, sector, min(t) AS x0 FROM lc GROUP BY 1, 2) USING (tic_id, sector) GROUP BY tic_id, sector, duration, floor((t - x0) / duration)""",
    sig="""SELECT tic_id, sector, duration, 1.4826D * median(abs(m - mm)) AS sigma FROM (
      SELECT means.*, median(m) OVER (PARTITION BY tic_id, sector, duration) AS mm FROM means JOIN scad USING (tic_id, sector)
      WHERE c >= 0.5D * greatest(duration / cadence, 1.0D)) GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
    centres="""SELECT ext.tic_id, duration, k, t_min, t_max, cadence, lev, t_min + k * (duration / 4.0D) AS c FROM ext JOIN cad USING (tic_id) JOIN lev USING (tic_id) CROSS JOIN ds,
      LATERAL (SELECT unnest(range(CAST(ceil((t_max - t_min) / (duration / 4.0D)) AS BIGINT))) AS k)""",
    pts="SELECT lc.tic_id, duration, sector, t, lev - flux AS y, CAST(floor((t - t_min) / (duration / 4.0D)) AS BIGINT) AS q FROM lc JOIN ext USING (tic_id) JOIN lev USING (tic_id) CROSS JOIN ds",
    sums="""SELECT c.tic_id, c.duration, c.k, c.c, cadence, coalesce(sum(y), 0) AS y, count(y) AS n FROM centres c LEFT JOIN pts p
      ON p.tic_id = c.tic_id AND p.duration = c.duration AND p.q BETWEEN c.k - 2 AND c.k + 1 GROUP BY ALL""",
    sect="""SELECT c.tic_id, c.duration, c.k, coalesce(min_by(sector, t) FILTER (p.q >= c.k), max_by(sector, t)) AS sector
      FROM centres c JOIN pts p ON p.tic_id = c.tic_id AND p.duration = c.duration GROUP BY 1, 2, 3""",
    box="""SELECT *, CASE WHEN n >= 0.5D * e AND err > 0 THEN y / n / err ELSE -1e9D END AS snr, CASE WHEN n >= 0.5D * e AND err > 0 THEN y / n ELSE 0.0D END AS depth
      FROM (SELECT s.*, greatest(duration / cadence, 1.0D) AS e, sigma * sqrt(greatest(duration / cadence, 1.0D) / greatest(n, 1)) AS err
        FROM sums s JOIN sect USING (tic_id, duration, k) LEFT JOIN sig USING (tic_id, sector, duration))""",
    peaks="""SELECT tic_id, duration, k, c AS time, depth, snr, row_number() OVER (PARTITION BY tic_id, duration ORDER BY snr DESC, k) AS rk FROM (
      SELECT *, lag(snr) OVER w AS l, lead(snr) OVER w AS rr FROM box WINDOW w AS (PARTITION BY tic_id, duration ORDER BY k))
      WHERE snr > l AND snr >= rr AND snr >= 2.5D""",
)


def _greedy(source: str, keys: str, at: str, reach: str, name: str) -> dict[str, str]:
    """Sequential suppression as a recursive query over rank within the key."""
    on = " AND ".join(f"g.{k} = n.{k}" for k in keys.split(", "))
    return {
        name: f"""SELECT * FROM (WITH RECURSIVE g AS (
      SELECT {keys}, 0::BIGINT AS step, []::STRUCT(a DOUBLE, w DOUBLE)[] AS kept FROM {source} GROUP BY {keys}
      UNION ALL SELECT {', '.join('g.' + k for k in keys.split(', '))}, n.rk, CASE WHEN len(list_filter(kept, lambda x: abs(x.a - n.{at}) < greatest(x.w, {reach}))) = 0
        THEN list_append(kept, {{'a': n.{at}::DOUBLE, 'w': ({reach})::DOUBLE}}) ELSE kept END
      FROM g JOIN {source} n ON {on} AND n.rk = g.step + 1)
      SELECT {keys}, unnest(arg_max(kept, step)) AS e FROM g GROUP BY {keys})""",
    }


@query("single_events", with_views("lc", """
SELECT p.tic_id, round(p.time, 6) AS time, p.duration, round(p.depth, 8) AS depth, round(p.snr, 6) AS snr
FROM kept JOIN ranked p ON p.tic_id = kept.tic_id AND p.time = kept.e.a AND p.duration = kept.e.w""",
    **EVENT_STEPS, **_greedy("peaks", "tic_id, duration", "k", "4.0D", "first_kept"),
    ranked="""SELECT p.tic_id, p.duration, p.time, p.depth, p.snr, row_number() OVER (PARTITION BY p.tic_id ORDER BY p.snr DESC, p.time) AS rk
      FROM peaks p JOIN first_kept f ON f.tic_id = p.tic_id AND f.duration = p.duration AND f.e.a = p.k""",
    **_greedy("ranked", "tic_id", "time", "n.duration", "kept")))
def single_events(spark, d):
    lc = V.lc(spark, d)
    out = H.single_events(lc, A.curve_stats(lc), [0.15, 0.3], 2.5)
    return out.select("tic_id", r("time", 6).alias("time"), "duration", r("depth", 8).alias("depth"), r("snr", 6).alias("snr"))


@query("edge_events")
def edge_events(spark, d):
    lc = gapped(spark, d)
    cfg = SearchConfig(edge_event_sigma=2.0, min_duration=0.15, max_duration=0.3, duration_ratio=2.0, edge_gap=0.1)
    return H.edge_events(lc, A.curve_stats(lc), cfg)


@query("event_coverage", with_views("lc cands", """
SELECT e.tic_id, e.time, round(count(*) FILTER (abs(t - time) < duration / 2) / any_value(x), 6) AS inside,
  round(count(*) FILTER (t - time < -duration / 2) / any_value(x), 6) AS before, round(count(*) FILTER (t - time > duration / 2) / any_value(x), 6) AS after
FROM (SELECT DISTINCT tic_id, t0 AS time, 0.5D AS duration, 0.5D / cadence AS x FROM cands JOIN cad USING (tic_id)) e
LEFT JOIN lc ON lc.tic_id = e.tic_id AND abs(t - time) < 1.5D * duration GROUP BY 1, 2""", cad=CADENCE))
def event_coverage(spark, d):
    lc = V.lc(spark, d)
    events = V.cands(spark, d).select("tic_id", F.col("t0").alias("time"), F.lit(0.5).alias("duration")).distinct()
    out = H.event_coverage(lc, events, A.cadence(lc))
    return out.select("tic_id", "time", *[r(c, 6).alias(c) for c in ("inside", "before", "after")])


@query("greedy_suppression", with_views("known", """
SELECT n.tic_id, n.ord FROM kept k JOIN ranked n ON n.tic_id = k.tic_id AND n.rk = k.e.w - 1000.0D""",
    ranked="SELECT tic_id, ord, t0, period, row_number() OVER (PARTITION BY tic_id ORDER BY ord DESC, t0) AS rk FROM known",
    kept="""SELECT tic_id, e FROM (WITH RECURSIVE g AS (
      SELECT tic_id, 0::BIGINT AS step, []::STRUCT(a DOUBLE, p DOUBLE, w DOUBLE)[] AS kept FROM ranked GROUP BY tic_id
      UNION ALL SELECT g.tic_id, n.rk, CASE WHEN len(list_filter(kept, lambda x: abs(x.a - n.t0) < greatest(x.p, n.period) / 10.0D)) = 0
        THEN list_append(kept, {'a': n.t0, 'p': n.period, 'w': n.rk + 1000.0D}) ELSE kept END
      FROM g JOIN ranked n ON g.tic_id = n.tic_id AND n.rk = g.step + 1)
      SELECT tic_id, unnest(arg_max(kept, step)) AS e FROM g GROUP BY tic_id)"""))
def greedy_suppression(spark, d):
    rows = V.known(spark, d).select("tic_id", "ord", "t0", "period")
    return S.suppress(rows, ["tic_id"], "t0", F.col("period") / 10.0, "ord").select("tic_id", "ord")


@query("event_dedup", with_views("known", """
SELECT tic_id, max(n) AS n, arg_max(t0, e) AS time, arg_max(period, e) AS duration FROM (
  SELECT tic_id, t0, period, round_even(t0, 4) AS k, (ord % 3, t0, period) AS e,
    count(*) OVER (PARTITION BY tic_id, round_even(t0, 4)) AS n FROM known) GROUP BY tic_id, k"""))
def event_dedup(spark, d):
    rows = V.known(spark, d).select("tic_id", F.col("t0").alias("time"), F.col("period").alias("duration"),
                                    F.lit(0.0).alias("depth"), F.lit(0.0).alias("snr"), (F.col("ord") % 3).alias("pass"))
    counts = rows.groupBy("tic_id", F.bround("time", 4).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    out = SR.distinct_events(rows).withColumn("_k", F.bround("time", 4))
    return out.join(counts, ["tic_id", "_k"]).select("tic_id", "time", "duration", "n")


# ---- statistics of signals
NEAR = f"SELECT c.cand_id, lc.*, period, t0, duration, depth, {FOLD} AS dt, round_even((t - t0) / period, 0) AS epoch FROM cands c JOIN lc USING (tic_id)"


@query("transits_with_data", with_views("lc cands", """
SELECT cand_id, coalesce(n, 0) AS n_transits FROM cands LEFT JOIN (
  SELECT cand_id, count(*) AS n FROM (SELECT cand_id, epoch, count(*) AS c, any_value(greatest(1.0D, 0.5D * greatest(duration / cadence, 1.0D))) AS need
    FROM nr JOIN cad USING (tic_id) WHERE abs(dt) < 0.5D * duration GROUP BY 1, 2) WHERE c >= need GROUP BY 1) USING (cand_id)""",
    cad=CADENCE, nr=NEAR))
def transits_with_data(spark, d):
    lc = V.lc(spark, d)
    return H.transits_with_data(lc, V.cands(spark, d), A.curve_stats(lc))


RED_NOISE = """
SELECT cand_id, round(any_value(depth) / (1.4826D * median(abs(m - mm)) / sqrt(3.0D)), 5) AS snr
FROM (SELECT b.*, median(m) OVER (PARTITION BY cand_id) AS mm FROM b JOIN ocad USING (cand_id) WHERE c >= 0.5D * greatest(duration / cadence, 1.0D))
GROUP BY cand_id HAVING count(*) >= 3 AND median(abs(m - mm)) > 0
UNION ALL SELECT cand_id, NULL FROM cands WHERE cand_id NOT IN (SELECT cand_id FROM b JOIN ocad USING (cand_id) WHERE c >= 0.5D * greatest(duration / cadence, 1.0D) GROUP BY 1 HAVING count(*) >= 3)"""
RED_STEPS = dict(
    nr=NEAR, oot="SELECT * FROM nr WHERE NOT abs(dt) < duration",
    ocad="SELECT cand_id, median(x) / 86400000000.0D AS cadence FROM (SELECT cand_id, t_us - lag(t_us) OVER (PARTITION BY cand_id ORDER BY t_us) AS x FROM oot) WHERE x IS NOT NULL GROUP BY 1",
    b="SELECT cand_id, any_value(duration) AS duration, any_value(depth) AS depth, avg(flux) AS m, count(*) AS c FROM oot JOIN (SELECT cand_id, min(t) AS x0 FROM oot GROUP BY 1) USING (cand_id) GROUP BY cand_id, floor((t - x0) / duration)",
)


@query("red_noise_snr", with_views("lc cands", RED_NOISE, **RED_STEPS))
def red_noise_snr(spark, d):
    cands = V.cands(spark, d).withColumn("n_transits", F.lit(3))
    return H.red_noise_snr(V.lc(spark, d), cands).withColumn("snr", r("snr", 5))


@query("red_noise_of_every_signal", with_views("lc signals", RED_NOISE, cands=V.EVERY_SIGNAL, **RED_STEPS))
def red_noise_of_every_signal(spark, d):
    cands = V.every_signal(spark, d).withColumn("n_transits", F.lit(3))
    return H.red_noise_snr(V.lc(spark, d), cands).withColumn("snr", r("snr", 5))


@query("folded_brightening", with_views("lc cands", """
SELECT cand_id, round(max(CASE WHEN j = 0 THEN -sg END), 6) AS dip,
  round(max(CASE WHEN j * s >= reach AND j * s <= period - reach THEN sg END), 6) AS bright
FROM (SELECT m.*, least(2.0D * duration, period / 2 - duration) AS reach, (wy / w - lev) * sqrt(w) AS sg
  FROM m JOIN (SELECT cand_id, median(wy / w) AS lev, count(*) AS nb FROM m GROUP BY 1) USING (cand_id)) GROUP BY cand_id
HAVING count(*) >= 2 AND max(CASE WHEN j = 0 THEN 1 END) = 1
UNION ALL SELECT cand_id, NULL, NULL FROM cands WHERE cand_id NOT IN (SELECT cand_id FROM m WHERE j = 0)""",
    nr=NEAR, u="SELECT cand_id, period, duration, 0.2D * duration AS s, 1.0D / (flux_err * flux_err) AS w, flux, (t - t0) - period * floor((t - t0) / period) AS u FROM nr",
    c3="SELECT cand_id, period, duration, s, w, flux, u FROM u UNION ALL SELECT cand_id, period, duration, s, w, flux, u - period FROM u WHERE u > period - duration / 2 - s UNION ALL SELECT cand_id, period, duration, s, w, flux, u + period FROM u WHERE u < duration / 2 + s",
    q="SELECT cand_id, period, duration, s, CAST(floor(u / s + 0.5D) AS BIGINT) AS j, sum(w) AS w, sum(w * flux) AS wy FROM c3 GROUP BY ALL",
    js="SELECT cand_id, period, duration, 0.2D * duration AS s, unnest(range(CAST(ceil(period / (0.2D * duration)) AS BIGINT))) AS j FROM cands",
    m="SELECT js.cand_id, js.period, js.duration, js.s, js.j, sum(q.w) AS w, sum(q.wy) AS wy FROM js JOIN q ON q.cand_id = js.cand_id AND q.j BETWEEN js.j - 2 AND js.j + 2 GROUP BY ALL"))
def folded_brightening(spark, d):
    out = H.folded_brightening(V.lc(spark, d), V.cands(spark, d))
    return out.select("cand_id", r("dip", 6).alias("dip"), r("bright", 6).alias("bright"))


@query("signal_stats", with_views("lc cands", """
SELECT cand_id, round((Y - y) / (W - w) - y / w, 9) AS depth, round(sqrt(1 / w + 1 / (W - w)), 9) AS depth_err,
  round((Y - y) / (W - w) - yo / wo, 9) AS depth_odd, round((Y - y) / (W - w) - ye / we, 9) AS depth_even, n_times
FROM (SELECT cand_id, tic_id, sum(iw) AS w, sum(iw * flux) AS y, sum(iw) FILTER (epoch % 2 <> 0) AS wo, sum(iw * flux) FILTER (epoch % 2 <> 0) AS yo,
  sum(iw) FILTER (epoch % 2 = 0) AS we, sum(iw * flux) FILTER (epoch % 2 = 0) AS ye, CAST(count(DISTINCT epoch) AS INT) AS n_times
  FROM (SELECT *, 1.0D / (flux_err * flux_err) AS iw FROM nr WHERE abs(dt) < 0.5D * duration) GROUP BY 1, 2)
JOIN (SELECT tic_id, sum(1.0D / (flux_err * flux_err)) AS W_, sum(flux / (flux_err * flux_err)) AS Y_ FROM lc GROUP BY 1) USING (tic_id)""".replace("(Y - y)", "(Y_ - y)").replace("(W - w)", "(W_ - w)"),
    nr=NEAR))
def signal_stats(spark, d):
    lc = V.lc(spark, d)
    out = H.signal_stats(lc, V.cands(spark, d), A.curve_stats(lc))
    return out.select("cand_id", *[r(c).alias(c) for c in ("depth", "depth_err", "depth_odd", "depth_even")],
                      F.size("transit_times").alias("n_times"))


@query("refine_peak")
def refine_peak(spark, d):
    lc = V.lc(spark, d)
    peaks = V.planted(spark, d).withColumn("grid_step", F.lit(0.001))
    return H.refine(lc, peaks, SearchConfig(), A.curve_stats(lc))


# ---- relations
def numbered_signals(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("tic_id").orderBy("cand_id")
    return V.signals(spark, d).withColumn("iteration", F.row_number().over(w))


NUMBERED = "SELECT cand_id, tic_id, period, t0, duration, n_transits, row_number() OVER (PARTITION BY tic_id ORDER BY cand_id) AS iteration FROM signals"


@query("harmonic_relation", with_views("signals", """
SELECT a.tic_id, a.iteration, min(b.iteration) AS harmonic_of FROM s a JOIN s b ON a.tic_id = b.tic_id AND b.iteration < a.iteration
WHERE ((round_even(a.period / b.period, 0) BETWEEN 1 AND 10 AND abs(a.period / b.period - round_even(a.period / b.period, 0)) < 0.002D * round_even(a.period / b.period, 0))
    OR (round_even(b.period / a.period, 0) BETWEEN 1 AND 10 AND abs(b.period / a.period - round_even(b.period / a.period, 0)) < 0.002D * round_even(b.period / a.period, 0)))
  AND abs((a.t0 - b.t0 + 0.5D * least(a.period, b.period)) - least(a.period, b.period) * floor((a.t0 - b.t0 + 0.5D * least(a.period, b.period)) / least(a.period, b.period)) - 0.5D * least(a.period, b.period)) < greatest(a.duration, b.duration)
GROUP BY 1, 2""", s=NUMBERED))
def harmonic_relation(spark, d):
    out = H.harmonic_relations(numbered_signals(spark, d))
    return out.select("tic_id", "iteration", "harmonic_of")


@query("same_period_relation", with_views("signals", """
SELECT tic_id, iteration, min(earlier) AS secondary_of, round(min_by(c / p, earlier), 9) AS phase_offset FROM (
  SELECT m.tic_id, m.iteration, m.earlier, m.p, m.w, m.c FROM medoid m JOIN ph USING (tic_id, iteration, earlier)
  GROUP BY ALL HAVING min(least(x, m.p - x)) >= m.w AND max(abs((x - m.c + 0.5D * m.p) - m.p * floor((x - m.c + 0.5D * m.p) / m.p) - 0.5D * m.p)) < m.w)
GROUP BY 1, 2""",
    s=NUMBERED,
    ph="""SELECT a.tic_id, a.iteration, b.iteration AS earlier, b.period AS p, greatest(a.duration, b.duration) AS w, i,
      (a.t0 + i * a.period - b.t0) - b.period * floor((a.t0 + i * a.period - b.t0) / b.period) AS x
      FROM s a JOIN s b ON a.tic_id = b.tic_id AND b.iteration < a.iteration AND round_even(b.period / a.period, 0) BETWEEN 1 AND 3
        AND abs(b.period / a.period - round_even(b.period / a.period, 0)) < 0.002D * round_even(b.period / a.period, 0), LATERAL (SELECT unnest(range(greatest(a.n_transits, 1))) AS i)""",
    medoid="""SELECT tic_id, iteration, earlier, any_value(p) AS p, any_value(w) AS w, min_by(x, {'c': round(cost, 9), 'i': i}) AS c FROM (
      SELECT a.tic_id, a.iteration, a.earlier, a.p, a.w, a.i, a.x, sum(abs((b.x - a.x + 0.5D * a.p) - a.p * floor((b.x - a.x + 0.5D * a.p) / a.p) - 0.5D * a.p)) AS cost
      FROM ph a JOIN ph b USING (tic_id, iteration, earlier) GROUP BY ALL) GROUP BY 1, 2, 3"""))
def same_period_relation(spark, d):
    rows = numbered_signals(spark, d).withColumn(
        "transit_times",
        F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_transits"), F.lit(1)) - 1), lambda i: F.col("t0") + i * F.col("period")),
    )
    return H.same_period_relations(rows).withColumn("phase_offset", r("phase_offset"))


# ---- sinusoids
@query("sine_spectrum", with_views("lc", """
SELECT tic_id, round(freq, 9) AS freq, round((ss * qc * qc + cc * qs * qs - 2 * cs * qc * qs) / (yy * (cc * ss - cs * cs)), 6) AS power
FROM (SELECT tic_id, freq, avg(y * y) - avg(y) * avg(y) AS yy, avg(y * c) - avg(y) * avg(c) AS qc, avg(y * s) - avg(y) * avg(s) AS qs,
    avg(c * c) - avg(c) * avg(c) AS cc, avg(s * s) - avg(s) * avg(s) AS ss, avg(c * s) - avg(c) * avg(s) AS cs
  FROM (SELECT tic_id, freq, y, cos(2 * pi() * freq * x) AS c, sin(2 * pi() * freq * x) AS s FROM (
    SELECT p.tic_id, y, t - t1 AS x, f0 + k * df AS freq FROM pts p JOIN g USING (tic_id) JOIN (SELECT tic_id, min(t) AS t1 FROM pts GROUP BY 1) USING (tic_id),
      LATERAL (SELECT unnest(range(n)) AS k))) GROUP BY 1, 2)""",
    ext=EXTENT,
    pts="SELECT tic_id, avg(t) AS t, sum(flux / (flux_err * flux_err)) / sum(1.0D / (flux_err * flux_err)) - 1.0D AS y FROM lc JOIN ext USING (tic_id) GROUP BY tic_id, floor((t - t_min) / (30.0D / 1440.0D))",
    g="SELECT tic_id, 2.0D / baseline AS f0, 1.0D / (5.0D * baseline) AS df, CAST(ceil((1.0D / 1.0D - 2.0D / baseline) / (1.0D / (5.0D * baseline))) AS BIGINT) AS n FROM ext"))
def sine_spectrum(spark, d):
    out = H.sine_spectrum(V.lc(spark, d), min_period=1.0)
    return out.select("tic_id", r("freq").alias("freq"), r("power", 6).alias("power"))


@query("rotation_period")
def rotation_period(spark, d):
    return H.rotation_period(V.lc(spark, d))


def _sines_sql(keys: str, shortest: float, longest: float, per_peak: float, rows: str) -> dict[str, str]:
    """Every frequency of every key by direct sums over ``rows``, the strongest (``top``), and what its bound needs."""
    return {
        "src": rows,
        "about": f"SELECT {keys}, min(t) AS t1, max(t) - min(t) AS b, count(*) AS n, stddev_pop(t) AS sd, avg(flux) AS mean FROM src GROUP BY ALL",
        "grid": f"""SELECT {keys}, k, 1.0D / {longest}D + k / ({per_peak}D * b) AS freq FROM about,
      LATERAL (SELECT unnest(range(1 + CAST(floor((1.0D / {shortest}D - 1.0D / {longest}D) * {per_peak}D * b + 0.5D) AS BIGINT))) AS k)""",
        "sums": f"""SELECT {keys}, freq, avg(y * y) AS yy, avg(y * c) AS qc, avg(y * s) AS qs, avg(c * c) - avg(c) * avg(c) AS cc,
      avg(s * s) - avg(s) * avg(s) AS ss, avg(c * s) - avg(c) * avg(s) AS cs
      FROM (SELECT {keys}, freq, flux - mean AS y, cos(2 * pi() * freq * (t - t1)) AS c, sin(2 * pi() * freq * (t - t1)) AS s
        FROM src JOIN about USING ({keys}) JOIN grid USING ({keys})) GROUP BY ALL""",
        "spectrum": f"SELECT *, (ss * qc * qc + cc * qs * qs - 2 * cs * qc * qs) / (yy * (cc * ss - cs * cs)) AS power FROM sums",
        "top": f"""SELECT *, 1.0D / freq AS sine_period, sqrt(pow(qc * ss - qs * cs, 2) + pow(qs * cc - qc * cs, 2)) / (cc * ss - cs * cs) * 1e6D AS amplitude_ppm
      FROM spectrum JOIN about USING ({keys}) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY power DESC, freq) = 1""",
    }


#: Bound on the false-alarm probability, {f} being the highest frequency.
_FAP = """(1.0D - (1.0D - pow(1.0D - power, 0.5D * (n - 3))) * exp(-(1.0D - 0.75D / (n - 1)) * ({f}) * sd * sqrt(4 * pi())
  * pow(1.0D - power, 0.5D * (n - 4)) * sqrt(0.5D * (n - 1) * power)))"""


@query("sector_periodicity", with_views("lc planted", f"""
SELECT e.tic_id, e.sector, e.n, enough, round(sine_period, 8) AS sine_period, round(power, 7) AS power, round(amplitude_ppm, 3) AS amplitude_ppm,
  round({_FAP.format(f="10.0D")} + 3.7e-9D, 6) AS fap,
  coalesce(power > 0.05D AND (abs(period / (sine_period * 0.5D) - 1) < 0.05D OR abs(period / sine_period - 1) < 0.05D OR abs(period / (sine_period * 2.0D) - 1) < 0.05D), false) AS matches
FROM (SELECT tic_id, sector, count(*) AS n, count(*) >= 200 AS enough FROM lc GROUP BY 1, 2) e
LEFT JOIN (SELECT * EXCLUDE (n), n FROM top) top ON top.tic_id = e.tic_id AND top.sector = e.sector LEFT JOIN planted ON planted.tic_id = e.tic_id""".replace("(n - ", "(top.n - "),
    **_sines_sql("tic_id, sector", 0.1, 15.0, 5.0, "SELECT * FROM lc WHERE (tic_id, sector) IN (SELECT (tic_id, sector) FROM lc GROUP BY tic_id, sector HAVING count(*) >= 200)")))
def sector_periodicity(spark, d):
    """Strongest sinusoid of every sector, with its false-alarm bound and nearby multiples."""
    from ..operators.studies import sector_sines

    out = sector_sines(V.lc(spark, d), V.planted(spark, d))
    return out.select(
        "tic_id", "sector", "n", "enough", r("sine_period", 8).alias("sine_period"), r("power", 7).alias("power"),
        r("amplitude_ppm", 3).alias("amplitude_ppm"), r(F.col("fap") + 3.7e-9, 6).alias("fap"), "matches",
    )


@query("short_sinusoids", with_views("lc signals", f"""
SELECT cand_id, c.tic_id, n, round(sine_period, 8) AS sine_period, round(power, 7) AS power, round(amplitude_ppm, 3) AS amplitude_ppm,
  round(fap + 3.7e-9D, 6) AS fap, round(period / sine_period, 6) AS ratio,
  coalesce(fap < 1e-6D AND round(period / sine_period) >= 2 AND abs(period / sine_period - round(period / sine_period)) < 0.02D, false) AS multiple
FROM ({V.EVERY_SIGNAL}) c LEFT JOIN (SELECT *, {_FAP.format(f="2.5D * n / b")} AS fap FROM top) top ON top.tic_id = c.tic_id""",
    **_sines_sql("tic_id", 0.05, 0.6, 10.0, "SELECT * FROM lc")))
def short_sinusoids(spark, d):
    """Strongest sinusoid of 0.05 to 0.6 days under every signal, and whether the signal is a multiple of it."""
    from ..operators.studies import short_sines

    out = short_sines(V.lc(spark, d), V.every_signal(spark, d))
    return out.select(
        "cand_id", "tic_id", "n", r("sine_period", 8).alias("sine_period"), r("power", 7).alias("power"),
        r("amplitude_ppm", 3).alias("amplitude_ppm"), r(F.col("fap") + 3.7e-9, 6).alias("fap"), r("ratio", 6).alias("ratio"),
        "multiple",
    )


# ---- whole searches
RUN = SearchConfig(min_duration=0.1, max_duration=0.3, frequency_oversample=1.5, bin_minutes=20.0,
                   bands_per_decade=4, sde_threshold=6.0)


@query("find_signal")
def find_signal(spark, d):
    lc = V.lc(spark, d)
    done = SR.find_signals(lc.drop("event_id"), baselines(spark, d), RUN)
    return done.signals.drop("skipped_peaks", "transit_times")


@query("iterative_search")
def iterative_search(spark, d):
    lc = V.lc(spark, d).drop("event_id")
    flat = flat_curve(detrend(lc, DetrendConfig(window_length=2.0)))
    out = SR.iterative_search(flat, RUN, raw=lc, detrend_config=DetrendConfig(window_length=2.0))
    return out.signals.drop("skipped_peaks", "transit_times")
