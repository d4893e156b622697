"""Vetting queries: noise, single depths, every test, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import VetConfig
from ..functions import expr as X
from ..functions import special as N
from ..operators import stats as A
from ..operators import vetting as T
from . import views as V
from .curves import CADENCE, FOLD, r
from .registry import query
from .searches import EXTENT
from .views import table, with_views

CFG = VetConfig()
NEAR = f"SELECT c.cand_id, lc.*, period, t0, duration, depth, {FOLD} AS dt, CAST(round_even((t - t0) / period, 0) AS BIGINT) AS epoch FROM cands c JOIN lc USING (tic_id)"
COVERAGE = """SELECT cand_id, tic_id, epoch, any_value(t0 + epoch * period) AS tc, any_value(duration) AS duration,
  least(count(*) FILTER (abs(dt) < duration / 2) / any_value(duration / cadence), 1.0D) AS inside,
  least(count(*) FILTER (dt < -duration / 2) / any_value(duration / cadence), 1.0D) AS before,
  least(count(*) FILTER (dt > duration / 2) / any_value(duration / cadence), 1.0D) AS after
  FROM (SELECT *, t - (t0 + epoch * period) AS dt FROM (SELECT * EXCLUDE (dt) FROM nr)) JOIN cad USING (tic_id)
  WHERE abs(dt) < 1.5D * duration GROUP BY 1, 2, 3"""
NOISE = dict(
    cad=CADENCE, nr=NEAR,
    ph=f"SELECT nr.*, abs(dt) > duration AND abs({FOLD.replace('t0', '(t0 + 0.5D * period)')}) > duration AS clear, abs(dt) > 0.5D * duration AS outside FROM nr",
    oot="""SELECT ph.* FROM ph JOIN (SELECT cand_id, count(*) FILTER (clear) AS nc, count(*) FILTER (outside) AS no FROM ph GROUP BY 1) USING (cand_id)
      WHERE CASE WHEN nc >= 100 THEN clear WHEN no >= 100 THEN outside ELSE true END""",
    sg="""SELECT cand_id, 1.4826D * median(abs(flux - m)) AS sigma FROM (SELECT *, median(flux) OVER (PARTITION BY cand_id) AS m FROM oot) GROUP BY 1""",
    ocad="SELECT cand_id, median(x) / 86400000000.0D AS oc FROM (SELECT cand_id, t_us - lag(t_us) OVER (PARTITION BY cand_id ORDER BY t_us) AS x FROM oot) WHERE x IS NOT NULL GROUP BY 1",
    bn="""SELECT cand_id, 1.4826D * median(abs(m - mm)) AS binned FROM (SELECT b.*, median(m) OVER (PARTITION BY cand_id) AS mm FROM (
      SELECT cand_id, any_value(duration) AS duration, avg(flux) AS m, count(*) AS c FROM oot JOIN (SELECT cand_id, min(t) AS x0 FROM oot GROUP BY 1) USING (cand_id)
      GROUP BY cand_id, floor((t - x0) / duration)) b JOIN ocad USING (cand_id) WHERE c >= 0.5D * greatest(duration / oc, 1.0D)) GROUP BY 1 HAVING count(*) >= 3""",
    noise="""SELECT cand_id, sigma, greatest(CASE WHEN sigma > 0 AND binned IS NOT NULL THEN binned / (sigma / sqrt(greatest(duration / cadence, 1.0D))) ELSE 1.0D END, 1.0D) AS beta
      FROM cands JOIN sg USING (cand_id) LEFT JOIN bn USING (cand_id) JOIN cad USING (tic_id)""",
)
#: Mid-dip windows of every cycle, in the other engine: rows within two durations.
DEPTHS = dict(
    ext=EXTENT,
    cyc="""SELECT cand_id, tic_id, duration, e AS epoch, t0 + e * period AS tc FROM (
      SELECT c.*, unnest(range(CAST(ceil((t_min - 2 * duration - t0) / period) AS BIGINT), CAST(floor((t_max + 2 * duration - t0) / period) AS BIGINT) + 1)) AS e
      FROM cands c JOIN ext USING (tic_id))""",
    win="SELECT cyc.cand_id, cyc.epoch, cyc.tc, cyc.duration, flux, t - tc AS dt FROM cyc JOIN lc ON lc.tic_id = cyc.tic_id AND abs(t - tc) < 2 * duration",
    per="""SELECT cand_id, epoch, tc, count(*) FILTER (abs(dt) < 0.35D * duration) AS n_in, count(*) FILTER (dt < -0.75D * duration) AS n_pre,
      count(*) FILTER (dt > 0.75D * duration) AS n_post, median(flux) FILTER (abs(dt) < 0.35D * duration) AS m_in, median(flux) FILTER (dt < -0.75D * duration) AS m_pre,
      median(flux) FILTER (dt > 0.75D * duration) AS m_post, median(flux) FILTER (abs(dt) > 0.75D * duration) AS m_both FROM win GROUP BY 1, 2, 3""",
    depths="""SELECT cand_id, epoch, tc, CASE WHEN n_pre >= 5 AND n_post >= 5 THEN m_both WHEN n_pre >= 5 THEN m_pre ELSE m_post END - m_in AS depth,
      1.2533D * sigma * beta * sqrt(1.0D / n_in + 1.0D / (CASE WHEN n_pre >= 5 THEN n_pre ELSE 0 END + CASE WHEN n_post >= 5 THEN n_post ELSE 0 END)) AS depth_err,
      CASE WHEN n_pre >= 5 AND n_post >= 5 THEN m_pre - m_post END AS step, CASE WHEN n_pre >= 5 AND n_post >= 5 THEN 2 ELSE 1 END AS sides
      FROM per JOIN noise USING (cand_id) WHERE n_in >= 5 AND greatest(n_pre, n_post) >= 5""",
)


def inputs(spark, d):
    lc = V.lc(spark, d)
    return lc, V.cands(spark, d), A.curve_stats(lc)


def with_noise(spark, d):
    lc, cands, curves = inputs(spark, d)
    return lc, cands, curves, T.noise_properties(lc, cands, curves)


@query("noise_properties", with_views("lc cands", "SELECT cand_id, round(sigma, 9) AS sigma, round(beta, 6) AS beta FROM noise", **NOISE))
def noise_properties(spark, d):
    *_, noise = with_noise(spark, d)
    return noise.select("cand_id", r("sigma").alias("sigma"), r("beta", 6).alias("beta"))


@query("noise_of_every_signal", with_views("lc signals", "SELECT cand_id, round(sigma, 9) AS sigma, round(beta, 6) AS beta FROM noise", cands=V.EVERY_SIGNAL, **NOISE))
def noise_of_every_signal(spark, d):
    lc = V.lc(spark, d)
    noise = T.noise_properties(lc, V.every_signal(spark, d), A.curve_stats(lc))
    return noise.select("cand_id", r("sigma").alias("sigma"), r("beta", 6).alias("beta"))


@query("transit_coverage", with_views("lc cands", """
SELECT cand_id, epoch, round(tc, 9) AS tc, round(inside, 6) AS inside, round(before, 6) AS before, round(after, 6) AS after FROM cov""",
    cad=CADENCE, nr=NEAR, cov=COVERAGE))
def transit_coverage(spark, d):
    out = T.transit_coverage(*inputs(spark, d))
    return out.select("cand_id", "epoch", r("tc").alias("tc"), *[r(c, 6).alias(c) for c in ("inside", "before", "after")])


@query("coverage_test", with_views("lc cands", """
SELECT cand_id, CASE WHEN n_full IS NULL THEN 'n/a' WHEN n_full = 0 THEN 'fail' WHEN n_full < 2 THEN 'warn' ELSE 'pass' END AS status,
  CAST(n_full AS DOUBLE) AS statistic, coalesce(n_with, 0) AS n_with_data, coalesce(n_full, 0) AS n_fully_covered
FROM cands LEFT JOIN (SELECT cand_id, count(*) AS n_with, count(*) FILTER (inside >= 0.75D AND before >= 0.5D AND after >= 0.5D) AS n_full
  FROM cov WHERE inside > 0 GROUP BY 1) USING (cand_id)""", cad=CADENCE, nr=NEAR, cov=COVERAGE))
def coverage_test(spark, d):
    lc, cands, curves = inputs(spark, d)
    return T.coverage_test(cands, T.transit_coverage(lc, cands, curves), CFG).drop("partial_tc")


@query("transit_depths", with_views("lc cands", """
SELECT cand_id, epoch, round(tc, 9) AS tc, round(depth, 8) AS depth, round(depth_err, 8) AS depth_err, round(step, 8) AS step, sides FROM depths""",
    **NOISE, **DEPTHS))
def transit_depths(spark, d):
    out = T.transit_depths(*with_noise(spark, d))
    return out.select("cand_id", "epoch", r("tc").alias("tc"), *[r(c, 8).alias(c) for c in ("depth", "depth_err", "step")], "sides")


@query("bad_transits", with_views("lc cands", """
SELECT cand_id, epoch, round(deviation, 5) AS deviation FROM (
  SELECT *, count(*) FILTER (deviation > 1.5D) OVER (PARTITION BY cand_id) AS k FROM (
    SELECT cand_id, epoch, n, abs(depth - md) / sc AS deviation FROM depths JOIN (
      SELECT cand_id, any_value(md) AS md, count(*) AS n, greatest(1.4826D * median(abs(depth - md)), median(depth_err)) AS sc
      FROM (SELECT *, median(depth) OVER (PARTITION BY cand_id) AS md FROM depths) GROUP BY 1) USING (cand_id) WHERE n >= 6 AND sc > 0))
WHERE deviation > 1.5D AND k <= greatest(1, floor(0.1D * n))""", **NOISE, **DEPTHS))
def bad_transits(spark, d):
    depths = T.transit_depths(*with_noise(spark, d))
    out = T.bad_transits(depths, VetConfig(bad_transit_sigma=1.5))
    return out.select("cand_id", "epoch", r("deviation", 5).alias("deviation"))


ODD_EVEN = """
SELECT cand_id, CASE WHEN stat IS NULL THEN 'n/a' WHEN stat > 3.0D THEN 'fail' ELSE 'pass' END AS status, round(stat, 5) AS statistic,
  round(od + 3.7e-9D, 8) AS odd_depth, round(ed + 3.7e-9D, 8) AS even_depth, round(oe, 8) AS odd_err, round(ee, 8) AS even_err
FROM (SELECT *, CASE WHEN least(coalesce(o_n, 0), coalesce(e_n, 0)) >= 1 AND oe IS NOT NULL AND ee IS NOT NULL THEN abs(od - ed) / sqrt(oe * oe + ee * ee) END AS stat
  FROM (SELECT cands.cand_id, o.depth AS od, e.depth AS ed, o.n AS o_n, e.n AS e_n,
      greatest(o.err, CASE WHEN least(coalesce(o.ns, 0), coalesce(e.ns, 0)) >= 3 THEN scatter / sqrt(o.ns) ELSE 0.0D END) AS oe,
      greatest(e.err, CASE WHEN least(coalesce(o.ns, 0), coalesce(e.ns, 0)) >= 3 THEN scatter / sqrt(e.ns) ELSE 0.0D END) AS ee
    FROM cands LEFT JOIN (SELECT * FROM par WHERE parity = 1) o USING (cand_id) LEFT JOIN (SELECT * FROM par WHERE parity = 0) e USING (cand_id)
    LEFT JOIN (SELECT cand_id, 1.4826D * median(abs(single - mid)) AS scatter FROM single JOIN par USING (cand_id, parity) WHERE single IS NOT NULL GROUP BY 1) USING (cand_id)))"""


def _odd_even_sql(shape: str) -> dict[str, str]:
    """Sums, levels and depths per dip and parity for a dip of that ``shape`` (unit depth)."""
    return dict(
        n15=f"SELECT *, {shape} AS s FROM (SELECT * EXCLUDE (dt), t - (t0 + epoch * period) AS dt FROM nr) WHERE abs(dt) < 1.5D * duration",
        base="SELECT cand_id, median(flux) AS base FROM nr WHERE abs(dt) >= 1.5D * duration GROUP BY 1",
        ep="""SELECT cand_id, epoch, ((epoch % 2) + 2) % 2 AS parity, core, s1, ss, CASE WHEN nf >= 5 THEN fl ELSE coalesce(base, 1.0D) END * s1 - sf AS sy,
      CASE WHEN nf >= 5 THEN pow(1.2533D * sigma * beta, 2) / nf ELSE 0.0D END AS var, sigma * beta AS noise_row
      FROM (SELECT cand_id, epoch, count(*) FILTER (s > 0.5D) AS core, sum(s) AS s1, sum(s * s) AS ss, sum(s * flux) AS sf,
        count(*) FILTER (s <= 1e-6D) AS nf, median(flux) FILTER (s <= 1e-6D) AS fl FROM n15 GROUP BY 1, 2)
      LEFT JOIN base USING (cand_id) JOIN noise USING (cand_id)""",
        single="SELECT *, CASE WHEN core >= 3 THEN sy / ss END AS single FROM ep",
        par="""SELECT cand_id, parity, CASE WHEN sum(ss) > 0 THEN sum(sy) / sum(ss) END AS depth, count(*) FILTER (core > 0) AS n, count(single) AS ns, median(single) AS mid,
      CASE WHEN sum(ss) > 0 THEN sqrt(max(noise_row) * max(noise_row) / sum(ss) + sum(s1 * s1 * var) / pow(sum(ss), 2)) END AS err FROM single GROUP BY 1, 2""",
    )


def _odd_even_columns(out):
    return out.select("cand_id", "status", r("statistic", 5).alias("statistic"),
                      *[r(F.col(c) + 3.7e-9, 8).alias(c) for c in ("odd_depth", "even_depth")],
                      *[r(c, 8).alias(c) for c in ("odd_err", "even_err")])


_BOX = "CASE WHEN abs(dt) < 0.5D * duration THEN 1.0D ELSE 0.0D END"
#: Shapes as a fit would leave them: none for every fifth candidate, else from a tenth to seven tenths in ingress.
_FIT = ("duration * (0.8D + CAST(cand_id % 3 AS DOUBLE) / 10.0D)", "CASE WHEN cand_id % 5 > 0 THEN 0.1D + CAST(cand_id % 4 AS DOUBLE) / 5.0D END")


@query("odd_even_test", with_views("lc cands", ODD_EVEN, **NOISE, **_odd_even_sql(_BOX)))
def odd_even_test(spark, d):
    return _odd_even_columns(T.odd_even_test(*with_noise(spark, d), CFG))


@query("odd_even_fitted", with_views("lc cands", ODD_EVEN, **NOISE, **_odd_even_sql(
    f"CASE WHEN cand_id % 5 > 0 THEN greatest(0.0D, least(1.0D, (0.5D * {_FIT[0]} - abs(dt)) / (0.5D * ({_FIT[1]}) * {_FIT[0]}))) ELSE {_BOX} END")))
def odd_even_fitted(spark, d):
    """Odd and even depths as amplitudes of each candidate's fitted trapezoid, a box where there is none."""
    lc, cands, curves, noise = with_noise(spark, d)
    shaped = cands.withColumns({"fit_duration": F.expr(_FIT[0]), "fit_ingress": F.expr(_FIT[1])})
    return _odd_even_columns(T.odd_even_test(lc, shaped, curves, noise, CFG))


HALF = dict(
    hr=f"SELECT * FROM (SELECT *, t - (t0 + 0.5D * period + orbit * period) AS off FROM (SELECT nr.*, CAST(round_even((t - t0 - 0.5D * period) / period, 0) AS BIGINT) AS orbit FROM nr)) WHERE abs(off) < 1.5D * duration",
    orb="""SELECT cand_id, orbit, count(*) FILTER (abs(off) < 0.5D * duration) AS n_in, count(*) FILTER (NOT abs(off) < 0.5D * duration) AS n_out,
      coalesce(sum(flux) FILTER (abs(off) < 0.5D * duration), 0.0D) AS s_in, coalesce(sum(flux) FILTER (NOT abs(off) < 0.5D * duration), 0.0D) AS s_out FROM hr GROUP BY 1, 2""",
    tot="SELECT cand_id, sum(n_in) AS ti, sum(n_out) AS tn, sum(s_in) AS si, sum(s_out) AS so, count(*) FILTER (n_in > 0) AS n_orbits FROM orb GROUP BY 1",
)


@query("half_phase_dip", with_views("lc cands", """
SELECT cand_id, any_value(n_orbits) AS n_orbits, round(CASE WHEN any_value(ti) >= 3 AND any_value(tn) >= 3 THEN any_value(so / tn - si / ti) END + 3.7e-9D, 8) AS depth,
  round(CASE WHEN any_value(n_orbits) >= 2 THEN min(CASE WHEN ti - n_in >= 3 AND tn - n_out >= 3 THEN
    ((so - s_out) / (tn - n_out) - (si - s_in) / (ti - n_in)) / (sigma * beta * sqrt(1.0D / (ti - n_in) + 1.0D / (tn - n_out))) END) END, 5) AS loo_snr
FROM orb JOIN tot USING (cand_id) JOIN noise USING (cand_id) GROUP BY cand_id""", **NOISE, **HALF))
def half_phase_dip(spark, d):
    out = T.half_phase_dip(*with_noise(spark, d))
    return out.select("cand_id", "n_orbits", r(F.col("depth") + 3.7e-9, 8).alias("depth"), r("loo_snr", 5).alias("loo_snr"))


SCAN = dict(
    ph2="SELECT cand_id, period, duration, flux, (t - t0) - period * floor((t - t0) / period) AS u, greatest(duration / 4.0D, period / 2000.0D) AS step FROM nr",
    ks="SELECT cand_id, duration AS dd, greatest(duration / 4.0D, period / 2000.0D) AS step_, unnest(range(CAST(ceil((period - 4.0D * duration) / greatest(duration / 4.0D, period / 2000.0D)) AS BIGINT))) AS k FROM cands",
    bx="""SELECT ks.cand_id, ks.k, any_value(dd) AS duration, any_value(2.0D * dd + k * step_) AS centre, count(*) FILTER (abs(u - (2.0D * dd + k * step_)) < 0.5D * dd) AS n_in, count(*) FILTER (NOT abs(u - (2.0D * dd + k * step_)) < 0.5D * dd) AS n_out,
      avg(flux) FILTER (abs(u - (2.0D * dd + k * step_)) < 0.5D * dd) AS f_in, avg(flux) FILTER (NOT abs(u - (2.0D * dd + k * step_)) < 0.5D * dd) AS f_out
      FROM ks JOIN ph2 ON ph2.cand_id = ks.cand_id AND abs(u - (2.0D * dd + k * step_)) < 1.5D * dd AND least(u, period - u) > 1.5D * dd GROUP BY 1, 2""",
    scan="SELECT cand_id, k, duration, centre, f_out - f_in AS depth, (f_out - f_in) / (sigma * beta * sqrt(1.0D / n_in + 1.0D / n_out)) AS snr FROM bx JOIN noise USING (cand_id) WHERE n_in >= 3 AND n_out >= 3",
)


@query("phase_scan", with_views("lc cands", "SELECT cand_id, k, round(depth + 3.7e-9D, 8) AS depth, round(snr, 5) AS snr FROM scan", **NOISE, **SCAN))
def phase_scan(spark, d):
    lc, cands, _, noise = with_noise(spark, d)
    out = T.phase_scan(lc, cands, noise)
    return out.select("cand_id", "k", r(F.col("depth") + 3.7e-9, 8).alias("depth"), r("snr", 5).alias("snr"))


@query("top_phase_dips")
def top_phase_dips(spark, d):
    lc, cands, _, noise = with_noise(spark, d)
    return T.top_phase_dips(T.phase_scan(lc, cands, noise)).select("cand_id", "place", "centre", "depth", "snr")


@query("secondary_eclipse_test")
def secondary_eclipse_test(spark, d):
    lc, cands, curves, noise = with_noise(spark, d)
    return T.secondary_eclipse_test(lc, size_guess(cands), curves, noise, CFG)


def size_guess(cands):
    """Radius ratio and scaled orbit a box depth and duration imply (a central dip)."""
    k = F.sqrt("depth")
    a = F.greatest((1.0 + k) * F.col("period") / (X.PI * F.col("duration")), F.lit(1.0))
    return cands.withColumns({"rp_rs": k, "a_rs": a, "teff": F.lit(5772.0)})


@query("occultation_limit", with_views("cands", """
SELECT cand_id, round(k * k / (a * a) + k * k * sum(1 / pow(lam, 5) / (exp(hc / (lam * td)) - 1.0D)) / sum(1 / pow(lam, 5) / (exp(hc / (lam * 5772.0D)) - 1.0D)), 10) AS max_planet_depth
FROM (SELECT cand_id, sqrt(depth) AS k, greatest((1.0D + sqrt(depth)) * period / (pi() * duration), 1.0D) AS a FROM cands),
  LATERAL (SELECT 5772.0D * sqrt(1.0D / a) * pow(2.0D / 3.0D, 0.25D) AS td), (SELECT 6.62607015e-34D * 2.99792458e8D / 1.380649e-23D AS hc),
  (SELECT 600e-9D + unnest(range(400)) * (400e-9D / 399) AS lam) GROUP BY cand_id, k, a""".replace("e8D", "e8D").replace("2.99792458e8D", "299792458.0D")))
def occultation_limit(spark, d):
    rows = size_guess(V.cands(spark, d))
    limit = X.max_planet_occultation(F.col("rp_rs"), F.col("a_rs"), F.col("teff"))
    return rows.select("cand_id", r(limit, 10).alias("max_planet_depth"))


@query("template_amplitude", with_views("lc cands", """
SELECT cand_id, round(sum(s * (1.0D - flux)) / sum(s * s), 8) AS amplitude, round(0.005D / sqrt(sum(s * s)), 8) AS err FROM (
  SELECT *, 1.0D - CASE WHEN x <= 0.5D * duration - greatest(0.1D * duration, 1e-9D) THEN 0.0D WHEN x < 0.5D * duration THEN 1.0D - (0.5D * duration - x) / greatest(0.1D * duration, 1e-9D) ELSE 1.0D END AS s
  FROM (SELECT cand_id, duration, flux, abs(dt) AS x FROM nr)) GROUP BY cand_id HAVING sum(s * s) > 0""", nr=NEAR))
def template_amplitude(spark, d):
    """Least-squares amplitude of a trapezoid of each candidate's duration."""
    from ..operators.studies import amplitude

    lc, cands, curves = inputs(spark, d)
    out = amplitude(lc, cands, curves, F.lit(0.2), F.lit(0.005))
    return out.select("cand_id", r("amplitude", 8).alias("amplitude"), r("err", 8).alias("err"))


@query("shape_bins", with_views("lc cands", """
SELECT cand_id, CAST(n AS DOUBLE) AS n, round(x, 8) AS x, round(y / coalesce(base, 1.0D), 8) AS y FROM (
  SELECT cand_id, count(*) AS n, avg(off) AS x, avg(flux) AS y FROM n2 JOIN (SELECT cand_id, min(off) AS x0, count(*) AS rows_ FROM n2 GROUP BY 1) USING (cand_id)
  JOIN cad USING (tic_id) WHERE rows_ >= 10 GROUP BY cand_id, floor((off - x0) / greatest(duration / 30.0D, cadence)))
LEFT JOIN (SELECT cand_id, median(flux) AS base FROM n2 WHERE abs(off) > duration GROUP BY 1) USING (cand_id)""",
    cad=CADENCE, nr=NEAR, n2="SELECT * FROM (SELECT nr.*, t - (t0 + epoch * period) AS off FROM nr) WHERE abs(off) < 2 * duration"))
def shape_bins(spark, d):
    out = T.shape_bins(*inputs(spark, d))
    return out.select("cand_id", "n", r("x", 8).alias("x"), r("y", 8).alias("y"))


@query("shape_test")
def shape_test(spark, d):
    lc, cands, curves = inputs(spark, d)
    return T.shape_test(lc, cands, curves, CFG, samples(spark, d))


# ---- posterior tests on a table of samples
def samples(spark, d):
    """Posterior samples: one candidate per supplier, one sample per line item."""
    return table(spark, d, "lineitem").selectExpr(
        "l_suppkey AS cand_id", "0.2D + l_extendedprice / 50000.0D AS rho", "l_discount * 10.0D AS b",
        "0.02D + l_tax AS rp_rs", "l_quantity AS q",
    )


def hosts(spark, d):
    return table(spark, d, "supplier").selectExpr(
        "s_suppkey AS cand_id", "0.3D + s_nationkey / 5.0D AS rho_cat",
        "CASE WHEN s_nationkey < 8 THEN NULL ELSE 0.05D * (1 + s_nationkey) END AS rho_cat_err",
        "CASE WHEN s_nationkey = 3 THEN NULL ELSE 0.5D + s_nationkey / 3.0D END AS radius",
    )


SAMPLES = "SELECT l_suppkey AS cand_id, 0.2D + l_extendedprice / 50000.0D AS rho, l_discount * 10.0D AS b, 0.02D + l_tax AS rp_rs FROM lineitem"
HOSTS = """SELECT s_suppkey AS cand_id, 0.3D + s_nationkey / 5.0D AS rho_cat, CASE WHEN s_nationkey < 8 THEN NULL ELSE 0.05D * (1 + s_nationkey) END AS rho_cat_err,
  CASE WHEN s_nationkey = 3 THEN NULL ELSE 0.5D + s_nationkey / 3.0D END AS radius FROM supplier"""


def _horner(cs: list[float], x: str) -> str:
    out = f"({cs[0]!r}D)"
    for c in cs[1:]:
        out = f"({out} * {x} + ({c!r}D))"
    return out


def sql_log_ndtr(x: str) -> str:
    z = f"(abs({x}) / sqrt(2.0D))"
    t = f"(1.0D / (1.0D + 0.5D * {z}))"
    tail = f"(ln({t}) - {z} * {z} + {_horner(N.ERFC[::-1], t)} + ln(0.5D))"
    return f"CASE WHEN {x} <= 0 THEN {tail} ELSE ln(1.0D - exp({tail})) END"


def sql_ndtri_exp(lp: str) -> str:
    def tail(q: str) -> str:
        return f"({_horner(N.INV_C, q)} / {_horner([*N.INV_D, 1.0], q)})"

    p = f"exp({lp})"
    mid = f"({_horner(N.INV_A, f'(({p} - 0.5D) * ({p} - 0.5D))')} * ({p} - 0.5D) / {_horner([*N.INV_B, 1.0], f'(({p} - 0.5D) * ({p} - 0.5D))')})"
    return (f"CASE WHEN {lp} < ln(0.02425D) THEN {tail(f'sqrt(-2.0D * {lp})')} WHEN {p} <= 0.97575D THEN {mid} "
            f"ELSE -{tail(f'sqrt(-2.0D * ln(1.0D - {p}))')} END")


@query("density_test", with_views("", f"""
SELECT cand_id, CASE WHEN z IS NULL THEN 'n/a' WHEN abs(z) <= 3.0D THEN 'pass' WHEN greatest(ratio, 1.0D / ratio) > 5.0D THEN 'fail' ELSE 'warn' END AS status,
  round(z, 5) AS statistic, round(ratio, 8) AS ratio
FROM hosts LEFT JOIN (SELECT cand_id, ratio, CASE WHEN mu < lc THEN -sz ELSE sz END AS z FROM (
  SELECT cand_id, exp(mu) / rho_cat AS ratio, mu, lc, greatest(-({sql_ndtri_exp('lt')}), 0.0D) AS sz FROM tail)) USING (cand_id)""",
    samples=SAMPLES, hosts=HOSTS,
    known="SELECT *, ln(rho_cat) AS lc, CASE WHEN coalesce(rho_cat_err, 0) > 0 THEN rho_cat_err / rho_cat ELSE 0.25D END AS sd FROM hosts JOIN (SELECT cand_id, median(ln(rho)) AS mu FROM samples GROUP BY 1) USING (cand_id)",
    ls=f"SELECT cand_id, any_value(mu) AS mu, l FROM (SELECT cand_id, mu, {sql_log_ndtr('d')} AS l FROM (SELECT cand_id, mu, CASE WHEN mu < lc THEN (ln(rho) - lc) / sd ELSE -(ln(rho) - lc) / sd END AS d FROM samples JOIN known USING (cand_id))) GROUP BY ALL".replace("any_value(mu) AS mu, l", "mu, l").replace(" GROUP BY ALL", ""),
    tail="SELECT cand_id, any_value(known.mu) AS mu, any_value(lc) AS lc, any_value(rho_cat) AS rho_cat, any_value(top) + ln(sum(exp(l - top))) - ln(count(*)) AS lt FROM ls JOIN (SELECT cand_id, max(l) AS top FROM ls GROUP BY 1) USING (cand_id) JOIN known USING (cand_id) GROUP BY cand_id"))
def density_test(spark, d):
    out = T.density_test(samples(spark, d), hosts(spark, d), CFG)
    return out.select("cand_id", "status", r("statistic", 5).alias("statistic"), r("ratio", 8).alias("ratio"))


@query("radius_test", with_views("", f"""
SELECT cand_id, CASE WHEN rp IS NULL THEN 'n/a' WHEN rp > 2.5D THEN 'fail' ELSE 'pass' END AS status, round(rp, 8) AS statistic
FROM (SELECT hosts.cand_id, k * radius * {T.R_SUN / T.R_JUP!r}D AS rp FROM hosts LEFT JOIN (SELECT cand_id, median(rp_rs) AS k FROM samples GROUP BY 1) USING (cand_id))""",
    samples=SAMPLES, hosts=HOSTS))
def radius_test(spark, d):
    return T.radius_test(samples(spark, d), hosts(spark, d), CFG).withColumn("statistic", r("statistic", 8))


@query("grazing_share", with_views("", "SELECT cand_id, round(avg(CASE WHEN b + rp_rs > 1.0D THEN 1.0D ELSE 0.0D END), 9) AS p_grazing FROM samples GROUP BY 1", samples=SAMPLES))
def grazing_share(spark, d):
    return T.grazing(samples(spark, d)).withColumn("p_grazing", r("p_grazing"))


@query("rotation_test", with_views("signals", """
SELECT cand_id, CASE WHEN power IS NULL OR power < 0.1D THEN 'n/a' WHEN abs(best.o) <= 0.05D THEN 'warn' ELSE 'pass' END AS status,
  CASE WHEN power >= 0.1D THEN round(best.o, 9) END AS statistic, CASE WHEN power >= 0.1D THEN best.k END AS multiple
FROM (SELECT cand_id, power, list_min([{'s': abs(period / p - 1.0D), 'i': 0, 'k': 1.0D, 'o': period / p - 1.0D}, {'s': abs(period / (0.5D * p) - 1.0D), 'i': 1, 'k': 0.5D, 'o': period / (0.5D * p) - 1.0D},
  {'s': abs(period / (2.0D * p) - 1.0D), 'i': 2, 'k': 2.0D, 'o': period / (2.0D * p) - 1.0D}]) AS best FROM signals LEFT JOIN (
  SELECT c_custkey AS tic_id, 1.0D + (c_acctbal + 1000.0D) / 1000.0D AS p, c_nationkey / 25.0D AS power FROM customer) USING (tic_id))"""))
def rotation_test(spark, d):
    rot = table(spark, d, "customer").selectExpr("c_custkey AS tic_id", "1.0D + (c_acctbal + 1000.0D) / 1000.0D AS period", "c_nationkey / 25.0D AS power")
    return T.rotation_test(V.signals(spark, d), rot, CFG).withColumn("statistic", r("statistic"))


@query("momentum_dump_test", with_views("lc cands dumps", """
SELECT cands.cand_id, CASE WHEN n IS NULL THEN 'n/a' WHEN k = 0 THEN 'pass' WHEN k = n AND n >= 2 AND chance < 0.01D THEN 'fail' WHEN k = n THEN 'warn'
  WHEN sg > 3.0D AND da < 3.0D * ea THEN 'fail' WHEN sg > 3.0D THEN 'warn' ELSE 'pass' END AS status,
  round(CASE WHEN k = 0 THEN 0.0D WHEN k = n THEN chance ELSE sg END, 5) AS statistic, coalesce(n, 0) AS n_transits, coalesce(k, 0) AS n_at_dumps
FROM cands LEFT JOIN (SELECT *, (dt_ - da) / sqrt(et * et + ea * ea) AS sg FROM (SELECT cand_id, count(*) AS n, count(*) FILTER (at_) AS k,
    sum(depth / (depth_err * depth_err)) FILTER (at_) / sum(1 / (depth_err * depth_err)) FILTER (at_) AS dt_, 1 / sqrt(sum(1 / (depth_err * depth_err)) FILTER (at_)) AS et,
    sum(depth / (depth_err * depth_err)) FILTER (NOT at_) / sum(1 / (depth_err * depth_err)) FILTER (NOT at_) AS da, 1 / sqrt(sum(1 / (depth_err * depth_err)) FILTER (NOT at_)) AS ea
  FROM flagged GROUP BY 1)) USING (cand_id)
LEFT JOIN (SELECT cand_id, pow(avg(CASE WHEN hit THEN 1.0D ELSE 0.0D END), any_value(n)) AS chance FROM (
    SELECT c.cand_id, n, lc.t_us, EXISTS (SELECT 1 FROM dumps WHERE dumps.tic_id = lc.tic_id AND abs(lc.t - dumps.t) <= c.duration / 2 + 1.0D / 24.0D) AS hit
    FROM (SELECT cand_id, any_value(tic_id) AS tic_id, any_value(duration) AS duration, count(*) AS n FROM flagged GROUP BY 1 HAVING count(*) = count(*) FILTER (at_)) c JOIN lc USING (tic_id)) GROUP BY 1) USING (cand_id)""",
    **NOISE, **DEPTHS,
    flagged="SELECT depths.*, tic_id, duration, EXISTS (SELECT 1 FROM dumps WHERE dumps.tic_id = cands.tic_id AND abs(depths.tc - dumps.t) <= cands.duration / 2 + 1.0D / 24.0D) AS at_ FROM depths JOIN cands USING (cand_id)"))
def momentum_dump_test(spark, d):
    lc, cands, curves, noise = with_noise(spark, d)
    depths = T.transit_depths(lc, cands, curves, noise)
    out = T.momentum_dump_test(lc, cands, depths, V.dumps(spark, d), CFG)
    return out.select("cand_id", "status", r("statistic", 5).alias("statistic"), "n_transits", "n_at_dumps")


@query("chunk_consistency", with_views("lc cands", """
SELECT cand_id, n_transits, n_chunks, chunked_by, round(snr_all, 5) AS snr_all, CASE WHEN n_chunks >= 2 THEN round((tot * mean - top.v * top.depth) / sqrt(tot - top.v), 5) END AS snr_without_strongest,
  CASE WHEN n_chunks >= 2 THEN top.chunk END AS strongest, CASE WHEN n_chunks >= 2 THEN round(chi2, 5) END AS chi2, CASE WHEN n_chunks >= 2 THEN CAST(n_chunks - 1 AS INT) WHEN n_chunks IS NOT NULL THEN 0 END AS dof
FROM cands LEFT JOIN (SELECT cand_id, sum(n)::BIGINT AS n_transits, count(*) AS n_chunks, CASE WHEN bool_or(many) THEN 'sector' ELSE 'segment' END AS chunked_by, any_value(tot) AS tot, any_value(mean) AS mean,
    any_value(mean) * sqrt(any_value(tot)) AS snr_all, sum((depth - mean) * (depth - mean) * v) AS chi2, max({'snr': depth * sqrt(v), 'o': -first_, 'chunk': chunk, 'v': v, 'depth': depth}) AS top
  FROM (SELECT *, sum(v) OVER (PARTITION BY cand_id) AS tot, sum(v * depth) OVER (PARTITION BY cand_id) / sum(v) OVER (PARTITION BY cand_id) AS mean
    FROM (SELECT c.*, 1 / pow(greatest(1 / sqrt(w), CASE WHEN coalesce(m, 0) >= 6 THEN sc ELSE 0.0D END / sqrt(n)), 2) AS v FROM ch c LEFT JOIN flo USING (cand_id))) GROUP BY 1) USING (cand_id)""",
    **NOISE, **DEPTHS,
    ends="SELECT tic_id, sector, max(t) AS e FROM lc GROUP BY 1, 2",
    segs="SELECT tic_id, t AS s FROM (SELECT tic_id, t, t_us - lag(t_us) OVER (PARTITION BY tic_id ORDER BY t_us) AS g FROM lc) WHERE g IS NULL OR g > 43200000000",
    lab="""SELECT d.*, coalesce((SELECT min_by(sector, e) FROM ends WHERE ends.tic_id = cands.tic_id AND e >= tc), (SELECT max_by(sector, e) FROM ends WHERE ends.tic_id = cands.tic_id)) AS sec,
      (SELECT count(*) FROM segs WHERE segs.tic_id = cands.tic_id AND s <= tc) AS seg FROM depths d JOIN cands USING (cand_id)""",
    lab2="SELECT cand_id, tc, lab.depth, depth_err, many, CASE WHEN many THEN 'sector ' || sec ELSE 'segment ' || seg END AS chunk FROM (SELECT *, min(sec) OVER (PARTITION BY cand_id) < max(sec) OVER (PARTITION BY cand_id) AS many FROM lab) lab",
    ch="SELECT cand_id, chunk, count(*) AS n, bool_or(many) AS many, min(tc) AS first_, sum(1 / (depth_err * depth_err)) AS w, sum(depth / (depth_err * depth_err)) / sum(1 / (depth_err * depth_err)) AS depth, median(depth) AS mid FROM lab2 GROUP BY 1, 2",
    flo="SELECT cand_id, count(*) AS m, 1.4826D * median(abs(lab2.depth - mid)) AS sc FROM lab2 JOIN ch USING (cand_id, chunk) WHERE n >= 3 GROUP BY 1"))
def chunk_consistency(spark, d):
    lc, cands, curves, noise = with_noise(spark, d)
    out = T.chunk_consistency(lc, cands, T.transit_depths(lc, cands, curves, noise))
    return out.select("cand_id", "n_transits", "n_chunks", "chunked_by", r("snr_all", 5).alias("snr_all"),
                      r("snr_without_strongest", 5).alias("snr_without_strongest"), "strongest", r("chi2", 5).alias("chi2"), "dof")


@query("transit_times")
def transit_times(spark, d):
    lc, cands, curves = inputs(spark, d)
    times = T.transit_times(lc, cands, curves, T.transit_coverage(lc, cands, curves), CFG)
    return T.o_minus_c(times)


@query("o_minus_c_seasons", with_views("", """
SELECT cand_id, season, round(min(tc), 6) AS first_t, round(max(tc), 6) AS last_t, count(*) AS n_transits, round(median(oc), 4) AS median_oc_minutes
FROM (SELECT *, CAST(sum(CASE WHEN g > 300.0D THEN 1 ELSE 0 END) OVER (PARTITION BY cand_id ORDER BY tc ROWS UNBOUNDED PRECEDING) AS BIGINT) AS season FROM (
  SELECT *, tc - lag(tc) OVER (PARTITION BY cand_id ORDER BY tc) AS g, (tc - my - CASE WHEN xx > 0 THEN xy / xx ELSE 0.0D END * (epoch - mx)) * 1440.0D AS oc
  FROM tt JOIN (SELECT cand_id, any_value(mx) AS mx, any_value(my) AS my, sum(w * (epoch - mx) * (epoch - mx)) AS xx, sum(w * (epoch - mx) * (tc - my)) AS xy FROM (
    SELECT *, 1 / (err * err) AS w FROM tt) JOIN (SELECT cand_id, sum(epoch / (err * err)) / sum(1 / (err * err)) AS mx, sum(tc / (err * err)) / sum(1 / (err * err)) AS my FROM tt GROUP BY 1) USING (cand_id) GROUP BY 1) USING (cand_id)))
GROUP BY 1, 2""", tt="SELECT o_custkey AS cand_id, o_orderkey AS epoch, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) + o_orderkey / 100000.0D AS tc, 0.5D + (o_totalprice / 100000.0D) AS err FROM orders"))
def o_minus_c_seasons(spark, d):
    times = table(spark, d, "orders").selectExpr(
        "o_custkey AS cand_id", "o_orderkey AS epoch",
        "datediff(CAST(o_orderdate AS DATE), DATE'1992-01-01') + o_orderkey / 100000.0D AS tc",
        "0.5D + o_totalprice / 100000.0D AS err",
    )
    out = T.seasonal_oc(T.o_minus_c(times, 300.0))
    return out.select("cand_id", "season", r("first_t", 6).alias("first_t"), r("last_t", 6).alias("last_t"), "n_transits",
                      r("median_oc_minutes", 4).alias("median_oc_minutes"))


OUTCOMES = """SELECT l_orderkey AS cand_id, CASE l_linenumber % 4 WHEN 0 THEN 'rotation' WHEN 1 THEN 'shape' WHEN 2 THEN 'density' ELSE 'coverage' END AS name,
  CASE WHEN l_discount >= 0.1D THEN 'fail' WHEN l_discount >= 0.09D THEN 'warn' WHEN l_tax >= 0.08D THEN 'n/a' ELSE 'pass' END AS status, l_quantity AS statistic FROM lineitem"""


@query("verdicts", with_views("", """
SELECT cand_id, CASE WHEN bool_or(status = 'fail') THEN 'likely false positive' WHEN bool_or(status = 'warn' OR (status = 'n/a' AND name <> 'rotation')) THEN 'planet candidate (with caveats)'
  ELSE 'planet candidate (passes all tests)' END AS verdict, count(*) FILTER (status = 'n/a' AND name <> 'rotation') AS n_untested FROM outcomes GROUP BY 1""", outcomes=OUTCOMES))
def verdicts(spark, d):
    tests = table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS cand_id", "CASE l_linenumber % 4 WHEN 0 THEN 'rotation' WHEN 1 THEN 'shape' WHEN 2 THEN 'density' ELSE 'coverage' END AS name",
        "CASE WHEN l_discount >= 0.1D THEN 'fail' WHEN l_discount >= 0.09D THEN 'warn' WHEN l_tax >= 0.08D THEN 'n/a' ELSE 'pass' END AS status", "l_quantity AS statistic")
    return T.decide(tests).select("cand_id", "verdict", F.size("untested").cast("long").alias("n_untested"))


@query("secondary_verdicts", with_views("signals", """
SELECT a.tic_id, a.cand_id AS iteration, CASE WHEN b.sde >= 20.0D THEN 'secondary eclipse of an eclipsing binary' WHEN b.sde < 10.0D THEN 'occultation, consistent with a planet' ELSE 'second eclipse' END AS verdict
FROM signals a LEFT JOIN signals b ON a.tic_id = b.tic_id AND b.cand_id = a.cand_id - 1 WHERE a.iteration > 1"""))
def secondary_verdicts(spark, d):
    rows = V.signals(spark, d)
    sig = rows.where("iteration > 1").selectExpr("tic_id", "cand_id AS iteration", "cand_id - 1 AS secondary_of", "t0 AS phase_offset")
    tests = rows.selectExpr("tic_id", "cand_id AS iteration", "CASE WHEN sde >= 20.0D THEN 'fail' WHEN sde < 10.0D THEN 'pass' ELSE 'warn' END AS status")
    return T.secondary_verdicts(sig, tests).select("tic_id", "iteration", "verdict")


@query("vetting_report")
def vetting_report(spark, d):
    """Every curve-based test of every candidate, and the verdict."""
    from .report import vet

    lc, cands, curves = inputs(spark, d)
    out = vet(lc, size_guess(cands), curves, V.dumps(spark, d), CFG)
    return out.select("cand_id", "verdict", F.size("tests").alias("n_tests"))
