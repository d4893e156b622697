"""Study queries: posteriors, injections, completeness, calibration tables, re-searches, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DetrendConfig, SearchConfig
from ..operators import stats as A
from ..operators import studies as Y
from ..operators.detrend import detrend, flat_curve
from . import report as P
from . import search_run as SR
from . import views as V
from .curves import CADENCE, FOLD, r
from .registry import query
from .searches import RUN
from .vets import NEAR
from .views import table, with_views

POST = """SELECT l_suppkey AS cand_id, l_orderkey * 10 + l_linenumber AS sample, CAST(l_linenumber AS DOUBLE) AS t0, 1.0D + l_quantity AS period, 0.02D + l_tax AS rp_rs,
  ln(5.0D + l_quantity) AS ln_a_rs, l_discount * 9.0D AS b, 0.1D + l_tax AS q1, l_discount * 5.0D AS q2 FROM lineitem"""


def posterior(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "l_suppkey AS cand_id", "l_orderkey * 10 + l_linenumber AS sample", "CAST(l_linenumber AS DOUBLE) AS t0", "1.0D + l_quantity AS period", "0.02D + l_tax AS rp_rs",
        "ln(5.0D + l_quantity) AS ln_a_rs", "l_discount * 9.0D AS b", "0.1D + l_tax AS q1", "l_discount * 5.0D AS q2")


@query("derived_samples", with_views("", """
SELECT cand_id, sample, round(a, 6) AS a_rs, round(degrees(acos(b / a)), 6) AS inc_deg, round(24.0D * period / pi() * asin(least(sqrt(greatest((1 + k) * (1 + k) - b * b, 0)) / (a * sqrt(1 - b * b / (a * a))), 1.0D)), 6) AS t14_hours,
  round(24.0D * period / pi() * asin(least(sqrt(greatest((1 - k) * (1 - k) - b * b, 0)) / (a * sqrt(1 - b * b / (a * a))), 1.0D)), 6) AS t23_hours,
  round(3.0D * pi() * pow(a, 3) / (6.6743e-11D * pow(period * 86400.0D, 2)) / RHO, 6) AS rho_star_solar, round(k * radius * RJ, 6) AS rp_jup, round(teff * sqrt(1.0D / (2.0D * a)), 4) AS teq_k
FROM (SELECT cand_id, sample, period, rp_rs AS k, exp(ln_a_rs) AS a, b FROM post) JOIN (SELECT s_suppkey AS cand_id, 0.5D + s_nationkey / 20.0D AS radius, 4000.0D + s_nationkey * 100.0D AS teff FROM supplier) USING (cand_id)""".replace(
    "RHO", f"{Y.RHO_SUN!r}D").replace("RJ", f"{Y.R_SUN / Y.R_JUP!r}D"), post=POST))
def derived_samples(spark, d):
    """Stellar values without errors are held fixed, so the result is the same everywhere."""
    stellar = table(spark, d, "supplier").selectExpr("s_suppkey AS cand_id", "0.5D + s_nationkey / 20.0D AS radius", "CAST(NULL AS DOUBLE) AS radius_err",
                                                     "4000.0D + s_nationkey * 100.0D AS teff", "CAST(NULL AS DOUBLE) AS teff_err")
    out = Y.derived_samples(posterior(spark, d), stellar)
    names = {"a_rs": 6, "inc_deg": 6, "t14_hours": 6, "t23_hours": 6, "rho_star_solar": 6, "rp_jup": 6, "teq_k": 4}
    return out.select("cand_id", "sample", *[r(c, n).alias(c) for c, n in names.items()])


@query("derived_samples_drawn")
def derived_samples_drawn(spark, d):
    stellar = table(spark, d, "supplier").selectExpr("s_suppkey AS cand_id", "0.5D + s_nationkey / 20.0D AS radius", "0.1D AS radius_err",
                                                     "4000.0D + s_nationkey * 100.0D AS teff", "150.0D AS teff_err")
    return Y.derived_samples(posterior(spark, d), stellar)


@query("posterior_summary", with_views("", """
SELECT cand_id, parameter, round(median(v), 8) AS median, round(median(v) - quantile_cont(v, 0.15865), 8) AS err_lo, round(quantile_cont(v, 0.84135) - median(v), 8) AS err_hi
FROM (SELECT cand_id, unnest(['period', 'rp_rs', 'b']) AS parameter, unnest([period, rp_rs, b]) AS v FROM post) GROUP BY 1, 2""", post=POST))
def posterior_summary(spark, d):
    out = Y.posterior_summary(posterior(spark, d), ["period", "rp_rs", "b"])
    return out.select("cand_id", "parameter", *[r(c, 8).alias(c) for c in ("median", "err_lo", "err_hi")])


# ---- injections
P_EDGES, R_EDGES = Y.log_edges(1.0, 8.0, 2), Y.log_edges(4.0, 12.0, 2)


def hosts(spark, d):
    start = V.lc(spark, d).groupBy("tic_id").agg(F.min("t").alias("t_min"))
    return start.selectExpr("tic_id", "0.9D AS radius", "0.9D AS mass", "t_min")


@query("draw_injections")
def draw_injections(spark, d):
    return Y.draw_injections(hosts(spark, d), Y.log_edges(0.5, 10.0, 8), Y.log_edges(0.7, 8.0, 8), 32)


INJ = """SELECT tic_id, tic_id * 10 AS curve_id, period, t0, 0.3D AS b, 0.1D AS k, 8.0D AS a, duration FROM planted"""


def fixed_injections(spark, d):
    return V.planted(spark, d).selectExpr("tic_id", "tic_id * 10 AS curve_id", "period", "t0", "0.3D AS b", "0.1D AS rp_rs", "8.0D AS a_rs", "duration", "0.4D AS u1", "0.2D AS u2")


@query("inject", with_views("lc planted", """
SELECT tic_id, event_id, round(flux * CASE WHEN x <= half - tau THEN 1.0D - dep WHEN x < half THEN 1.0D - dep * (half - x) / tau ELSE 1.0D END, 9) AS flux
FROM (SELECT *, greatest(0.5D * (1.0D - t23 / duration) * duration, 1e-9D) AS tau, k * k * (1.0D - 0.4D * (1.0D - sqrt(1.0D - b * b)) - 0.2D * pow(1.0D - sqrt(1.0D - b * b), 2)) / (1.0D - 0.4D / 3.0D - 0.2D / 6.0D) AS dep
  FROM (SELECT curve_id AS tic_id, event_id, flux, duration, 0.5D * duration AS half, b, k, abs(FOLD) AS x,
    period / pi() * asin(least(sqrt((1.0D - k) * (1.0D - k) - b * b) / (a * sqrt(1.0D - (b / a) * (b / a))), 1.0D)) AS t23 FROM lc JOIN inj USING (tic_id)))""".replace("FOLD", FOLD), inj=INJ))
def inject(spark, d):
    out = Y.inject(V.lc(spark, d), fixed_injections(spark, d))
    return out.select("tic_id", "event_id", r("flux").alias("flux"))


MISS = "abs((x - t0 + 0.5D * period) - period * floor((x - t0 + 0.5D * period) / period) - 0.5D * period)"


def _case(ratio: str, m: int) -> str:
    misses = ", ".join(MISS.replace("x -", f"(ft + fp * {j}) -") for j in range(m))
    best = f"least({misses})" if m > 1 else misses
    return f"abs(fp - period * {ratio}) <= 0.01D * period * {ratio} AND {best} < 0.5D * greatest(duration, 1e-3D)"


@query("match_injection", with_views("signals known", f"""
SELECT cand_id, ord, CASE WHEN {_case('1.0D', 1)} THEN 'exact' WHEN {_case('0.5D', 2)} THEN 'alias' WHEN {_case('2.0D', 1)} THEN 'alias'
  WHEN {_case('(1.0D / 3.0D)', 3)} THEN 'alias' WHEN {_case('3.0D', 1)} THEN 'alias' ELSE 'none' END AS match
FROM (SELECT s.cand_id, k.ord, s.period, s.t0, s.duration * 4.0D AS duration, k.period AS fp, k.t0 AS ft FROM signals s JOIN known k USING (tic_id))"""))
def match_injection(spark, d):
    known = V.known(spark, d).select("tic_id", "ord", F.col("period").alias("found_period"), F.col("t0").alias("found_t0"))
    pairs = V.signals(spark, d).withColumn("duration", F.col("duration") * 4.0).join(known, "tic_id")
    return Y.match_injection(pairs).select("cand_id", "ord", "match")


RECOVERED = "SELECT l_orderkey AS i, CAST(l_suppkey % 8 AS INT) AS radius_bin, CAST(l_partkey % 8 AS INT) AS period_bin, l_quantity > 25 AS recovered, CASE WHEN l_quantity > 25 THEN 'exact' WHEN l_tax > 0.05 THEN 'alias' ELSE 'none' END AS match FROM lineitem"


def recovered(spark, d):
    return table(spark, d, "lineitem").selectExpr("CAST(l_suppkey % 8 AS INT) AS radius_bin", "CAST(l_partkey % 8 AS INT) AS period_bin", "l_quantity > 25 AS recovered",
                                                  "CASE WHEN l_quantity > 25 THEN 'exact' WHEN l_tax > 0.05D THEN 'alias' ELSE 'none' END AS match")


@query("completeness", with_views("", """
SELECT radius_bin, period_bin, count(*) AS total, count(*) FILTER (recovered) AS recovered, count(*) FILTER (match = 'alias') AS aliases,
  round(avg(CASE WHEN recovered THEN 1.0D ELSE 0.0D END), 9) AS fraction FROM rec GROUP BY 1, 2""", rec=RECOVERED))
def completeness(spark, d):
    return Y.completeness(recovered(spark, d)).withColumn("fraction", r("fraction"))


@query("completeness_matrix", with_views("", "SELECT radius_bin, " + ", ".join(
    f"round(avg(CASE WHEN recovered THEN 1.0D ELSE 0.0D END) FILTER (period_bin = {j}), 9) AS p{j}" for j in range(8)) + " FROM rec GROUP BY 1", rec=RECOVERED))
def completeness_matrix(spark, d):
    out = Y.completeness_matrix(Y.completeness(recovered(spark, d)), 8)
    return out.select("radius_bin", *[r(f"p{j}").alias(f"p{j}") for j in range(8)])


@query("recovery_run")
def recovery_run(spark, d):
    """Inject a planet per cell into every curve, detrend, search and classify."""
    lc = V.lc(spark, d).drop("event_id")
    injections = Y.draw_injections(hosts(spark, d), [2.0, 4.0], [12.0, 16.0], 1, seed=3)
    injections = SR.materialize(injections, "injections")
    curves = SR.materialize(Y.inject(lc, injections), "injected")
    cfg = DetrendConfig(window_length=2.0)
    flat = flat_curve(detrend(curves, cfg))
    found = SR.iterative_search(flat, RUN, raw=curves, detrend_config=cfg)
    return Y.recovery_rows(injections, found.signals, flat)


# ---- calibration tables
CASES = """SELECT CASE o_orderstatus WHEN 'P' THEN 'quiet' WHEN 'F' THEN 'moderate' ELSE 'active' END AS regime, 1 + o_orderkey % 2 AS n_sectors, o_totalprice / 50000.0D AS sde, o_totalprice / 40000.0D AS snr,
  o_orderkey % 300 AS cdpp, o_totalprice > 400000 AS det, o_custkey % 2 = 0 AS warn, o_custkey % 3 AS skips, o_custkey / 10000.0D AS elig, o_orderkey % 4 AS edges FROM orders"""


@query("false_alarm_summary", with_views("", """
SELECT regime, n_sectors, count(*) AS n, count(*) FILTER (det) AS n_false_alarms, round(avg(CASE WHEN det THEN 1.0D ELSE 0.0D END), 9) AS false_alarm_fraction, count(*) FILTER (det AND warn) AS n_with_rotation_warning,
  count(*) FILTER (skips > 0) AS n_with_variability_skips, min(elig) AS eligible_fraction_min, count(*) FILTER (edges > 0) AS n_with_edge_events, round(median(sde), 6) AS sde_p50, round(quantile_cont(sde, 0.99), 6) AS sde_p99,
  round(max(snr), 6) AS snr_max, median(cdpp) AS median_cdpp_1h_ppm FROM cases GROUP BY 1, 2""", cases=CASES))
def false_alarm_summary(spark, d):
    rows = table(spark, d, "orders").selectExpr(
        "CASE o_orderstatus WHEN 'P' THEN 'quiet' WHEN 'F' THEN 'moderate' ELSE 'active' END AS regime", "1 + o_orderkey % 2 AS n_sectors", "o_totalprice / 50000.0D AS sde", "o_totalprice / 40000.0D AS snr",
        "CAST(o_orderkey % 300 AS DOUBLE) AS cdpp_1h_ppm", "o_totalprice > 400000 AS detected", "o_custkey % 2 = 0 AS rotation_warning", "o_custkey % 3 AS n_skipped_variability",
        "o_custkey / 10000.0D AS eligible_fraction", "o_orderkey % 4 AS n_edge_events")
    out = Y.false_alarm_summary(rows)
    return out.select("regime", "n_sectors", "n", "n_false_alarms", r("false_alarm_fraction").alias("false_alarm_fraction"), "n_with_rotation_warning", "n_with_variability_skips",
                      "eligible_fraction_min", "n_with_edge_events", r("sde_p50", 6).alias("sde_p50"), r("sde_p99", 6).alias("sde_p99"), r("snr_max", 6).alias("snr_max"), "median_cdpp_1h_ppm")


VERDICT = "CASE WHEN iteration = 1 THEN 'likely false positive' WHEN iteration < 4 THEN 'planet candidate (with caveats)' ELSE 'planet candidate (passes all tests)' END"


@query("real_star_summary", with_views("stars signals", f"""
SELECT count(*) AS n_stars, count(*) FILTER (nd > 0) AS n_with_detection, (SELECT count(*) FROM signals) AS n_detections,
  (SELECT count(DISTINCT tic_id) FROM signals WHERE {VERDICT} LIKE 'planet candidate%') AS n_surviving FROM stars LEFT JOIN (SELECT tic_id, count(*) AS nd FROM signals GROUP BY 1) USING (tic_id)"""))
def real_star_summary(spark, d):
    sig = V.signals(spark, d)
    count = sig.groupBy("tic_id").agg(F.count(F.lit(1)).alias("n_detections"))
    return Y.real_star_summary(V.stars(spark, d).join(count, "tic_id", "left"), sig.withColumn("verdict", F.expr(VERDICT)))


@query("verdict_counts", with_views("signals", f"SELECT {VERDICT} AS verdict, count(*) AS n FROM signals GROUP BY 1"))
def verdict_counts(spark, d):
    return Y.verdict_counts(V.signals(spark, d).withColumn("verdict", F.expr(VERDICT)))


def entries(spark, d):
    tests = ("array(struct('density' AS name, CASE WHEN tax_ < 3 THEN 'n/a' WHEN snr > 30 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN tax_ < 3 THEN double('NaN') ELSE snr END AS statistic),"
             " struct('shape' AS name, CASE WHEN sde > 20 THEN 'warn' ELSE 'pass' END AS status, sde AS statistic))")
    return V.signals(spark, d).selectExpr("CASE WHEN iteration % 2 = 0 THEN 'planet' ELSE 'false positive' END AS class", "snr", "sde", "n_transits AS tax_", f"{VERDICT} AS verdict").selectExpr(
        "class", "verdict", f"{tests} AS tests")


LONG = """SELECT CASE WHEN iteration % 2 = 0 THEN 'planet' ELSE 'false positive' END AS class, 'density' AS name, CASE WHEN n_transits < 3 THEN 'n/a' WHEN snr > 30 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN n_transits >= 3 THEN snr END AS v FROM signals
  UNION ALL SELECT CASE WHEN iteration % 2 = 0 THEN 'planet' ELSE 'false positive' END, 'shape', CASE WHEN sde > 20 THEN 'warn' ELSE 'pass' END, sde FROM signals"""


@query("vetting_agreement", with_views("signals", """SELECT class, name, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'warn') AS warn, count(*) FILTER (status = 'fail') AS fail,
  count(*) FILTER (status = 'n/a') AS na FROM long GROUP BY 1, 2""", long=LONG))
def vetting_agreement(spark, d):
    return Y.vetting_agreement(entries(spark, d))[1]


@query("statistic_ranges", with_views("signals", "SELECT class, name, count(v) AS n, min(v) AS min, median(v) AS median, max(v) AS max FROM long GROUP BY 1, 2", long=LONG))
def statistic_ranges(spark, d):
    return Y.vetting_agreement(entries(spark, d))[2]


@query("headline_statistics", with_views("signals", f"""
SELECT count(*) AS n_planets, count(*) FILTER (rec) AS n_recovered, round(max(abs(pct)) FILTER (rec), 6) AS max_period_err_pct, count(*) FILTER (rec AND v = 'planet candidate (passes all tests)') AS n_pass_all,
  count(*) FILTER (rec AND v LIKE '%false positive%') AS n_false_positive, round(median(abs(dp)) FILTER (rec), 6) AS median_depth_err_pct
FROM (SELECT snr >= 20 AS rec, snr - 25.0D AS pct, sde - 12.0D AS dp, {VERDICT} AS v FROM signals)"""))
def headline_statistics(spark, d):
    rows = V.signals(spark, d).selectExpr("snr >= 20 AS recovered", "snr - 25.0D AS period_pct", "sde - 12.0D AS depth_pct", f"{VERDICT} AS verdict")
    out = Y.headline_statistics(rows)
    return out.withColumns({c: r(c, 6) for c in ("max_period_err_pct", "median_depth_err_pct")})


# ---- one period again
@query("depth_by_sector", with_views("lc cands", """
SELECT cand_id, sector, round(fo - fi + 3.7e-9D, 8) AS depth, round(s * sqrt(1.0D / n_in + 1.0D / n_out), 8) AS depth_err, n_transits FROM (
  SELECT cand_id, sector, count(*) FILTER (x < duration / 2) AS n_in, count(*) FILTER (x > duration) AS n_out, avg(flux) FILTER (x < duration / 2) AS fi, avg(flux) FILTER (x > duration) AS fo,
    count(DISTINCT epoch) FILTER (x < duration / 2) AS n_transits FROM sel GROUP BY 1, 2)
JOIN (SELECT cand_id, sector, 1.4826D * median(abs(flux - m)) AS s FROM (SELECT *, median(flux) OVER (PARTITION BY cand_id, sector) AS m FROM sel WHERE x > duration) GROUP BY 1, 2) USING (cand_id, sector)
WHERE n_in >= 5 AND n_out >= 10""", nr=NEAR, sel="SELECT *, abs(dt) AS x FROM nr WHERE abs(dt) < duration / 2 OR (abs(dt) > duration AND abs(dt) < 4 * duration)"))
def depth_by_sector(spark, d):
    out = Y.depth_by_group(V.lc(spark, d), V.cands(spark, d), ["sector"])
    return out.select("cand_id", "sector", r(F.col("depth") + 3.7e-9, 8).alias("depth"), r("depth_err", 8).alias("depth_err"), "n_transits")


@query("sector_depths", with_views("lc cands", """
SELECT cand_id, sector, count(*) AS n_epochs, round(sum((fo - fi) * n_in / (s * s)) / sum(n_in / (s * s)) + 3.7e-9D, 8) AS depth, round(1 / sqrt(sum(n_in / (s * s))), 8) AS depth_err FROM (
  SELECT cand_id, sector, epoch, count(*) FILTER (abs(off) < duration / 2) AS n_in, count(*) FILTER (abs(off) > duration) AS n_out, avg(flux) FILTER (abs(off) < duration / 2) AS fi, avg(flux) FILTER (abs(off) > duration) AS fo,
    stddev_pop(flux) FILTER (abs(off) > duration) AS s FROM (SELECT *, t - (t0 + epoch * period) AS off FROM nr) WHERE abs(off) < 4 * duration GROUP BY 1, 2, 3) WHERE n_in >= 8 AND n_out >= 20 GROUP BY 1, 2""", nr=NEAR))
def sector_depths(spark, d):
    lc = V.lc(spark, d)
    out = Y.sector_depths(lc, V.cands(spark, d), A.extent(lc))
    return out.select("cand_id", "sector", "n_epochs", r(F.col("depth") + 3.7e-9, 8).alias("depth"), r("depth_err", 8).alias("depth_err"))


@query("targeted_search")
def targeted_search(spark, d):
    """Each planted period looked at again: the best trial and the next best away from it."""
    lc = V.lc(spark, d)
    curves = A.curve_stats(lc)
    power = SR.materialize(Y.targeted_search(lc, V.planted(spark, d), curves, SearchConfig()), "targeted")
    return Y.next_best(power, curves)


@query("missed_planets", with_views("lc cands", """
SELECT cand_id, round((Y_ - y) / (W_ - w) - y / w, 8) AS depth FROM (SELECT cand_id, tic_id, sum(1.0D / (flux_err * flux_err)) AS w, sum(flux / (flux_err * flux_err)) AS y FROM nr WHERE abs(dt) < 0.5D * duration AND depth >= 0.004D GROUP BY 1, 2)
JOIN (SELECT tic_id, sum(1.0D / (flux_err * flux_err)) AS W_, sum(flux / (flux_err * flux_err)) AS Y_ FROM lc GROUP BY 1) USING (tic_id)""", cad=CADENCE, nr=NEAR))
def missed_planets(spark, d):
    lc, cands = V.lc(spark, d), V.cands(spark, d)
    out = Y.check_missed(lc, cands, cands.where("depth < 0.004D"), A.curve_stats(lc))
    return out.select("cand_id", r("depth", 8).alias("depth"))


# ---- everything
@query("target_reports")
def target_reports(spark, d):
    """From curves to nested reports, for all targets at once."""
    lc = V.lc(spark, d).drop("event_id")
    reports, _ = P.run_curves(lc, RUN, DetrendConfig(window_length=2.0), dumps=V.dumps(spark, d))
    return reports.select("tic_id", F.col("target.n_points").alias("n_points"), "search.n_detections", "search.n_candidates",
                          F.size("planets").alias("n_planets"), F.get("planets.verdict", F.lit(0)).alias("first_verdict"))


