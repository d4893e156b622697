"""Study-level operators: injections, completeness, calibration tables, re-searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AU, R_EARTH, R_JUP, R_SUN, RHO_SUN, SearchConfig
from ..functions.expr import (
    PI,
    a_rs_from_mass_radius,
    finite,
    fold,
    inclination_deg,
    q_to_u,
    stellar_density,
    t14,
    t23,
    trapezoid,
)
from ..functions.special import log_ndtr, ndtri_exp
from .joins import central_epoch, dip_rows
from .search import (
    false_alarm_probability,
    red_noise_snr,
    signal_stats,
    targeted_power,
    transits_with_data,
    unbinned_spectrum,
)
from .stats import quantiles, robust_std


def amplitude(
    lc: DataFrame, cands: DataFrame, curves: DataFrame, ingress_fraction: Column, sigma: Column
) -> DataFrame:
    """Least-squares amplitude of each candidate's trapezoid in 1 - flux, and its error."""
    rows = dip_rows(lc.select("tic_id", "t", "flux"), cands, curves, 0.5)
    s = 1.0 - trapezoid(F.col("dt"), F.lit(1.0), F.col("duration"), ingress_fraction)
    rows = rows.withColumn("_s", s)
    ss = F.sum(F.col("_s") * F.col("_s"))
    out = rows.groupBy("cand_id").agg(
        (F.sum(F.col("_s") * (1.0 - F.col("flux"))) / ss).alias("amplitude"),
        (F.max(sigma) / F.sqrt(ss)).alias("err"),
        ss.alias("_ss"),
    )
    return out.where(F.col("_ss") > 0).drop("_ss")


def _strongest(spectrum: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: sine_period, power and amplitude_ppm of a spectrum's highest point."""
    best = spectrum.groupBy(*keys).agg(
        F.max(F.struct("power", (-F.col("freq")).alias("nf"), "amplitude")).alias("b")
    )
    return best.select(
        *keys, (-1.0 / F.col("b.nf")).alias("sine_period"), F.col("b.power").alias("power"),
        (F.col("b.amplitude") * 1e6).alias("amplitude_ppm"),
    )


def sector_sines(lc: DataFrame, cands: DataFrame, min_power: float = 0.05, min_rows: int = 200) -> DataFrame:
    """Per target and sector: strongest sinusoid of 0.1 to 15 days in the unbinned rows, its
    false-alarm bound, and whether it sits at once, half or twice the candidate's period.

    A sector of fewer than ``min_rows`` rows stays as a row with ``enough`` false and no sinusoid.
    """
    keys = ["tic_id", "sector"]
    size = lc.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("t").alias("_sd"))
    size = size.withColumn("enough", F.col("n") >= min_rows)
    rows = lc.join(size.where("enough").select(*keys), keys, "left_semi")
    best = _strongest(unbinned_spectrum(rows, 0.1, 15.0, 5.0, keys), keys)
    out = size.join(best, keys, "left").select(
        *keys, "n", "enough", "sine_period", "power", "amplitude_ppm",
        false_alarm_probability(F.col("power"), F.col("n"), F.lit(10.0), F.col("_sd")).alias("fap"),
    )
    out = out.join(cands.select("tic_id", "period"), "tic_id", "left")
    at = F.lit(False)
    for k in (0.5, 1.0, 2.0):
        at = at | (F.abs(F.col("period") / (F.col("sine_period") * k) - 1.0) < 0.05)
    return out.withColumn("matches", F.coalesce(at & (F.col("power") > min_power), F.lit(False)))


def short_sines(
    lc: DataFrame, cands: DataFrame, shortest: float = 0.05, longest: float = 0.6,
    max_fap: float = 1e-6, tolerance: float = 0.02,
) -> DataFrame:
    """Strongest sinusoid of ``shortest`` to ``longest`` days under each candidate, from unbinned rows.

    cand_id, tic_id, n, sine_period, power, amplitude_ppm, fap, ratio (the candidate's period over it) and
    ``multiple``: the sinusoid is real (``fap`` below ``max_fap``) and the period a multiple of it. The
    bound counts frequencies up to five times the mean Nyquist frequency. Candidates whose target has
    no usable rows stay, with nulls and ``multiple`` false.
    """
    rows = lc.where(finite(F.col("t"), F.col("flux")))
    size = rows.groupBy("tic_id").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("t").alias("_sd"), (F.max("t") - F.min("t")).alias("_b")
    )
    best = _strongest(unbinned_spectrum(rows, shortest, longest), ["tic_id"]).join(size, "tic_id")
    fap = false_alarm_probability(F.col("power"), F.col("n"), 2.5 * F.col("n") / F.col("_b"), F.col("_sd"))
    best = best.withColumn("fap", fap).drop("_sd", "_b")
    out = cands.select("cand_id", "tic_id", "period").join(best, "tic_id", "left")
    out = out.withColumn("ratio", F.col("period") / F.col("sine_period")).drop("period")
    whole = F.round("ratio")
    flag = (F.col("fap") < max_fap) & (whole >= 2) & (F.abs(F.col("ratio") - whole) < tolerance)
    return out.withColumn("multiple", F.coalesce(flag, F.lit(False)))


# ---- posterior tables
PARAMETERS = ("t0", "period", "rp_rs", "ln_a_rs", "b", "q1", "q2", "f0", "ln_jitter")


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) that depends only on the seed and the keys, not on partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 12)
    return (bits.cast("double") + 0.5) / float(2**52)


def with_positive_normal(
    df: DataFrame, name: str, mean: str, sd: str, u: Column
) -> DataFrame:
    """``df`` with a draw from a normal cut at zero, from one uniform number per row.

    Without a positive ``sd`` the mean itself. Built in steps: the formulas use their argument
    many times, and a step is evaluated once.
    """
    ok = finite(F.col(sd)) & (F.col(sd) > 0)
    out = df.withColumn("_z", F.when(ok, -F.col(mean) / F.col(sd)))
    out = out.withColumn("_below", F.exp(log_ndtr(F.col("_z"))))
    out = out.withColumn("_lp", F.log(F.col("_below") + u * (1.0 - F.col("_below"))))
    out = out.withColumn("_x", ndtri_exp(F.col("_lp")))
    draw = F.greatest(F.col(mean) + F.col(sd) * F.col("_x"), F.lit(1e-12))
    return out.withColumn(name, F.when(ok, draw).otherwise(F.col(mean))).drop("_z", "_below", "_lp", "_x")


def derived_samples(samples: DataFrame, stellar: DataFrame, seed: int = 0) -> DataFrame:
    """Physical quantities of every posterior sample.

    ``samples``: cand_id, sample and the fitted parameters; ``stellar``: cand_id, radius,
    radius_err, teff, teff_err.
    """
    rows = samples.join(stellar, "cand_id", "left").withColumn("a_rs", F.exp("ln_a_rs"))
    k, a, b, p = (F.col(c) for c in ("rp_rs", "a_rs", "b", "period"))
    sin_i = F.sqrt(F.greatest(F.least(1.0 - (b / a) * (b / a), F.lit(1.0)), F.lit(0.0)))

    def hours(reach: Column, grazing: float) -> Column:
        chord = F.sqrt(F.greatest(reach * reach - b * b, F.lit(0.0)))
        x = F.when(sin_i > 0, chord / (a * sin_i)).when(chord > 0, F.lit(1.0)).otherwise(grazing)
        return 24.0 * p / PI * F.asin(F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))

    u1, u2 = q_to_u(F.col("q1"), F.col("q2"))
    rho = stellar_density(p, a)
    own = (F.col("cand_id"), F.col("sample"))
    rows = with_positive_normal(rows, "_r_star", "radius", "radius_err", uniform(seed, *own))
    rows = with_positive_normal(rows, "_t_star", "teff", "teff_err", uniform(seed + 1, *own))
    r_star, teff = F.col("_r_star"), F.col("_t_star")
    has_r, has_t = F.coalesce(F.col("radius") != 0, F.lit(False)), F.coalesce(F.col("teff") != 0, F.lit(False))
    return rows.select(
        "cand_id", "sample", "a_rs", inclination_deg(a, b).alias("inc_deg"), u1.alias("u1"), u2.alias("u2"),
        (k * k * 1e6).alias("depth_ppm"), hours(1.0 + k, 1.0).alias("t14_hours"),
        hours(1.0 - k, 0.0).alias("t23_hours"), (rho / 1000.0).alias("rho_star_cgs"),
        (rho / RHO_SUN).alias("rho_star_solar"),
        F.when(has_r, k * r_star * (R_SUN / R_EARTH)).alias("rp_earth"),
        F.when(has_r, k * r_star * (R_SUN / R_JUP)).alias("rp_jup"),
        F.when(has_r, a * r_star * (R_SUN / AU)).alias("a_au"),
        F.when(has_t, teff * F.sqrt(1.0 / (2.0 * a))).alias("teq_k"),
    )


def posterior_summary(samples: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """Median and 68 % interval of every parameter: cand_id, parameter, median, err_lo, err_hi."""
    named = F.explode(F.array(*[
        F.struct(F.lit(p).alias("parameter"), F.col(p).cast("double").alias("v")) for p in parameters
    ])).alias("x")
    rows = samples.select("cand_id", named).select("cand_id", "x.parameter", "x.v").where(finite(F.col("v")))
    probs = {"_lo": 0.15865, "median": 0.5, "_hi": 0.84135}
    out = quantiles(rows, ["cand_id", "parameter"], F.col("v"), probs)
    return out.select(
        "cand_id", "parameter", "median", (F.col("median") - F.col("_lo")).alias("err_lo"),
        (F.col("_hi") - F.col("median")).alias("err_hi"),
    )


# ---- injections
def log_edges(low: float, high: float, n: int) -> list[float]:
    return [low * (high / low) ** (i / n) for i in range(n + 1)]


def draw_injections(
    stars: DataFrame,
    period_edges: Sequence[float],
    radius_edges: Sequence[float],
    n_per_cell: int,
    seed: int = 0,
    b_max: float = 0.9,
    limb_darkening: tuple[float, float] = (0.4, 0.2),
) -> DataFrame:
    """Planets in every period and radius cell of every star: log-uniform sizes, uniform phase.

    ``stars``: tic_id, radius, mass, t_min. Adds index, bins, period, radius_earth, t0, b, rp_rs,
    a_rs, duration, u1, u2 and ``curve_id``, the key of the injected curve.
    """
    n_p, n_r = len(period_edges) - 1, len(radius_edges) - 1
    size = n_p * n_r * n_per_cell
    rows = stars.withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    cell = F.floor(F.col("index") / n_per_cell)
    rows = rows.withColumns(
        {"radius_bin": F.floor(cell / n_p).cast("int"), "period_bin": (cell % n_p).cast("int")}
    )

    def log_uniform(edges: Sequence[float], which: str, number: int) -> Column:
        lo = F.log(F.element_at(F.array(*[F.lit(e) for e in edges]), F.col(which) + 1))
        hi = F.log(F.element_at(F.array(*[F.lit(e) for e in edges]), F.col(which) + 2))
        return F.exp(lo + (hi - lo) * u(number))

    def u(number: int) -> Column:
        return uniform(seed, F.col("tic_id"), F.col("index"), F.lit(number))

    rows = rows.withColumns(
        {"period": log_uniform(period_edges, "period_bin", 1), "radius_earth": log_uniform(radius_edges, "radius_bin", 2), "b": b_max * u(3)}
    )
    rows = rows.withColumns(
        {
            "t0": F.col("t_min") + F.col("period") * u(4),
            "rp_rs": F.col("radius_earth") * R_EARTH / (F.col("radius") * R_SUN),
            "a_rs": a_rs_from_mass_radius(F.col("period"), F.col("mass"), F.col("radius")),
            "u1": F.lit(limb_darkening[0]),
            "u2": F.lit(limb_darkening[1]),
            "curve_id": F.col("tic_id") * size + F.col("index"),
        }
    )
    duration = t14(F.col("period"), F.col("a_rs"), F.col("rp_rs"), F.col("b"))
    return rows.withColumn("duration", duration).drop("radius", "mass", "t_min")


def inject(lc: DataFrame, injections: DataFrame) -> DataFrame:
    """Each injection's own curve: un-detrended flux times a limb-darkened trapezoid.

    The result's ``tic_id`` is the injection's ``curve_id``.
    """
    columns = ["tic_id", "curve_id", "period", "t0", "b", "rp_rs", "a_rs", "duration", "u1", "u2"]
    rows = lc.join(injections.select(*columns), "tic_id")
    flat = t23(F.col("period"), F.col("a_rs"), F.col("rp_rs"), F.col("b"))
    ingress = F.when(F.col("duration") > 0, 1.0 - flat / F.col("duration")).otherwise(1.0)
    mu = F.sqrt(F.greatest(1.0 - F.col("b") * F.col("b"), F.lit(0.0)))
    disk = 1.0 - F.col("u1") / 3.0 - F.col("u2") / 6.0
    local = 1.0 - F.col("u1") * (1.0 - mu) - F.col("u2") * (1.0 - mu) * (1.0 - mu)
    depth = F.col("rp_rs") * F.col("rp_rs") * local / disk
    shape = trapezoid(fold(F.col("t"), F.col("period"), F.col("t0")), depth, F.col("duration"), ingress)
    keep = [c for c in lc.columns if c not in ("tic_id", "flux")]
    return rows.select(
        F.col("curve_id").alias("tic_id"), *keep,
        F.when(F.col("duration") > 0, F.col("flux") * shape).otherwise(F.col("flux")).alias("flux"),
    )


# Period ratios at which a recovery counts, and their labels.
RECOVERY = ((1.0, "exact"), (0.5, "alias"), (2.0, "alias"), (1.0 / 3.0, "alias"), (3.0, "alias"))


def match_injection(
    pairs: DataFrame, period_tolerance: float = 0.01, t0_tolerance: float = 0.5
) -> DataFrame:
    """``pairs`` of injection (period, t0, duration) and signal (found_period, found_t0) with
    ``match``: exact, alias or none.

    At a fraction 1/m of the period only every m-th dip is real, so any of m epochs may fit.
    """
    p, found = F.col("period"), F.col("found_period")
    tol = t0_tolerance * F.greatest(F.col("duration"), F.lit(1e-3))
    label = F.lit("none")
    for ratio, name in reversed(RECOVERY):
        m = round(1 / ratio) if ratio < 1 else 1
        misses = [F.abs(fold(F.col("found_t0") + found * j, p, F.col("t0"))) for j in range(m)]
        best = F.least(*misses) if m > 1 else misses[0]
        fits = (F.abs(found - p * ratio) <= period_tolerance * p * ratio) & (best < tol)
        label = F.when(fits, F.lit(name)).otherwise(label)
    return pairs.withColumn("match", label)


def recovery_rows(injections: DataFrame, signals: DataFrame, flat: DataFrame) -> DataFrame:
    """One row per injection: whether and how it was found, and the signal that says so.

    ``signals``: the search's, keyed by curve; ``flat``: the searched curves.
    """
    curve = injections.withColumnRenamed("tic_id", "host")
    sig = signals.select(
        F.col("tic_id").alias("curve_id"), "iteration", F.col("period").alias("found_period"),
        F.col("t0").alias("found_t0"), F.col("depth").alias("found_depth"), F.col("sde").alias("found_sde"),
        F.col("snr").alias("found_snr"), F.col("detected").alias("found_detected"), "brightening_ratio", "skipped_peaks",
    )
    pairs = match_injection(curve.join(sig, "curve_id"))
    rank = (
        F.when(F.col("found_detected") & (F.col("match") == "exact"), 0)
        .when(F.col("found_detected") & (F.col("match") == "alias"), 1)
        .otherwise(2)
    )
    variable = F.filter(F.coalesce("skipped_peaks", F.array()), lambda s: s["reason"] == "stellar variability")
    at = F.exists(variable, lambda s: F.abs(s["period"] / F.col("period") - 1.0) < 0.01)
    pick = F.struct("match", "found_period", "found_t0", "found_depth", "found_sde", "found_snr", "found_detected", "brightening_ratio")
    best = pairs.withColumn("_rank", rank).groupBy("curve_id").agg(
        F.min_by(pick, F.struct("_rank", "iteration")).alias("m"),
        F.min("_rank").alias("_best"),
        F.count_if("found_detected").alias("n_detections"),
        F.sum(F.size(variable)).alias("n_skipped_variability"),
        F.bool_or(at).alias("skipped_variability_at_period"),
    )
    inside = F.abs(fold(F.col("t"), F.col("period"), F.col("t0"))) < 0.5 * F.col("duration")
    seen = flat.select(F.col("tic_id").alias("curve_id"), "t").join(
        curve.select("curve_id", "period", "t0", "duration"), "curve_id"
    ).where(inside).select("curve_id", F.rint((F.col("t") - F.col("t0")) / F.col("period")).alias("e")).distinct()
    seen = seen.groupBy("curve_id").agg(F.count(F.lit(1)).alias("n_transits_in_data"))
    out = curve.join(best, "curve_id", "left").join(seen, "curve_id", "left")
    match = F.when(F.col("_best") < 2, F.col("m.match")).otherwise("none")
    return out.select(
        *curve.columns, (match == "exact").alias("recovered"), match.alias("match"),
        F.coalesce("n_transits_in_data", F.lit(0)).alias("n_transits_in_data"),
        *[F.col(f"m.{c}").alias(c) for c in ("found_period", "found_t0", "found_depth", "found_sde", "found_snr", "found_detected", "brightening_ratio")],
        F.coalesce("n_detections", F.lit(0)).alias("n_detections"),
        F.coalesce("n_skipped_variability", F.lit(0)).alias("n_skipped_variability"),
        F.coalesce("skipped_variability_at_period", F.lit(False)).alias("skipped_variability_at_period"),
    )


def completeness(rows: DataFrame) -> DataFrame:
    """Per radius and period cell: injected, recovered, aliases, fraction."""
    hit = F.col("recovered").cast("long")
    return rows.groupBy("radius_bin", "period_bin").agg(
        F.count(F.lit(1)).alias("total"), F.sum(hit).alias("recovered"),
        F.count_if(F.col("match") == "alias").alias("aliases"),
        F.avg(hit.cast("double")).alias("fraction"),
    )


def completeness_matrix(cells: DataFrame, n_period: int) -> DataFrame:
    """The fractions as one row per radius bin and one column per period bin."""
    out = cells.groupBy("radius_bin").pivot("period_bin", list(range(n_period))).agg(F.first("fraction"))
    return out.select("radius_bin", *[F.col(str(j)).alias(f"p{j}") for j in range(n_period)])


# ---- calibration tables
def false_alarm_summary(rows: DataFrame, keys: Sequence[str] = ("regime", "n_sectors")) -> DataFrame:
    """Percentiles of the strongest peaks and counts of false alarms, per case.

    ``rows``: the keys, sde, snr, cdpp_1h_ppm, detected, rotation_warning, n_skipped_variability,
    eligible_fraction, n_edge_events.
    """
    keys = list(keys)
    probs = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "max": 1.0}
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("detected").alias("n_false_alarms"),
        F.avg(F.col("detected").cast("double")).alias("false_alarm_fraction"),
        F.count_if(F.col("detected") & F.col("rotation_warning")).alias("n_with_rotation_warning"),
        F.count_if(F.col("n_skipped_variability") > 0).alias("n_with_variability_skips"),
        F.min("eligible_fraction").alias("eligible_fraction_min"),
        F.count_if(F.col("n_edge_events") > 0).alias("n_with_edge_events"),
    )
    for name in ("sde", "snr"):
        q = quantiles(rows, keys, F.when(finite(F.col(name)), F.col(name)), probs)
        out = out.join(q.select(*keys, *[F.col(p).alias(f"{name}_{p}") for p in probs]), keys, "left")
    cdpp = quantiles(rows, keys, F.col("cdpp_1h_ppm"), {"median_cdpp_1h_ppm": 0.5}).drop("n")
    return out.join(cdpp, keys, "left")


def real_star_summary(stars: DataFrame, planets: DataFrame) -> DataFrame:
    """One row: stars, detections, surviving candidates, median noise."""
    a = stars.agg(
        F.count(F.lit(1)).alias("n_stars"), F.count_if(F.col("n_detections") > 0).alias("n_with_detection")
    )
    passed = F.col("verdict").startswith("planet candidate")
    b = planets.agg(
        F.count(F.lit(1)).alias("n_detections"),
        F.countDistinct(F.when(passed, F.col("tic_id"))).alias("n_surviving"),
    )
    return a.crossJoin(b)  # one row each


def verdict_counts(planets: DataFrame) -> DataFrame:
    return planets.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def vetting_agreement(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdicts per class; statuses per test and class; range of every statistic.

    ``entries``: class, verdict, tests (array of name, status, statistic).
    """
    verdicts = entries.groupBy("class", "verdict").agg(F.count(F.lit(1)).alias("n"))
    tests = entries.select("class", F.explode("tests").alias("x")).select("class", "x.*")
    statuses = tests.groupBy("class", "name").pivot("status", ["pass", "warn", "fail", "n/a"]).agg(F.count(F.lit(1)))
    statuses = statuses.select(
        "class", "name", *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(s.replace("/", "")) for s in ("pass", "warn", "fail", "n/a")]
    )
    good = tests.where(finite(F.col("statistic")))
    ranges = quantiles(good, ["class", "name"], F.col("statistic"), {"min": 0.0, "median": 0.5, "max": 1.0})
    return verdicts, statuses, ranges


def headline_statistics(comparison: DataFrame) -> DataFrame:
    """One row: planets, recovered, largest and median errors, verdict counts.

    ``comparison``: recovered, period_pct, depth_pct, verdict.
    """
    found = comparison.where("recovered")
    counts = comparison.agg(
        F.count(F.lit(1)).alias("n_planets"), F.count_if("recovered").alias("n_recovered"),
        F.max(F.when(F.col("recovered"), F.abs("period_pct"))).alias("max_period_err_pct"),
        F.count_if(F.col("recovered") & (F.col("verdict") == "planet candidate (passes all tests)")).alias("n_pass_all"),
        F.count_if(F.col("recovered") & F.contains("verdict", F.lit("false positive"))).alias("n_false_positive"),
    )
    mid = quantiles(found.withColumn("_all", F.lit(1)), ["_all"], F.abs(F.col("depth_pct")), {"median_depth_err_pct": 0.5})
    return counts.withColumn("_all", F.lit(1)).join(mid.drop("n"), "_all", "left").drop("_all")


# ---- looking again at one period
def depth_by_group(
    lc: DataFrame, cands: DataFrame, groups: Sequence[str]
) -> DataFrame:
    """Box depth and error at each candidate's ephemeris, per source, year or sector.

    Rows between one and four durations out are the level; five inside and ten outside are
    needed.
    """
    keys = ["cand_id", *groups]
    info = cands.select("cand_id", "tic_id", "period", "t0", "duration")
    rows = lc.select("tic_id", "t", "flux", *groups).join(info, "tic_id")
    x = F.abs(fold(F.col("t"), F.col("period"), F.col("t0")))
    d = F.col("duration")
    epoch = F.rint((F.col("t") - F.col("t0")) / F.col("period"))
    rows = rows.withColumns({"_in": x < d / 2.0, "_out": (x > d) & (x < 4.0 * d), "_e": epoch})
    rows = rows.where("_in OR _out")
    sums = rows.groupBy(*keys).agg(
        F.count_if("_in").alias("n_in"), F.count_if("_out").alias("n_out"),
        F.avg(F.when(F.col("_in"), F.col("flux"))).alias("_fi"),
        F.avg(F.when(F.col("_out"), F.col("flux"))).alias("_fo"),
    )
    cycles = rows.where("_in").select(*keys, "_e").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_transits"))
    noise = robust_std(rows.where("_out"), keys, F.col("flux"), "_s").select(*keys, "_s")
    out = sums.join(cycles, keys, "left").join(noise, keys, "left")
    ok = (F.col("n_in") >= 5) & (F.col("n_out") >= 10)
    return out.where(ok).select(
        *keys, (F.col("_fo") - F.col("_fi")).alias("depth"),
        (F.col("_s") * F.sqrt(1.0 / F.col("n_in") + 1.0 / F.col("n_out"))).alias("depth_err"), "n_transits",
    )


def targeted_search(
    lc: DataFrame, cands: DataFrame, curves: DataFrame, config: SearchConfig, window: float = 0.005,
    factors: Sequence[float] = (0.6, 0.8, 1.0, 1.3, 1.7),
) -> DataFrame:
    """Box power within ``window`` of each candidate's period, at a few of its durations."""
    own = F.array(*[F.least(F.greatest(f * F.col("duration"), F.lit(0.01)), 0.4 * F.col("period")) for f in factors])
    rows = cands.join(curves.select("tic_id", "baseline"), "tic_id").withColumn("durations", own)
    df = F.array_min("durations") / (3.0 * F.col("baseline") * F.col("period"))
    lo, hi = 1.0 / (F.col("period") * (1 + window)), 1.0 / (F.col("period") * (1 - window))
    steps = F.sequence(F.lit(0), F.floor((hi - lo) / df).cast("int"))
    rows = rows.withColumn("periods", F.transform(steps, lambda i: 1.0 / (lo + i * df)))
    return targeted_power(lc, rows.select("tic_id", "cand_id", "periods", "durations"), config, curves, config.bls_oversample)


def next_best(power: DataFrame, curves: DataFrame, n: int = 3) -> DataFrame:
    """The strongest trial of each candidate (place 0), then the best ``n`` away from it."""
    top = power.groupBy("cand_id").agg(
        F.max(F.struct("depth_snr", "period", "duration")).alias("m")
    ).select("cand_id", F.col("m.period").alias("_p"), F.col("m.duration").alias("_d"))
    rows = power.join(top, "cand_id").join(curves.select("tic_id", "baseline"), "tic_id")
    away = F.abs(F.col("period") - F.col("_p")) > 2.0 * F.col("_d") * F.col("_p") / F.col("baseline")
    main = F.col("period") == F.col("_p")
    order = Window.partitionBy("cand_id").orderBy(F.desc(main), F.desc("depth_snr"), "period")
    out = rows.where(main | away).withColumn("place", F.row_number().over(order) - 1)
    return out.where(F.col("place") <= n).select("cand_id", "place", "period", "depth_snr", "depth", "duration", "t0")


def sector_depths(lc: DataFrame, cands: DataFrame, curves: DataFrame) -> DataFrame:
    """Weighted mean box depth of every sector over its epochs (8 rows inside, 20 around)."""
    hit = dip_rows(lc.select("tic_id", "sector", "t", "flux"), cands, curves, 4.0)
    x, d = F.abs("dt"), F.col("duration")
    inside, around = x < d / 2.0, x > d
    per = hit.groupBy("cand_id", "sector", "epoch").agg(
        F.count_if(inside).alias("n_in"), F.count_if(around).alias("n_out"),
        F.avg(F.when(inside, F.col("flux"))).alias("_fi"), F.avg(F.when(around, F.col("flux"))).alias("_fo"),
        F.stddev_pop(F.when(around, F.col("flux"))).alias("_s"),
    ).where("n_in >= 8 AND n_out >= 20")
    depth, err = F.col("_fo") - F.col("_fi"), F.col("_s") / F.sqrt("n_in")
    w = 1.0 / (err * err)
    return per.groupBy("cand_id", "sector").agg(
        F.count(F.lit(1)).alias("n_epochs"), (F.sum(w * depth) / F.sum(w)).alias("depth"),
        (1.0 / F.sqrt(F.sum(w))).alias("depth_err"),
    )


def check_missed(
    lc: DataFrame, published: DataFrame, recovered: DataFrame, curves: DataFrame
) -> DataFrame:
    """Depth, dips with data and S/N of the published planets the search did not recover.

    ``published``: cand_id, tic_id, period, t0, duration; ``recovered``: cand_id.
    """
    missed = published.join(recovered.select("cand_id"), "cand_id", "left_anti")
    missed = missed.join(curves.select("tic_id", "t_median"), "tic_id")
    missed = missed.withColumn(
        "t0", central_epoch(F.col("t_median"), F.col("period"), F.col("t0"))
    ).drop("t_median", "depth")
    stats = signal_stats(lc, missed, curves).select("cand_id", "depth")
    count = transits_with_data(lc, missed, curves)
    full = missed.join(stats, "cand_id").join(count, "cand_id")
    return full.select("cand_id", "depth", "n_transits").join(red_noise_snr(lc, full), "cand_id", "left")
