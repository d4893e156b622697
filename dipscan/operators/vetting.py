"""Vetting tests of many candidates at once.

Candidates: cand_id, tic_id, period, t0, duration (days). Curves ``lc``: tic_id, sector, t,
t_us, flux, flux_err. Every test returns one row per candidate: cand_id, status, statistic and
its details. Work near dips is keyed (cand_id, epoch), so a group is one dip's rows; only
out-of-dip noise meets whole curves, and its medians are the open-group ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import R_JUP, R_SUN, VetConfig
from ..functions.expr import finite, fold, max_planet_occultation, trapezoid
from ..functions.special import chi2_sf, log_ndtr, ndtri_exp
from ..session import materialize, spread
from .dipless import scatters
from .joins import dip_rows, drop_near, epochs, near
from .kernels import fit_shifts, fit_trapezoid
from .quiet import QuietCurves
from .sequence import segments, suppress
from .stats import MAD_SCALE, bin_rows, medians, quantiles
from .timesums import TimeSums, in_cycle

PASS, WARN, FAIL, NA = "pass", "warn", "fail", "n/a"
MEDIAN_ERROR = 1.2533  # error of a median over that of a mean


def _when(*cases: tuple[Column, str], otherwise: str) -> Column:
    out = F.when(cases[0][0], F.lit(cases[0][1]))
    for condition, value in cases[1:]:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise))


# ---- noise
def _noise_by_rows(lc: DataFrame, info: DataFrame) -> DataFrame:
    """cand_id, sigma and _binned of candidates that meet the rows of their dips."""
    quiet, ids = QuietCurves(lc.join(info.select("tic_id").distinct(), "tic_id", "left_semi")), ["cand_id"]
    d = F.col("duration")
    dips = materialize(quiet.members(info, ids, (0.0, 0.5)), "dips")
    core = (F.col("_phase") == 0) & (F.col("_off") <= 0.5 * d)
    counts = dips.groupBy("cand_id").agg(F.count(F.lit(1)).alias("_near"), F.count_if(core).alias("_core"))
    left = {c: F.col("n_rows") - F.coalesce(c, F.lit(0)) for c in ("_near", "_core")}
    choice = info.join(quiet.info.select("tic_id", "n_rows"), "tic_id").join(counts, "cand_id", "left").select(
        "cand_id", (left["_near"] >= 100).alias("_use_clear"), (left["_core"] >= 100).alias("_use_outside")
    )
    out = dips.join(choice, "cand_id").where(F.col("_use_clear") | (F.col("_use_outside") & core))
    out = materialize(out.select("cand_id", "seq", "t", "_y", "_cycle", "flux", "flux_bucket", "dt_us", "dt_us_bucket"), "noise-out")
    sigma = quiet.scatter(info, ids, out)
    binned = quiet.binned_scatter(info, ids, out, materialize(quiet.islands(out, ids), "islands"), "_binned")
    return sigma.join(binned, "cand_id", "left")


def noise_properties(lc: DataFrame, cands: DataFrame, curves: DataFrame) -> DataFrame:
    """cand_id, sigma (per row) and beta (red-noise factor, at least 1) away from the dips.

    Rows clear of phases 0 and 0.5 by a duration; if under 100, those outside the dip; if
    still under 100, all.
    """
    info = cands.select("cand_id", "tic_id", "period", "t0", "duration")
    d = F.col("duration")
    info = materialize(info, "cands")
    every = materialize(scatters(lc, info, ["cand_id"], (0.0, 0.5), closed=True, values=True, least=100), "scatters")
    few = info.join(every.where("few").select("cand_id"), "cand_id", "left_semi")
    found = every.where("settled")
    if few.limit(1).count():
        wide = scatters(lc, few, ["cand_id"], (0.0,), closed=True, values=True, least=100, reach=0.5)
        found = found.unionByName(materialize(wide, "scatters").where("settled"))
    scatter = found.select("cand_id", "sigma", F.col("binned").alias("_binned"))
    rest = info.join(found.select("cand_id"), "cand_id", "left_anti")
    if rest.limit(1).count():
        scatter = scatter.unionByName(_noise_by_rows(lc, materialize(rest, "rest")))
    out = (
        info.join(scatter, "cand_id")
        .join(curves.select("tic_id", "cadence"), "tic_id")
    )
    per_bin = F.greatest(d / F.col("cadence"), F.lit(1.0))
    beta = F.col("_binned") / (F.col("sigma") / F.sqrt(per_bin))
    ok = (F.col("sigma") > 0) & finite(F.col("_binned"))
    out = out.select(
        "cand_id", "sigma", F.greatest(F.when(ok, beta).otherwise(1.0), F.lit(1.0)).alias("beta")
    )
    return materialize(out, "noise")


# ---- coverage and single depths
def transit_coverage(lc: DataFrame, cands: DataFrame, curves: DataFrame) -> DataFrame:
    """cand_id, epoch, tc and the share of expected rows inside, before and after each dip."""
    hit = dip_rows(lc.select("tic_id", "t"), cands, curves, 1.5)
    half = F.col("duration") / 2.0
    counts = hit.groupBy("cand_id", "tic_id", "epoch", F.col("time").alias("tc"), "duration").agg(
        F.count_if(F.abs("dt") < half).alias("_in"),
        F.count_if(F.col("dt") < -half).alias("_pre"),
        F.count_if(F.col("dt") > half).alias("_post"),
    )
    out = counts.join(curves.select("tic_id", "cadence"), "tic_id")
    expected = F.col("duration") / F.col("cadence")
    return out.select(
        "cand_id", "epoch", "tc",
        *[
            F.least(F.col(c) / expected, F.lit(1.0)).alias(name)
            for name, c in (("inside", "_in"), ("before", "_pre"), ("after", "_post"))
        ],
    )


def fully_covered(config: VetConfig) -> Column:
    return (
        (F.col("inside") >= config.coverage_min)
        & (F.col("before") >= 0.5)
        & (F.col("after") >= 0.5)
    )


def coverage_test(cands: DataFrame, coverage: DataFrame, config: VetConfig) -> DataFrame:
    """Fail a signal none of whose dips is covered inside and on both sides."""
    counts = coverage.where("inside > 0").groupBy("cand_id").agg(
        F.count(F.lit(1)).alias("n_with_data"),
        F.count_if(fully_covered(config)).alias("n_fully_covered"),
        F.array_sort(F.collect_list(F.when(~fully_covered(config), F.round("tc", 4)))).alias(
            "partial_tc"
        ),
    )
    out = cands.select("cand_id").join(counts, "cand_id", "left")
    full = F.col("n_fully_covered")
    status = _when((full.isNull(), NA), (full == 0, FAIL), (full < 2, WARN), otherwise=PASS)
    return out.select(
        "cand_id", status.alias("status"), full.cast("double").alias("statistic"),
        F.coalesce("n_with_data", F.lit(0)).alias("n_with_data"),
        F.coalesce(full, F.lit(0)).alias("n_fully_covered"), "partial_tc",
    )


def transit_depths(
    lc: DataFrame, cands: DataFrame, curves: DataFrame, noise: DataFrame
) -> DataFrame:
    """cand_id, epoch, tc, depth, depth_err, step, sides of every dip with enough data.

    Flank median (0.75 to 2 durations out, on the sides that have five rows) minus the median
    of the middle 70 %.
    """
    hit = near(lc.select("tic_id", "t", "flux"), epochs(cands, curves, 2.0))
    d, dt, flux = F.col("duration"), F.col("dt"), F.col("flux")
    inside = F.abs(dt) < 0.35 * d
    pre = dt < -0.75 * d
    post = dt > 0.75 * d

    def middle(condition: Column) -> Column:
        return F.percentile(F.when(condition, flux), F.lit(0.5))

    per = hit.groupBy("cand_id", "epoch", F.col("time").alias("tc")).agg(
        F.count_if(inside).alias("n_in"),
        F.count_if(pre).alias("n_pre"),
        F.count_if(post).alias("n_post"),
        middle(inside).alias("m_in"),
        middle(pre).alias("m_pre"),
        middle(post).alias("m_post"),
        middle(pre | post).alias("m_both"),
    )
    has_pre, has_post = F.col("n_pre") >= 5, F.col("n_post") >= 5
    per = per.where((F.col("n_in") >= 5) & (has_pre | has_post)).join(noise, "cand_id")
    both = has_pre & has_post
    level = F.when(both, F.col("m_both")).when(has_pre, F.col("m_pre")).otherwise(F.col("m_post"))
    n_flank = F.when(has_pre, F.col("n_pre")).otherwise(0) + F.when(
        has_post, F.col("n_post")
    ).otherwise(0)
    err = MEDIAN_ERROR * F.col("sigma") * F.col("beta") * F.sqrt(1 / F.col("n_in") + 1 / n_flank)
    return per.select(
        "cand_id", "epoch", "tc", (level - F.col("m_in")).alias("depth"), err.alias("depth_err"),
        F.when(both, F.col("m_pre") - F.col("m_post")).alias("step"),
        F.when(both, 2).otherwise(1).alias("sides"),
    )


def bad_transits(depths: DataFrame, config: VetConfig) -> DataFrame:
    """Single dips far from the others' depth, with ``deviation``; none if they are not rare."""
    centre = quantiles(depths, ["cand_id"], F.col("depth"), {"median_depth": 0.5}, True)
    spread_ = depths.join(centre, "cand_id")
    dev = F.abs(F.col("depth") - F.col("median_depth"))
    scale = spread_.groupBy("cand_id").agg(
        F.greatest(
            MAD_SCALE * F.percentile(dev, F.lit(0.5)), F.percentile("depth_err", F.lit(0.5))
        ).alias("scale")
    )
    rows = spread_.join(scale, "cand_id").where(
        (F.col("n") >= config.bad_transit_min_count) & (F.col("scale") > 0)
    )
    rows = rows.withColumn("deviation", dev / F.col("scale")).where(
        F.col("deviation") > config.bad_transit_sigma
    )
    per = Window.partitionBy("cand_id")
    most = F.greatest(F.lit(1), F.floor(config.bad_transit_max_fraction * F.col("n")))
    rows = rows.withColumn("_k", F.count(F.lit(1)).over(per)).where(F.col("_k") <= most)
    return rows.select(*depths.columns, "median_depth", "scale", "deviation")


def without_transits(planet_rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Per-candidate curves (with cand_id) without two durations around each dropped dip.

    ``dropped``: cand_id, tic_id, tc, duration.
    """
    events = dropped.select(
        "cand_id", F.col("tc").alias("time"), (2.0 * F.col("duration")).alias("half")
    )
    keyed = planet_rows.withColumn("_tic", F.col("tic_id")).withColumn("tic_id", F.col("cand_id"))
    kept = drop_near(keyed, events.withColumnRenamed("cand_id", "tic_id"))
    return kept.withColumn("tic_id", F.col("_tic")).drop("_tic")


# ---- odd and even dips
def odd_even_test(
    lc: DataFrame, cands: DataFrame, curves: DataFrame, noise: DataFrame, config: VetConfig
) -> DataFrame:
    """Compare the depths of odd and even cycles, each dip against its own surroundings.

    A depth is the least-squares amplitude of the dip's shape: the trapezoid of ``fit_duration`` and
    ``fit_ingress`` where ``cands`` has both and they are not null, else a box. The closed form needs four
    sums a dip, so dips combine in each task before they are shuffled.
    """
    rows = lc.select("tic_id", "t", "flux")
    shaped = {"fit_duration", "fit_ingress"} <= set(cands.columns)
    hit = dip_rows(rows, cands, curves, 1.5)
    inside = F.abs("dt") < 0.5 * F.col("duration")
    shape = F.when(inside, 1.0).otherwise(0.0)
    if shaped:
        fitted = finite(F.col("fit_duration"), F.col("fit_ingress")) & (F.col("fit_duration") > 0)
        slope = 1.0 - trapezoid(F.col("dt"), F.lit(1.0), F.col("fit_duration"), F.col("fit_ingress"))
        shape = F.when(F.coalesce(fitted, F.lit(False)), slope).otherwise(shape)
    hit = hit.withColumn("_s", shape)
    flank = F.when(F.col("_s") <= 1e-6, F.col("flux"))
    per = hit.groupBy("cand_id", "epoch").agg(
        F.count_if(F.col("_s") > 0.5).alias("_core"),
        F.sum("_s").alias("_s1"),
        F.sum(F.col("_s") * F.col("_s")).alias("_ss"),
        F.count(flank).alias("_n_flank"),
        F.percentile(flank, F.lit(0.5)).alias("_flank"),
        F.sum(F.col("_s") * F.col("flux")).alias("_sf"),
    )
    # the curve's own level, for the few candidates with a dip lacking flank rows
    lonely = per.where("_n_flank < 5").select("cand_id").distinct()
    sparse = cands.join(lonely, "cand_id", "left_semi").select(
        "cand_id", "tic_id", "period", "t0", "duration"
    )
    outside = rows.join(sparse, "tic_id").where(
        F.abs(fold(F.col("t"), F.col("period"), F.col("t0"))) >= 1.5 * F.col("duration")
    )
    base = medians(outside, ["cand_id"], F.col("flux"), "_base").drop("n")
    per = per.join(base, "cand_id", "left").join(noise, "cand_id")
    own = F.col("_n_flank") >= 5
    noise_row = F.col("sigma") * F.col("beta")
    per = per.withColumns(
        {
            "_level": F.when(own, F.col("_flank")).otherwise(F.coalesce("_base", F.lit(1.0))),
            "_var": F.when(
                own, F.pow(MEDIAN_ERROR * noise_row, F.lit(2.0)) / F.col("_n_flank")
            ).otherwise(0.0),
            "_parity": F.pmod("epoch", F.lit(2)),
        }
    )
    per = per.withColumn("_sy", F.col("_level") * F.col("_s1") - F.col("_sf"))
    single = F.when(F.col("_core") >= 3, F.col("_sy") / F.col("_ss"))
    per = per.withColumn("_single", single)
    sums = per.groupBy("cand_id", "_parity").agg(
        F.sum("_ss").alias("_ss"),
        (F.sum("_sy") / F.sum("_ss")).alias("depth"),
        F.count_if(F.col("_core") > 0).alias("n"),
        F.sum(F.col("_s1") * F.col("_s1") * F.col("_var")).alias("_lv"),
        F.count("_single").alias("n_single"),
        F.percentile("_single", F.lit(0.5)).alias("_mid"),
        F.max(noise_row).alias("_noise"),
    )
    deviations = per.where("_single IS NOT NULL").join(
        sums.select("cand_id", "_parity", "_mid"), ["cand_id", "_parity"]
    )
    scatter = deviations.groupBy("cand_id").agg(
        (MAD_SCALE * F.percentile(F.abs(F.col("_single") - F.col("_mid")), F.lit(0.5))).alias(
            "_scatter"
        )
    )
    err = F.sqrt(F.col("_noise") * F.col("_noise") / F.col("_ss") + F.col("_lv") / F.pow("_ss", F.lit(2.0)))
    sums = sums.withColumn("err", F.when(F.col("_ss") > 0, err))
    wide = cands.select("cand_id")
    for parity, name in ((1, "odd"), (0, "even")):
        part = sums.where(F.col("_parity") == parity).select(
            "cand_id", *[F.col(c).alias(f"{name}_{c}") for c in ("depth", "err", "n", "n_single")]
        )
        wide = wide.join(part, "cand_id", "left")
    wide = wide.join(scatter, "cand_id", "left")
    enough = (
        F.least(F.coalesce("odd_n_single", F.lit(0)), F.coalesce("even_n_single", F.lit(0)))
        >= config.odd_even_min_per_parity
    )
    wide = wide.withColumn("transit_scatter", F.when(enough, F.col("_scatter")))
    floors = {
        name: F.coalesce(F.col("transit_scatter") / F.sqrt(f"{name}_n_single"), F.lit(0.0))
        for name in ("odd", "even")
    }
    floored = (floors["odd"] > F.col("odd_err")) | (floors["even"] > F.col("even_err"))
    wide = wide.withColumn("scatter_floor_applied", F.coalesce(floored, F.lit(False)))
    wide = wide.withColumns(
        {f"{n}_err": F.greatest(F.col(f"{n}_err"), floors[n]) for n in ("odd", "even")}
    )
    missing = (
        F.least(F.coalesce("odd_n", F.lit(0)), F.coalesce("even_n", F.lit(0))) < 1
    ) | ~finite(F.col("odd_err"), F.col("even_err"))
    statistic = F.abs(F.col("odd_depth") - F.col("even_depth")) / F.hypot("odd_err", "even_err")
    status = _when((missing, NA), (statistic > config.odd_even_sigma, FAIL), otherwise=PASS)
    return wide.select(
        "cand_id", status.alias("status"), F.when(~missing, statistic).alias("statistic"),
        "odd_depth", "odd_err", "even_depth", "even_err", "transit_scatter",
        "scatter_floor_applied",
    )


# ---- secondary eclipses
def box_sums(hit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and flux sums inside (half a duration) and in the flanks (to 1.5 durations)."""
    inside = F.abs("dt") < 0.5 * F.col("duration")
    return hit.groupBy(*keys).agg(
        F.count_if(inside).alias("n_in"),
        F.count_if(~inside).alias("n_out"),
        F.coalesce(F.sum(F.when(inside, F.col("flux"))), F.lit(0.0)).alias("s_in"),
        F.coalesce(F.sum(F.when(~inside, F.col("flux"))), F.lit(0.0)).alias("s_out"),
    )


def _box_depth(noise: Column) -> tuple[Column, Column]:
    ok = (F.col("n_in") >= 3) & (F.col("n_out") >= 3)
    depth = F.col("s_out") / F.col("n_out") - F.col("s_in") / F.col("n_in")
    err = noise * F.sqrt(1.0 / F.col("n_in") + 1.0 / F.col("n_out"))
    return F.when(ok, depth), F.when(ok, err)


def leave_one_orbit_out(orbits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From sums per orbit (with ``noise``): the S/N left without the orbit that matters most.

    Adds n_orbits (with rows inside) and the totals' depth and error. NULL S/N with fewer
    than two orbits.
    """
    per = Window.partitionBy(*keys)
    sums = ("n_in", "n_out", "s_in", "s_out")
    rows = orbits.withColumns({f"_t_{c}": F.sum(c).over(per) for c in sums})
    rest = {c: F.col(f"_t_{c}") - F.col(c) for c in sums}
    depth = rest["s_out"] / rest["n_out"] - rest["s_in"] / rest["n_in"]
    err = F.col("noise") * F.sqrt(1.0 / rest["n_in"] + 1.0 / rest["n_out"])
    ok = (rest["n_in"] >= 3) & (rest["n_out"] >= 3)
    rows = rows.withColumn("_snr", F.when(ok, depth / err))
    out = rows.groupBy(*keys).agg(
        F.min("_snr").alias("_loo"),
        F.count_if(F.col("n_in") > 0).alias("n_orbits"),
        F.min_by("epoch", F.col("_snr")).alias("worst_orbit"),
        F.max("noise").alias("noise"),
        *[F.sum(c).alias(c) for c in sums],
    )
    depth, err = _box_depth(F.col("noise"))
    return out.select(
        *keys, F.when(F.col("n_orbits") >= 2, F.col("_loo")).alias("loo_snr"), "n_orbits",
        F.when(F.col("n_orbits") >= 2, F.col("worst_orbit")).alias("worst_orbit"),
        "n_in", depth.alias("depth"), err.alias("depth_err"),
    )


def half_phase_dip(
    lc: DataFrame, cands: DataFrame, curves: DataFrame, noise: DataFrame
) -> DataFrame:
    """The box dip at phase 0.5, and its S/N without its strongest orbit."""
    shifted = cands.withColumn("t0", F.col("t0") + 0.5 * F.col("period"))
    hit = dip_rows(lc.select("tic_id", "t", "flux"), shifted, curves, 1.5)
    orbits = box_sums(hit, ["cand_id", "epoch"]).join(noise, "cand_id")
    orbits = orbits.withColumn("noise", F.col("sigma") * F.col("beta"))
    return leave_one_orbit_out(orbits, ["cand_id"])


def phase_scan(lc: DataFrame, cands: DataFrame, noise: DataFrame) -> DataFrame:
    """Box dips at every quarter duration of phase: cand_id, k, centre (days), depth, snr.

    A box is the difference of running sums at its four edges in every cycle, so a candidate costs
    its baseline over a quarter of its duration, not its rows.
    """
    info = cands.select("cand_id", "tic_id", "period", "t0", "duration")
    p, d = F.col("period"), F.col("duration")
    step = F.greatest(d / 4.0, p / 2000.0)
    count = F.ceil((p - 4.0 * d) / step)
    info = info.withColumns({"_step": step, "_count": count}).where(F.col("_count") > 0)
    sums = TimeSums(lc, s=F.col("flux") - 1.0)  # a depth doesn't see the level
    edges = sums.cycles(info).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1)))
    edges = edges.withColumn("_c", 2.0 * d + F.col("k") * F.col("_step")).withColumn("_edge", F.explode(F.array(*map(F.lit, range(4)))))
    c, edge = F.col("_c"), F.col("_edge")
    from_start = (
        F.when(edge == 0, F.greatest(c - 1.5 * d, 1.5 * d)).when(edge == 1, c - 0.5 * d).when(edge == 2, c + 0.5 * d)
        .otherwise(F.least(c + 1.5 * d, p - 1.5 * d))
    )

    def below(t: Column) -> Column:
        u = in_cycle(t)
        return (
            F.when(edge == 0, (u - c <= -1.5 * d) | (u <= 1.5 * d)).when(edge == 1, u - c <= -0.5 * d)
            .when(edge == 2, u - c < 0.5 * d).otherwise((u - c < 1.5 * d) & (p - u > 1.5 * d))
        )

    found = sums.below(edges, F.col("t0") + F.col("e") * p + from_start, below)
    sign_in = F.when(edge == 1, -1).when(edge == 2, 1).otherwise(0)
    sign_out = F.when(edge % 2 == 0, -1).otherwise(1)
    sums = found.groupBy("cand_id", "k", "duration", "_step").agg(
        F.sum(sign_in * F.col("n")).alias("n_in"), F.sum(sign_out * F.col("n")).alias("n_out"),
        F.sum(sign_in * F.col("s")).alias("s_in"), F.sum(sign_out * F.col("s")).alias("s_out"),
    ).join(noise, "cand_id")
    depth, err = _box_depth(F.col("sigma") * F.col("beta"))
    out = sums.select(
        "cand_id", "k", "duration", (2.0 * d + F.col("k") * F.col("_step")).alias("centre"),
        depth.alias("depth"), (depth / err).alias("snr"),
    )
    return out.where(finite(F.col("snr")))


def top_phase_dips(scan: DataFrame, count: int = 5) -> DataFrame:
    """The strongest dips of each scan that lie a duration apart: with ``place`` from 1."""
    apart = suppress(scan, ["cand_id"], "centre", F.col("duration"), "snr")
    order = Window.partitionBy("cand_id").orderBy(F.desc("snr"), "centre")
    return apart.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def secondary_eclipse_test(
    lc: DataFrame, cands: DataFrame, curves: DataFrame, noise: DataFrame, config: VetConfig
) -> DataFrame:
    """An eclipse at phase 0.5, or a dip at another phase, and whether a planet could cause it.

    ``cands`` may carry rp_rs, a_rs and teff for the planetary limit.
    """
    names = [c for c in ("rp_rs", "a_rs", "teff") if c in cands.columns]
    half = half_phase_dip(lc, cands, curves, noise)
    # every dip of the scan that counts, a duration apart
    tops = suppress(phase_scan(lc, cands, noise), ["cand_id"], "centre", F.col("duration"), "snr")
    tops = tops.where(F.col("snr") >= config.secondary_scan_sigma).withColumnRenamed("k", "place")
    # these dips again, orbit by orbit, without the primary's surroundings
    places = cands.join(tops.select("cand_id", "place", "centre", "snr", F.col("depth").alias("scan_d")), "cand_id")
    moved = places.withColumn("_primary", F.col("t0")).withColumn("t0", F.col("t0") + F.col("centre"))
    hit = dip_rows(lc.select("tic_id", "t", "flux"), moved, curves, 1.5).where(
        F.abs(fold(F.col("t"), F.col("period"), F.col("_primary"))) > 1.5 * F.col("duration")
    )
    orbits = box_sums(hit, ["cand_id", "place", "epoch"]).join(noise, "cand_id")
    orbits = orbits.withColumn("noise", F.col("sigma") * F.col("beta"))
    robust = leave_one_orbit_out(orbits, ["cand_id", "place"]).select("cand_id", "place", "loo_snr")
    judged = places.join(robust, ["cand_id", "place"], "left")
    holds = F.coalesce(F.col("loo_snr") >= config.secondary_scan_sigma, F.lit(False))
    best = judged.groupBy("cand_id").agg(
        F.max(F.when(holds, F.struct("snr", F.col("scan_d").alias("d"), (F.col("centre") / F.col("period")).alias("ph")))).alias("_b"),
        F.count_if(~holds & (F.col("snr") >= config.secondary_scan_sigma)).alias("n_single_orbit_dips"),
    )
    out = cands.select("cand_id", *names).join(half, "cand_id", "left").join(best, "cand_id", "left")
    if "rp_rs" in names and "a_rs" in names:
        teff = F.col("teff") if "teff" in names else F.lit(None).cast("double")
        limit = max_planet_occultation(F.col("rp_rs"), F.col("a_rs"), teff)
    else:
        limit = F.lit(None).cast("double")
    snr = F.col("depth") / F.col("depth_err")
    out = out.withColumns({"max_planet_depth": limit, "statistic": snr})
    lim, factor = F.col("max_planet_depth"), config.secondary_planet_factor
    robust_half = F.coalesce(F.col("loo_snr") >= config.secondary_sigma, F.lit(False))
    one_orbit = (snr >= config.secondary_sigma) & ~robust_half
    decisive = F.when(one_orbit, F.coalesce("loo_snr", F.lit(0.0))).otherwise(snr)
    quiet = decisive < config.secondary_sigma
    scan_hit = F.coalesce(F.col("_b.snr") >= config.secondary_scan_sigma, F.lit(False))
    deep_scan = F.coalesce(F.col("_b.d") > factor * lim, F.lit(False))
    deep = F.coalesce(F.col("depth") > factor * lim, F.lit(False))
    status = _when(
        (F.col("depth").isNull() | ~finite(F.col("depth_err")) | (F.col("depth_err") <= 0), NA),
        (quiet & scan_hit & deep_scan, FAIL),
        (quiet & scan_hit, WARN),
        (quiet, PASS),
        (deep, FAIL),
        (lim.isNotNull(), PASS),
        otherwise=WARN,
    )
    return out.select(
        "cand_id", status.alias("status"), "statistic", "depth", "depth_err", "loo_snr", "n_orbits",
        F.col("_b.snr").alias("scan_snr"), F.col("_b.ph").alias("scan_phase"),
        F.col("_b.d").alias("scan_depth"), "n_single_orbit_dips", "max_planet_depth",
    )


# ---- shape
_SHAPE = (
    "cand_id long, tc double, fit_depth double, t14 double, ingress_fraction double, "
    "ingress_err double"
)


def shape_bins(lc: DataFrame, cands: DataFrame, curves: DataFrame) -> DataFrame:
    """Folded dips in bins of a thirtieth duration (or a cadence): cand_id, x, y, n."""
    hit = dip_rows(lc.select("tic_id", "t", "flux"), cands, curves, 2.0).join(
        curves.select("tic_id", "cadence"), "tic_id"
    )
    width = F.greatest(F.col("duration") / 30.0, F.col("cadence"))
    far = hit.where(F.abs("dt") > F.col("duration"))
    base = medians(far, ["cand_id"], F.col("flux"), "_base").drop("n")
    bins = bin_rows(hit, ["cand_id", "duration"], "dt", "flux", width)
    size = hit.groupBy("cand_id").agg(F.count(F.lit(1)).alias("_rows")).where("_rows >= 10")
    bins = bins.join(size, "cand_id").join(base, "cand_id", "left")
    return bins.select(
        "cand_id", "duration", F.col("x_mean").alias("x"),
        (F.col("y_mean") / F.coalesce("_base", F.lit(1.0))).alias("y"),
        F.col("count").cast("double").alias("n"),
    )


def fit_shapes(bins: DataFrame) -> DataFrame:
    """Best trapezoid of every candidate: a candidate is some 120 bins, whatever its rows."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, n = (pdf[c].to_numpy(float) for c in ("x", "y", "n"))
        out = fit_trapezoid(x, y, n, float(pdf["duration"].iloc[0]))
        return pd.DataFrame([{"cand_id": pdf["cand_id"].iloc[0], **out}])

    return spread(bins, "cand_id").groupBy("cand_id").applyInPandas(fit, _SHAPE)


def shape_test(
    lc: DataFrame,
    cands: DataFrame,
    curves: DataFrame,
    config: VetConfig,
    samples: DataFrame | None = None,
) -> DataFrame:
    """V- or U-shaped, and the posterior share of grazing geometries (samples: b, rp_rs)."""
    out = cands.select("cand_id").join(fit_shapes(shape_bins(lc, cands, curves)), "cand_id", "left")
    if samples is None:
        out = out.withColumn("p_grazing", F.lit(None).cast("double"))
    else:
        out = out.join(grazing(samples), "cand_id", "left")
    v = F.col("ingress_fraction") >= config.v_shape_warn
    graze = F.coalesce(F.col("p_grazing") > 0.5, F.lit(False))
    status = _when((F.col("ingress_fraction").isNull(), NA), (v | graze, WARN), otherwise=PASS)
    return out.select("cand_id", status.alias("status"), F.col("ingress_fraction").alias("statistic"),
                      "tc", "fit_depth", "t14", "ingress_err", "p_grazing")


def grazing(samples: DataFrame) -> DataFrame:
    over = (F.col("b") + F.col("rp_rs") > 1.0).cast("double")
    return samples.groupBy("cand_id").agg(F.avg(over).alias("p_grazing"))


# ---- posterior tests
def density_test(samples: DataFrame, stellar: DataFrame, config: VetConfig) -> DataFrame:
    """Gaussian-equivalent tension between samples of the density and the catalog's.

    ``samples``: cand_id, rho (solar); ``stellar``: cand_id, rho_cat, rho_cat_err. The tail
    probability is averaged over samples in log space, so extreme tensions stay finite.
    """
    good = samples.where(finite(F.col("rho")) & (F.col("rho") > 0)).select(
        "cand_id", "rho", F.log("rho").alias("_x")
    )
    probs = {"_lo": 0.15865, "_hi": 0.84135, "_rho": 0.5}
    mid = quantiles(good, ["cand_id"], F.col("rho"), probs).join(
        medians(good, ["cand_id"], F.col("_x"), "_mu").drop("n"), "cand_id"
    )
    known = stellar.where("rho_cat IS NOT NULL").join(mid, "cand_id")
    sd = F.when(
        F.coalesce(F.col("rho_cat_err"), F.lit(0.0)) > 0, F.col("rho_cat_err") / F.col("rho_cat")
    ).otherwise(0.25)
    known = known.withColumns({"_sd": sd, "_lc": F.log("rho_cat")})
    rows = good.join(known.select("cand_id", "_sd", "_lc", "_mu"), "cand_id")
    d = (F.col("_x") - F.col("_lc")) / F.col("_sd")
    rows = rows.withColumn("_l", log_ndtr(F.when(F.col("_mu") < F.col("_lc"), d).otherwise(-d)))
    top = rows.groupBy("cand_id").agg(F.max("_l").alias("_top"))
    tail = rows.join(top, "cand_id").groupBy("cand_id").agg(
        (F.max("_top") + F.log(F.sum(F.exp(F.col("_l") - F.col("_top")))) - F.log(F.count(F.lit(1)))).alias("_lt")
    )
    out = stellar.select("cand_id").join(
        known.join(tail, "cand_id"), "cand_id", "left"
    )
    size = F.greatest(-ndtri_exp(F.col("_lt")), F.lit(0.0))
    z = F.when(F.col("_mu") < F.col("_lc"), -size).otherwise(size)
    ratio = F.exp("_mu") / F.col("rho_cat")
    status = _when(
        (F.col("_lt").isNull(), NA),
        (F.abs(z) <= config.density_sigma, PASS),
        (F.greatest(ratio, 1.0 / ratio) > config.density_factor_fail, FAIL),
        otherwise=WARN,
    )
    return out.select("cand_id", status.alias("status"), z.alias("statistic"), ratio.alias("ratio"),
                      F.exp("_mu").alias("rho_fit"), F.col("_lo").alias("rho_fit_lo"),
                      F.col("_hi").alias("rho_fit_hi"))


def radius_test(samples: DataFrame, stellar: DataFrame, config: VetConfig) -> DataFrame:
    """Whether the companion is too large for a planet (stellar: cand_id, radius)."""
    mid = medians(samples, ["cand_id"], F.col("rp_rs"), "_k").drop("n")
    out = stellar.join(mid, "cand_id", "left")
    rp = F.when(F.col("radius") != 0, F.col("_k") * F.col("radius") * (R_SUN / R_JUP))
    status = _when((rp.isNull(), NA), (rp > config.max_planet_radius_rjup, FAIL), otherwise=PASS)
    return out.select("cand_id", status.alias("status"), rp.alias("statistic"))


def rotation_test(cands: DataFrame, rotation: DataFrame, config: VetConfig) -> DataFrame:
    """Warn at once, half or twice the rotation period (rotation: tic_id, period, power)."""
    rot = rotation.select("tic_id", F.col("period").alias("_prot"), F.col("power").alias("_power"))
    out = cands.select("cand_id", "tic_id", "period").join(rot, "tic_id", "left")
    offers = F.array(*[
        F.struct(
            F.abs(F.col("period") / (k * F.col("_prot")) - 1.0).alias("size"),
            F.lit(i).alias("i"), F.lit(k).alias("multiple"),
            (F.col("period") / (k * F.col("_prot")) - 1.0).alias("offset"),
        )
        for i, k in enumerate((1.0, 0.5, 2.0))
    ])
    out = out.withColumn("_b", F.array_min(offers))
    clear = finite(F.col("_prot"), F.col("_power")) & (F.col("_power") >= config.rotation_min_power)
    status = _when(
        (~clear, NA), (F.abs("_b.offset") <= config.rotation_tolerance, WARN), otherwise=PASS
    )
    return out.select("cand_id", status.alias("status"),
                      F.when(clear, F.col("_b.offset")).alias("statistic"),
                      F.when(clear, F.col("_b.multiple")).alias("multiple"))


# ---- momentum dumps
def momentum_dump_test(
    lc: DataFrame, cands: DataFrame, depths: DataFrame, dumps: DataFrame, config: VetConfig
) -> DataFrame:
    """Fail a signal whose depth comes from dips at momentum dumps (dumps: tic_id, t)."""
    margin = config.dump_margin_hours / 24.0
    info = cands.select("cand_id", "tic_id", "duration")
    dips = depths.join(info, "cand_id").select(
        "cand_id", "tic_id", F.col("tc").alias("t"), "epoch", "depth", "depth_err", "duration"
    )
    widest = cands.groupBy("tic_id").agg(F.max("duration").alias("_d"))
    events = dumps.join(widest, "tic_id").select(
        "tic_id", F.col("t").alias("time"), (F.col("_d") / 2.0 + margin).alias("half")
    )
    window = F.col("duration") / 2.0 + margin
    at = near(dips, events, closed=True).where(F.abs("dt") <= window)
    flags = at.select("cand_id", "epoch").distinct().withColumn("_at", F.lit(True))
    rows = dips.join(flags, ["cand_id", "epoch"], "left").withColumn(
        "_at", F.coalesce("_at", F.lit(False))
    )
    w = 1.0 / (F.col("depth_err") * F.col("depth_err"))
    aggs = []
    for name, cond in (("at", F.col("_at")), ("away", ~F.col("_at"))):
        aggs += [
            F.sum(F.when(cond, w)).alias(f"_w_{name}"),
            F.sum(F.when(cond, w * F.col("depth"))).alias(f"_wd_{name}"),
        ]
    sums = rows.groupBy("cand_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_at").alias("k"), *aggs
    )
    # chance that all dips fall near dumps: only for candidates where all do
    all_at = sums.where("k = n").join(info, "cand_id")
    total = lc.groupBy("tic_id").agg(F.count(F.lit(1)).alias("_rows"))
    close = near(lc.select("tic_id", "t", "t_us"), events, closed=True)
    close = close.join(all_at.select("cand_id", "tic_id", "duration"), "tic_id").where(
        F.abs("dt") <= window
    )
    close = close.groupBy("cand_id", "tic_id", "t_us").agg(F.lit(1).alias("_one"))
    share = close.groupBy("cand_id", "tic_id").agg(F.count(F.lit(1)).alias("_c")).join(total, "tic_id")
    share = share.select("cand_id", (F.col("_c") / F.col("_rows")).alias("_share"))
    out = cands.select("cand_id").join(sums, "cand_id", "left").join(share, "cand_id", "left")
    d_at, d_away = F.col("_wd_at") / F.col("_w_at"), F.col("_wd_away") / F.col("_w_away")
    e_at, e_away = 1.0 / F.sqrt("_w_at"), 1.0 / F.sqrt("_w_away")
    sigma = (d_at - d_away) / F.hypot(e_at, e_away)
    chance = F.pow(F.coalesce("_share", F.lit(0.0)), F.col("n"))
    whole = F.col("k") == F.col("n")
    deeper = sigma > config.dump_sigma
    status = _when(
        (F.col("n").isNull(), NA),
        (F.col("k") == 0, PASS),
        (whole & (F.col("n") >= 2) & (chance < config.dump_chance), FAIL),
        (whole, WARN),
        (deeper & (d_away < config.dump_sigma * e_away), FAIL),
        (deeper, WARN),
        otherwise=PASS,
    )
    statistic = F.when(F.col("k") == 0, F.lit(0.0)).when(whole, chance).otherwise(sigma)
    return out.select("cand_id", status.alias("status"), statistic.alias("statistic"),
                      F.coalesce("n", F.lit(0)).alias("n_transits"),
                      F.coalesce("k", F.lit(0)).alias("n_at_dumps"),
                      d_at.alias("depth_at_dumps"), d_away.alias("depth_elsewhere"))


# ---- consistency over chunks of data
def chunk_consistency(
    lc: DataFrame, cands: DataFrame, depths: DataFrame, max_gap: float = 0.5
) -> DataFrame:
    """Whether dips are equally deep in every sector (or, within one, every data segment).

    Returns cand_id, n_transits, n_chunks, chunked_by, chunks, snr_all, snr_without_strongest,
    strongest, chi2, dof, p_value, scatter_floor.
    """
    spans = lc.groupBy("tic_id", "sector").agg(F.max("t").alias("_end")).groupBy("tic_id").agg(
        F.array_sort(F.collect_list(F.struct("_end", "sector"))).alias("_ends")
    )
    starts = segments(lc, ["tic_id"], max_gap).groupBy("tic_id").agg(
        F.array_sort(F.collect_list("seg_start")).alias("_starts")
    )
    rows = depths.join(cands.select("cand_id", "tic_id"), "cand_id")
    rows = rows.join(spans, "tic_id").join(starts, "tic_id")
    later = F.filter("_ends", lambda e: e["_end"] >= F.col("tc"))
    sector = F.coalesce(F.get(later, F.lit(0))["sector"], F.element_at("_ends", -1)["sector"])
    segment = F.size(F.filter("_starts", lambda s: s <= F.col("tc")))
    rows = rows.withColumns({"_sector": sector, "_segment": segment})
    per = Window.partitionBy("cand_id")
    many = (F.min("_sector").over(per) < F.max("_sector").over(per))
    rows = rows.withColumn("_many", many)
    label = F.when(F.col("_many"), F.concat(F.lit("sector "), F.col("_sector"))).otherwise(
        F.concat(F.lit("segment "), F.col("_segment"))
    )
    rows = rows.withColumn("chunk", label).select(
        "cand_id", "chunk", "_many", "tc", "depth", "depth_err"
    )
    w = 1.0 / (F.col("depth_err") * F.col("depth_err"))
    sums = rows.groupBy("cand_id", "chunk").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("_many").alias("_many"),
        F.min("tc").alias("_first"),
        F.sum(w).alias("_w"),
        (F.sum(w * F.col("depth")) / F.sum(w)).alias("depth"),
        F.percentile("depth", F.lit(0.5)).alias("_mid"),
    )
    dev = rows.select("cand_id", "chunk", F.col("depth").alias("_d")).join(
        sums.where("n >= 3").select("cand_id", "chunk", "_mid"), ["cand_id", "chunk"]
    )
    floor = dev.groupBy("cand_id").agg(
        F.count(F.lit(1)).alias("_m"),
        (MAD_SCALE * F.percentile(F.abs(F.col("_d") - F.col("_mid")), F.lit(0.5))).alias("_sc"),
    )
    sums = sums.join(floor, "cand_id", "left")
    scatter = F.when(F.coalesce("_m", F.lit(0)) >= 6, F.col("_sc")).otherwise(0.0)
    sums = sums.withColumn("_scatter", scatter)
    err = F.greatest(1.0 / F.sqrt("_w"), F.col("_scatter") / F.sqrt("n"))
    sums = sums.withColumn("depth_err", err)
    sums = sums.withColumns(
        {
            "snr": F.when(F.col("depth_err") > 0, F.col("depth") / F.col("depth_err")),
            "_v": 1.0 / (F.col("depth_err") * F.col("depth_err")),
        }
    )
    sums = sums.withColumns(
        {
            "_total": F.sum("_v").over(per),
            "_mean": F.sum(F.col("_v") * F.col("depth")).over(per) / F.sum("_v").over(per),
        }
    )
    term = (F.col("depth") - F.col("_mean")) * (F.col("depth") - F.col("_mean")) * F.col("_v")
    top = F.struct("snr", (-F.col("_first")).alias("o"), "chunk", F.col("_v").alias("v"), "depth")
    item = F.struct("_first", "chunk", F.col("n").alias("n_transits"), "depth", "depth_err", "snr")
    out = sums.groupBy("cand_id").agg(
        F.sum("n").alias("n_transits"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.max("_many").alias("_many"),
        F.array_sort(F.collect_list(item)).alias("chunks"),
        F.max("_total").alias("_total"),
        F.max("_mean").alias("_mean"),
        F.sum(term).alias("_chi2"),
        F.max(top).alias("_top"),
        F.max("_scatter").alias("scatter_floor"),
    )
    rest = F.col("_total") - F.col("_top.v")
    rest_mean = (F.col("_total") * F.col("_mean") - F.col("_top.v") * F.col("_top.depth")) / rest
    several = F.col("n_chunks") >= 2
    dof = (F.col("n_chunks") - 1).cast("int")
    out = out.select(
        "cand_id", "n_transits", "n_chunks",
        F.when(F.col("_many"), "sector").otherwise("segment").alias("chunked_by"),
        F.transform("chunks", lambda c: c.dropFields("_first")).alias("chunks"),
        (F.col("_mean") * F.sqrt("_total")).alias("snr_all"),
        F.when(several, rest_mean * F.sqrt(rest)).alias("snr_without_strongest"),
        F.when(several, F.col("_top.chunk")).alias("strongest"),
        F.when(several, F.col("_chi2")).alias("chi2"),
        F.when(several, dof).otherwise(0).alias("dof"),
        F.when(several, chi2_sf(F.col("_chi2"), F.greatest(dof, F.lit(1)))).alias("p_value"),
        "scatter_floor",
    )
    return cands.select("cand_id").join(out, "cand_id", "left")


# ---- timing
_TIMES = "cand_id long, epoch long, tc double, err double"


def transit_times(
    lc: DataFrame, cands: DataFrame, curves: DataFrame, coverage: DataFrame, config: VetConfig
) -> DataFrame:
    """Mid-time and error of every fully covered dip, its shape held fixed.

    ``cands`` also carries depth and optionally ingress_fraction (a trapezoid's).
    """
    full = coverage.where(fully_covered(config)).select("cand_id", "epoch")
    shape = cands if "ingress_fraction" in cands.columns else cands.withColumn(
        "ingress_fraction", F.lit(0.2)
    )
    windows = epochs(shape, curves, 1.5).join(full, ["cand_id", "epoch"], "left_semi")
    hit = near(lc.select("tic_id", "t", "flux", "flux_err"), windows).select(
        "cand_id", "epoch", "time", "dt", "flux", "flux_err", "duration", "depth", "ingress_fraction"
    )

    keys = ["cand_id", "epoch"]
    # a dip's rows (three durations of a curve) are one array; many dips are fitted together
    dips = hit.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("time", "duration", "depth", "ingress_fraction")],
        F.collect_list(F.struct("dt", "flux", "flux_err")).alias("_r"),
    ).select("*", F.col("_r.dt").alias("dt"), F.col("_r.flux").alias("flux"), F.col("_r.flux_err").alias("flux_err")).drop("_r")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            flat = {c: np.concatenate([np.asarray(x, float) for x in pdf[c]]) for c in ("dt", "flux", "flux_err")}
            ends = np.cumsum([len(x) for x in pdf["dt"]])
            shift, err = fit_shifts(
                flat["dt"], flat["flux"], 1.0 / flat["flux_err"] ** 2, ends,
                *[pdf[c].to_numpy(float) for c in ("duration", "depth", "ingress_fraction")],
            )
            yield pd.DataFrame({"cand_id": pdf["cand_id"], "epoch": pdf["epoch"], "tc": pdf["time"] + shift, "err": err})

    out = spread(dips, *keys).mapInPandas(measure, _TIMES)
    return out.where(finite(F.col("err")))


def o_minus_c(times: DataFrame, season_gap: float = 100.0) -> DataFrame:
    """``times`` with ``oc_minutes`` against each candidate's weighted line, and ``season``."""
    w = 1.0 / (F.col("err") * F.col("err"))
    mean = times.groupBy("cand_id").agg(
        (F.sum(w * F.col("epoch")) / F.sum(w)).alias("_mx"),
        (F.sum(w * F.col("tc")) / F.sum(w)).alias("_my"),
    )
    rows = times.join(mean, "cand_id")
    x, y = F.col("epoch") - F.col("_mx"), F.col("tc") - F.col("_my")
    line = rows.groupBy("cand_id").agg(
        F.sum(w * x * x).alias("_xx"), F.sum(w * x * y).alias("_xy")
    )
    rows = rows.join(line, "cand_id")
    slope = F.when(F.col("_xx") > 0, F.col("_xy") / F.col("_xx")).otherwise(0.0)
    order = Window.partitionBy("cand_id").orderBy("tc")
    jump = F.coalesce((F.col("tc") - F.lag("tc").over(order) > season_gap).cast("int"), F.lit(0))
    rows = rows.withColumns({"oc_minutes": (y - slope * x) * 1440.0, "_jump": jump})
    season = F.sum("_jump").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("cand_id", "epoch", "tc", "err", "oc_minutes", season.alias("season"))


def seasonal_oc(oc: DataFrame) -> DataFrame:
    """Per candidate and season: first and last time, dips, median O-C."""
    return oc.groupBy("cand_id", "season").agg(
        F.min("tc").alias("first_t"), F.max("tc").alias("last_t"),
        F.count(F.lit(1)).alias("n_transits"),
        F.percentile("oc_minutes", F.lit(0.5)).alias("median_oc_minutes"),
    )


# ---- verdicts
NA_IS_A_RESULT = ("rotation",)


def collect_tests(tests: dict[str, DataFrame]) -> DataFrame:
    """Long table of outcomes: cand_id, name, status, statistic."""
    parts = [
        df.select("cand_id", F.lit(name).alias("name"), "status", F.col("statistic").cast("double").alias("statistic"))
        for name, df in tests.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def decide(tests: DataFrame) -> DataFrame:
    """cand_id, verdict and the tests as an array: fail over warn or untested over pass."""
    status = F.col("status")
    untested = (status == NA) & ~F.col("name").isin(*NA_IS_A_RESULT)
    out = tests.groupBy("cand_id").agg(
        F.bool_or(status == FAIL).alias("_fail"),
        F.bool_or((status == WARN) | untested).alias("_caveat"),
        F.array_sort(F.collect_list(F.struct("name", "status", "statistic"))).alias("tests"),
        F.array_sort(F.collect_list(F.when(untested, F.col("name")))).alias("untested"),
    )
    verdict = _when(
        (F.col("_fail"), "likely false positive"),
        (F.col("_caveat"), "planet candidate (with caveats)"),
        otherwise="planet candidate (passes all tests)",
    )
    return out.select("cand_id", verdict.alias("verdict"), "tests", "untested")


def secondary_verdicts(signals: DataFrame, tests: DataFrame) -> DataFrame:
    """What a signal at another phase of an earlier one's orbit is, by that one's own test.

    ``signals``: tic_id, iteration, secondary_of, phase_offset; ``tests``: tic_id, iteration,
    status of the secondary-eclipse test.
    """
    primary = tests.select("tic_id", F.col("iteration").alias("secondary_of"), "status")
    rows = signals.where("secondary_of IS NOT NULL").join(primary, ["tic_id", "secondary_of"], "left")
    text = _when(
        (F.col("status") == FAIL, "secondary eclipse of an eclipsing binary"),
        (F.col("status") == PASS, "occultation, consistent with a planet"),
        otherwise="second eclipse",
    )
    return rows.select("tic_id", "iteration", "secondary_of", "phase_offset", text.alias("verdict"))
