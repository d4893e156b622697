"""From cleaned curves to one nested report per target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DetrendConfig, SearchConfig, VetConfig
from ..functions.expr import fold, jsonable
from ..operators import pixels as P
from ..operators import search as H
from ..operators import stats as A
from ..operators import vetting as T
from ..operators.detrend import detrend, flat_curve, mark_ephemerides
from ..operators.joins import drop_near
from ..session import materialize
from .search_run import SearchResult, iterative_search


#: Candidate ids are the target's id times this, plus the iteration; searches end long before.
ITERATIONS = 1_000_000


def vet(
    lc: DataFrame,
    cands: DataFrame,
    curves: DataFrame,
    dumps: DataFrame | None,
    config: VetConfig | None = None,
    rotation: DataFrame | None = None,
    samples: DataFrame | None = None,
    stellar: DataFrame | None = None,
    centroid: DataFrame | None = None,
) -> DataFrame:
    """Run every test the inputs allow and decide: cand_id, verdict, tests, untested.

    ``cands``: cand_id, tic_id, period, t0, duration and optionally rp_rs, a_rs, teff.
    ``samples``: cand_id, rho, b, rp_rs; ``stellar``: cand_id, rho_cat, rho_cat_err, radius.
    Without them the density and radius tests are recorded as not applicable; without
    ``dumps`` or ``centroid`` those tests are not run at all.
    """
    config = config or VetConfig()
    noise = materialize(T.noise_properties(lc, cands, curves), "noise")
    coverage = T.transit_coverage(lc, cands, curves)
    depths = T.transit_depths(lc, cands, curves, noise)
    untested = cands.select(
        "cand_id", F.lit(T.NA).alias("status"), F.lit(None).cast("double").alias("statistic")
    )
    tests = {
        "odd_even": T.odd_even_test(lc, cands, curves, noise, config),
        "secondary": T.secondary_eclipse_test(lc, cands, curves, noise, config),
        "shape": T.shape_test(lc, cands, curves, config, samples),
        "density": untested,
        "radius": untested,
        "coverage": T.coverage_test(cands, coverage, config),
        "rotation": untested if rotation is None else T.rotation_test(cands, rotation, config),
    }
    if samples is not None and stellar is not None:
        tests["density"] = T.density_test(samples, stellar, config)
        tests["radius"] = T.radius_test(samples, stellar, config)
    if dumps is not None:
        tests["momentum_dumps"] = T.momentum_dump_test(lc, cands, depths, dumps, config)
    if centroid is not None:
        tests["centroid"] = centroid
    return T.decide(T.collect_tests(tests))


def candidate_curves(flat: DataFrame, signals: DataFrame, width_factor: float = 2.0) -> DataFrame:
    """Each candidate's own curve: the other detections' dips dropped, its own eclipses kept.

    ``signals``: detections with cand_id, tic_id, iteration, secondary_of, period, t0, duration.
    A candidate is a detection that is no other's eclipse.
    """
    others = signals.select(
        "tic_id",
        F.struct("iteration", "secondary_of", "period", "t0", "duration").alias("s"),
    ).groupBy("tic_id").agg(F.collect_list("s").alias("_all"))
    cands = signals.where("secondary_of IS NULL").select("cand_id", "tic_id", "iteration")
    rows = flat.join(cands.join(others, "tic_id"), "tic_id")
    hit = F.exists(
        "_all",
        lambda s: (s["iteration"] != F.col("iteration"))
        & ~F.coalesce(s["secondary_of"] == F.col("iteration"), F.lit(False))
        & (F.abs(fold(F.col("t"), s["period"], s["t0"])) < 0.5 * width_factor * s["duration"]),
    )
    return rows.where(~hit).drop("_all", "iteration")


def run_curves(
    raw: DataFrame,
    search: SearchConfig | None = None,
    detrending: DetrendConfig | None = None,
    config: VetConfig | None = None,
    dumps: DataFrame | None = None,
    densities: DataFrame | None = None,
    width_factor: float = 2.0,
    samples: DataFrame | None = None,
    stellar: DataFrame | None = None,
    pixels: DataFrame | None = None,
    stamps: DataFrame | None = None,
) -> tuple[DataFrame, SearchResult]:
    """Detrend, search, detrend again with all dips masked, drop stray dips, vet, report.

    ``samples``: tic_id, iteration, rho, b, rp_rs (draws of a fit); ``stellar``: tic_id, rho_cat,
    rho_cat_err, radius and optionally teff; ``pixels`` and ``stamps`` as the pixel operators take
    them. A test whose tables are missing is recorded as not applicable or not run.
    Returns one nested report row per target, and the search's own tables.
    """
    search, config = search or SearchConfig(), config or VetConfig()
    first = flat_curve(detrend(raw, detrending))
    found = iterative_search(first, search, raw, detrending, densities)
    detections = found.signals.where("detected").withColumn(
        "cand_id", F.col("tic_id") * ITERATIONS + F.col("iteration")
    )
    detections = materialize(detections, "detections")
    marked = mark_ephemerides(raw, detections, width_factor)
    flat = flat_curve(detrend(marked, detrending, mask="masked"))
    flat = materialize(H.without_events(flat, found.edge_events, search.mask_factor), "flat")
    rotation = materialize(
        H.rotation_period(marked.where("NOT masked")), "rotation"
    )
    # A candidate's curve becomes a curve of its own, keyed by the candidate.
    own = candidate_curves(flat, detections, width_factor)
    planet = materialize(
        own.withColumn("_tic", F.col("tic_id")).withColumn("tic_id", F.col("cand_id")), "planet"
    )
    base = detections.where("secondary_of IS NULL")
    keyed = base.withColumn("_tic", F.col("tic_id")).withColumn("tic_id", F.col("cand_id"))
    k = F.sqrt(F.greatest(F.col("depth"), F.lit(0.0)))
    a_rs = F.greatest((1 + k) * F.col("period") / (3.141592653589793 * F.col("duration")), F.lit(1.0))
    cands = keyed.select(
        "cand_id", "tic_id", "_tic", "period", "t0", "duration", "depth",
        k.alias("rp_rs"), a_rs.alias("a_rs"),
    )
    if stellar is not None and "teff" in stellar.columns:
        cands = cands.join(stellar.select(F.col("tic_id").alias("_tic"), "teff"), "_tic", "left")
    curves = materialize(A.curve_stats(planet), "planet-stats")
    noise = T.noise_properties(planet, cands, curves)
    depths = materialize(T.transit_depths(planet, cands, curves, noise), "planet-depths")
    stray = T.bad_transits(depths, config)
    events = stray.join(cands.select("cand_id", "tic_id", "duration"), "cand_id").select(
        "tic_id", F.col("tc").alias("time"), (2.0 * F.col("duration")).alias("half")
    )
    planet = materialize(drop_near(planet, events), "planet-kept")
    curves = materialize(A.curve_stats(planet), "kept-stats")
    noise = materialize(T.noise_properties(planet, cands, curves), "kept-noise")
    depths = materialize(T.transit_depths(planet, cands, curves, noise), "kept-depths")
    chunks = T.chunk_consistency(planet, cands, depths).select(
        "cand_id",
        F.struct(
            "n_transits", "n_chunks", "chunked_by", "snr_without_strongest", "strongest", "p_value"
        ).alias("chunks"),
    )
    by_cand = cands.select("_tic", F.col("cand_id").alias("tic_id"))
    own_dumps = None
    if dumps is not None:
        own_dumps = dumps.withColumnRenamed("tic_id", "_tic").join(by_cand, "_tic").select("tic_id", "t")
    own_rotation = rotation.withColumnRenamed("tic_id", "_tic").join(by_cand, "_tic").drop("_tic")
    ids = base.select("cand_id", "tic_id", "iteration")
    own_samples = None if samples is None else samples.join(ids, ["tic_id", "iteration"]).drop("tic_id", "iteration")
    own_stars = None if stellar is None else stellar.join(ids.drop("iteration"), "tic_id").drop("tic_id")
    centroid = None
    if pixels is not None and stamps is not None:
        real = cands.select("cand_id", F.col("_tic").alias("tic_id"), "period", "t0", "duration", "depth")
        measured = materialize(P.measure_centroids(pixels, flat, real, stamps, config), "centroids")
        centroid = P.centroid_test(real, measured, None, config).select("cand_id", "status", "statistic")
    verdicts = materialize(
        vet(planet, cands, curves, own_dumps, config, own_rotation, own_samples, own_stars, centroid), "verdicts"
    )
    entry = (
        base.join(verdicts, "cand_id", "left").join(chunks, "cand_id", "left")
        .join(
            stray.groupBy("cand_id").agg(
                F.array_sort(F.collect_list(F.struct("tc", "depth", "deviation"))).alias("dropped")
            ),
            "cand_id", "left",
        )
        .select(
            "tic_id", "iteration", F.lit("candidate").alias("role"),
            F.struct("period", "t0", "duration", "depth", "snr", "sde", "n_transits").alias("signal"),
            "verdict", "tests", "untested", "dropped",
            "chunks",
        )
    )
    secondary = T.secondary_verdicts(
        detections,
        verdicts.select("cand_id", F.explode("tests").alias("x")).where("x.name = 'secondary'")
        .join(base.select("cand_id", "tic_id", "iteration"), "cand_id")
        .select("tic_id", "iteration", F.col("x.status").alias("status")),
    )
    second = detections.where("secondary_of IS NOT NULL").join(
        secondary.select("tic_id", "iteration", "verdict"), ["tic_id", "iteration"], "left"
    )
    second = second.select(
        "tic_id", "iteration", F.lit("secondary").alias("role"),
        F.struct("period", "t0", "duration", "depth", "snr", "sde", "n_transits").alias("signal"),
        "verdict",
    )
    planets = entry.unionByName(second, allowMissingColumns=True).groupBy("tic_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "iteration", "role", "signal", "verdict", "tests", "untested", "dropped", "chunks"
        ))).alias("planets")
    )
    return assemble(raw, first, found, planets, rotation), found


def assemble(
    raw: DataFrame, first: DataFrame, found: SearchResult, planets: DataFrame, rotation: DataFrame
) -> DataFrame:
    """Target, noise, search and planets as one nested row per target."""
    target = A.extent(raw)
    noise = A.cdpp(first).groupBy("tic_id").agg(
        F.array_sort(F.collect_list(F.struct("hours", jsonable(F.col("cdpp_ppm")).alias("cdpp_ppm")))).alias("cdpp")
    )
    sectors = A.sector_summary(first).groupBy("tic_id").agg(
        F.array_sort(F.collect_list(F.struct("sector", "n", "rms_ppm"))).alias("per_sector")
    )
    signal = F.struct(
        "iteration", "period", "t0", "duration", "depth", "depth_err", "snr", "snr_white", "sde",
        "power", "n_transits", "detected", "snr_threshold", "harmonic_of", "secondary_of",
        "phase_offset", "brightening_ratio", "skipped_peaks", "transit_times",
    )
    search = found.signals.groupBy("tic_id").agg(
        F.sort_array(F.collect_list(signal)).alias("signals"),
        F.count_if("detected").alias("n_detections"),
        F.count_if(F.col("detected") & F.col("secondary_of").isNull()).alias("n_candidates"),
    )
    edges = found.edge_events.groupBy("tic_id").agg(
        F.array_sort(F.collect_list(F.struct("time", "duration", "depth", "snr"))).alias("edge_events")
    )
    out = target
    for part in (noise, sectors, search, edges, planets):
        out = out.join(part, "tic_id", "left")
    rot = rotation.select("tic_id", F.struct("period", "power", "amplitude_ppm").alias("rotation"))
    return out.join(rot, "tic_id", "left").select(
        "tic_id",
        F.struct("sectors", "n_points", "baseline", "t_min", "t_max").alias("target"),
        F.struct("cdpp", "per_sector").alias("noise"),
        "rotation",
        F.struct(
            "signals", "edge_events",
            F.coalesce("n_detections", F.lit(0)).alias("n_detections"),
            F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        ).alias("search"),
        F.coalesce("planets", F.array()).alias("planets"),
    )
