"""Light-curve queries: scans, cleaning, folding, binning, noise, segments, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CleaningConfig, DetrendConfig
from ..functions import expr as X
from ..operators import detrend as D
from ..operators import joins as J
from ..operators import sequence as S
from ..operators import stats as A
from ..sources import cadences as C
from . import views as V
from .registry import query
from .views import with_views

R = F.round


def r(c: str | Column, digits: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rs(c: str | Column) -> Column:
    """Rounded off the half-way points on which means of few decimals like to fall."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 3.7e-10, 9)


def raw_view(spark: SparkSession, d: str) -> DataFrame:
    """The cadence view in the columns of raw photometry."""
    return V.cadences(spark, d).select(
        "tic_id", "sector", "t", "t_us", F.col("flux_raw").alias("flux"),
        F.col("flux_err_raw").alias("flux_err"), "quality", "event_id",
    )


RAW = "SELECT tic_id, sector, t, t_us, flux_raw AS flux, flux_err_raw AS flux_err, quality, event_id FROM cadences"
CADENCE = """SELECT tic_id, median(dt) / 86400000000.0D AS cadence FROM (
  SELECT tic_id, t_us - lag(t_us) OVER (PARTITION BY tic_id ORDER BY t_us) AS dt FROM lc)
  WHERE dt IS NOT NULL GROUP BY tic_id"""


# ---- scans and cleaning
@query("cadence_scan", with_views("cadences", """
SELECT tic_id, sector, count(*) AS n, round(sum(flux_raw), 4) AS total, min(t_us) AS first_us,
  max(t_us) AS last_us, round(min(t), 9) AS t_min FROM cadences GROUP BY tic_id, sector"""))
def cadence_scan(spark, d):
    return V.cadences(spark, d).groupBy("tic_id", "sector").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("flux_raw"), 4).alias("total"),
        F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"),
        r(F.min("t")).alias("t_min"),
    )


VERSIONED = """SELECT tic_id, sector, CASE WHEN quality = 64 THEN tic_id + 5 ELSE tic_id END AS target_id,
  CAST(event_id % 3 AS INT) AS version, event_id, CASE WHEN flux_raw > 100.0D THEN NULL ELSE flux_raw END AS flux
  FROM cadences"""


@query("version_dedup", with_views("cadences", """
SELECT tic_id, sector, version, count(*) AS n, count(flux) AS n_finite FROM own
JOIN best USING (tic_id, sector, version) GROUP BY tic_id, sector, version""",
    versioned=VERSIONED, own="SELECT * FROM versioned WHERE target_id = tic_id",
    best="""SELECT tic_id, sector, version FROM (SELECT tic_id, sector, version,
      row_number() OVER (PARTITION BY tic_id, sector ORDER BY count(flux) DESC, version) AS rn
      FROM own GROUP BY tic_id, sector, version) WHERE rn = 1"""))
def version_dedup(spark, d):
    rows = V.cadences(spark, d).selectExpr(
        "tic_id", "sector", "CASE WHEN quality = 64 THEN tic_id + 5 ELSE tic_id END AS target_id",
        "CAST(event_id % 3 AS INT) AS version", "event_id",
        "CASE WHEN flux_raw > 100.0D THEN NULL ELSE flux_raw END AS flux",
    )
    return C.latest_versions(rows).groupBy("tic_id", "sector", "version").agg(
        F.count(F.lit(1)).alias("n"), F.count("flux").alias("n_finite")
    )


@query("quality_filter", with_views("cadences", """
SELECT tic_id, quality, count(*) AS n FROM cadences WHERE (quality & 17087) = 0 GROUP BY tic_id, quality"""))
def quality_filter(spark, d):
    return V.cadences(spark, d).where(C.quality_ok("default")).groupBy("tic_id", "quality").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("finite_filter", with_views("cadences", """
SELECT tic_id, count(*) AS n, round(sum(flux), 4) AS total FROM holes
WHERE flux IS NOT NULL AND NOT isnan(flux) AND flux_err > 0 GROUP BY tic_id""",
    holes="""SELECT tic_id, t, CASE WHEN flux_raw < 1.0D THEN NULL WHEN flux_raw > 200.0D THEN 'NaN'::DOUBLE
      ELSE flux_raw END AS flux, CASE WHEN event_id % 7 = 0 THEN 0.0D ELSE flux_err_raw END AS flux_err FROM cadences"""))
def finite_filter(spark, d):
    holes = V.cadences(spark, d).selectExpr(
        "tic_id", "t",
        "CASE WHEN flux_raw < 1.0D THEN NULL WHEN flux_raw > 200.0D THEN double('NaN') ELSE flux_raw END AS flux",
        "CASE WHEN event_id % 7 = 0 THEN 0.0D ELSE flux_err_raw END AS flux_err",
    )
    return holes.where(C.usable()).groupBy("tic_id").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("flux"), 4).alias("total")
    )


@query("sector_normalize", with_views("cadences", """
SELECT tic_id, sector, event_id, round(flux / med, 9) AS flux, round(flux_err / med, 9) AS flux_err
FROM raw JOIN (SELECT tic_id, sector, median(flux) AS med FROM raw GROUP BY tic_id, sector
  HAVING count(*) >= 100 AND median(flux) > 0) m USING (tic_id, sector)""",
    raw=RAW + " WHERE (quality & 17087) = 0"))
def sector_normalize(spark, d):
    rows = C.normalize_sectors(C.good_rows(raw_view(spark, d)))
    return rows.select("tic_id", "sector", "event_id", r("flux").alias("flux"), r("flux_err").alias("flux_err"))


@query("subset_and_replace", with_views("lc", """
SELECT tic_id, count(*) AS n, round(sum(flux * 2.0D), 6) AS total FROM lc WHERE sector = 2 GROUP BY tic_id"""))
def subset_and_replace(spark, d):
    rows = V.lc(spark, d).where("sector = 2").withColumn("flux", F.col("flux") * 2.0)
    return rows.groupBy("tic_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("flux"), 6).alias("total"))


@query("curve_extent", with_views("lc", """
SELECT tic_id, count(*) AS n_points, round(max(t) - min(t), 9) AS baseline, round(any_value(cadence), 12) AS cadence,
  round(median(t), 9) AS t_median, array_to_string(list_sort(list_distinct(list(sector))), ' ') AS sectors
FROM lc JOIN cad USING (tic_id) GROUP BY tic_id""", cad=CADENCE))
def curve_extent(spark, d):
    s = A.curve_stats(V.lc(spark, d))
    return s.select("tic_id", "n_points", r("baseline").alias("baseline"), r("cadence", 12).alias("cadence"),
                    r("t_median").alias("t_median"), F.concat_ws(" ", F.col("sectors").cast("array<string>")).alias("sectors"))


@query("cleaning_counts", with_views("cadences", """
SELECT r.tic_id, r.sector, n_raw, n_quality_flagged, 0::BIGINT AS n_nonfinite,
  CASE WHEN n_final IS NULL THEN 0 ELSE n_good - n_final END AS n_outliers, coalesce(n_final, 0) AS n_final,
  round(1482600.0D * mad_ / 1.0D, 3) AS rms_ppm, n_final IS NULL AS rejected
FROM (SELECT tic_id, sector, count(*) AS n_raw, count(*) FILTER ((quality & 17087) <> 0) AS n_quality_flagged,
        count(*) FILTER ((quality & 17087) = 0) AS n_good FROM cadences GROUP BY 1, 2) r
LEFT JOIN (SELECT tic_id, sector, count(*) AS n_final, median(abs(flux - med)) AS mad_
  FROM (SELECT *, median(flux) OVER (PARTITION BY tic_id, sector) AS med FROM norm WHERE flux <= 4.0D)
  GROUP BY 1, 2) f USING (tic_id, sector)""",
    raw=RAW + " WHERE (quality & 17087) = 0",
    norm="""SELECT tic_id, sector, event_id, flux / med AS flux FROM raw JOIN (SELECT tic_id, sector, median(flux) AS med
      FROM raw GROUP BY tic_id, sector HAVING count(*) >= 100 AND median(flux) > 0) m USING (tic_id, sector)"""))
def cleaning_counts(spark, d):
    """Bookkeeping around a plain cut at four times the level, which SQL can repeat."""
    raw = raw_view(spark, d)
    kept = C.normalize_sectors(C.good_rows(raw)).where("flux <= 4.0D")
    return C.cleaning_counts(raw, kept).withColumn("rms_ppm", r("rms_ppm", 3)).withColumn(
        "n_final", F.col("n_final").cast("long")
    )


@query("cleaned_curve")
def cleaned_curve(spark, d):
    return C.clean(raw_view(spark, d), CleaningConfig(clip_window=1.0)).select(
        "tic_id", "sector", "event_id", "t", "flux", "flux_err"
    )


@query("momentum_dump_times", with_views("cadences dumps", "SELECT tic_id, round(t, 9) AS t FROM dumps"))
def momentum_dump_times(spark, d):
    return V.dumps(spark, d).select("tic_id", r("t").alias("t"))


@query("stitch_sectors", with_views("lc", """
SELECT tic_id, sector, count(*) AS n, round(sum(flux), 6) AS total FROM lc GROUP BY tic_id, sector"""))
def stitch_sectors(spark, d):
    rows = V.lc(spark, d)
    parts = [rows.where(F.col("sector") == s) for s in (1, 2)] + [rows.where("sector >= 3")]
    return C.stitch(parts).groupBy("tic_id", "sector").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("flux"), 6).alias("total")
    )


@query("author_priority", with_views("cadences", """
SELECT tic_id, sector, author, event_id, round(flux / med, 9) AS flux FROM picked
JOIN (SELECT tic_id, sector, median(flux) AS med FROM picked GROUP BY 1, 2) m USING (tic_id, sector)""",
    src="""SELECT tic_id, sector, t, event_id, CASE WHEN quality = 64 THEN 'QLP' WHEN quality = 32 THEN 'TESS-SPOC' ELSE 'SPOC' END AS author,
      CASE WHEN sector = 1 THEN NULL ELSE flux_raw END AS pdcsap_flux, flux_raw * 2.0D AS kspsap_flux,
      flux_raw + 1.0D AS sap_flux FROM cadences""",
    prod="""SELECT tic_id, sector, author, CASE author WHEN 'SPOC' THEN 1 WHEN 'TESS-SPOC' THEN 2 ELSE 3 END AS rk,
      count(CASE WHEN author = 'QLP' THEN kspsap_flux ELSE pdcsap_flux END) AS has,
      count(*) FILTER (CASE WHEN author = 'QLP' THEN kspsap_flux ELSE pdcsap_flux END > 0) AS n1,
      count(*) FILTER (sap_flux > 0) AS n2 FROM src GROUP BY 1, 2, 3""",
    best="""SELECT tic_id, sector, author, has FROM (SELECT *, row_number() OVER (PARTITION BY tic_id, sector ORDER BY rk) AS rn
      FROM prod WHERE CASE WHEN has > 0 THEN n1 ELSE n2 END >= 100) WHERE rn = 1""",
    picked="""SELECT tic_id, sector, author, event_id, CASE WHEN has > 0 THEN
      CASE WHEN author = 'QLP' THEN kspsap_flux ELSE pdcsap_flux END ELSE sap_flux END AS flux
      FROM src JOIN best USING (tic_id, sector, author)
      WHERE CASE WHEN has > 0 THEN CASE WHEN author = 'QLP' THEN kspsap_flux ELSE pdcsap_flux END ELSE sap_flux END > 0"""))
def author_priority(spark, d):
    rows = V.cadences(spark, d).selectExpr(
        "tic_id", "sector", "t", "event_id AS t_us",
        "CASE WHEN quality = 64 THEN 'QLP' WHEN quality = 32 THEN 'TESS-SPOC' ELSE 'SPOC' END AS author",
        "CASE WHEN sector = 1 THEN NULL ELSE flux_raw END AS pdcsap_flux",
        "flux_raw * 2.0D AS kspsap_flux", "flux_raw + 1.0D AS sap_flux",
    )
    return C.merge_authors(rows).select(
        "tic_id", "sector", "author", F.col("t_us").alias("event_id"), r("flux").alias("flux")
    )


# ---- folding
FOLD = "(t - t0 + 0.5D * period) - period * floor((t - t0 + 0.5D * period) / period) - 0.5D * period"


@query("fold_mask_epoch", with_views("lc planted", f"""
SELECT tic_id, event_id, round({FOLD}, 9) AS phase_days, abs({FOLD}) < 0.5D * duration AS in_transit,
  CAST(round_even((t - t0) / period, 0) AS BIGINT) AS epoch FROM lc JOIN planted USING (tic_id)"""))
def fold_mask_epoch(spark, d):
    rows = V.lc(spark, d).join(V.planted(spark, d), "tic_id")
    t, p, t0, w = (F.col(c) for c in ("t", "period", "t0", "duration"))
    return rows.select("tic_id", "event_id", r(X.fold(t, p, t0)).alias("phase_days"),
                       X.in_transit(t, p, t0, w).alias("in_transit"), X.epoch_index(t, p, t0).alias("epoch"))


@query("ephemeris_mask", with_views("lc planted", f"""
SELECT tic_id, count(*) AS n, count(*) FILTER (hit) AS n_masked FROM (
  SELECT lc.tic_id, event_id, bool_or(abs({FOLD}) < 0.75D * duration) AS hit
  FROM lc JOIN eph USING (tic_id) GROUP BY 1, 2) GROUP BY tic_id""",
    eph="SELECT tic_id, period, t0, duration FROM planted UNION ALL SELECT tic_id, period * 1.5D, t0 + 0.4D, duration FROM planted"))
def ephemeris_mask(spark, d):
    one = V.planted(spark, d).select("tic_id", "period", "t0", "duration")
    two = one.selectExpr("tic_id", "period * 1.5D AS period", "t0 + 0.4D AS t0", "duration")
    rows = D.mark_ephemerides(V.lc(spark, d), one.unionByName(two), 1.5)
    return rows.groupBy("tic_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("masked").alias("n_masked"))


@query("central_epoch", with_views("lc planted", """
SELECT tic_id, round(t0 + round_even((med - t0) / period, 0) * period, 9) AS t0
FROM planted JOIN (SELECT tic_id, median(t) AS med FROM lc GROUP BY tic_id) USING (tic_id)"""))
def central_epoch(spark, d):
    mid = A.medians(V.lc(spark, d), ["tic_id"], F.col("t"), "med")
    rows = V.planted(spark, d).join(mid, "tic_id")
    return rows.select("tic_id", r(J.central_epoch(F.col("med"), F.col("period"), F.col("t0"))).alias("t0"))


# ---- statistics
@query("robust_std", with_views("lc", """
SELECT tic_id, any_value(med) AS med, round(1.4826D * median(abs(flux - m)), 12) AS sigma, count(*) AS n
FROM (SELECT tic_id, flux, median(flux) OVER (PARTITION BY tic_id) AS m,
        round(median(flux) OVER (PARTITION BY tic_id), 12) AS med FROM lc) GROUP BY tic_id"""))
def robust_std(spark, d):
    out = A.robust_std(V.lc(spark, d), ["tic_id"], F.col("flux"))
    return out.select("tic_id", "n", r("med", 12).alias("med"), r("sigma", 12).alias("sigma"))


@query("bin_timeseries", with_views("lc", """
SELECT tic_id, CAST(floor((t - x0) / 0.25D) AS BIGINT) AS bin, round(avg(t) + 3.7e-10D, 9) AS x_mean, round(avg(flux) + 3.7e-10D, 9) AS y_mean,
  round(CASE WHEN count(*) > 1 THEN stddev_samp(flux) / sqrt(count(*)) END, 9) AS y_err, count(*) AS count
FROM lc JOIN (SELECT tic_id, min(t) AS x0 FROM lc GROUP BY 1) USING (tic_id) GROUP BY 1, 2"""))
def bin_timeseries(spark, d):
    out = A.bin_rows(V.lc(spark, d), ["tic_id"], "t", "flux", 0.25)
    return out.select("tic_id", "bin", rs("x_mean").alias("x_mean"), rs("y_mean").alias("y_mean"),
                      r("y_err").alias("y_err"), "count")


@query("bin_edges_weighted", with_views("lc", """
SELECT tic_id, bin, round(avg(t), 9) AS x_mean, round(sum(w * flux) / sum(w), 9) AS y_mean,
  round(1.0D / sqrt(sum(w)), 9) AS y_err, count(*) AS count
FROM (SELECT *, 1.0D / (flux_err * flux_err) AS w,
        CAST(CASE WHEN t < 1 THEN -1 WHEN t < 2.5 THEN 0 WHEN t < 7 THEN 1 WHEN t < 11 THEN 2 WHEN t < 25 THEN 3 ELSE -1 END AS BIGINT) AS bin FROM lc)
WHERE bin >= 0 GROUP BY 1, 2 HAVING count(*) >= 5"""))
def bin_edges_weighted(spark, d):
    out = A.bin_edges(V.lc(spark, d), ["tic_id"], "t", "flux", [1.0, 2.5, 7.0, 11.0, 25.0], err="flux_err", min_count=5)
    return out.select("tic_id", "bin", r("x_mean").alias("x_mean"), r("y_mean").alias("y_mean"),
                      r("y_err").alias("y_err"), "count")


@query("bin_curve", with_views("lc", """
SELECT m.tic_id, m.bin, round(x_mean, 9) AS t, round(y_mean, 9) AS flux, round(y_err, 9) AS flux_err, count,
  coalesce((SELECT min_by(sector, t) FROM lc WHERE lc.tic_id = m.tic_id AND lc.t >= m.x_mean),
           (SELECT max_by(sector, t) FROM lc WHERE lc.tic_id = m.tic_id)) AS sector
FROM m""", m="""SELECT tic_id, CAST(floor((t - x0) / 0.5D) AS BIGINT) AS bin, avg(t) AS x_mean,
    sum(flux / (flux_err * flux_err)) / sum(1.0D / (flux_err * flux_err)) AS y_mean,
    1.0D / sqrt(sum(1.0D / (flux_err * flux_err))) AS y_err, count(*) AS count
  FROM lc JOIN (SELECT tic_id, min(t) AS x0 FROM lc GROUP BY 1) USING (tic_id) GROUP BY 1, 2"""))
def bin_curve(spark, d):
    out = C.bin_curve(V.lc(spark, d), 0.5)
    return out.select("tic_id", "bin", "sector", r("t").alias("t"), r("flux").alias("flux"),
                      r("flux_err").alias("flux_err"), "count")


BINNED = """SELECT tic_id, hours, avg(flux) AS m, count(*) AS c FROM lc
  JOIN (SELECT tic_id, min(t) AS x0 FROM lc GROUP BY 1) USING (tic_id)
  CROSS JOIN (SELECT unnest([0.5D, 1.0D, 2.0D]) AS hours) GROUP BY tic_id, hours, floor((t - x0) / (hours / 24.0D))"""


@query("cdpp", with_views("lc", """
SELECT tic_id, hours, round(1482600.0D * median(abs(m - mm)), 4) AS cdpp_ppm
FROM (SELECT b.*, median(m) OVER (PARTITION BY tic_id, hours) AS mm FROM b JOIN cad USING (tic_id)
      WHERE c >= 0.5D * greatest(hours / 24.0D / cadence, 1.0D))
GROUP BY tic_id, hours HAVING count(*) >= 3""", cad=CADENCE, b=BINNED))
def cdpp(spark, d):
    return A.cdpp(V.lc(spark, d)).select("tic_id", "hours", r("cdpp_ppm", 4).alias("cdpp_ppm"))


@query("sector_noise", with_views("lc", """
SELECT tic_id, sector, count(*) AS n, round(1482600.0D * median(abs(flux - m)), 4) AS rms_ppm
FROM (SELECT *, median(flux) OVER (PARTITION BY tic_id, sector) AS m FROM lc) GROUP BY 1, 2"""))
def sector_noise(spark, d):
    return A.sector_summary(V.lc(spark, d)).withColumn("rms_ppm", r("rms_ppm", 4))


@query("symmetric_clip", with_views("lc", """
SELECT tic_id, count(*) AS n, round(sum(flux), 6) AS total FROM (
  SELECT lc.*, m, 1.4826D * median(abs(flux - m)) OVER (PARTITION BY tic_id) AS s
  FROM lc JOIN (SELECT tic_id, median(flux) AS m FROM lc GROUP BY 1) USING (tic_id))
WHERE abs(flux - m) < 3.0D * s GROUP BY tic_id"""))
def symmetric_clip(spark, d):
    return A.clipped(V.lc(spark, d), nsigma=3.0).groupBy("tic_id").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("flux"), 6).alias("total")
    )


# ---- segments and trends
GAPPED = "SELECT * REPLACE (t + 5 * (sector - 1) AS t, t_us + 432000000000 * (sector - 1) AS t_us) FROM lc"
SEGMENT = """SELECT *, CAST(sum(CASE WHEN prev IS NULL OR t_us - prev > 8640000000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY tic_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS INT) AS segment
  FROM (SELECT *, lag(t_us) OVER (PARTITION BY tic_id ORDER BY t_us) AS prev FROM gapped)"""


def gapped(spark: SparkSession, d: str) -> DataFrame:
    """All rows, with five days without data between sectors."""
    later = F.col("sector") - 1
    return V.lc(spark, d).withColumns({"t": F.col("t") + 5 * later, "t_us": F.col("t_us") + 432_000_000_000 * later})


@query("segment_bounds", with_views("lc", """
SELECT tic_id, segment, round(min(t), 9) AS seg_start, round(max(t), 9) AS seg_end, count(*) AS seg_n
FROM seg GROUP BY 1, 2""", gapped=GAPPED, seg=SEGMENT))
def segment_bounds(spark, d):
    out = S.segments(gapped(spark, d), ["tic_id"], 0.1)
    return out.select("tic_id", "segment", r("seg_start").alias("seg_start"), r("seg_end").alias("seg_end"), "seg_n")


SIZES = """SELECT tic_id, segment, greatest(3, CAST(round_even(43200000000.0D / median(t_us - prev), 0) AS INT)) AS s0
  FROM (SELECT tic_id, segment, t_us, lag(t_us) OVER (PARTITION BY tic_id, segment ORDER BY t_us) AS prev FROM seg)
  WHERE prev IS NOT NULL GROUP BY 1, 2"""


@query("running_median", with_views("lc", """
SELECT p.tic_id, p.segment, p.event_id, round(median(q.flux), 9) AS trend
FROM padded p JOIN seq q ON q.tic_id = p.tic_id AND q.segment = p.segment AND q.i = p.j
GROUP BY 1, 2, 3""",
    gapped=GAPPED,
    seg="""SELECT *, CAST(sum(CASE WHEN prev IS NULL OR t_us - prev > 21600000000 THEN 1 ELSE 0 END)
      OVER (PARTITION BY tic_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS INT) AS segment
      FROM (SELECT *, lag(t_us) OVER (PARTITION BY tic_id ORDER BY t_us) AS prev FROM gapped)""",
    sizes=SIZES,
    seq="""SELECT tic_id, segment, event_id, flux, row_number() OVER (PARTITION BY tic_id, segment ORDER BY t_us) - 1 AS i,
      count(*) OVER (PARTITION BY tic_id, segment) AS n FROM seg""",
    padded="""SELECT tic_id, segment, event_id, least(greatest(k, 0), n - 1) AS j FROM (
      SELECT seq.*, unnest(range(i - h, i + h + 1)) AS k FROM (
        SELECT s.*, coalesce(s0 + 1 - s0 % 2, 3) // 2 AS h FROM seq s LEFT JOIN sizes USING (tic_id, segment)) seq)"""))
def running_median(spark, d):
    rows = gapped(spark, d).select("tic_id", "event_id", "t_us", "flux", "t")
    out = S.running_median(S.with_segments(rows, ["tic_id"], 0.25).drop("seg_start", "seg_end", "seg_n")
                           .withColumnRenamed("segment", "seg"), ["tic_id"], 0.5)
    return out.select("tic_id", F.col("seg").alias("segment"), "event_id", r("trend").alias("trend"))


@query("trend_interpolation", with_views("lc", """
SELECT tic_id, event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN a.t_us IS NULL THEN b.v WHEN b.t_us IS NULL THEN a.v
  ELSE a.v + (b.v - a.v) * ((r.t_us - a.t_us)::DOUBLE / (b.t_us - a.t_us)) END, 9) AS flux
FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE flux END AS v,
  last_value(CASE WHEN event_id % 5 <> 0 THEN {'t_us': t_us, 'v': flux} END IGNORE NULLS) OVER (PARTITION BY tic_id, segment ORDER BY t_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
  first_value(CASE WHEN event_id % 5 <> 0 THEN {'t_us': t_us, 'v': flux} END IGNORE NULLS) OVER (PARTITION BY tic_id, segment ORDER BY t_us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
  FROM seg) r""", gapped=GAPPED, seg=SEGMENT))
def trend_interpolation(spark, d):
    rows = S.with_segments(gapped(spark, d), ["tic_id"], 0.1)
    rows = rows.withColumn("flux", F.when(F.col("event_id") % 5 != 0, F.col("flux")))
    out = S.lerp(rows, ["tic_id", "segment"], "flux")
    return out.select("tic_id", "event_id", r("flux").alias("flux"))


@query("outlier_clip", with_views("lc", """
SELECT tic_id, sector, event_id, flux - trend > 4.0D * 1.4826D * mad_ AS outlier
FROM (SELECT *, median(abs(flux - trend - med)) OVER (PARTITION BY tic_id, sector) AS mad_
  FROM (SELECT *, median(flux - trend) OVER (PARTITION BY tic_id, sector) AS med FROM fit))""",
    seg="""SELECT *, CAST(sum(CASE WHEN prev IS NULL OR t_us - prev > 43200000000 THEN 1 ELSE 0 END)
      OVER (PARTITION BY tic_id, sector ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS INT) AS segment
      FROM (SELECT *, lag(t_us) OVER (PARTITION BY tic_id, sector ORDER BY t_us) AS prev FROM lc)""",
    sizes="""SELECT tic_id, sector, segment, greatest(3, CAST(round_even(86400000000.0D / median(t_us - prev), 0) AS INT)) AS s0
      FROM (SELECT tic_id, sector, segment, t_us, lag(t_us) OVER (PARTITION BY tic_id, sector, segment ORDER BY t_us) AS prev FROM seg)
      WHERE prev IS NOT NULL GROUP BY 1, 2, 3""",
    seq="""SELECT tic_id, sector, segment, event_id, flux, row_number() OVER (PARTITION BY tic_id, sector, segment ORDER BY t_us) - 1 AS i,
      count(*) OVER (PARTITION BY tic_id, sector, segment) AS n FROM seg""",
    padded="""SELECT tic_id, sector, segment, event_id, flux, least(greatest(k, 0), n - 1) AS j FROM (
      SELECT seq.*, unnest(range(i - h, i + h + 1)) AS k FROM (
        SELECT s.*, coalesce(s0 + 1 - s0 % 2, 3) // 2 AS h FROM seq s LEFT JOIN sizes USING (tic_id, sector, segment)) seq)""",
    fit="""SELECT p.tic_id, p.sector, p.event_id, any_value(p.flux) AS flux, median(q.flux) AS trend
      FROM padded p JOIN seq q ON q.tic_id = p.tic_id AND q.sector = p.sector AND q.segment = p.segment AND q.i = p.j GROUP BY 1, 2, 3"""))
def outlier_clip(spark, d):
    """One clipping pass; the full loop is ``cleaned_curve``."""
    out = S.find_outliers(V.lc(spark, d), ["tic_id", "sector"], CleaningConfig(clip_window=1.0), passes=1)
    return out.select("tic_id", "sector", "event_id", "outlier")


@query("outlier_clip_converged")
def outlier_clip_converged(spark, d):
    out = S.find_outliers(V.lc(spark, d), ["tic_id", "sector"], CleaningConfig(clip_window=1.0))
    return out.groupBy("tic_id", "sector").agg(F.count_if("outlier").alias("n_outliers"))


# ---- sliding estimators
WINDOW = """SELECT p.tic_id, p.event_id, p.flux AS own, p.flux_err AS own_err, q.flux AS v FROM lc p JOIN lc q
  ON q.tic_id = p.tic_id AND q.t_us BETWEEN p.t_us - 32400000000 AND p.t_us + 32400000000"""
SCALED = """SELECT w.*, med, mad_ FROM win w JOIN (SELECT tic_id, event_id, any_value(med) AS med, median(abs(v - med)) AS mad_
  FROM (SELECT *, median(v) OVER (PARTITION BY tic_id, event_id) AS med FROM win) GROUP BY 1, 2) USING (tic_id, event_id)"""


def slide(spark: SparkSession, d: str, method: str, passes: int = 3) -> DataFrame:
    cfg = DetrendConfig(method=method, break_tolerance=5.0, passes=passes)
    out = D.sliding_trend(V.lc(spark, d), ["tic_id"], cfg)
    return out.select("tic_id", "event_id", rs("trend").alias("trend"))


def _reweighted(weight: str, passes: int, scale: str) -> dict[str, str]:
    """Chained SQL steps: ``passes`` weighted means started at the median."""
    steps = {"c0": "SELECT tic_id, event_id, any_value(med) AS c, any_value(mad_) AS mad_ FROM scaled GROUP BY 1, 2"}
    for i in range(1, passes + 1):
        steps[f"c{i}"] = f"""SELECT tic_id, event_id, any_value(mad_) AS mad_,
          CASE WHEN any_value(mad_) > 0 AND sum(w) > 0 THEN sum(w * v) / sum(w) ELSE any_value(c) END AS c
          FROM (SELECT *, {weight} AS w FROM (SELECT s.*, c, (v - c) / ({scale}) AS u
            FROM scaled s JOIN c{i - 1} k USING (tic_id, event_id))) GROUP BY 1, 2"""
    return steps


def _estimator(name: str, weight: str, scale: str, passes: int = 3) -> str:
    return with_views("lc", f"SELECT tic_id, event_id, round(c + 3.7e-10D, 9) AS trend FROM c{passes}",
                      win=WINDOW, scaled=SCALED, **_reweighted(weight, passes, scale))


ESTIMATOR_SQL = {
    "biweight": _estimator("biweight", "CASE WHEN abs(u) < 1 THEN (1 - u * u) * (1 - u * u) ELSE 0.0D END", "5.0D * s.mad_"),
    "tau": _estimator("tau", "CASE WHEN abs(u) < 1 THEN (1 - u * u) * (1 - u * u) ELSE 0.0D END", "4.5D * s.mad_", 1),
    "huber_psi": _estimator("huber_psi", "1.0D / greatest(abs(u), 1.0D)", "1.5D * 1.4826D * s.mad_"),
    "welsch": _estimator("welsch", "exp(-least(u * u, 700.0D))", "2.11D * 1.4826D * s.mad_"),
    "andrewsinewave": _estimator("andrewsinewave",
        "CASE WHEN u = 0 THEN 1.0D WHEN abs(u) <= pi() THEN sin(abs(u)) / abs(u) ELSE 0.0D END", "1.339D * 1.4826D * s.mad_"),
    "mean": with_views("lc", "SELECT tic_id, event_id, round(avg(v) + 3.7e-10D, 9) AS trend FROM win GROUP BY 1, 2", win=WINDOW),
    "median": with_views("lc", "SELECT tic_id, event_id, round(median(v) + 3.7e-10D, 9) AS trend FROM win GROUP BY 1, 2", win=WINDOW),
    "trim_mean": with_views("lc", """SELECT tic_id, event_id, round(avg(v) + 3.7e-10D, 9) AS trend
      FROM (SELECT *, row_number() OVER (PARTITION BY tic_id, event_id ORDER BY v) - 1 AS i,
              count(*) OVER (PARTITION BY tic_id, event_id) AS n FROM win)
      WHERE i >= CAST(floor(0.1D * n) AS INT) AND i < n - CAST(floor(0.1D * n) AS INT) GROUP BY 1, 2""", win=WINDOW),
    "winsorize": with_views("lc", """SELECT tic_id, event_id, round(avg(least(greatest(v, lo), hi)) + 3.7e-10D, 9) AS trend FROM (
      SELECT tic_id, event_id, v, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY tic_id, event_id) AS lo,
        max(CASE WHEN i = n - 1 - k THEN v END) OVER (PARTITION BY tic_id, event_id) AS hi
      FROM (SELECT *, CAST(floor(0.1D * n) AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY tic_id, event_id ORDER BY v) - 1 AS i,
              count(*) OVER (PARTITION BY tic_id, event_id) AS n FROM win))) GROUP BY 1, 2""", win=WINDOW),
    "hampelfilt": with_views("lc", """SELECT tic_id, event_id,
      round(avg(CASE WHEN abs(v - med) > 3.0D * 1.4826D * mad_ THEN med ELSE v END) + 3.7e-10D, 9) AS trend
      FROM scaled GROUP BY 1, 2""", win=WINDOW, scaled=SCALED),
    "hodges": with_views("lc", """SELECT a.tic_id, a.event_id, round(median(0.5D * (a.v + b.v)) + 3.7e-10D, 9) AS trend
      FROM num a JOIN num b ON a.tic_id = b.tic_id AND a.event_id = b.event_id AND a.i <= b.i GROUP BY 1, 2""",
      win=WINDOW, num="SELECT *, row_number() OVER (PARTITION BY tic_id, event_id ORDER BY v) AS i FROM win"),
}
for _method, _sql in ESTIMATOR_SQL.items():
    query(f"slider_{_method}", _sql)(lambda spark, d, _m=_method: slide(spark, d, _m))


@query("detrend_masked", with_views("lc planted", """
SELECT tic_id, event_id, round(trend, 9) AS trend, round(flux / trend, 9) AS flat, round(flux_err / trend, 9) AS flat_err
FROM (SELECT tic_id, event_id, flux, flux_err, CASE WHEN c IS NOT NULL THEN c WHEN a.t_us IS NULL THEN b.v WHEN b.t_us IS NULL THEN a.v
  ELSE a.v + (b.v - a.v) * ((t_us - a.t_us)::DOUBLE / (b.t_us - a.t_us)) END AS trend FROM (SELECT l.*, c,
    last_value(CASE WHEN c IS NOT NULL THEN {'t_us': t_us, 'v': c} END IGNORE NULLS) OVER (PARTITION BY l.tic_id ORDER BY t_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
    first_value(CASE WHEN c IS NOT NULL THEN {'t_us': t_us, 'v': c} END IGNORE NULLS) OVER (PARTITION BY l.tic_id ORDER BY t_us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
    FROM lc l LEFT JOIN c3 ON c3.tic_id = l.tic_id AND c3.event_id = l.event_id))""",
    win=f"""SELECT p.tic_id, p.event_id, q.flux AS v FROM lc p JOIN (SELECT lc.* FROM lc JOIN planted USING (tic_id)
      WHERE NOT abs({FOLD}) < 0.75D * duration) q
      ON q.tic_id = p.tic_id AND q.t_us BETWEEN p.t_us - 32400000000 AND p.t_us + 32400000000""",
    scaled=SCALED, **_reweighted("CASE WHEN abs(u) < 1 THEN (1 - u * u) * (1 - u * u) ELSE 0.0D END", 3, "5.0D * s.mad_")))
def detrend_masked(spark, d):
    rows = D.mark_ephemerides(V.lc(spark, d), V.planted(spark, d), 1.5)
    cfg = DetrendConfig(break_tolerance=5.0, passes=3)
    out = D.detrend(rows, cfg, mask="masked")
    return out.select("tic_id", "event_id", *[r(c).alias(c) for c in ("trend", "flat", "flat_err")])


@query("recommended_window", with_views("cands", """
SELECT cand_id, round(3.0D * duration, 9) AS window_days FROM cands"""))
def recommended_window(spark, d):
    return V.cands(spark, d).select("cand_id", r(D.recommended_window(F.col("duration"))).alias("window_days"))


@query("edge_cutoff", with_views("lc", """
SELECT tic_id, count(*) AS n, round(min(t), 9) AS t_min, round(max(t), 9) AS t_max
FROM (SELECT *, min(t) OVER (PARTITION BY tic_id, segment) AS a, max(t) OVER (PARTITION BY tic_id, segment) AS b FROM seg)
WHERE t - a >= 0.25D AND b - t >= 0.25D GROUP BY tic_id""", gapped=GAPPED, seg=SEGMENT))
def edge_cutoff(spark, d):
    out = S.edge_rows(gapped(spark, d), ["tic_id"], 0.1, 0.25)
    return out.groupBy("tic_id").agg(F.count(F.lit(1)).alias("n"), r(F.min("t")).alias("t_min"), r(F.max("t")).alias("t_max"))


# ---- event windows
@query("nearest_dump", with_views("lc dumps", """
SELECT lc.tic_id, event_id, round(min(abs(lc.t - dumps.t)) + 3.7e-10D, 9) AS distance
FROM lc JOIN dumps USING (tic_id) GROUP BY 1, 2"""))
def nearest_dump(spark, d):
    out = J.nearest_event(V.lc(spark, d), V.dumps(spark, d))
    return out.select("tic_id", "event_id", rs("distance").alias("distance"))


@query("drop_event_windows", with_views("lc dumps", """
SELECT tic_id, count(*) AS n, round(sum(flux), 6) AS total FROM lc WHERE NOT EXISTS (
  SELECT 1 FROM dumps WHERE dumps.tic_id = lc.tic_id AND abs(lc.t - dumps.t) < 0.02D) GROUP BY tic_id"""))
def drop_event_windows(spark, d):
    events = V.dumps(spark, d).select("tic_id", F.col("t").alias("time"), F.lit(0.02).alias("half"))
    return J.drop_near(V.lc(spark, d), events).groupBy("tic_id").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("flux"), 6).alias("total")
    )
