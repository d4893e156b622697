"""Photometry in: scans, versions, cleaning, the processed store, and source priorities."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import QUALITY_FLAGS, CleaningConfig, resolve_bitmask
from ..functions.expr import finite, parse_tic_id
from ..operators.sequence import find_outliers, segment_bins
from ..operators.stats import bin_rows, medians, robust_std

STORE_FORMAT = 2


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A long table of raw photometry, one row per cadence, NaN turned into NULL on the way in."""
    raw = spark.read.parquet(path)
    doubles = [f.name for f in raw.schema.fields if f.dataType.typeName() == "double"]
    return raw.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in raw.columns]
    )


def latest_versions(raw: DataFrame) -> DataFrame:
    """Per target and sector, the version with the most finite samples, filed under its own id.

    ``raw``: tic_id, target_id (the id in the file), sector, version, flux, ...
    """
    own = raw.where(F.col("target_id") == F.col("tic_id"))
    counts = own.groupBy("tic_id", "sector", "version").agg(
        F.count_if(finite(F.col("flux"))).alias("n_finite")
    )
    best = Window.partitionBy("tic_id", "sector").orderBy(F.desc("n_finite"), "version")
    chosen = counts.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return own.join(chosen, ["tic_id", "sector", "version"], "left_semi")


def two_minute_targets(observations: DataFrame) -> DataFrame:
    """Distinct (tic_id, sector) with a 120-second product of the main pipeline.

    ``observations``: target_name, sector, exptime, author.
    """
    rows = observations.where((F.col("exptime") == 120) & (F.col("author") == "SPOC"))
    out = rows.select(parse_tic_id(F.col("target_name")).alias("tic_id"), "sector")
    return out.where("tic_id IS NOT NULL AND tic_id <> 0").distinct()


def own_sectors(observations: DataFrame) -> DataFrame:
    """Sectors whose product is filed under the queried id itself.

    ``observations``: tic_id (queried), target_name, sector.
    """
    own = observations.where(
        F.trim(F.col("target_name").cast("string")) == F.col("tic_id").cast("string")
    )
    return own.groupBy("tic_id").agg(F.array_sort(F.collect_set("sector")).alias("sectors"))


def quality_ok(bitmask: str | int = "default", quality: str = "quality") -> Column:
    """No bit of the mask is set."""
    return F.col(quality).cast("long").bitwiseAND(F.lit(resolve_bitmask(bitmask))) == 0


def usable(flux: str = "flux", err: str = "flux_err") -> Column:
    """Finite time, flux and error, and a positive error."""
    return finite(F.col("t"), F.col(flux), F.col(err)) & (F.col(err) > 0)


def good_rows(raw: DataFrame, config: CleaningConfig | None = None) -> DataFrame:
    config = config or CleaningConfig()
    return raw.where(quality_ok(config.bitmask) & usable())


def normalize_sectors(rows: DataFrame, min_points: int = 100) -> DataFrame:
    """Flux over its sector's median; sectors too short or with a median <= 0 are left out."""
    keys = ["tic_id", "sector"]
    level = medians(rows, keys, F.col("flux"), "_median")
    level = level.where((F.col("n") >= min_points) & (F.col("_median") > 0)).drop("n")
    out = rows.join(level, keys)
    return out.withColumns(
        {"flux": F.col("flux") / F.col("_median"), "flux_err": F.col("flux_err") / F.col("_median")}
    ).drop("_median")


def clean(
    raw: DataFrame, config: CleaningConfig | None = None, passes: int | None = None
) -> DataFrame:
    """Raw photometry of every target and sector as one normalized, clipped light curve.

    Columns of ``raw``: tic_id, sector, t, t_us, flux, flux_err, quality.
    """
    config = config or CleaningConfig()
    rows = normalize_sectors(good_rows(raw, config).drop("quality"), config.min_points)
    kept = find_outliers(rows, ["tic_id", "sector"], config, passes=passes).where("NOT outlier")
    size = kept.groupBy("tic_id", "sector").agg(F.count(F.lit(1)).alias("_n"))
    long_enough = size.where(F.col("_n") >= config.min_points)
    return kept.join(long_enough, ["tic_id", "sector"], "left_semi").drop("outlier")


def cleaning_counts(
    raw: DataFrame, cleaned: DataFrame, config: CleaningConfig | None = None
) -> DataFrame:
    """What cleaning removed, per target and sector; ``n_final`` 0 means the sector is rejected.

    The counts add up: raw = flagged + nonfinite + outliers + final for a kept sector.
    """
    config = config or CleaningConfig()
    keys = ["tic_id", "sector"]
    flagged, ok = ~quality_ok(config.bitmask), usable()
    before = raw.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(flagged).alias("n_quality_flagged"),
        F.count_if(~ok & ~flagged).alias("n_nonfinite"),
        F.count_if(ok & ~flagged).alias("_good"),
    )
    after = robust_std(cleaned, keys, F.col("flux")).select(
        *keys, F.col("n").alias("n_final"), (F.col("sigma") * 1e6).alias("rms_ppm")
    )
    rejected = F.col("n_final").isNull()
    return before.join(after, keys, "left").select(
        *keys,
        "n_raw",
        "n_quality_flagged",
        "n_nonfinite",
        F.when(rejected, F.lit(0)).otherwise(F.col("_good") - F.col("n_final")).alias("n_outliers"),
        F.coalesce("n_final", F.lit(0)).alias("n_final"),
        "rms_ppm",
        rejected.alias("rejected"),
    )


def momentum_dumps(raw: DataFrame) -> DataFrame:
    """One time per run of dump flags (a gap above 0.1 d starts a new run), per sector."""
    flagged = raw.where(
        (F.col("quality").cast("long").bitwiseAND(F.lit(QUALITY_FLAGS["Desat"])) != 0)
        & finite(F.col("t"))
    )
    keys = ["tic_id", "sector"]
    gap = 8_640_000_000
    runs = segment_bins(flagged, keys, 0.1).select(*keys, "gap_bin", "segment")
    sums = flagged.groupBy(*keys, F.floor(F.col("t_us") / gap).alias("gap_bin")).agg(
        F.sum("t").alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    return (
        sums.join(runs, [*keys, "gap_bin"])
        .groupBy(*keys, "segment")
        .agg((F.sum("_s") / F.sum("_n")).alias("dump_t"), F.sum("_n").alias("n_flags"))
        .drop("segment")
    )


def stitch(parts: Sequence[DataFrame]) -> DataFrame:
    """All parts as one table; time order is left to whoever needs it."""
    if not parts:
        raise ValueError("nothing to stitch")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bin_curve(rows: DataFrame, width: float, min_count: int = 1) -> DataFrame:
    """Inverse-variance bins of every light curve; each takes the sector of its first sample
    at or after its mean time."""
    means = bin_rows(rows, ["tic_id"], "t", "flux", width, err="flux_err", min_count=min_count)
    start = rows.groupBy("tic_id").agg(F.min("t").alias("_x0"))
    placed = rows.join(start, "tic_id").select(
        "tic_id",
        F.floor((F.col("t") - F.col("_x0")) / width).cast("long").alias("bin"),
        F.col("t").alias("_t"),
        "sector",
    )
    found = (
        placed.join(means.select("tic_id", "bin", "x_mean"), ["tic_id", "bin"])
        .groupBy("tic_id", "bin")
        .agg(
            F.min_by("sector", F.when(F.col("_t") >= F.col("x_mean"), F.col("_t"))).alias("_after"),
            F.max_by("sector", "_t").alias("_last"),
        )
    )
    out = means.join(found, ["tic_id", "bin"])
    return out.select(
        "tic_id",
        "bin",
        F.coalesce("_after", "_last").alias("sector"),
        F.col("x_mean").alias("t"),
        F.round(F.col("x_mean") * 86_400_000_000.0).cast("long").alias("t_us"),
        F.col("y_mean").alias("flux"),
        F.col("y_err").alias("flux_err"),
        "count",
    )


# ---- processed store
def config_key(spark: SparkSession, config: CleaningConfig) -> str:
    """Short hash of the cleaning settings and the store format."""
    parts = [F.lit(f"{k}={v}") for k, v in sorted(dataclasses.asdict(config).items())]
    text = F.concat_ws(";", F.lit(f"format={STORE_FORMAT}"), *parts)
    return spark.range(1).select(F.substring(F.sha1(text), 1, 12)).first()[0]


def store_missing(
    raw: DataFrame, path: str, config: CleaningConfig | None = None, force: bool = False
) -> DataFrame:
    """Cleaned curves from the store; sectors of targets not there yet (or all, forced) are cleaned first."""
    spark = raw.sparkSession
    config = config or CleaningConfig()
    folder = f"{path.rstrip('/')}/config={config_key(spark, config)}"
    todo, mode = raw, "overwrite"
    if not force and path_exists(spark, folder):
        stored = spark.read.parquet(folder).select("tic_id", "sector").distinct()
        todo, mode = raw.join(stored, ["tic_id", "sector"], "left_anti"), "append"
    clean(todo, config).write.partitionBy("sector").mode(mode).parquet(folder)
    return spark.read.parquet(folder)


def path_exists(spark: SparkSession, folder: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


# ---- several pipelines' products
# Source priority.
AUTHORS = ("SPOC", "TESS-SPOC", "QLP")


def merge_authors(rows: DataFrame, min_points: int = 100) -> DataFrame:
    """Per target and sector, the best author's curve, over its own median.

    ``rows``: tic_id, sector, author, t, t_us, pdcsap_flux, kspsap_flux, sap_flux. The flux is
    the author's preferred column, or simple photometry where a whole product lacks it. A
    product needs ``min_points`` finite positive samples to count.
    """
    keys = ["tic_id", "sector", "author"]
    rank = F.array_position(F.array(*[F.lit(a) for a in AUTHORS]), F.col("author"))
    preferred = F.when(F.col("author") == "QLP", F.col("kspsap_flux")).otherwise(
        F.col("pdcsap_flux")
    )
    rows = rows.withColumns({"_rank": rank, "_preferred": preferred}).where("_rank > 0")
    products = rows.groupBy(*keys, "_rank").agg(
        F.count("_preferred").alias("_has"),
        F.count_if(finite(F.col("_preferred")) & (F.col("_preferred") > 0)).alias("_n_preferred"),
        F.count_if(finite(F.col("sap_flux")) & (F.col("sap_flux") > 0)).alias("_n_sap"),
    )
    n = F.when(F.col("_has") > 0, F.col("_n_preferred")).otherwise(F.col("_n_sap"))
    best = Window.partitionBy("tic_id", "sector").orderBy("_rank")
    chosen = (
        products.where(n >= min_points)
        .withColumn("_r", F.row_number().over(best))
        .where("_r = 1")
        .select(*keys, (F.col("_has") > 0).alias("_use"))
    )
    flux = F.when(F.col("_use"), F.col("_preferred")).otherwise(F.col("sap_flux"))
    picked = rows.join(chosen, keys).withColumn("flux", flux)
    picked = picked.where(finite(F.col("t"), F.col("flux")) & (F.col("flux") > 0))
    level = medians(picked, keys, F.col("flux"), "_median").drop("n")
    return picked.join(level, keys).select(
        *keys, "t", "t_us", (F.col("flux") / F.col("_median")).alias("flux")
    )
