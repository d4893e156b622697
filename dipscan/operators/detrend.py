"""Remove slow variability with a robust location estimate in a sliding time window."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DetrendConfig
from ..functions.expr import finite, fold
from ..session import materialize, spread
from .kernels import METHODS, TUNING, sliding_location
from .sequence import _us, lerp, with_segments


def recommended_window(duration: Column, factor: float = 3.0) -> Column:
    """Window length that leaves a dip of this duration alone."""
    return factor * duration


def ephemeris_arrays(ephemerides: DataFrame) -> DataFrame:
    """One row per target with its (few) ephemerides as an array of structs."""
    return ephemerides.groupBy("tic_id").agg(
        F.collect_list(F.struct("period", "t0", "duration")).alias("_eph")
    )


def mark_ephemerides(
    df: DataFrame, ephemerides: DataFrame, width_factor: float = 1.5, name: str = "masked"
) -> DataFrame:
    """``df`` with ``name``: within ``width_factor``/2 durations of any listed mid-dip."""
    rows = df.join(ephemeris_arrays(ephemerides), "tic_id", "left")
    hit = F.exists(
        "_eph",
        lambda e: F.abs(fold(F.col("t"), e["period"], e["t0"]))
        < 0.5 * width_factor * e["duration"],
    )
    return rows.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_eph")


def sliding_trend(
    df: DataFrame,
    keys: Sequence[str],
    config: DetrendConfig,
    value: str = "flux",
    mask: str | None = None,
) -> DataFrame:
    """``df`` plus ``trend``: the estimate within half a window of every row, per segment.

    Rows are sent to every block of ``block_days`` their window reaches, so one task holds a
    few days of one segment, never a whole target. Masked rows do not influence the trend.
    """
    if config.method not in METHODS:
        raise ValueError(f"method {config.method!r} is not one of {sorted(METHODS)}")
    half = _us(0.5 * config.window_length)
    block = _us(max(config.block_days, config.window_length))
    rows = with_segments(df, keys, config.break_tolerance)
    first, last = ((F.col("t_us") + s * half) / block for s in (-1, 1))
    rows = rows.withColumn("_block", F.explode(F.sequence(F.floor(first), F.floor(last))))
    columns = [*df.columns, "segment", "seg_start", "seg_end"]
    schema = T.StructType(
        [rows.schema[c] for c in columns] + [T.StructField("trend", T.DoubleType())]
    )
    cval = config.cval if config.cval is not None else TUNING.get(config.method, 0.0)
    method, passes = config.method, config.passes

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_us")
        core = (pdf["t_us"] // block == pdf["_block"]).to_numpy()
        used = pdf if mask is None else pdf[~pdf[mask]]
        trend = sliding_location(
            pdf["t_us"].to_numpy()[core],
            used["t_us"].to_numpy(),
            used[value].to_numpy(float),
            half,
            method,
            cval,
            passes,
        )
        return pdf.loc[core, columns].assign(trend=trend)

    group = [*keys, "segment", "_block"]
    return spread(rows, *group).groupBy(*group).applyInPandas(evaluate, schema)


def fill_trend(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Undefined or non-positive trend values, interpolated inside each segment."""
    ok = finite(F.col("trend")) & (F.col("trend") > 0)
    return lerp(df.withColumn("trend", F.when(ok, F.col("trend"))), [*keys, "segment"], "trend")


def detrend(
    df: DataFrame,
    config: DetrendConfig | None = None,
    mask: str | None = None,
    keys: Sequence[str] = ("tic_id",),
) -> DataFrame:
    """``df`` with ``trend``, ``flat`` and ``flat_err``; rows without a usable trend are left out.

    ``mask`` names a boolean column: rows that must not influence the trend. With an
    ``edge_cutoff`` the trend near a segment's ends is the nearest one further inside.
    """
    config = config or DetrendConfig()
    rows = df.where(finite(F.col("t"), F.col("flux"), F.col("flux_err")))
    out = sliding_trend(rows, keys, config, mask=mask)
    if config.edge_cutoff > 0:
        cut = (F.col("t") - F.col("seg_start") < config.edge_cutoff) | (
            F.col("seg_end") - F.col("t") < config.edge_cutoff
        )
        out = out.withColumn("trend", F.when(~cut, F.col("trend")))
    # The trend is written once: filling looks at it twice, and most callers many times.
    out = materialize(out, "trend")
    undefined = ~(finite(F.col("trend")) & (F.col("trend") > 0))
    if out.where(undefined).limit(1).count():
        out = materialize(fill_trend(out, keys), "filled-trend")
    out = out.where(finite(F.col("trend")) & (F.col("trend") > 0))
    return out.select(
        *df.columns,
        "trend",
        (F.col("flux") / F.col("trend")).alias("flat"),
        (F.col("flux_err") / F.col("trend")).alias("flat_err"),
    )


def flat_curve(detrended: DataFrame) -> DataFrame:
    """The flattened curve in the columns the search expects."""
    return detrended.select(
        "tic_id", "sector", "t_us", "t", F.col("flat").alias("flux"),
        F.col("flat_err").alias("flux_err"),
    )
