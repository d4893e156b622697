"""Keyed statistics that stay whole and parallel when one key holds most of the rows.

Two kinds of group occur. *Bounded* groups are cut by time (a bin, one dip of one
candidate): their size is set by the sampling rate, and the built-in ``percentile`` is used.
*Open* groups (all rows of a target) may hold a third of the table; their order statistics
come from a sketch pass that brackets the wanted rank, and an exact pass over the bracket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite
from ..session import materialize

#: Rows a single task may hold for one key's order statistics.
BOUND = 2_000_000
MAD_SCALE = 1.4826  # MAD of a normal distribution to its standard deviation
SKETCH = 10_000


def _cols(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: dict[str, float],
    bounded: bool | None = None,
    accuracy: int = SKETCH,
) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per key: one row of ``keys``, ``n``, names.

    NULLs do not count. ``bounded`` says that every group fits one task; if not given, the
    largest group is measured. For open groups a mergeable sketch per key (rank error below
    n/accuracy) gives a bracket four errors wide on either side of each wanted rank. A second
    pass counts what lies below, keeps the nearest value on either side, and counts the distinct
    values inside, so ties cost one row and no group becomes an array.
    """
    rows = df.select(*_cols(keys), value.alias("_v")).where(F.col("_v").isNotNull())
    if groups_fit(df, keys) if bounded is None else bounded:
        aggs = [F.percentile("_v", F.lit(p)).alias(name) for name, p in probs.items()]
        return rows.groupBy(*keys).agg(F.count("_v").alias("n"), *aggs)

    # read by each pass below: kept once, they are not derived anew and stay spread whatever the keys
    rows = materialize(rows, "ranked")
    margin, k = 4.0 / accuracy, len(probs)
    wanted = [max(p - margin, 0.0) for p in probs.values()] + [min(p + margin, 1.0) for p in probs.values()]
    sketch = rows.groupBy(*keys).agg(
        F.count("_v").alias("n"),
        F.percentile_approx("_v", F.array(*[F.lit(p) for p in wanted]), accuracy).alias("_q"),
    )
    # its size on disk keeps a small sketch from drawing all rows of a key into one task
    sketch = materialize(sketch, "sketch")
    joined = rows.join(sketch, list(keys)) if keys else rows.crossJoin(sketch)  # one sketch row
    low, high = [F.col("_q")[i] for i in range(k)], [F.col("_q")[k + i] for i in range(k)]
    v = F.col("_v")
    beside = [F.first("n").alias("n")]
    for i in range(k):
        beside += [
            F.count_if(v < low[i]).alias(f"_below{i}"),
            F.max(F.when(v < low[i], v)).alias(f"_before{i}"),
            F.min(F.when(v > high[i], v)).alias(f"_after{i}"),
        ]
    out = joined.groupBy(*keys).agg(*beside)
    slots = F.array_compact(F.array(*[F.when((v >= low[i]) & (v <= high[i]), F.lit(i)) for i in range(k)]))
    counted = joined.select(*_cols(keys), "_v", F.explode(slots).alias("_i")).groupBy(*keys, "_i", "_v").agg(
        F.count(F.lit(1)).alias("_c")
    )
    so_far = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_upto", F.sum("_c").over(so_far))
    ranked = ranked.join(out, list(keys)) if keys else ranked.crossJoin(out)  # one row
    place = [F.floor(F.lit(p) * (F.col("n") - 1)) - F.col(f"_below{i}") for i, p in enumerate(probs.values())]
    inside = ranked.groupBy(*keys).agg(*[
        F.min(F.when((F.col("_i") == i) & (F.col("_upto") > place[i] + step), v)).alias(f"_in{i}_{step}")
        for i in range(k) for step in (0, 1)
    ])
    out = out.join(inside, list(keys)) if keys else out.crossJoin(inside)  # one row
    picks = []
    for i, (name, p) in enumerate(probs.items()):
        pos = F.lit(p) * (F.col("n") - 1)
        a = F.when(place[i] < 0, F.col(f"_before{i}")).otherwise(F.coalesce(f"_in{i}_0", f"_after{i}"))
        b = F.coalesce(F.col(f"_in{i}_1"), F.col(f"_after{i}"), a)
        picks.append((a + (pos - F.floor(pos)) * (b - a)).alias(name))
    return out.select(*keys, "n", *picks)


def groups_fit(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether every key's rows fit one task: measured, with the open-group way beyond it."""
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (top or 0) <= BOUND


def medians(
    df: DataFrame, keys: Sequence[str], value: Column, name: str, bounded: bool | None = None
) -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5}, bounded)


def robust_std(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    name: str = "sigma",
    bounded: bool | None = None,
    median_name: str = "med",
) -> DataFrame:
    """``keys``, ``n``, median, and 1.4826 times the median absolute deviation."""
    bounded = groups_fit(df, keys) if bounded is None else bounded
    rows = df.select(*_cols(keys), F.when(finite(value), value).alias("_x"))
    centre = medians(rows, keys, F.col("_x"), median_name, bounded)
    if not bounded:
        centre = materialize(centre, "centre")
    with_centre = (
        rows.join(centre, list(keys)) if keys else rows.crossJoin(centre)  # one row
    )
    spread = medians(
        with_centre, [*keys], F.abs(F.col("_x") - F.col(median_name)), "_mad", bounded
    ).drop("n")
    out = centre.join(spread, list(keys)) if keys else centre.crossJoin(spread)
    return out.select(*keys, "n", median_name, (MAD_SCALE * F.col("_mad")).alias(name))


def bin_rows(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    width: Column | float,
    origin: str | None = None,
    err: str | None = None,
    min_count: int = 1,
) -> DataFrame:
    """Fixed-width bins counted from each key's smallest ``x`` (or the column ``origin``).

    Returns ``keys``, ``bin``, x mean, y mean, y error, count. With ``err`` the mean is
    inverse-variance weighted; without, the error is the standard error (NULL for one row).
    Every aggregate combines before the shuffle, so no row crosses the network.
    """
    ok = finite(F.col(x), F.col(y))
    if err:
        ok = ok & finite(F.col(err)) & (F.col(err) > 0)
    rows = df.where(ok)
    w = F.lit(width) if isinstance(width, int | float) else width
    if origin is None:
        start = rows.groupBy(*keys).agg(F.min(x).alias("_x0"))
        rows = rows.join(start, list(keys)) if keys else rows.crossJoin(start)  # one row
        x0 = F.col("_x0")
    else:
        x0 = F.col(origin)
    rows = rows.withColumn("bin", F.floor((F.col(x) - x0) / w).cast("long"))
    return _bin_means(rows, [*keys, "bin"], x, y, err, min_count)


def bin_edges(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    edges: Sequence[float],
    err: str | None = None,
    min_count: int = 1,
) -> DataFrame:
    """Bins between explicit edges, the same for all keys; rows outside them are left out."""
    ok = finite(F.col(x), F.col(y))
    if err:
        ok = ok & finite(F.col(err)) & (F.col(err) > 0)
    grid = F.array(*[F.lit(float(e)) for e in edges])
    rows = df.where(ok).withColumn(
        "bin", (F.size(F.filter(grid, lambda e: e <= F.col(x))) - 1).cast("long")
    )
    rows = rows.where((F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1))
    return _bin_means(rows, [*keys, "bin"], x, y, err, min_count)


def _bin_means(
    rows: DataFrame, keys: list[str], x: str, y: str, err: str | None, min_count: int
) -> DataFrame:
    n = F.count(F.lit(1))
    if err:
        w = 1.0 / (F.col(err) * F.col(err))
        mean = F.sum(w * F.col(y)) / F.sum(w)
        error = 1.0 / F.sqrt(F.sum(w))
    else:
        mean = F.avg(y)
        error = F.when(n > 1, F.stddev_samp(y) / F.sqrt(n))
    out = rows.groupBy(*keys).agg(
        F.avg(x).alias("x_mean"), mean.alias("y_mean"), error.alias("y_err"), n.alias("count")
    )
    return out.where(F.col("count") >= min_count)


# ---- cadence and extent
CHUNK_US = 86_400_000_000  # one day: rows of one key and one chunk share a task


def steps(df: DataFrame, keys: Sequence[str], t_us: str = "t_us") -> DataFrame:
    """Time steps between neighboring rows of each key, in microseconds (``dt_us``).

    Neighbors are found inside day-long chunks; the step across a chunk border comes from
    the chunks' own first and last times, so no task holds a whole key.
    """
    chunk = F.floor(F.col(t_us) / CHUNK_US).alias("_chunk")
    rows = df.select(*_cols(keys), F.col(t_us).alias("_t"), chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_t")
    inner = rows.select(*_cols(keys), (F.col("_t") - F.lag("_t").over(inside)).alias("dt_us"))
    ends = rows.groupBy(*keys, "_chunk").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    border = ends.select(*_cols(keys), (F.col("_a") - F.lag("_b").over(across)).alias("dt_us"))
    return inner.unionByName(border).where(F.col("dt_us").isNotNull())


def extent(df: DataFrame, keys: Sequence[str] = ("tic_id",)) -> DataFrame:
    """Per key: rows, first and last time, baseline (days) and sorted sectors."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min("t").alias("t_min"),
        F.max("t").alias("t_max"),
        (F.max("t") - F.min("t")).alias("baseline"),
        F.array_sort(F.collect_set("sector")).alias("sectors"),
    )


def cadence(
    df: DataFrame, keys: Sequence[str] = ("tic_id",), bounded: bool | None = None
) -> DataFrame:
    """Median sampling interval per key, in days (``cadence``)."""
    bounded = groups_fit(df, keys) if bounded is None else bounded
    gaps = steps(df, keys)
    out = medians(gaps, keys, F.col("dt_us").cast("double"), "_dt", bounded)
    return out.select(*keys, (F.col("_dt") / 86_400_000_000.0).alias("cadence"))


def curve_stats(
    df: DataFrame, keys: Sequence[str] = ("tic_id",), bounded: bool | None = None
) -> DataFrame:
    """Extent, cadence and median time per key: what the search needs of every curve."""
    bounded = groups_fit(df, keys) if bounded is None else bounded
    mid = medians(df, keys, F.col("t"), "t_median", bounded).drop("n")
    spacing = cadence(df, keys, bounded)
    return extent(df, keys).join(spacing, list(keys), "left").join(mid, list(keys), "left")


def binned_rms(
    df: DataFrame,
    keys: Sequence[str],
    width: Column,
    value: str = "flux",
    min_fraction: float = 0.5,
    name: str = "rms",
    spacing: DataFrame | None = None,
    bounded: bool | None = None,
) -> DataFrame:
    """Robust scatter of bin means, for bins with at least half the expected samples.

    ``df`` must carry ``t``, ``t_us`` and ``value``; ``width`` is constant per key. The bins
    of a key are few (its baseline over the width), so their medians are bounded groups.
    ``spacing`` gives known cadences by any subset of the keys.
    """
    rows = df.where(finite(F.col("t"), F.col(value))).withColumn("_w", width)
    cad = cadence(rows, keys, bounded) if spacing is None else spacing
    on = [k for k in keys if k in cad.columns]
    bins = bin_rows(rows, [*keys, "_w"], "t", value, F.col("_w"))
    kept = bins.join(cad, on).where(
        F.col("count") >= min_fraction * F.greatest(F.col("_w") / F.col("cadence"), F.lit(1.0))
    )
    out = robust_std(kept, list(keys), F.col("y_mean"), name, bounded=True)
    return out.where(F.col("n") >= 3).select(*keys, name)


def cdpp(df: DataFrame, hours: Sequence[float] = (0.5, 1.0, 2.0)) -> DataFrame:
    """Scatter of the flux on each of the given timescales, in ppm: tic_id, hours, cdpp_ppm."""
    widths = F.explode(F.array(*[F.lit(float(h)) for h in hours])).alias("hours")
    rows = df.select("tic_id", "t", "t_us", "flux", widths)
    spacing = cadence(df, ["tic_id"])
    out = binned_rms(
        rows, ["tic_id", "hours"], F.col("hours") / 24.0, name="_rms", spacing=spacing
    )
    return out.select("tic_id", "hours", (F.col("_rms") * 1e6).alias("cdpp_ppm"))


def sector_summary(df: DataFrame, value: str = "flux") -> DataFrame:
    """Rows and robust scatter (ppm) of every target and sector."""
    out = robust_std(df, ["tic_id", "sector"], F.col(value))
    return out.select("tic_id", "sector", "n", (F.col("sigma") * 1e6).alias("rms_ppm"))


def clipped(
    df: DataFrame, keys: Sequence[str] = ("tic_id",), value: str = "flux", nsigma: float = 6.0
) -> DataFrame:
    """Rows within ``nsigma`` robust deviations of their key's median."""
    noise = robust_std(df, keys, F.col(value), "_sigma", median_name="_med").drop("n")
    out = df.join(noise, list(keys))
    keep = finite(F.col(value)) & (F.abs(F.col(value) - F.col("_med")) < nsigma * F.col("_sigma"))
    return out.where(keep).drop("_med", "_sigma")
