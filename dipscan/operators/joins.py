"""Joins in time: windows around events, nearest events, dips of many candidates at once.

A row meets only the events of its own time bucket: windows are spread over the buckets they
touch and the join is an equi join on (target, bucket). Even a target that holds most of the
rows is thereby split over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 0.5  # days


def central_epoch(t_median: Column, period: Column, t0: Column) -> Column:
    """The mid-dip nearest the middle of the data."""
    return t0 + F.rint((t_median - t0) / period) * period


def _bucket(t: Column) -> Column:
    return F.floor(t / BUCKET)


def _spread(events: DataFrame) -> DataFrame:
    """``events`` (tic_id, time, half, ...) once per bucket their window touches."""
    time, half = F.col("time"), F.col("half")
    span = F.sequence(_bucket(time - half), _bucket(time + half))
    return events.withColumn("_bucket", F.explode(span))


def near(df: DataFrame, events: DataFrame, closed: bool = False) -> DataFrame:
    """Every row within ``half`` of an event, with the event's columns and ``dt`` = t - time."""
    rows = df.withColumn("_bucket", _bucket(F.col("t")))
    hit = rows.join(_spread(events), ["tic_id", "_bucket"]).drop("_bucket")
    hit = hit.withColumn("dt", F.col("t") - F.col("time"))
    inside = F.abs("dt") <= F.col("half") if closed else F.abs("dt") < F.col("half")
    return hit.where(inside)


def drop_near(df: DataFrame, events: DataFrame) -> DataFrame:
    """Rows at least ``half`` away from every event."""
    rows = df.withColumn("_bucket", _bucket(F.col("t"))).alias("r")
    spread = _spread(events.select("tic_id", "time", "half")).alias("e")
    on = (
        (F.col("r.tic_id") == F.col("e.tic_id"))
        & (F.col("r._bucket") == F.col("e._bucket"))
        & (F.abs(F.col("r.t") - F.col("e.time")) < F.col("e.half"))
    )
    return rows.join(spread, on, "left_anti").drop("_bucket")


def nearest_event(df: DataFrame, events: DataFrame, name: str = "distance") -> DataFrame:
    """``df`` with the distance to the nearest event (tic_id, t) on either side; NULL if none.

    Each occupied bucket knows its own events, the last before it and the first after it.
    """
    here = (
        events.withColumn("_bucket", _bucket(F.col("t")))
        .groupBy("tic_id", "_bucket")
        .agg(F.collect_list("t").alias("_times"), F.min("t").alias("_a"), F.max("t").alias("_b"))
    )
    rows = df.withColumn("_bucket", _bucket(F.col("t")))
    buckets = rows.select("tic_id", "_bucket").distinct()
    line = buckets.join(here, ["tic_id", "_bucket"], "full")
    order = Window.partitionBy("tic_id").orderBy("_bucket")
    before = F.last("_b", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_a", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    own = F.coalesce("_times", F.array().cast("array<double>"))
    close = line.select(
        "tic_id", "_bucket", F.array_compact(F.concat(own, F.array(before, after))).alias("_near")
    )
    joined = rows.join(close, ["tic_id", "_bucket"], "left")
    distance = F.array_min(F.transform("_near", lambda x: F.abs(F.col("t") - x)))
    return joined.withColumn(name, distance).drop("_bucket", "_near")


def epochs(cands: DataFrame, extent: DataFrame, reach: float) -> DataFrame:
    """One row per candidate and cycle whose window (``reach`` durations) touches the data.

    ``cands``: cand_id, tic_id, period, t0, duration; ``extent``: tic_id, t_min, t_max.
    Adds ``epoch``, ``time`` (mid-dip) and ``half`` (the window's half-width in days).
    """
    half = reach * F.col("duration")
    first = F.ceil((F.col("t_min") - half - F.col("t0")) / F.col("period"))
    last = F.floor((F.col("t_max") + half - F.col("t0")) / F.col("period"))
    rows = cands.join(extent.select("tic_id", "t_min", "t_max"), "tic_id")
    cycles = F.when(last >= first, F.sequence(first, last))
    rows = rows.withColumn("epoch", F.explode(cycles))
    return rows.withColumns(
        {"time": F.col("t0") + F.col("epoch") * F.col("period"), "half": half}
    ).drop("t_min", "t_max")


def dip_rows(df: DataFrame, cands: DataFrame, extent: DataFrame, reach: float) -> DataFrame:
    """Rows within ``reach`` durations of a mid-dip, keyed (cand_id, epoch), with ``dt``.

    Windows wider than the period would overlap; a row belongs to its nearest mid-dip only.
    """
    rows = near(df, epochs(cands, extent, reach))
    return rows.where(F.col("epoch") == F.rint((F.col("t") - F.col("t0")) / F.col("period")))


def ratio_pairs(a: DataFrame, b: DataFrame, ratios: Sequence[float], tol: float, step: float = 2.2) -> DataFrame:
    """Pairs of one target whose period ratio a/b is within ``tol`` of one of ``ratios``.

    An equi join on (target, step of log period): only pairs whose periods agree meet. The
    sides are addressed as ``a.*`` and ``b.*``; ``ratio`` is the one that matched. The step
    test is slightly wider than ``tol``; callers apply their exact condition. ``step`` (in ``tol``): a long
    one makes fewer copies of ``a`` and more pairs to look at.
    """
    width = step * tol
    left = a.withColumn("ratio", F.explode(F.array(*[F.lit(float(x)) for x in ratios])))
    want = F.log(F.col("period") / F.col("ratio"))
    span = F.sequence(F.floor((want - 1.05 * tol) / width), F.floor((want + 1.05 * tol) / width))
    left = left.withColumn("_step", F.explode(span)).alias("a")
    right = b.withColumn("_step", F.floor(F.log("period") / width)).alias("b")
    on = (F.col("a.tic_id") == F.col("b.tic_id")) & (F.col("a._step") == F.col("b._step"))
    near_ratio = F.abs(F.col("a.period") / (F.col("ratio") * F.col("b.period")) - 1.0) < 1.05 * tol
    return left.join(right, on).where(near_ratio)
