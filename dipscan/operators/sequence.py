"""Ordered-sequence operators without one task per target.

Order matters only locally: gaps are found between time bins, running filters work on
blocks that carry a halo of their neighbors' rows, and values are carried over a border by
the chunks' own summaries.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CleaningConfig
from ..functions.expr import finite
from ..session import materialize, spread
from .kernels import centered_median
from .stats import BOUND, CHUNK_US, groups_fit, medians, robust_std, steps

BLOCK_ROWS = 2048


def _us(days: float) -> int:
    return round(days * 86_400_000_000)


# ---- segments
def segment_bins(df: DataFrame, keys: Sequence[str], max_gap: float) -> DataFrame:
    """Which segment each occupied time bin belongs to; a gap above ``max_gap`` days splits.

    Bins are ``max_gap`` wide, so a gap can only lie between two bins, and the bins' first
    and last times (combined before the shuffle) decide. Columns: ``keys``, ``gap_bin``,
    ``segment`` (from 1), ``seg_start``, ``seg_end`` (days), ``seg_n``.
    """
    gap = _us(max_gap)
    bins = (
        df.groupBy(*keys, F.floor(F.col("t_us") / gap).alias("gap_bin"))
        .agg(F.min("t_us").alias("_a"), F.max("t_us").alias("_b"), F.count(F.lit(1)).alias("_n"))
    )
    order = Window.partitionBy(*keys).orderBy("gap_bin")
    first = F.coalesce((F.col("_a") - F.lag("_b").over(order) > gap).cast("int"), F.lit(1))
    bins = bins.withColumn("_first", first).withColumn(
        "segment", F.sum("_first").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    whole = Window.partitionBy(*keys, "segment")
    day = 86_400_000_000.0
    return bins.select(
        *keys,
        "gap_bin",
        F.col("segment").cast("int").alias("segment"),
        (F.min("_a").over(whole) / day).alias("seg_start"),
        (F.max("_b").over(whole) / day).alias("seg_end"),
        F.sum("_n").over(whole).alias("seg_n"),
    )


def segments(df: DataFrame, keys: Sequence[str], max_gap: float) -> DataFrame:
    """One row per segment: start, end and rows."""
    return segment_bins(df, keys, max_gap).select(
        *keys, "segment", "seg_start", "seg_end", "seg_n"
    ).distinct()


def with_segments(df: DataFrame, keys: Sequence[str], max_gap: float) -> DataFrame:
    """``df`` with its segment number, start, end and size."""
    gap = _us(max_gap)
    keyed = df.withColumn("gap_bin", F.floor(F.col("t_us") / gap))
    return keyed.join(segment_bins(df, keys, max_gap), [*keys, "gap_bin"]).drop("gap_bin")


def edge_rows(df: DataFrame, keys: Sequence[str], max_gap: float, cutoff: float) -> DataFrame:
    """``df`` without the rows within ``cutoff`` days of either end of their segment."""
    rows = with_segments(df, keys, max_gap)
    far = (F.col("t") - F.col("seg_start") >= cutoff) & (F.col("seg_end") - F.col("t") >= cutoff)
    return rows.where(far).select(*df.columns)


# ---- running median
def _numbered(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``df`` with each row's position (``_idx``, from 0) in its key's time order; rows of one time go by ``value``."""
    rows = df.withColumn("_chunk", F.floor(F.col("t_us") / CHUNK_US))
    counts = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy("t_us", value)
    rows = rows.withColumn("_rn", F.row_number().over(inside) - 1)
    return (
        rows.join(counts, [*keys, "_chunk"])
        .withColumn("_idx", F.col("_before") + F.col("_rn"))
        .drop("_chunk", "_before", "_rn")
    )


def running_median(
    df: DataFrame,
    keys: Sequence[str],
    window: float,
    value: str = "flux",
    max_gap: float | None = None,
    name: str = "trend",
    bounded: bool | None = None,
) -> DataFrame:
    """Median over an odd number of neighboring rows spanning ``window`` days, per segment.

    The number of rows follows from the segment's own cadence; beyond a segment's ends its
    end value repeats. Rows travel to the blocks whose windows reach them, so a block is
    ``BLOCK_ROWS`` rows, or a window where that is more, plus half a window on either side, whatever
    the segment's length; a row travels to three blocks at most.
    """
    gap = 0.5 * window if max_gap is None else max_gap
    seg = [*keys, "segment"]
    rows = with_segments(df, keys, gap)
    fits = groups_fit(df, keys) if bounded is None else bounded
    spacing = medians(steps(rows, seg), seg, F.col("dt_us").cast("double"), "_dt", fits).drop("n")
    rows = _numbered(rows, seg, value).join(spacing, seg, "left")
    size = F.greatest(F.lit(3), F.rint(F.lit(window * 86_400_000_000.0) / F.col("_dt")).cast("int"))
    rows = rows.withColumn("_size", F.coalesce(size + 1 - size % 2, F.lit(3)))
    half = F.floor(F.col("_size") / 2)
    wide = F.greatest(F.lit(BLOCK_ROWS), F.col("_size"))
    last = F.floor((F.col("seg_n") - 1) / wide)
    first_block = F.greatest(F.floor((F.col("_idx") - half) / wide), F.lit(0))
    last_block = F.least(F.floor((F.col("_idx") + half) / wide), last)
    rows = rows.withColumn("_block", F.explode(F.sequence(first_block, last_block)))
    keep = list(df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_idx")
        number, size, n = (int(pdf[c].iloc[0]) for c in ("_block", "_size", "seg_n"))
        idx = pdf["_idx"].to_numpy()
        v = pdf[value].to_numpy()
        half, wide = size // 2, max(BLOCK_ROWS, size)
        start, stop = number * wide, min((number + 1) * wide, n)
        at = np.clip(np.arange(start - half, stop + half), 0, n - 1) - idx[0]
        core = (idx >= start) & (idx < stop)
        trend = v[core] if n == 1 else centered_median(v[at], size)
        return pdf.loc[core, keep].assign(**{name: trend})

    return spread(rows, *seg, "_block").groupBy(*seg, "_block").applyInPandas(block, schema)


# ---- interpolation
def lerp(
    df: DataFrame, keys: Sequence[str], value: str, name: str | None = None
) -> DataFrame:
    """Fill NULLs of ``value`` linearly in time from the nearest defined rows of the key.

    Before the first and after the last defined row its value is held. The nearest defined
    rows are looked up inside day-long chunks first and carried over chunk borders.
    """
    out_name = name or value
    rows = df.withColumn("_chunk", F.floor(F.col("t_us") / CHUNK_US))
    known = F.when(F.col(value).isNotNull(), F.struct("t_us", F.col(value).alias("v")))
    rows = rows.withColumn("_known", known)
    ends = rows.groupBy(*keys, "_chunk").agg(
        F.min("_known").alias("_first"), F.max("_known").alias("_last")
    )
    order = Window.partitionBy(*keys).orderBy("_chunk")
    ends = ends.select(
        *keys,
        "_chunk",
        F.last("_last", ignorenulls=True)
        .over(order.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_carried"),
        F.first("_first", ignorenulls=True)
        .over(order.rowsBetween(1, Window.unboundedFollowing))
        .alias("_coming"),
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy("t_us")
    rows = rows.withColumn(
        "_prev",
        F.max("_known").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    # looking ahead is looking back in reverse order: a frame open to its end is evaluated anew for every row
    reverse = Window.partitionBy(*keys, "_chunk").orderBy(F.desc("t_us"))
    rows = rows.withColumn(
        "_next",
        F.min("_known").over(reverse.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    rows = rows.join(ends, [*keys, "_chunk"])
    a = F.coalesce(F.col("_prev"), F.col("_carried"))
    b = F.coalesce(F.col("_next"), F.col("_coming"))
    rows = rows.withColumn("_p", a).withColumn("_q", b)
    share = (F.col("t_us") - F.col("_p.t_us")) / (F.col("_q.t_us") - F.col("_p.t_us"))
    between = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * share
    filled = F.coalesce(
        F.col(value),
        F.when(F.col("_q.t_us") > F.col("_p.t_us"), between),
        F.col("_p.v"),
        F.col("_q.v"),
    )
    others = [c for c in df.columns if c != out_name]
    return rows.select(*others, filled.alias(out_name))


# ---- outliers
def find_outliers(
    df: DataFrame,
    keys: Sequence[str] = ("tic_id", "sector"),
    config: CleaningConfig | None = None,
    value: str = "flux",
    passes: int | None = None,
) -> DataFrame:
    """``df`` with ``outlier``: rows far above (and optionally below) a running median.

    Every pass fits the rows kept so far, interpolates the trend to all rows and clips on
    their robust scatter. A curve whose flags no longer change keeps them (the pass would repeat
    itself) and leaves the loop, which ends when none is left, or after ``max_iterations`` passes if given.
    Flags may also come back to what they were some passes ago, and would go round forever: without
    ``max_iterations`` such a curve leaves with those flags of the round that are fewest (ties: by their hash).
    """
    config = config or CleaningConfig()
    keys = list(keys)
    rows = df.withColumn("outlier", F.lit(False))
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    size = materialize(size.select(*keys, "_size", (F.col("_size") >= 5).alias("_enough")), "clip-size")
    # what a pass fits is part of the curve: one measure bounds them all
    fits = (size.agg(F.max("_size")).first()[0] or 0) <= BOUND
    size = size.drop("_size")
    limit = passes or config.max_iterations
    # the flags of every curve after every pass, as their number and the sum of their rows' hashes
    number = T.DecimalType(38, 0)
    states = size.select(
        *keys, F.lit(0).alias("_pass"), F.lit(0).cast("long").alias("_flags"), F.lit(0).cast(number).alias("_sum")
    )
    mark = F.sum(F.when(F.col("_new"), F.xxhash64(*df.columns).cast("decimal(20,0)")))
    settled, done = None, []
    for i in count() if limit is None else range(limit):
        kept = running_median(rows.where("NOT outlier"), keys, config.clip_window, value, bounded=fits)
        left = rows.where("outlier").withColumn("trend", F.lit(None).cast("double"))
        fitted = lerp(kept.unionByName(left), keys, "trend")
        fitted = materialize(
            fitted.withColumn("_resid", F.col(value) - F.col("trend")), f"clip-fit-{i}"
        )
        noise = robust_std(
            fitted.where("NOT outlier"), keys, F.col("_resid"), "_sigma", fits, median_name="_med"
        ).drop("n", "_med")
        flagged = fitted.join(noise, keys, "left").join(size, keys, "left")
        high = F.col("_resid") > config.sigma_upper * F.col("_sigma")
        if config.sigma_lower is not None:
            high = high | (F.col("_resid") < -config.sigma_lower * F.col("_sigma"))
        usable = finite(F.col("_sigma")) & (F.col("_sigma") != 0) & F.col("_enough")
        new = F.when(usable, F.coalesce(high, F.lit(False))).otherwise(F.col("outlier"))
        flagged = materialize(
            flagged.withColumn("_new", new).select(*df.columns, "outlier", "_new"), f"clip-{i}"
        )
        done.append(flagged.select(*df.columns, F.col("_new").alias("outlier")))
        rows = done[i]
        if i + 1 == limit:
            break
        state = flagged.groupBy(*keys).agg(
            F.lit(i + 1).alias("_pass"), F.count_if("_new").alias("_flags"),
            F.coalesce(mark.cast(number), F.lit(0).cast(number)).alias("_sum"),
        )
        state = materialize(state, f"clip-state-{i}")
        since = state.drop("_pass").join(states, [*keys, "_flags", "_sum"]).groupBy(*keys).agg(F.max("_pass").alias("_since"))
        if limit is not None:
            since = since.where(F.col("_since") == i)
        states = states.unionByName(state)
        round_ = states.join(since, keys).where("_pass > _since").groupBy(*keys)
        ended = materialize(
            round_.agg(F.min(F.struct("_flags", "_sum", "_pass")).alias("_s")).select(*keys, F.col("_s._pass").alias("_at")),
            f"clip-ended-{i}",
        )
        for at in sorted(r["_at"] for r in ended.select("_at").distinct().collect()):
            part = done[at - 1].join(ended.where(F.col("_at") == at), keys, "left_semi")
            settled = part if settled is None else settled.unionByName(part)
        rows = rows.join(ended, keys, "left_anti")
        if rows.isEmpty():
            break
    return rows if settled is None else settled.unionByName(rows)


# ---- peaks and suppression
def local_maxima(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows above their left neighbor and not below their right one."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_l", F.lag(value).over(w)).withColumn("_r", F.lead(value).over(w))
    return rows.where((F.col(value) > F.col("_l")) & (F.col(value) >= F.col("_r"))).drop("_l", "_r")


#: Rows of one block of a suppression round, about; blocks widen by rounds but not beyond this.
SETTLE_ROWS = 1 << 18
_STATES = (
    "_id long, _x double, _at double, _own double, _give double, _s double, _tie double, _then double, _wide double, "
    "_kept boolean"
)


def _settle(pdf: pd.DataFrame, starts: Sequence[int] = (0,)) -> np.ndarray:
    """What blocks of rows, one after another from ``starts``, can decide: 1 stays, -1 goes, 0 hangs on rows beyond.

    In order of strength: a row near a stronger one that stays goes; one that could meet a stronger
    undecided row, here or beyond the block's ends, waits.
    """
    at, own, give, kept = (pdf[c].tolist() for c in ("_at", "_own", "_give", "_kept"))
    inside = ((pdf["_x"] - pdf["_wide"] >= pdf["_low"]) & (pdf["_x"] + pdf["_wide"] < pdf["_high"])).tolist()
    out = np.zeros(len(at), np.int8)
    longest = np.maximum.reduceat(np.maximum(pdf["_own"].to_numpy(), pdf["_give"].to_numpy()), starts).tolist()
    block = np.repeat(np.arange(len(starts)), np.diff([*starts, len(at)]))
    order = np.lexsort((pdf["_id"], pdf["_then"], pdf["_tie"], -pdf["_s"].to_numpy(), ~pdf["_kept"].to_numpy(bool), block))
    number, stay, wait, far = -1, [], [], 0.0  # places and rows of those that stay, of those that wait

    def meets(found: list, i: int) -> bool:
        a = at[i]
        for k in range(bisect_left(found, (a,)), len(found)):
            b, j = found[k]
            if b - a > far:
                break
            if b - a < max(own[j], give[i]):
                return True
        for k in range(bisect_left(found, (a,)) - 1, -1, -1):
            b, j = found[k]
            if a - b > far:
                break
            if a - b < max(own[j], give[i]):
                return True
        return False

    for i, n in zip(order.tolist(), block[order].tolist(), strict=True):
        if n != number:
            number, stay, wait, far = n, [], [], longest[n]
        if kept[i]:
            insort(stay, (at[i], i))
            out[i] = 1
        elif meets(stay, i):
            out[i] = -1
        elif not inside[i] or meets(wait, i):
            insort(wait, (at[i], i))
        else:
            insort(stay, (at[i], i))
            out[i] = 1
    return out


def _whole_blocks(frames: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted batches cut so that no block (equal ``keys``) is split, with the first row of each block."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        same = np.ones(len(frame), bool)
        for k in keys:
            values = frame[k].to_numpy()
            same[1:] &= values[1:] == values[:-1]
            same[0] &= bool(held) and values[0] == held[-1][k].iloc[-1]
        new = np.flatnonzero(~same)
        if new.size == 0:
            held.append(frame)
            continue
        # the last block may go on in the next batch
        whole = pd.concat([*held, frame.iloc[: new[-1]]], ignore_index=True)
        if len(whole):
            before = sum(map(len, held))
            yield whole, np.unique([0, *(before + new[:-1])])
        held = [frame.iloc[new[-1]:]]
    if held:
        yield pd.concat(held, ignore_index=True), np.array([0])


def keep_apart(
    df: DataFrame, keys: Sequence[str], at: Column, own: Column, give: Column, score: Column, tie: Column,
    axis: Column | None = None, wide: Column | None = None, then: Column | None = None,
) -> DataFrame:
    """Greedy suppression by rounds: the strongest row stays and drops what it reaches, and so on.

    A row drops those nearer than its ``own`` reach, or than their ``give``; equal scores go by the
    smaller ``tie``, and equal ties by the smaller ``then``. Every round cuts the undecided rows of a key into blocks along ``axis`` (``at``
    unless given; no row meets another more than ``wide`` away on it). A block decides all that doesn't
    hang on rows beyond its ends; the next round's blocks lie across those ends and are twice as wide.
    Rows that are settled and reach no undecided one leave the loop. So no task holds a key's rows.
    """
    at = at.cast("double")
    rows = df.withColumn("_id", F.monotonically_increasing_id()).withColumns({
        "_at": at, "_x": (at if axis is None else axis).cast("double"), "_own": own.cast("double"), "_give": give.cast("double"),
        "_s": score.cast("double"), "_tie": tie.cast("double"), "_then": (F.lit(0) if then is None else then).cast("double"),
    })
    reach = F.greatest("_own", "_give") if wide is None else wide
    rows = materialize(rows.withColumn("_reach", reach.cast("double")), "apart")
    longest = rows.groupBy(*keys).agg(
        F.max("_reach").alias("_wide"), F.count(F.lit(1)).alias("_rows"), (F.max("_x") - F.min("_x")).alias("_span"),
        F.min("_x").alias("_from"), F.max("_x").alias("_to"),
    )
    # blocks of a bounded number of rows on average, at least eight reaches wide
    share = F.col("_span") * 4096 / F.col("_rows")
    cap = F.col("_span") * SETTLE_ROWS / F.col("_rows")
    sizes = longest.select(*keys, "_wide", "_from", "_to", F.greatest(8 * F.col("_wide"), share, F.lit(1e-12)).alias("_block"),
                           F.greatest(8 * F.col("_wide"), cap, F.lit(1e-12)).alias("_cap"))
    parts = ["_id", "_x", "_at", "_own", "_give", "_s", "_tie", "_then"]
    todo = rows.select(*keys, *parts).join(sizes, list(keys)).withColumn("_kept", F.lit(False))
    kept, round_ = None, 0
    schema = ", ".join([*[f"`{k}` {dict(df.dtypes)[k]}" for k in keys], _STATES, "_from double, _to double, _block double, _cap double, _state byte"])
    by = [*keys, "_number"]

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in _whole_blocks(frames, by):
            yield pdf.drop(columns=["_number", "_low", "_high"]).assign(_state=_settle(pdf, starts))

    while True:
        width = F.least(F.col("_block") * 2.0**round_, F.col("_cap"))
        shift = 0.5 if round_ % 2 else 0.0
        blocks = todo.withColumn("_number", F.floor(F.col("_x") / width + shift))
        low, high = (F.col("_number") - shift) * width, (F.col("_number") + 1 - shift) * width
        # nothing lies beyond a key's first and last row
        blocks = blocks.withColumns({
            "_low": F.when(low > F.col("_from"), low).otherwise(F.lit(-np.inf)),
            "_high": F.when(high <= F.col("_to"), high).otherwise(F.lit(np.inf)),
        })
        sorted_ = spread(blocks, *by).sortWithinPartitions(*by)
        done = materialize(sorted_.mapInPandas(settle, schema), f"apart-{round_}")
        new = done.where("_state = 1 AND NOT _kept").select("_id")
        kept = new if kept is None else kept.union(new)
        open_ = done.where("_state = 0")
        if open_.isEmpty():
            break
        # those that stay and may still drop somebody go on: they lie within a reach of an open row
        line = open_.select(*keys, F.explode(F.sequence(*[F.floor(F.col("_x") / F.col("_wide")) + i for i in (-1, 1)])).alias("_near")).distinct()
        staying = done.where("_state = 1").withColumn("_near", F.floor(F.col("_x") / F.col("_wide")))
        staying = staying.join(line, [*keys, "_near"], "left_semi").drop("_near").withColumn("_kept", F.lit(True))
        todo = open_.unionByName(staying).drop("_state")
        round_ += 1
    return rows.join(kept, "_id", "left_semi").select(*df.columns)


def suppress(df: DataFrame, keys: Sequence[str], at: str, reach: Column, score: str) -> DataFrame:
    """Keep the strongest row, drop weaker ones within the longer of the two reaches, repeat."""
    return keep_apart(df, keys, F.col(at), reach, reach, F.col(score), F.col(at))
