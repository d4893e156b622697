"""Scatter of a curve away from many candidates' dips, from the curve's totals minus each one's dips.

A curve is indexed once: its rows are numbered in time with running sums, and their values stand in
buckets between quantiles. A candidate brings only the rows inside its own dips. The k-th value of what
is left follows from the buckets' counts minus the dips', then from one bucket's values; a median
absolute deviation likewise from the two or four buckets at the wanted distance. Means of bins are
differences of running sums, again minus the dips. So no row outside a dip ever meets a candidate: a
candidate costs its dip rows, the square root of the curve's length and its bins.

No group here is open: buckets hold distinct values with counts, numbering and running sums work per
day and carry totals, and what is ordered per candidate is a list of buckets, bins or cycles.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite, fold
from ..session import materialize
from .joins import epochs, near
from .stats import CHUNK_US, MAD_SCALE, cadence, robust_std

STRETCH = 64  # bounds of value buckets looked through at once


def numbered(rows: DataFrame, key: str = "tic_id", *sums: str) -> DataFrame:
    """``rows`` with ``seq`` (0, 1, ... in time), ``dt_us`` since the row before, and running sums.

    ``_upto_<name>``: the sum of ``name`` over all earlier rows. Rows need ``t_us``.
    """
    day = rows.withColumn("_day", F.floor(F.col("t_us") / CHUNK_US))
    inside = Window.partitionBy(key, "_day").orderBy("t_us", *sums)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = day.withColumn("_at", F.row_number().over(inside) - 1).withColumn("_prev", F.lag("t_us").over(inside))
    local = local.withColumns({f"_upto_{s}": F.coalesce(F.sum(s).over(before), F.lit(0.0)) for s in sums})
    totals = day.groupBy(key, "_day").agg(
        F.count(F.lit(1)).alias("_n"), F.max("t_us").alias("_end"), *[F.sum(s).alias(f"_day_{s}") for s in sums]
    )
    days = Window.partitionBy(key).orderBy("_day")
    earlier = days.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        key, "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"), F.lag("_end").over(days).alias("_last"),
        *[F.coalesce(F.sum(f"_day_{s}").over(earlier), F.lit(0.0)).alias(f"_carry_{s}") for s in sums],
    )
    out = local.join(carried, [key, "_day"])
    return out.select(
        *rows.columns, (F.col("_from") + F.col("_at")).alias("seq"),
        (F.col("t_us") - F.coalesce("_prev", "_last")).alias("dt_us"),
        *[(F.col(f"_carry_{s}") + F.col(f"_upto_{s}")).alias(f"_upto_{s}") for s in sums],
    )


def time_cells(rows: DataFrame, info: DataFrame, key: str = "tic_id", times: bool = True) -> DataFrame:
    """``key``, ``cell``, ``before`` (rows in earlier cells) and, with ``times``, ``ts`` (the cell's own times, sorted).

    ``info``: key, t_min, t_max, width. Every cell from t_min to one past t_max is there, empty
    ones too; totals run inside days' worth of cells and are carried across.
    """
    block = F.floor(F.col("cell") / 1024)
    cell = F.floor((F.col("t") - F.col("t_min")) / F.col("width")).cast("long")
    own = rows.select(key, "t").join(info, key).groupBy(key, cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("_c"), *([F.sort_array(F.collect_list("t")).alias("ts")] if times else [])
    )
    last = F.floor((F.col("t_max") - F.col("t_min")) / F.col("width")).cast("long") + 1
    line = info.select(key, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("cell"))
    cells = line.join(own, [key, "cell"], "left").select(
        key, "cell", block.alias("_block"), F.coalesce("_c", F.lit(0)).alias("_c"),
        *([F.coalesce("ts", F.array().cast("array<double>")).alias("ts")] if times else []),
    )
    inside = Window.partitionBy(key, "_block").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy(key, "_block").agg(F.sum("_c").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"))
    size = F.coalesce(F.sum("_c").over(inside), F.lit(0))
    return cells.withColumn("_in", size).join(carried, [key, "_block"]).select(
        key, "cell", (F.col("_from") + F.col("_in")).alias("before"), *(["ts"] if times else [])
    )


class ValueIndex:
    """The values of each curve in buckets between quantiles, as distinct values with counts."""

    def __init__(self, rows: DataFrame, value: str, key: str, parts: int):
        probs = F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)])
        self.key, self.value = key, value
        self.grid = rows.where(F.col(value).isNotNull()).groupBy(key).agg(
            F.array_distinct(F.percentile_approx(value, probs, 50 * parts)).alias(f"_grid_{value}")
        )

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their bucket (``<value>_bucket``)."""
        # bounds come in stretches of STRETCH: first the whole stretches below, then one stretch's bounds
        grid, v = F.col(f"_grid_{self.value}"), F.col(self.value)
        tops = self.grid.withColumn("_tops", F.filter(grid, lambda e, i: i % STRETCH == STRETCH - 1))
        found = rows.join(tops, self.key).withColumn("_whole", STRETCH * F.size(F.filter("_tops", lambda e: e <= v)))
        part = F.size(F.filter(F.slice(grid, F.col("_whole") + 1, F.lit(STRETCH)), lambda e: e <= v))
        return found.withColumn(f"{self.value}_bucket", F.col("_whole") + part).drop(f"_grid_{self.value}", "_tops", "_whole")

    def built(self, placed: DataFrame) -> None:
        rows = placed.where(F.col(self.value).isNotNull())
        self.values = materialize(
            rows.groupBy(self.key, F.col(f"{self.value}_bucket").alias("bucket"), F.col(self.value).cast("double").alias("v"))
            .agg(F.count(F.lit(1)).alias("c")), "values",
        )
        self.buckets = self.values.groupBy(self.key, "bucket").agg(
            F.sum("c").alias("c"), F.min("v").alias("low"), F.max("v").alias("high")
        )

    def taken(self, rows: DataFrame, ids: Sequence[str], sign: int = -1) -> DataFrame:
        """Rows to leave out (or, with sign 1, to add) as signed counts per candidate and value."""
        rows = rows.where(F.col(self.value).isNotNull())
        return rows.groupBy(*ids, F.col(f"{self.value}_bucket").alias("bucket"), F.col(self.value).cast("double").alias("v")).agg(
            (sign * F.count(F.lit(1))).alias("c")
        )

    def median(self, cands: DataFrame, ids: Sequence[str], changes: DataFrame, name: str) -> DataFrame:
        """``ids``, ``_n`` (values left) and their interpolated median."""
        per_bucket = cands.join(self.buckets, self.key).select(*ids, "bucket", "c").unionByName(
            changes.select(*ids, "bucket", "c")
        ).groupBy(*ids, "bucket").agg(F.sum("c").alias("c"))
        by_bucket = Window.partitionBy(*ids).orderBy("bucket")
        per_bucket = per_bucket.withColumns({
            "_upto": F.sum("c").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)),
            "_n": F.sum("c").over(Window.partitionBy(*ids)),
        }).where("_n > 0 AND c > 0")
        low, high = _middle(F.col("_n"))
        hit = per_bucket.where((F.col("_upto") > low) & (F.col("_upto") - F.col("c") <= high)).select(
            *ids, "bucket", "_n", (F.col("_upto") - F.col("c")).alias("_before")
        )
        where = hit.join(cands.select(*ids, self.key).distinct() if self.key not in ids else cands.select(*ids), list(ids))
        values = where.join(self.values, [self.key, "bucket"]).select(*ids, "bucket", "_n", "_before", "v", "c").unionByName(
            hit.join(changes, [*ids, "bucket"]).select(*ids, "bucket", "_n", "_before", "v", "c")
        ).groupBy(*ids, "bucket", "_n", "_before", "v").agg(F.sum("c").alias("c"))
        by_value = Window.partitionBy(*ids, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        values = values.withColumn("_upto", F.col("_before") + F.sum("c").over(by_value)).where("c > 0")
        return _picked(values, ids, "v", name)

    def deviation(self, centres: DataFrame, ids: Sequence[str], changes: DataFrame, centre: str, name: str) -> DataFrame:
        """``ids``, ``_n`` and the median distance from ``centre`` of the values left (none may be added)."""
        m = F.col(centre)
        changed = changes.groupBy(*ids, "bucket").agg(F.sum("c").alias("_x"))
        buckets = centres.join(self.buckets, self.key).join(changed, [*ids, "bucket"], "left").select(
            *ids, *([self.key] if self.key not in ids else []), centre, "bucket", (F.col("c") + F.coalesce("_x", F.lit(0))).alias("c"),
            F.greatest(F.col("low") - m, m - F.col("high"), F.lit(0.0)).alias("_least"),
            F.greatest(F.abs(F.col("low") - m), F.abs(F.col("high") - m)).alias("_most"),
        ).where("c > 0")
        whole = Window.partitionBy(*ids)
        upto = Window.unboundedPreceding, 0
        buckets = buckets.withColumns({
            "_n": F.sum("c").over(whole),
            "_maybe": F.sum("c").over(whole.orderBy("_least", "bucket").rowsBetween(*upto)),
            "_surely": F.sum("c").over(whole.orderBy("_most", "bucket").rowsBetween(*upto)),
        })
        low, high = _middle(F.col("_n"))
        buckets = buckets.withColumns({
            "_near": F.min(F.when(F.col("_maybe") > low, F.col("_least"))).over(whole),
            "_far": F.min(F.when(F.col("_surely") > high, F.col("_most"))).over(whole),
        })
        below = F.col("_most") < F.col("_near")
        buckets = buckets.withColumn("_before", F.sum(F.when(below, F.col("c")).otherwise(0)).over(whole))
        hit = buckets.where(~below & (F.col("_least") <= F.col("_far"))).drop("c")
        fine = hit.join(self.values, [self.key, "bucket"]).select(*ids, "bucket", centre, "_n", "_before", "v", "c").unionByName(
            hit.join(changes, [*ids, "bucket"]).select(*ids, "bucket", centre, "_n", "_before", "v", "c")
        )
        fine = fine.groupBy(*ids, "_n", "_before", F.abs(F.col("v") - m).alias("v")).agg(F.sum("c").alias("c"))
        by_value = Window.partitionBy(*ids).orderBy("v").rowsBetween(*upto)
        fine = fine.withColumn("_upto", F.col("_before") + F.sum("c").over(by_value)).where("c > 0")
        return _picked(fine, ids, "v", name)


def _middle(n: Column) -> tuple[Column, Column]:
    """The two middle places (from 0) of n values."""
    return F.floor((n - 1) / 2), F.floor(n / 2)


def _picked(rows: DataFrame, ids: Sequence[str], value: str, name: str) -> DataFrame:
    low, high = _middle(F.col("_n"))
    covers = [(F.col("_upto") > k) & (F.col("_upto") - F.col("c") <= k) for k in (low, high)]
    out = rows.groupBy(*ids).agg(
        F.max("_n").alias("_n"), *[F.max(F.when(c, F.col(value))).alias(f"_v{i}") for i, c in enumerate(covers)]
    )
    return out.select(*ids, "_n", (F.col("_v0") + 0.5 * (F.col("_v1") - F.col("_v0"))).alias(name))


class QuietCurves:
    """The index of all curves: what any number of candidates may then be taken out of."""

    def __init__(self, lc: DataFrame, flux: bool = True):
        rows = lc.select("tic_id", "t", "t_us", "flux").where(finite(F.col("t"), F.col("flux")))
        level = rows.groupBy("tic_id").agg(F.avg("flux").alias("_level"))
        rows = rows.join(level, "tic_id").withColumn("_y", F.col("flux") - F.col("_level"))
        ordered = materialize(numbered(rows, "tic_id", "_y"), "numbered")
        size = ordered.groupBy("tic_id").agg(
            F.count(F.lit(1)).alias("n_rows"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.sum("_y").alias("_total")
        )
        most = size.agg(F.max("n_rows")).first()[0] or 1
        parts = min(max(isqrt(most), 8), 4096)
        self.fluxes = ValueIndex(ordered, "flux", "tic_id", parts) if flux else None
        self.steps = ValueIndex(ordered, "dt_us", "tic_id", parts)
        placed = self.steps.placed(self.fluxes.placed(ordered) if flux else ordered)
        self.rows = materialize(placed, "placed")
        if flux:
            self.fluxes.built(self.rows)
        self.steps.built(self.rows)
        spacing = cadence(ordered)
        # a curve of one row has no spacing
        width = F.coalesce("cadence", F.lit(1.0))
        self.info = materialize(
            size.join(spacing, "tic_id", "left").withColumn("width", F.when(width > 0, width).otherwise(1.0)).drop("cadence"), "curves"
        )
        self.cells = materialize(time_cells(self.rows, self.info.select("tic_id", "t_min", "t_max", "width")), "cells")

    def members(self, cands: DataFrame, ids: Sequence[str], phases: Sequence[float]) -> DataFrame:
        """Rows within a duration of a dip at any of ``phases`` (in cycles), once each.

        Adds the candidate's period, t0 and duration, ``_cycle`` and ``_off`` (the distance in phase).
        """
        info = cands.select(*dict.fromkeys([*ids, "tic_id", "period", "t0", "duration"]))
        hits = None
        for i, phase in enumerate(phases):
            moved = info.withColumn("t0", F.col("t0") + phase * F.col("period")) if phase else info
            # slightly wide, so that the exact test below decides at the border
            hit = near(self.rows, epochs(moved, self.info, 1.001), closed=True)
            hit = hit.where(F.col("epoch") == F.rint((F.col("t") - F.col("t0")) / F.col("period")))
            hit = hit.withColumn("_off", F.abs(fold(F.col("t"), F.col("period"), F.col("t0")))).where("_off <= duration")
            for earlier in phases[:i]:
                t0 = F.col("t0") + (earlier - phase) * F.col("period")
                hit = hit.where(F.abs(fold(F.col("t"), F.col("period"), t0)) > F.col("duration"))
            hit = hit.withColumns({"_phase": F.lit(i), "_cycle": F.struct(F.lit(i), "epoch")})
            hits = hit if hits is None else hits.unionByName(hit)
        return hits.drop("time", "half", "dt")

    def islands(self, out: DataFrame, ids: Sequence[str]) -> DataFrame:
        """``ids``, ``a``, ``b``: stretches of consecutive left-out rows. ``out`` has ``seq`` and ``_cycle``.

        The rows of one cycle are consecutive; cycles that touch or overlap become one stretch.
        """
        spans = out.groupBy(*ids, "_cycle").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
        order = Window.partitionBy(*ids).orderBy("a", "b")
        reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
        spans = spans.withColumn("_new", F.coalesce(F.col("a") > reach + 1, F.lit(True)).cast("int"))
        spans = spans.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return spans.groupBy(*ids, "_run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_run")

    def scatter(self, cands: DataFrame, ids: Sequence[str], out: DataFrame) -> DataFrame:
        """``ids``, ``sigma``: robust scatter of the rows that are left."""
        gone = materialize(self.fluxes.taken(out, ids), "left-out")
        who = cands.select(*dict.fromkeys([*ids, "tic_id"]))
        centre = self.fluxes.median(who, ids, gone, "_med").drop("_n")
        centre = materialize(who.join(centre, list(ids)), "centres")
        spread = self.fluxes.deviation(centre, ids, gone, "_med", "_mad")
        return spread.select(*ids, (MAD_SCALE * F.col("_mad")).alias("sigma"))

    def binned_scatter(
        self, cands: DataFrame, ids: Sequence[str], out: DataFrame, islands: DataFrame, name: str, min_fraction: float = 0.5
    ) -> DataFrame:
        """``ids`` and the robust scatter of means over one duration, of what is left.

        Bins start at the first row left; those with under half of the rows expected from the
        median step don't count, and fewer than three bins give no row.
        """
        out = out.select(*ids, "seq", "t", "_y", "dt_us", "dt_us_bucket")
        who = cands.select(*dict.fromkeys([*ids, "tic_id", "duration"])).join(self.info, "tic_id")
        marks = self.rows.select("tic_id", "seq", F.col("t").alias("_t"), F.col("t_us").alias("_us"))
        # the first row left, and the steps that open where a stretch is left out
        ends = islands.join(who.select(*dict.fromkeys([*ids, "tic_id", "n_rows"])), list(ids))
        left = marks.select("tic_id", (F.col("seq") + 1).alias("a"), F.col("_us").alias("_us0"))
        right = self.rows.select("tic_id", (F.col("seq") - 1).alias("b"), F.col("t_us").alias("_us1"), "dt_us", "dt_us_bucket")
        ends = materialize(ends.join(left, ["tic_id", "a"], "left").join(right, ["tic_id", "b"], "left"), "ends")
        opened = ends.where("_us0 IS NOT NULL AND _us1 IS NOT NULL").select(
            *dict.fromkeys([*ids, "tic_id"]), (F.col("_us1") - F.col("_us0")).alias("dt_us")
        )
        gone = self.steps.taken(out, ids).unionByName(
            self.steps.taken(ends.where("_us1 IS NOT NULL").select(*ids, "dt_us", "dt_us_bucket"), ids)
        ).unionByName(self.steps.taken(self.steps.placed(opened), ids, 1))
        gone = materialize(gone.groupBy(*ids, "bucket", "v").agg(F.sum("c").alias("c")), "left-out-steps")
        spacing = self.steps.median(who.select(*dict.fromkeys([*ids, "tic_id"])), ids, gone, "_step")
        spacing = spacing.select(*ids, (F.col("_step") / 86_400_000_000.0).alias("_spacing"))
        opening = ends.where("a = 0").select(*ids, (F.col("_us1").isNull()).alias("_none"), (F.col("b") + 1).alias("_first"))
        who = who.join(opening, list(ids), "left").where("coalesce(_none, false) = false").withColumn(
            "seq", F.coalesce("_first", F.lit(0)).cast("long")
        )
        who = who.join(marks.select("tic_id", "seq", F.col("_t").alias("_x0")), ["tic_id", "seq"]).drop("seq", "_first", "_none")
        who = materialize(who, "bin-starts")
        # bin edges as places in the curve: the first row at or after the edge
        d = F.col("duration")
        many = F.floor((F.col("t_max") - F.col("_x0")) / d).cast("long") + 1
        edges = who.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), many)))
        at = F.floor((F.col("_x0") + F.col("j") * d - F.col("t_min")) / F.col("width")).cast("long")
        end = F.floor((F.col("t_max") - F.col("t_min")) / F.col("width")).cast("long") + 1
        edges = edges.withColumn("cell", F.least(F.greatest(at, F.lit(0)), end)).join(self.cells, ["tic_id", "cell"])
        early = F.size(F.filter("ts", lambda t: F.floor((t - F.col("_x0")) / d) < F.col("j")))
        edges = edges.select(*dict.fromkeys([*ids, "tic_id"]), "j", "n_rows", "_total",
                             F.when(F.col("j") == 0, F.lit(0)).otherwise(F.col("before") + early).cast("long").alias("seq"))
        sums = edges.join(self.rows.select("tic_id", "seq", F.col("_upto__y").alias("_s")), ["tic_id", "seq"], "left")
        sums = sums.withColumn("_s", F.coalesce("_s", "_total"))
        order = Window.partitionBy(*ids).orderBy("j")
        bins = sums.select(
            *dict.fromkeys([*ids, "tic_id"]), "j",
            (F.lead("seq").over(order) - F.col("seq")).alias("_n"), (F.lead("_s").over(order) - F.col("_s")).alias("_s"),
        ).where("_n > 0")
        own = out.join(who.select(*ids, "_x0", "duration"), list(ids)).where("t >= _x0").groupBy(
            *ids, F.floor((F.col("t") - F.col("_x0")) / d).cast("long").alias("j")
        ).agg(F.count(F.lit(1)).alias("_gn"), F.sum("_y").alias("_gs"))
        # rows before the first one left were all left out
        head = out.join(who.select(*ids, "_x0"), list(ids)).where("t < _x0").groupBy(*ids).agg(
            F.count(F.lit(1)).alias("_hn"), F.sum("_y").alias("_hs")
        )
        bins = bins.join(own, [*ids, "j"], "left").join(head, list(ids), "left")
        start = F.when(F.col("j") == 0, F.coalesce("_hn", F.lit(0))).otherwise(0)
        lead = F.when(F.col("j") == 0, F.coalesce("_hs", F.lit(0.0))).otherwise(0.0)
        count = F.col("_n") - F.coalesce("_gn", F.lit(0)) - start
        bins = bins.withColumns({"_c": count, "_m": (F.col("_s") - F.coalesce("_gs", F.lit(0.0)) - lead) / count}).where("_c > 0")
        kept = bins.join(spacing, list(ids)).join(cands.select(*ids, "duration"), list(ids)).where(
            F.col("_c") >= min_fraction * F.greatest(F.col("duration") / F.col("_spacing"), F.lit(1.0))
        )
        return robust_std(kept, list(ids), F.col("_m"), name, bounded=True).where("n >= 3").select(*ids, name)
