"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source gets a token target; documents get the rates closest to 1 (least relative entropy)
that meet it: ``min(max_copies, exp(lambda * size / mean size))``, one lambda per source. Lambda
solves the convex dual by Newton steps on the log of the tokens taken, bracketed so that the limit
on copies can't throw a step off. Steps run on the histogram of (source, size), which is exact, as
a rate depends on nothing else. Rates become whole copies by systematic rounding in order of size:
the error of a source stays within about one document.

A hot source or a hot size is never one group: ranks are taken inside (source, size, salt), and
places before them come from sums over aggregated rows.

Defined cases. Null text: size 0. Null source: a source of its own, last in order. Documents
without words count for no target and stay once. Repeated rows and null ids are documents like any
other. Empty table: empty result. Columns of the input stay as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipscan.llm.common import WORD, boxed
from dipscan.operators.catalog import global_rank
from dipscan.session import materialize


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)  # by place of the source in code-point order, repeating
    max_copies: int = 3
    share: float = 1.0  # of all tokens
    salts: int = 1024  # parts of one (source, size)
    tolerance: float = 1e-10  # of a source's log tokens
    steps_per_job: int = 3
    phases: int = 32  # of the rounding; the best is taken


def targets(hist: DataFrame, cfg: Mix = Mix()) -> DataFrame:
    """_key, _size, _docs, _target of every source; ``hist`` has _key, size, n.

    Filling to the limits and resharing the rest by weight ends at one level: the tokens of a
    unit of weight. The level rises until the set of sources at their limit no longer grows.
    """
    sources = hist.groupBy("_key").agg(
        F.sum(F.col("size") * F.col("n")).alias("_size"),
        F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("_docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("_least"),
    )
    ranked = global_rank(sources, F.col("_key").isNull().asc(), F.col("_key").asc(), name="_place")
    weights = F.array(*[F.lit(float(w)) for w in cfg.weights])
    ranked = materialize(
        ranked.withColumn("_w", F.element_at(weights, ((F.col("_place") - 1) % len(cfg.weights) + 1).cast("int")))
        .withColumn("_limit", F.col("_size") * float(cfg.max_copies)),
        "sources",
    )
    level, last = 0.0, None
    while level != last:
        full = F.col("_limit") < F.col("_w") * level
        row = ranked.agg(
            F.sum("_size"), F.sum(F.when(full, F.col("_limit")).otherwise(0.0)), F.sum(F.when(~full, F.col("_w")))
        ).first()
        last = level
        if not row[2]:
            break
        level = max(level, (cfg.share * (row[0] or 0) - row[1]) / row[2])
    return ranked.select(
        "_key", "_size", "_docs", "_least", F.least(F.col("_w") * level, F.col("_limit")).alias("_target")
    )


def _step(hist: DataFrame, state: DataFrame, cfg: Mix) -> DataFrame:
    """One Newton step of every source."""
    top = F.log(F.lit(float(cfg.max_copies)))
    x = F.col("size") * F.col("_docs") / F.col("_size")
    power = F.col("_lambda") * x
    tokens = F.col("n") * F.col("size") * F.exp(F.least(power, top))
    keep = [c for c in state.columns if c != "_key"]
    sums = (
        hist.where("size > 0").join(state, hist["_key"].eqNullSafe(state["_key"])).drop(hist["_key"])
        .groupBy("_key", *keep)
        .agg(F.sum(tokens).alias("_f"), F.sum(F.when(power < top, tokens * x).otherwise(0.0)).alias("_g"))
    )
    gap = F.log("_f") - F.log("_target")
    low = F.when(gap <= 0, F.col("_lambda")).otherwise(F.col("_low"))
    high = F.when(gap >= 0, F.col("_lambda")).otherwise(F.col("_high"))
    sums = sums.withColumns({"_gap": gap, "_low": low, "_high": high})
    newton = F.col("_lambda") - F.col("_gap") * F.col("_f") / F.when(F.col("_g") > 0, F.col("_g"))
    inside = (newton >= F.col("_low")) & (newton <= F.col("_high"))
    middle = (F.col("_low") + F.col("_high")) / 2
    following = F.when(F.abs("_gap") <= cfg.tolerance, F.col("_lambda")).otherwise(
        F.when(F.coalesce(inside, F.lit(False)), newton).otherwise(F.coalesce(middle, newton))
    )
    return sums.withColumn("_lambda", following).select(*state.columns)


def balanced(hist: DataFrame, sources: DataFrame, cfg: Mix = Mix()) -> DataFrame:
    """``sources`` with _lambda; null where all documents are taken ``max_copies`` times."""
    top = F.log(F.lit(float(cfg.max_copies)))
    full = F.col("_target") >= F.col("_size") * float(cfg.max_copies)
    state = sources.where((F.col("_size") > 0) & ~full & (F.col("_target") > 0))
    over = F.col("_target") > F.col("_size")
    state = state.withColumns({
        "_lambda": F.lit(0.0),
        # where tokens must shrink, the log of a sum of exponentials is convex: steps can't overshoot
        "_low": F.when(over, F.lit(0.0)).otherwise(F.lit(float("-inf"))),
        "_high": F.when(over, top * F.col("_size") / (F.col("_docs") * F.col("_least"))).otherwise(F.lit(0.0)),
        "_gap": F.lit(1.0),
    })
    state = materialize(state, "newton")
    while True:
        for _ in range(cfg.steps_per_job):
            state = _step(hist, state, cfg)
        state = materialize(state, "newton")
        worst = state.agg(F.max(F.when(F.col("_low") < F.col("_high"), F.abs("_gap")))).first()[0]
        if worst is None or worst <= cfg.tolerance:
            break
    found = state.select("_key", "_lambda")
    return (
        sources.join(found, sources["_key"].eqNullSafe(found["_key"]), "left").drop(found["_key"])
    )


def with_copies(docs: DataFrame, cfg: Mix = Mix()) -> DataFrame:
    """``_doc`` (a row of ``docs``) and ``_mix`` (size, source_size, target, rate, copies)."""
    text = F.col("_doc.text")
    sized = boxed(docs).withColumn(
        "_mix", F.struct(
            F.col("_doc.source").cast("string").alias("_key"),
            F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long").alias("size"),
            F.pmod(F.xxhash64("_doc.doc_id", "_doc.source"), F.lit(cfg.salts)).cast("int").alias("_salt"),
        )
    )
    parts = materialize(
        sized.select("_mix.*").groupBy("_key", "size", "_salt").agg(F.count(F.lit(1)).alias("n")), "sizes"
    )
    hist = materialize(parts.groupBy("_key", "size").agg(F.sum("n").alias("n")), "histogram")
    sources = balanced(hist, targets(hist, cfg), cfg)
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("_target") <= 0, 0.0).otherwise(
        F.when(F.col("_lambda").isNull(), float(cfg.max_copies)).otherwise(
            F.exp(F.least(F.col("_lambda") * F.col("size") * F.col("_docs") / F.col("_size"),
                          F.log(F.lit(float(cfg.max_copies)))))
        )
    )
    rated = (
        hist.join(sources, hist["_key"].eqNullSafe(sources["_key"])).drop(sources["_key"])
        .select("_key", "size", "n", rate.alias("rate"), "_size", "_target")
    )
    before = Window.partitionBy("_key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = materialize(
        rated.withColumn("_start", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(before), F.lit(0.0))), "rates"
    )
    # the rounding's phase that comes nearest to the source's target
    choices = []
    for i in range(cfg.phases):
        shift = F.col("_start") + i / cfg.phases
        got = F.sum(F.col("size") * (F.floor(shift + F.col("n") * F.col("rate")) - F.floor(shift)))
        choices.append(F.struct(F.abs(got - F.first("_target")).alias("miss"), F.lit(i / cfg.phases).alias("shift")))
    phase = rated.groupBy("_key").agg(F.array_min(F.array(*choices))["shift"].alias("_phase"))
    rated = rated.join(phase, rated["_key"].eqNullSafe(phase["_key"])).drop(phase["_key"]).withColumn(
        "_start", F.col("_start") + F.col("_phase")
    )
    inner = Window.partitionBy("_key", "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = parts.withColumn("_ahead", F.coalesce(F.sum("n").over(inner), F.lit(0))).drop("n")
    same = cells["_key"].eqNullSafe(rated["_key"]) & (cells["size"] == rated["size"])
    cells = (
        cells.join(rated, same).drop(rated["_key"], rated["size"]).select(
            F.col("_key").alias("_ck"), F.col("size").alias("_cs"), F.col("_salt").alias("_cz"),
            "_ahead", "_start", F.col("rate").alias("_rate"), "_size", "_target",
        )
    )
    m = F.col("_mix")
    rows = sized.join(
        cells,
        m["_key"].eqNullSafe(F.col("_ck")) & (m["size"] == F.col("_cs")) & (m["_salt"] == F.col("_cz")),
    )
    order = Window.partitionBy("_ck", "_cs", "_cz").orderBy(
        F.xxhash64("_doc.doc_id", F.lit(1)), "_doc.doc_id"
    )
    place = F.col("_ahead") + F.row_number().over(order)
    rows = rows.withColumn("_place", place)
    taken = F.floor(F.col("_start") + F.col("_rate") * F.col("_place")) - F.floor(
        F.col("_start") + F.col("_rate") * (F.col("_place") - 1)
    )
    # sums of floats may fall beside a whole number: a rate of 3 is 3 copies
    copies = F.least(F.greatest(taken, F.floor("_rate")), F.ceil("_rate"))
    return rows.withColumn(
        "_mix", F.struct(
            m["size"].alias("size"), F.col("_size").alias("source_size"), F.col("_target").alias("target"),
            F.col("_rate").alias("rate"), copies.cast("int").alias("copies"),
        )
    ).select("_doc", "_mix")


def mixture(docs: DataFrame, cfg: Mix = Mix()) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the number of the copy."""
    rows = with_copies(docs, cfg).where("_mix.copies > 0")
    number = "copy" if "copy" not in docs.columns else "_copy"
    return rows.select("_doc.*", F.explode(F.sequence(F.lit(1), F.col("_mix.copies"))).alias(number))


def plan(docs: DataFrame, cfg: Mix = Mix()) -> DataFrame:
    """What the mix takes of every document."""
    narrow = docs.select("doc_id", "source", "text")
    rows = with_copies(narrow, cfg)
    return rows.select(
        "_doc.doc_id", "_doc.source", "_mix.size", "_mix.source_size", "_mix.target", "_mix.rate", "_mix.copies",
        (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"),
    )
