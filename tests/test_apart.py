"""Suppression by rounds against the one-by-one rule; the order in which peaks are examined."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dipscan.operators import search as H
from dipscan.operators import sequence as S


def one_by_one(at, reach, score):
    """Places that stay: in order of score, ties by the smaller place on the axis."""
    kept = []
    for i in sorted(range(len(at)), key=lambda i: (-score[i], at[i])):
        if all(abs(at[i] - at[k]) >= max(reach[i], reach[k]) for k in kept):
            kept.append(i)
    return sorted(float(at[i]) for i in kept)


def chains(kind, n, rng):
    at = np.sort(rng.uniform(0, n / 3, n))
    reach = rng.uniform(0.2, 1.5, n) if kind != "equal" else np.full(n, 0.9)
    score = {
        "random": rng.uniform(size=n), "falling": np.linspace(9, 1, n), "rising": np.linspace(1, 9, n),
        "equal": np.ones(n), "few": rng.integers(0, 5, n).astype(float),
    }[kind]
    return at, reach, score


@pytest.mark.parametrize("settle", [None, 64])
def test_every_chain_ends_as_one_by_one(spark, monkeypatch, settle):
    """Falling scores make each row hang on the one before it, through all blocks of a run."""
    rng = np.random.default_rng(8)
    if settle:
        monkeypatch.setattr(S, "SETTLE_ROWS", settle)
    n = 600 if settle else 9000
    sets = {kind: chains(kind, n if kind != "equal" else 300, rng) for kind in ("random", "falling", "rising", "equal", "few")}
    pdf = pd.concat([pd.DataFrame({"k": kind, "at": a, "r": r, "s": s}) for kind, (a, r, s) in sets.items()])
    got = S.suppress(spark.createDataFrame(pdf), ["k"], "at", F.col("r"), "s").toPandas()
    for kind, (a, r, s) in sets.items():
        assert sorted(got[got.k == kind]["at"].tolist()) == one_by_one(a, r, s), kind


def test_one_row_and_none(spark):
    kind = "k long, at double, r double, s double"
    assert S.suppress(spark.createDataFrame([(1, 2.0, 0.5, 1.0)], kind), ["k"], "at", F.col("r"), "s").count() == 1
    assert S.suppress(spark.createDataFrame([], kind), ["k"], "at", F.col("r"), "s").count() == 0
    same = [(1, 2.0, 0.5, float(i % 3)) for i in range(50)]
    assert [r.s for r in S.suppress(spark.createDataFrame(same, kind), ["k"], "at", F.col("r"), "s").collect()] == [2.0]


def spectrum(spark, rows):
    kind = "tic_id long, period double, t0 double, duration double, depth double, power double, sde double, eligible boolean"
    return spark.createDataFrame([(1, p, 0.1, 0.2, 0.01, w, s, ok) for p, w, s, ok in rows], kind)


def test_peaks_stand_once_per_family(spark):
    periods = np.sort(np.concatenate([np.linspace(1, 12, 2000), [3.0, 6.0]]))
    rows = {float(p): (1.0, 0.0) for p in periods}
    rows[3.0], rows[6.0] = (10.0, 9.0), (20.0, 8.0)
    got = H.examine_peaks(spectrum(spark, [(p, w, s, True) for p, (w, s) in rows.items()])).orderBy("rank").collect()
    assert (got[0].top_period, got[0].period) == (3.0, 6.0)  # the family's best member has clearly more power
    assert 6.0 not in [r.period for r in got[1:]]
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and len(got) > 100  # no limit on peaks
    p = np.array(sorted(rows))
    for r in got[:40]:
        i = int(np.searchsorted(p, r.period))
        gaps = np.abs(np.diff(np.log(p[max(i - 1, 0): i + 2])))
        assert r.grid_step == pytest.approx(np.median(gaps), rel=1e-9)


def test_separated_peaks_are_those_of_the_one_by_one_rule(spark):
    rng = np.random.default_rng(4)
    period = np.sort(np.exp(rng.uniform(0, 2, 3000)))
    score = rng.integers(0, 60, period.size).astype(float)
    kept: list[int] = []
    for i in sorted(range(period.size), key=lambda i: (-score[i], -i)):
        if all(abs(period[i] - period[k]) >= 0.01 * period[k] for k in kept):
            kept.append(i)
    rows = [(float(p), 1.0, float(s), True) for p, s in zip(period, score)] + [(2.0, 1.0, 99.0, False)]
    got = H.examine_peaks(spectrum(spark, rows)).collect()
    assert sorted(r.top_period for r in got) == sorted(float(period[i]) for i in kept)


def test_equal_families_keep_the_longest_top(spark):
    """Two tops of equal score that share their best member: the longer top stays, in whatever order rows come."""
    rows = []
    for tic in range(60):
        two = [(tic, 3.2, 10.0, 5.0, True), (tic, 9.6, 10.0, 5.0, True)]
        rows += (two if tic % 2 else two[::-1]) + [(tic, 9.6, 20.0, 5.0, False)]
    pdf = pd.DataFrame(rows, columns=["tic_id", "period", "power", "sde", "eligible"]).assign(t0=1.0, duration=0.1, depth=0.01)
    out = H.examine_peaks(spark.createDataFrame(pdf)).toPandas()
    assert sorted(out["tic_id"]) == list(range(60))
    assert set(zip(out["top_period"], out["period"], strict=True)) == {(9.6, 9.6)}


def test_blocks_across_batches():
    """Blocks are cut whole from batches of any size, and settled as each one alone."""
    rng = np.random.default_rng(11)
    n = 400
    at = rng.integers(0, 60, n) / 2.0
    pdf = pd.DataFrame({
        "k": np.sort(rng.integers(0, 40, n)), "_number": 0, "_id": np.arange(n), "_x": at, "_at": at,
        "_own": rng.uniform(0.2, 2.0, n), "_give": 0.3, "_s": rng.integers(0, 30, n).astype(float), "_tie": at,
        "_then": 0.0, "_wide": 2.0, "_kept": False, "_low": -np.inf, "_high": np.inf,
    })
    alone = {i: s for _, x in pdf.groupby("k") for i, s in zip(x["_id"], S._settle(x.reset_index(drop=True)), strict=True)}
    assert set(alone.values()) == {-1, 1}
    for size in (1, 3, 7, 50, n):
        got, blocks = {}, 0
        for frame, starts in S._whole_blocks((pdf.iloc[i: i + size] for i in range(0, n, size)), ["k", "_number"]):
            got |= dict(zip(frame["_id"], S._settle(frame, starts), strict=True))
            blocks += len(starts)
        assert got == alone and blocks == pdf["k"].nunique()


def test_a_short_key_settles_at_once(spark, monkeypatch):
    """Nothing lies beyond a key's first and last row, so no second round is needed there."""
    rounds = []
    write = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, label: rounds.append(label) or write(df, label))
    rows = spark.createDataFrame([(k, float(i), 0.5, float(i)) for k in range(3) for i in range(5)], "k int, at double, r double, s double")
    assert S.suppress(rows, ["k"], "at", F.col("r"), "s").count() == 15
    assert rounds == ["apart", "apart-0"]
