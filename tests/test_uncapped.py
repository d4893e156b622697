"""The registered searches end by themselves, not at a number of signals."""

import pytest
from pyspark.sql import functions as F

from dipscan.plans import search_run, searches, studies


@pytest.mark.parametrize("config", [searches.RUN, studies.RUN])
def test_a_search_goes_on_until_nothing_is_significant(spark, monkeypatch, config):
    rows = [(tic, 1, int(i * 8.64e8), i / 100, 1.0, 1e-3) for tic in (1, 2) for i in range(400)]
    flat = spark.createDataFrame(rows, "tic_id long, sector int, t_us long, t double, flux double, flux_err double")

    def found(current, _baselines, _config, iteration, _previous):
        """Target 1 has five dips in turn, target 2 has one; then nothing counts."""
        last = F.when(F.col("tic_id") == 1, 5).otherwise(1)
        signals = current.groupBy("tic_id").agg(F.count(F.lit(1)).alias("n")).selectExpr(
            "tic_id", f"{iteration} AS iteration", f"{iteration} * 0.5D AS t0", "3.9D AS period", "0.1D AS duration",
        ).withColumn("significant", F.lit(iteration) <= last)
        return search_run.Pass(signals, signals, current.selectExpr("tic_id", "t AS time", "0.1D AS duration", "0.1D AS depth", "1.0D AS snr").limit(0))

    monkeypatch.setattr(search_run, "find_signals", found)
    out = search_run.iterative_search(flat, config).signals.where("significant").groupBy("tic_id").count().collect()
    assert {r.tic_id: r["count"] for r in out} == {1: 5, 2: 1}
